"""Weighted evaluation of scored rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.ordered import running_sums

c = F.col


def brier(df: DataFrame, p: str = "probability", y: str = "label", w: str = "weight") -> DataFrame:
    return df.agg((F.sum(c(w) * (c(p) - c(y)) ** 2) / F.sum(w)).alias("brier"))


def improvement_pct(before: DataFrame, after: DataFrame) -> DataFrame:
    both = before.select(c("brier").alias("b")).crossJoin(after.select(c("brier").alias("a")))  # one row each
    return both.select((100 * (c("b") - c("a")) / c("b")).alias("improvement_pct"))


def calibration_curve(df: DataFrame, bins: int = 20, p: str = "probability", y: str = "label") -> DataFrame:
    """Observed share and mean score of the right-closed, equal-width bins that hold rows."""
    at = F.greatest(F.ceil(c(p) * bins) - 1, F.lit(0)).cast("int")
    return df.groupBy(at.alias("bin")).agg(F.avg(y).alias("observed"), F.avg(p).alias("predicted"), F.count("*").alias("n"))


def classification_report(df: DataFrame, bound: float = 0.5, p: str = "probability", y: str = "label", w: str = "weight") -> DataFrame:
    """Unweighted confusion counts and weighted accuracy, precision, recall and F1."""
    hit = c(p) > bound
    part = {"tp": hit & (c(y) == 1), "fp": hit & (c(y) == 0), "fn": ~hit & (c(y) == 1), "tn": ~hit & (c(y) == 0)}
    one = df.agg(*[F.count_if(x).alias(k) for k, x in part.items()], *[F.coalesce(F.sum(F.when(x, c(w))), F.lit(0.0)).alias(f"w_{k}") for k, x in part.items()])
    ratio = lambda a, b: a / F.nullif(b, F.lit(0.0))
    tp, fp, fn, tn = (c(f"w_{k}") for k in part)
    out = one.select(*part, ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"))
    return out.withColumn("f1", ratio(2 * c("precision") * c("recall"), c("precision") + c("recall")))


def roc_curve(df: DataFrame, p: str = "probability", y: str = "label") -> DataFrame:
    """Rates of true and false positives at each distinct score, from the highest down.

    Rows are counted by score, and the counts run up over ranges of scores: no task holds all of them.
    """
    return _curve(df, p, y).select("threshold", (c("tp") / c("_p")).alias("tpr"), (c("fp") / c("_n")).alias("fpr"))


def _curve(df: DataFrame, p: str, y: str) -> DataFrame:
    steps = df.groupBy(c(p).alias("threshold")).agg(F.sum(c(y)).alias("pos"), F.sum(1 - c(y)).alias("neg"))
    added = running_sums(steps, "threshold", {"pos": "tp", "neg": "fp"}, descending=True)
    return added.crossJoin(F.broadcast(added.agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))))  # one row


def roc_auc(df: DataFrame, p: str = "probability", y: str = "label") -> DataFrame:
    """The area under the curve, by trapezoids; a step's start is its end less its own counts."""
    area = c("neg") / c("_n") * (2 * c("tp") - c("pos")) / c("_p") / 2
    return _curve(df, p, y).agg(F.sum(area).alias("auc"))


def class_curves(df: DataFrame, scores: dict[int, str], y: str = "label") -> DataFrame:
    """``(class, threshold, pos, neg, tp, fp, tpr, fpr)`` at each distinct score of each class, from the
    highest down: a class against all others by its own score column in ``scores``.

    All classes are counted in one pass and their counts run up over ranges of class and score. Rates of a
    class that has no rows, or all of them, are null.
    """
    each = F.inline(F.array(*[F.struct(F.lit(k).alias("class"), c(s).cast("double").alias("threshold"), (c(y) == k).cast("int").alias("hit")) for k, s in scores.items()]))
    steps = df.select(each).groupBy("class", "threshold").agg(F.sum("hit").alias("pos"), F.sum(1 - c("hit")).alias("neg"))
    added = running_sums(steps, "threshold", {"pos": "tp", "neg": "fp"}, descending=True, within="class")
    totals = added.groupBy("class").agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))  # a row for each class
    both = added.join(F.broadcast(totals), "class")
    rates = {"tpr": c("tp") / F.nullif("_p", F.lit(0)), "fpr": c("fp") / F.nullif("_n", F.lit(0))}
    return both.withColumns(rates).withColumn("_step", c("neg") / F.nullif("_n", F.lit(0)) * (2 * c("tp") - c("pos")) / F.nullif("_p", F.lit(0)) / 2)


def roc_by_class(df: DataFrame, scores: dict[int, str], y: str = "label") -> DataFrame:
    """``(class, threshold, tpr, fpr)``: a curve for each class."""
    return class_curves(df, scores, y).select("class", "threshold", "tpr", "fpr")


def auc_by_class(df: DataFrame, scores: dict[int, str], y: str = "label") -> DataFrame:
    """``(class, auc)``: the area for each class, and that of class null, the mean over classes (macro)."""
    own = class_curves(df, scores, y).groupBy("class").agg(F.sum("_step").alias("auc"))
    return own.unionByName(own.agg(F.lit(None).cast("int").alias("class"), F.avg("auc").alias("auc")))


def rank_auc(df: DataFrame, p: str = "probability", y: str = "label") -> DataFrame:
    """Mann-Whitney area with average ranks for ties."""
    steps = df.groupBy(c(p).alias("s")).agg(F.sum(y).alias("pos"), F.count("*").alias("n"))
    steps = running_sums(steps, "s", {"n": "to"})
    ranked = steps.withColumn("rank", c("to") - c("n") + (c("n") + 1) / 2).agg(F.sum(c("pos") * c("rank")).alias("r"), F.sum("pos").alias("p"), F.sum("n").alias("n"))
    return ranked.select(((c("r") - c("p") * (c("p") + 1) / 2) / (c("p") * (c("n") - c("p")))).alias("auc"))


def vote_variance(votes: DataFrame, key: str = "point_id", vote: str = "vote") -> DataFrame:
    """Population variance over trees of their hard votes."""
    return votes.groupBy(key).agg(F.var_pop(vote).alias("vote_variance"))
