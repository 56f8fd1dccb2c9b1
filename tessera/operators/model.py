"""Positive-unlabelled learning, forests, calibration and explanation on Spark ML."""

from __future__ import annotations

import math
import random

from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.physics import entropy_bits, uncertainty
from tessera.operators.evaluate import classification_report
from tessera.operators.prepare import hashed, stratified_folds
from tessera.operators.statistics import minmax_normalise
from tessera.plans.ordered import quantiles
from tessera.plans.tables import materialise

c = F.col


def with_vector(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep").transform(df)


def fit_forest(df: DataFrame, features: list[str], trees: int = 50, depth: int = 8, seed: int = 42) -> RandomForestClassificationModel:
    """A weighted forest; it also tells the leaf of each tree."""
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, weightCol="weight", leafCol="leaf")
    return forest.fit(with_vector(df, features).select("features", "label", "weight"))


def probability(df: DataFrame, model, features: list[str], out: str = "probability") -> DataFrame:
    scored = model.transform(with_vector(df, features))
    return scored.withColumn("_p", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction").withColumnRenamed("_p", out)


def vote_table(model: RandomForestClassificationModel, spark) -> DataFrame:
    """``(tree, leaf, vote)``: the class that each leaf votes for. Leaves are few: 2 ** depth a tree."""
    rows = []
    for k, tree in enumerate(model.trees):
        leaves, stack = [], [tree._call_java("rootNode")]
        while stack:
            node = stack.pop()
            if node.getClass().getSimpleName() == "LeafNode":
                leaves.append(float(node.prediction()))
            else:
                stack += [node.rightChild(), node.leftChild()]
        rows += [(k, float(i), int(v)) for i, v in enumerate(leaves)]
    return spark.createDataFrame(rows, "tree int, leaf double, vote int")


def forest_votes(df: DataFrame, model, features: list[str], key: str = "point_id") -> DataFrame:
    scored = model.transform(with_vector(df, features)).select(key, F.posexplode(vector_to_array("leaf")).alias("tree", "leaf"))
    return scored.join(F.broadcast(vote_table(model, df.sparkSession)), ["tree", "leaf"]).select(key, "tree", "vote")


def calibrate_isotonic(df: DataFrame, p: str = "probability"):
    """An isotonic map of scores to labels, weighted.

    Rows of equal scores are one with their mean label, as in the fit itself, which holds all rows of a range
    of scores in one task: a forest gives few scores to any number of rows.
    """
    rows = df.where(c(p).isNotNull() & ~F.isnan(p) & (c("weight") > 0)).groupBy(p)
    rows = rows.agg((F.sum(c("label") * c("weight")) / F.sum("weight")).alias("label"), F.sum("weight").cast("double").alias("weight"))
    return IsotonicRegression(featuresCol=p, labelCol="label", weightCol="weight", predictionCol="calibrated").fit(rows)


def score_points(df: DataFrame, model, isotonic, features: list[str], key: str = "point_id") -> DataFrame:
    """Calibrated probability, its entropy, the variance of votes, their uncertainty and the adjusted score."""
    p = isotonic.transform(probability(df, model, features)).select(key, c("calibrated").alias("probability"))
    variance = forest_votes(df, model, features, key).groupBy(key).agg(F.var_pop("vote").alias("vote_variance"))
    both = p.join(variance, key).withColumn("entropy", entropy_bits(c("probability")))
    both = minmax_normalise(minmax_normalise(both, "entropy", "entropy_norm"), "vote_variance", "vote_variance_norm")
    both = both.withColumn("uncertainty", uncertainty(c("entropy_norm"), c("vote_variance_norm")))
    return both.withColumn("adjusted", c("probability") * (1 - c("uncertainty")))


def pu_bagging(df: DataFrame, features: list[str], bags: int = 10, share: float = 0.5, depth: int = 6, seed: int = 42, key: str = "point_id") -> DataFrame:
    """Mean vote of one tree a bag, each of all positives and a hashed share of the unlabelled rows."""
    rows, votes = with_vector(df, features).select(key, "features", "label"), F.lit(0.0)
    for b in range(bags):
        chosen = rows.where((c("label") == 1) | (F.pmod(hashed(key, seed + b), F.lit(1000)) < int(1000 * share)))
        tree = DecisionTreeClassifier(maxDepth=depth, seed=seed, predictionCol=f"_v{b}", rawPredictionCol=f"_w{b}", probabilityCol=f"_q{b}").fit(chosen)
        rows = tree.transform(rows).drop(f"_w{b}", f"_q{b}")
        votes = votes + c(f"_v{b}")
    return rows.select(key, "label", (votes / bags).alias("probability"))


def tune(df: DataFrame, features: list[str], settings: int = 50, folds: int = 5, metric: str = "f1", seed: int = 42, rungs: int = 3, keep: int = 3, trees: tuple[int, int] = (10, 50), depth: tuple[int, int] = (3, 10), key: str = "point_id"):
    """Cross-validated choice among sampled settings of a forest: F1, or area under the ROC curve.

    Successive halving: the first rung grows a part of each setting's trees, the best one in ``keep`` goes
    on to the next rung with ``keep`` times as many, the last rung grows all. Every rung uses all rows, in
    the same stratified folds of one written table. ``rungs=1`` is the full search.

    Returns the last rung's model and all scores, ``(rung, setting, trees, depth, score, kept)``, best first;
    ties go to the setting drawn first.
    """
    forest, rnd = RandomForestClassifier(seed=seed, weightCol="weight"), random.Random(seed)
    left = [(k, rnd.randrange(*trees), rnd.randrange(*depth)) for k in range(settings)]
    judge = MulticlassClassificationEvaluator(metricName="f1") if metric == "f1" else BinaryClassificationEvaluator()
    rows = with_vector(materialise(stratified_folds(df, folds, 1, seed, key), "folds"), features).select("features", "label", "weight", "fold")
    scores, fitted = [], None
    for rung in range(rungs):
        grown = [max(1, math.ceil(n / keep ** (rungs - 1 - rung))) for _, n, _ in left]
        maps = [{forest.numTrees: n, forest.maxDepth: d} for n, (_, _, d) in zip(grown, left)]
        fitted = CrossValidator(estimator=forest, estimatorParamMaps=maps, evaluator=judge, numFolds=folds, foldCol="fold", parallelism=4, seed=seed).fit(rows)
        order = sorted(range(len(left)), key=lambda i: (-fitted.avgMetrics[i], left[i][0]))
        on = 1 if rung == rungs - 1 else math.ceil(len(left) / keep)
        scores += [(rung, left[i][0], grown[i], left[i][2], float(fitted.avgMetrics[i]), at < on) for at, i in enumerate(order)]
        left = [left[i] for i in sorted(order[:on])]
    return fitted, df.sparkSession.createDataFrame(scores, "rung int, setting int, trees int, depth int, score double, kept boolean")


def gini_importance(df: DataFrame, features: list[str], folds: int = 5, repeats: int = 1, trees: int = 10) -> DataFrame:
    """``(repeat, fold, tree, feature, importance)`` of forests fitted without each fold."""
    rows = []
    for r in range(repeats):
        parts = materialise(stratified_folds(df, folds, 1, 42 + r), "folds")
        for k in range(folds):
            for i, tree in enumerate(fit_forest(parts.where(c("fold") != k), features, trees, 5).trees):
                rows += [(r, k, i, f, float(x)) for f, x in zip(features, tree.featureImportances.toArray())]
    return df.sparkSession.createDataFrame(rows, "repeat int, fold int, tree int, feature string, importance double")


def permutation_importance(df: DataFrame, model, features: list[str], repeats: int = 3, key: str = "point_id") -> DataFrame:
    """Loss of F1 when a feature's values are dealt anew among rows, in a hashed order."""
    base = classification_report(probability(df, model, features)).first()["f1"] or 0.0
    from tessera.operators.prepare import _ranked

    out, own = [], _ranked(df, [F.lit(0)], key, 0)
    for r in range(repeats):
        other = _ranked(df, [F.lit(0)], key, 100 + r)
        for f in features:
            mixed = own.drop(f).join(other.select("_rank", f), "_rank")
            out.append((f, r, float(base - (classification_report(probability(mixed, model, features)).first()["f1"] or 0.0))))
    return df.sparkSession.createDataFrame(out, "feature string, repeat int, importance double")


def permutation_importance_cv(df: DataFrame, features: list[str], folds: int = 5, repeats: int = 10, trees: int = 50, depth: int = 8, key: str = "point_id") -> DataFrame:
    """``(feature, repeat, fold, importance)``: the loss of F1 on each fold, kept back from the fit."""
    out = None
    for r in range(repeats):
        parts = materialise(stratified_folds(df, folds, 1, 42 + r, key), "folds")
        for k in range(folds):
            model = fit_forest(parts.where(c("fold") != k), features, trees, depth, 42 + r)
            own = permutation_importance(parts.where(c("fold") == k).drop("repeat", "fold"), model, features, 1, key)
            own = own.select("feature", F.lit(r).alias("repeat"), F.lit(k).alias("fold"), "importance")
            out = own if out is None else out.unionByName(own)
    return out


def partial_dependence(df: DataFrame, model, features: list[str], feature: str, n: int = 20) -> DataFrame:
    """Weighted mean score with the feature set to each of n values from p1 to p99."""
    low, high = quantiles(df, feature, [0.01, 0.99])
    grid = df.sparkSession.range(n).select((F.lit(low) + (high - low) * c("id") / (n - 1)).alias("_x"))
    each = df.crossJoin(F.broadcast(grid)).withColumn(feature, c("_x"))  # n copies of a row
    return probability(each, model, features).groupBy(c("_x").alias("value")).agg((F.sum(c("probability") * c("weight")) / F.sum("weight")).alias("dependence"))


def shapley(df: DataFrame, background: DataFrame, model, features: list[str], key: str = "point_id") -> DataFrame:
    """``(key, feature, attribution)``: exact Shapley values of the score, against the background's medians.

    A row is scored with each subset of its features known and the others at the background's median:
    ``2 ** len(features)`` copies, so for up to a dozen features; ``attribution.tree_attributions`` has the
    values against background rows, of forests over any number of features.
    """
    n = len(features)
    base = {f: quantiles(background, f, [0.5])[0] for f in features}
    known = lambda k: F.shiftright(c("_s"), k).bitwiseAND(F.lit(1)) == 1
    subsets = df.sparkSession.range(1 << n).select(c("id").cast("int").alias("_s"))
    each = df.select(key, *features).crossJoin(F.broadcast(subsets))
    each = each.withColumns({f: F.when(known(k), c(f)).otherwise(F.lit(base[f])) for k, f in enumerate(features)} | {"weight": F.lit(1.0)})
    scored = probability(each, model, features)
    size = F.bit_count("_s")
    share = F.array(*[F.lit(math.factorial(s) * math.factorial(n - s - 1) / math.factorial(n)) for s in range(n)])
    part = lambda k: F.when(known(k), F.get(share, size - 1)).otherwise(-F.get(share, size)) * c("probability")
    sums = scored.groupBy(key).agg(*[F.sum(part(k)).alias(f) for k, f in enumerate(features)])
    return sums.select(key, F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), c(f).alias("attribution")) for f in features])))


def shapley_sample(df: DataFrame, background: DataFrame, model, features: list[str], permutations: int = 4, seed: int = 42, key: str = "point_id") -> DataFrame:
    """Monte-Carlo attributions: features join the row's own values in random orders, the rest keep the
    background's medians; each gets its mean change of the score."""
    base = {f: quantiles(background, f, [0.5])[0] for f in features}
    rnd, out = random.Random(seed), None
    for _ in range(permutations):
        order = rnd.sample(features, len(features))
        for k in range(len(features) + 1):
            have = set(order[:k])
            part = df.select(key, *[c(f) if f in have else F.lit(base[f]).alias(f) for f in features], F.lit(order[k - 1] if k else None).alias("_f"), F.lit(_).alias("_perm"), F.lit(k).alias("_k"))
            out = part if out is None else out.unionByName(part)
    scored = probability(out.withColumn("weight", F.lit(1.0)), model, features).select(key, "_perm", "_k", "_f", "probability")
    before = scored.select(key, "_perm", (c("_k") + 1).alias("_k"), c("probability").alias("_before"))
    return scored.join(before, [key, "_perm", "_k"]).groupBy(key, c("_f").alias("feature")).agg(F.avg(c("probability") - c("_before")).alias("attribution"))


def impute_iterative(df: DataFrame, columns: list[str], others: list[str], rounds: int = 1, trees: int = 10) -> DataFrame:
    """NULLs by forests on the other columns and the age, column after column; all-NULL ages get 0."""
    from tessera.operators.prepare import impute_median

    filled = impute_median(df, [*columns, *others])
    marks = df.select("point_id", *[c(x).isNull().alias(f"_null_{x}") for x in columns])
    for _ in range(rounds):
        for x in columns:
            inputs = ["age", *others, *[y for y in columns if y != x]]
            rows = with_vector(filled.join(marks, "point_id"), inputs)
            model = RandomForestRegressor(labelCol=x, numTrees=trees, maxDepth=5, seed=42, predictionCol="_new").fit(rows.where(~c(f"_null_{x}")))
            filled = model.transform(rows).withColumn(x, F.when(c(f"_null_{x}"), c("_new")).otherwise(c(x))).select(*df.columns)
    return filled


def fit_slab_dip(df: DataFrame, predictors: list[str], response: str, estimator=None):
    """A regression of the dip on its predictors; any estimator may stand in for the forest."""
    rows = with_vector(df.dropna(subset=[*predictors, response]), predictors)
    return (estimator or RandomForestRegressor(labelCol=response, predictionCol="slab_dip_deg", numTrees=20, maxDepth=6, seed=42)).fit(rows)
