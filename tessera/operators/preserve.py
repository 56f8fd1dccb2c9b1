"""The erosion-based preservation score: a spline in log erosion and a regularised logistic fit."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.sphere import clip
from tessera.operators.prepare import random_holdouts
from tessera.plans.ordered import running_sums
from tessera.plans.tables import materialise

c = F.col
OFFSET_M, KNOTS, DEGREE = 50.0, 6, 3
#: Erosion at which a fit is summarised, in m.
SUMMARY = [0.0, 250.0, 500.0, 1000.0, 2000.0, 3000.0, 5000.0, 8000.0, 12000.0, 20000.0, 30000.0]


def transform(erosion: Column) -> Column:
    return F.log10(erosion + OFFSET_M)


def bspline_basis(x: Column, low: float, high: float, knots: int = KNOTS, degree: int = DEGREE) -> list[Column]:
    """Uniform B-splines by the Cox-de Boor recursion; beyond the knots the edge's values go on."""
    step = (high - low) / (knots - 1) or 1.0
    t = [low + step * (i - degree) for i in range(knots + 2 * degree)]
    x = clip(x, low, high)
    last = knots + degree - 2  # the span that closes at the highest knot
    within = lambda i: F.lit(False) if i > last else (x >= t[i]) if i == last else (x >= t[i]) & (x < t[i + 1])
    basis = [F.when(within(i), 1.0).when(x.isNotNull(), 0.0) for i in range(len(t) - 1)]
    for d in range(1, degree + 1):
        basis = [(x - t[i]) / (step * d) * basis[i] + (t[i + d + 1] - x) / (step * d) * basis[i + 1] for i in range(len(basis) - 1)]
    return basis


@dataclass
class Preservation:
    """Coefficients of the basis and the bounds that scale the linear predictor to 0..1."""

    low: float
    high: float
    coefficients: list[float]
    intercept: float
    bounds: tuple[float, float]

    def linear(self, erosion: Column) -> Column:
        total = F.lit(self.intercept)
        for b, k in zip(bspline_basis(transform(erosion), self.low, self.high), self.coefficients):
            total = total + b * k
        return total

    def score(self, erosion: Column) -> Column:
        low, high = self.bounds
        known = F.when(erosion.isNotNull() & ~F.isnan(erosion) & (F.abs(erosion) < float("inf")), erosion)
        return clip((self.linear(known) - low) / ((high - low) or 1.0), 0, 1)


def _placed(df: DataFrame, x: Column, low: Column, high: Column) -> DataFrame:
    """``df`` with the span ``_s`` of uniform cubic splines that a value lies in, from 0, and the values
    ``_p0`` to ``_p3`` of the four that are not zero there, numbered from the span on."""
    step = F.when(high > low, (high - low) / (KNOTS - 1)).otherwise(1.0)
    df = df.withColumn("_u", (F.least(F.greatest(x, low), high) - low) / step).withColumn("_s", F.least(F.floor("_u"), F.lit(KNOTS - 2)).cast("int"))
    df = df.withColumn("_f", c("_u") - c("_s"))
    f, g = c("_f"), 1 - c("_f")
    pieces = [g * g * g / 6, (3 * f * f * f - 6 * f * f + 4) / 6, (3 * g * g * g - 6 * g * g + 4) / 6, f * f * f / 6]
    return df.withColumns({f"_p{i}": p for i, p in enumerate(pieces)})


def _linear(w: str = "w") -> Column:
    """The linear predictor of a placed row from an array of coefficients, the intercept first."""
    return sum((c(f"_p{i}") * F.get(w, c("_s") + 1 + i) for i in range(DEGREE + 1)), c(w)[0])


def newton_sums(rows: DataFrame, given: DataFrame, by: str = "split_id") -> DataFrame:
    """``(by, n, g0.., h00..)``: rows, gradient and curvature of the log likelihood of each group at given
    coefficients, the intercept first; one aggregation for all groups.

    ``rows`` has ``(by, x, y)``; ``given`` has a row for each group with the lowest and highest knot
    ``low, high`` and ``w``, the array of coefficients.
    """
    here = rows.join(F.broadcast(given), by)
    here = _placed(here, c("x"), c("low"), c("high"))
    here = here.withColumn("_e", 1 / (1 + F.exp(-_linear())))
    here = here.withColumns({"_r": c("y") - c("_e"), "_v": c("_e") * (1 - c("_e"))})
    part = lambda k: F.coalesce(*[F.when(c("_s") == k - i, c(f"_p{i}")) for i in range(DEGREE + 1)], F.lit(0.0))
    size = KNOTS + DEGREE
    here = here.select(by, "_r", "_v", F.lit(1.0).alias("_b0"), *[part(k).alias(f"_b{k + 1}") for k in range(size - 1)])
    b = [c(f"_b{k}") for k in range(size)]
    gradient = [F.sum(c("_r") * x).alias(f"g{i}") for i, x in enumerate(b)]
    curvature = [F.sum(c("_v") * b[i] * b[k]).alias(f"h{i}{k}") for i in range(len(b)) for k in range(i, len(b))]
    return here.groupBy(by).agg(F.count("*").alias("n"), *gradient, *curvature)


def fit_preservations(rows: DataFrame, by: str = "split_id", penalty: float = 1.0, tolerance: float = 1e-10) -> dict[int, Preservation]:
    """Fits of all groups of ``(by, x, y)`` at once, x being the transformed erosion.

    Each step of Newton's method takes the sums of all groups by one aggregation; only 9 x 9 numbers a
    group reach the driver, which solves for the next coefficients. Groups that have converged take no
    part in later steps. The squares of all coefficients but the intercept are penalised.
    """
    spark = rows.sparkSession
    edges = rows.groupBy(by).agg(F.min("x").alias("low"), F.max("x").alias("high")).collect()  # a row for each group
    size = KNOTS + DEGREE
    knots = {r[by]: (r["low"], r["high"]) for r in edges}
    w = {g: np.zeros(size) for g in knots}
    ridge = np.diag([0.0] + [1.0 / penalty] * (size - 1))
    shape = f"{by} long, low double, high double, w array<double>"
    table = lambda groups: spark.createDataFrame([(g, *knots[g], w[g].tolist()) for g in groups], shape)
    left = set(knots)
    for _ in range(100):
        if not left:
            break
        for r in newton_sums(rows, table(left), by).collect():
            h = np.zeros((size, size))
            for i in range(size):
                for k in range(i, size):
                    h[i, k] = h[k, i] = r[f"h{i}{k}"]
            own = w[r[by]]
            step = np.linalg.lstsq(h + ridge, np.array([r[f"g{i}"] for i in range(size)]) - ridge @ own, rcond=None)[0]
            w[r[by]] = own + step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-300))  # no wild first steps
            if np.abs(step).max() <= tolerance * max(1.0, np.abs(own).max()):
                left.discard(r[by])
    here = _placed(rows.join(F.broadcast(table(knots)), by), c("x"), c("low"), c("high"))
    ends = here.groupBy(by).agg(F.min(_linear()).alias("lo"), F.max(_linear()).alias("hi")).collect()
    return {r[by]: Preservation(*knots[r[by]], w[r[by]][1:].tolist(), float(w[r[by]][0]), (r["lo"], r["hi"])) for r in ends}


def _rows(df: DataFrame, erosion: str, label: str, *keys: str) -> DataFrame:
    known = df.where(c(erosion).isNotNull() & (F.abs(c(erosion)) < float("inf")))
    return known.select(*keys, transform(c(erosion)).alias("x"), c(label).cast("double").alias("y"))


def fit_preservation(df: DataFrame, erosion: str = "erosion_m", label: str = "label", penalty: float = 1.0) -> Preservation:
    """Fit on deposits (label 1) against background (0); rows of unknown erosion are left out."""
    rows = materialise(_rows(df, erosion, label, F.lit(0).cast("long").alias("split_id")), "erosion")  # read in every step
    return fit_preservations(rows, penalty=penalty)[0]


def score_summary(spark, fit: Preservation) -> DataFrame:
    return spark.createDataFrame([(e,) for e in SUMMARY], "erosion_m double").withColumn("preservation_score", fit.score(c("erosion_m")))


def split_areas(scored: DataFrame, by: str = "split_id", p: str = "probability", y: str = "label") -> DataFrame:
    """``(by, auc)``: the Mann-Whitney area of each group, ties at average ranks."""
    steps = scored.groupBy(by, c(p).alias("s")).agg(F.sum(y).alias("pos"), F.count("*").alias("n"))
    steps = running_sums(steps, "s", {"n": "to"}, within=by)
    ranked = steps.withColumn("rank", c("to") - c("n") + (c("n") + 1) / 2)
    sums = ranked.groupBy(by).agg(F.sum(c("pos") * c("rank")).alias("r"), F.sum("pos").alias("p"), F.sum("n").alias("n"))
    return sums.select(by, ((c("r") - c("p") * (c("p") + 1) / 2) / (c("p") * (c("n") - c("p")))).alias("auc"))


def held_out_auc(df: DataFrame, n: int = 25, fraction: float = 0.7, erosion: str = "erosion_m") -> tuple[float, float]:
    """Mean and population deviation of the area on rows kept back, over n refits.

    All splits are fitted together and scored in one pass.
    """
    splits = materialise(random_holdouts(df, n, fraction), "splits")
    train = materialise(_rows(splits.where("train"), erosion, "label", c("split_id").cast("long").alias("split_id")), "erosion")
    fits = fit_preservations(train)
    shape = "split_id long, low double, high double, w array<double>, lo double, hi double"
    table = [(g, f.low, f.high, [f.intercept, *f.coefficients], *f.bounds) for g, f in fits.items()]
    test = splits.where("not train").withColumn("split_id", c("split_id").cast("long"))
    test = _placed(test.join(F.broadcast(df.sparkSession.createDataFrame(table, shape)), "split_id"), transform(c(erosion)), c("low"), c("high"))
    score = clip((_linear() - c("lo")) / F.when(c("hi") > c("lo"), c("hi") - c("lo")).otherwise(1.0), 0, 1)
    row = split_areas(test.withColumn("probability", score)).agg(F.avg("auc").alias("mean"), F.stddev_pop("auc").alias("std")).first()
    return row["mean"], row["std"]
