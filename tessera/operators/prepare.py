"""Filters, imputation, scaling, sampling and unions of point and feature tables."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.selection import parts
from tessera.plans.ordered import grouped_quantiles, quantiles
from tessera.plans.tables import materialise

c = F.col


def filter_physical(df: DataFrame, strict: bool = True, obliquity: str = "obliquity_deg", rates: tuple[str, ...] = ("conv_rate_cm_yr", "conv_rate_orth_cm_yr"), fluxes: tuple[str, ...] = ()) -> DataFrame:
    """Rows whose rates are not negative; strictly, obliquity within 90 degrees and fluxes too. NULL fails."""
    fine = F.lit(True)
    for name in (*rates, *(fluxes if strict else ())):
        fine = fine & (c(name) >= 0)
    return df.where(fine & c(obliquity).between(-90, 90) if strict else fine)


def within_trench_distance(df: DataFrame, degrees: float, distance: str = "distance_to_trench_km") -> DataFrame:
    return df.where(c(distance) <= math.radians(degrees) * 6371.0)


def age_range(df: DataFrame, low: float, high: float, age: str = "age") -> DataFrame:
    """Ages as numbers, text that is none dropped, within an inclusive range."""
    number = F.expr(f"try_cast(`{age}` AS DOUBLE)")
    return df.withColumn(age, number).where(c(age).between(low, high))


def snap_to_step(age: Column, step: float = 1.0) -> Column:
    """The nearest step, ties to the younger."""
    return F.ceil(age / step - 0.5) * step


def snap_to_steps(df: DataFrame, steps: list[float], age: str = "age", out: str = "step") -> DataFrame:
    """The nearest of a given list of steps, ties to the first."""
    listed = F.array(*[F.struct(F.abs(c(age) - s).alias("d"), F.lit(i).alias("i"), F.lit(float(s)).alias("s")) for i, s in enumerate(steps)])
    return df.withColumn(out, F.when(c(age).isNotNull(), F.array_min(listed)["s"]))


def default_weight(df: DataFrame) -> DataFrame:
    return df if "weight" in df.columns else df.withColumn("weight", F.lit(1.0))


def drop_incomplete(df: DataFrame, names: list[str]) -> DataFrame:
    return df.dropna(subset=[n for n in names if n in df.columns])


def degenerate_columns(df: DataFrame) -> tuple[list[str], list[str]]:
    """Columns without a value, and columns with one distinct value, found in one pass."""
    stats = df.agg(*[F.count(n).alias(f"n{i}") for i, n in enumerate(df.columns)], *[F.min(n).eqNullSafe(F.max(n)).alias(f"c{i}") for i, n in enumerate(df.columns)]).first()
    empty = [n for i, n in enumerate(df.columns) if not stats[f"n{i}"]]
    return empty, [n for i, n in enumerate(df.columns) if stats[f"n{i}"] and stats[f"c{i}"]]


def drop_degenerate_columns(df: DataFrame) -> DataFrame:
    empty, constant = degenerate_columns(df)
    return df.drop(*empty, *constant)


def project_features(df: DataFrame, drop: list[str], keep: list[str]) -> DataFrame:
    """The columns of ``keep`` that aren't dropped, absent ones as NULL."""
    left = [n for n in keep if n not in drop]
    return df.select(*[c(n) if n in df.columns else F.lit(None).cast("double").alias(n) for n in left])


def high_only(df: DataFrame, name: str, bound: float = 0.5) -> DataFrame:
    return df.where(c(name) > bound)


def deposit_age_class(df: DataFrame, t: float, window: float = 2.5, age: str = "age") -> DataFrame:
    """``new`` within the window before t, ``old`` beyond it; younger deposits go."""
    kind = F.when((c(age) >= t) & (c(age) - t <= window), "new").when(c(age) > t + window, "old")
    return df.withColumn("age_class", kind).where(c("age_class").isNotNull())


def valid_only(df: DataFrame) -> DataFrame:
    return df.where(c("valid"))


def iqr_upper_fence(df: DataFrame, name: str) -> DataFrame:
    q = quantiles(df, name, [0.25, 0.75])
    return df.sparkSession.range(1).select(F.lit(q[1] + 1.5 * (q[1] - q[0]) if q else None).cast("double").alias("fence"))


def exclude_zero(df: DataFrame, name: str) -> DataFrame:
    return df.where(c(name) > 0)


def impute_median(df: DataFrame, columns: list[str], by: str = "age") -> DataFrame:
    """NULL becomes the median of the row's age, or 0 where an age has no value.

    Medians of all columns and ages come from one pass over counts of values; no age's rows meet in one task.
    """
    found = grouped_quantiles(df, by, columns, [0.5])
    medians = found.groupBy(by).agg(*[F.max(F.when(c("name") == n, c("q")[0])).alias(f"_m_{n}") for n in columns])
    both = df.join(medians, by, "left")
    filled = {n: F.coalesce(c(n), c(f"_m_{n}"), F.lit(0.0)) for n in columns}
    return both.withColumns(filled).select(*df.columns)


def robust_scale(train: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Centre (median) and scale (interquartile range, 1 where it is 0) of each column."""
    found = {n: quantiles(train, n, [0.25, 0.5, 0.75]) for n in columns}
    return {n: (q[1], (q[2] - q[0]) or 1.0) for n, q in found.items() if q}


def apply_scale(df: DataFrame, fit: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({n: (c(n) - m) / s for n, (m, s) in fit.items()})


def unscale(df: DataFrame, fit: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({n: c(n) * s + m for n, (m, s) in fit.items()})


def hashed(key: str, seed: int) -> Column:
    """A fixed pseudo-random order of rows."""
    return F.xxhash64(F.lit(seed), c(key))


def _ranked(df: DataFrame, by: list[Column], key: str, seed: int) -> DataFrame:
    """``df`` with ``_rank``: the place of a row within its group in hashed order, from 1.

    Ranks are found in hash ranges, with counts of the ranges before, so a group may be of any size.
    """
    h = hashed(key, seed)
    names = [f"_g{i}" for i in range(len(by))]
    rows = df.withColumns({n: b for n, b in zip(names, by)} | {"_h": h, "_s": F.shiftright(h, 58)})
    sizes = rows.groupBy(*names, "_s").agg(F.count("*").alias("_n"))
    order = Window.partitionBy(*names).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*[c(n).alias(f"{n}_") for n in names], c("_s").alias("_s_"), F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_before"))
    on = c("_s") == c("_s_")
    for n in names:
        on = on & c(n).eqNullSafe(c(f"{n}_"))
    own = Window.partitionBy(*names, "_s").orderBy("_h", key)
    ranked = rows.withColumn("_rank", F.row_number().over(own)).join(sizes, on)
    return ranked.withColumn("_rank", c("_rank") + c("_before")).select(*df.columns, "_rank")


def downsample(df: DataFrame, n: int, age_bins: int = 50, xy_bins: int = 10, seed: int = 42, key: str = "point_id", order: Column | None = None) -> DataFrame:
    """About n rows, spread over age quantiles and over equal-width cells of each; all rows if fewer.

    A cell gives its first rows in the order of ``order``, by default a hash of the key."""
    if df.count() < n:
        return df
    edges = sorted(set(quantiles(df, "age", [i / age_bins for i in range(age_bins + 1)]) or [0.0]))
    bin_of = F.greatest(F.aggregate(F.array(*map(F.lit, edges)), F.lit(0), lambda s, e: s + (e < c("age")).cast("int")), F.lit(1))
    rows = df.withColumn("_a", bin_of)
    box = rows.groupBy("_a").agg(*[f(x).alias(f"_{f.__name__}_{x}") for f in (F.min, F.max) for x in ("lon", "lat")])
    rows = rows.join(F.broadcast(box), "_a")
    cell = lambda x: F.least(F.floor((c(x) - c(f"_min_{x}")) / F.nullif(c(f"_max_{x}") - c(f"_min_{x}"), F.lit(0.0)) * xy_bins), F.lit(xy_bins - 1))
    rows = rows.withColumn("_cell", F.struct("_a", F.coalesce(cell("lon"), F.lit(0)).alias("i"), F.coalesce(cell("lat"), F.lit(0)).alias("j")))
    cells = rows.groupBy("_a").agg(F.count_distinct("_cell").alias("_k"))
    most = F.greatest(F.lit(1), F.floor(F.floor(F.lit(n) / (len(edges) - 1 or 1)) / c("_k")))
    ranks = rows.select("_a", "_cell").distinct().join(F.broadcast(cells), "_a").select("_cell", most.alias("rank"))  # age_bins x xy_bins ** 2 at most
    return parts(rows, ["_cell"], ranks, hashed(key, seed) if order is None else order).where("_part = 0").select(*df.columns)


def split(df: DataFrame, fractions: list[float], seed: int = 42, key: str = "point_id") -> DataFrame:
    """``df`` with ``part`` 0, 1, ...: exact shares in hashed order."""
    n, total, bounds = df.count(), 0.0, []
    for f in fractions[:-1]:
        total += f
        bounds.append((round(total * n),))
    ranks = df.sparkSession.createDataFrame(bounds, "rank long")
    return parts(df, [], ranks, hashed(key, seed)).withColumnRenamed("_part", "part")


def stratified_folds(df: DataFrame, k: int = 5, repeats: int = 1, seed: int = 42, key: str = "point_id", label: str = "label", order: Callable[[int], Column] | None = None) -> DataFrame:
    """``df`` once for each repeat, with ``repeat`` and ``fold``; labels are spread evenly over folds.

    A label's rows are cut into k equal parts of a hashed order, which ``order`` may give for a repeat."""
    out, sizes = None, df.groupBy(label).agg(F.count("*").alias("_n"))  # a row for each label
    ends = F.array(*[F.floor(c("_n") * i / k) for i in range(1, k)] or [F.lit(1 << 62)])
    for r in range(repeats):
        ranks = sizes.select(label, F.explode(F.array_distinct(ends)).alias("rank"))
        rows = parts(df, [label], ranks, order(r) if order else hashed(key, seed + r))
        # small labels have several folds that end at one rank
        marks = sizes.select(c(label).alias("_label"), F.array_sort(F.array_distinct(ends)).alias("_d"), ends.alias("_e"))
        rows = rows.join(F.broadcast(marks), c(label).eqNullSafe(c("_label")))
        past = F.filter("_e", lambda e: (c("_part") > 0) & (e <= F.get("_d", c("_part") - 1)))
        rows = rows.select(*df.columns, F.lit(r).alias("repeat"), F.size(past).alias("fold"))
        out = rows if out is None else out.unionByName(rows)
    return out


def random_holdouts(df: DataFrame, n: int = 25, fraction: float = 0.7, seed: int = 42, key: str = "point_id") -> DataFrame:
    """``df`` once for each split, with ``split_id`` and ``train``."""
    splits = df.sparkSession.range(n).withColumnRenamed("id", "split_id")
    each = df.crossJoin(F.broadcast(splits))  # n copies of a row
    ranks = splits.select("split_id", F.lit(int(fraction * df.count())).alias("rank"))
    found = parts(each, ["split_id"], ranks, F.xxhash64(F.lit(seed), F.xxhash64("split_id", key)))
    return found.withColumn("train", c("_part") == 0).drop("_part")


def stack_labelled(deposits: DataFrame, unlabelled: DataFrame) -> DataFrame:
    return deposits.withColumn("label", F.lit(1)).unionByName(unlabelled.withColumn("label", F.lit(0)), allowMissingColumns=True)


def balance_union(df: DataFrame, seed: int = 42, key: str = "point_id") -> DataFrame:
    """All positives and as many negatives in hashed order; rows of label 2 go."""
    positive = df.where("label = 1")
    ranks = df.sparkSession.createDataFrame([(positive.count(),)], "rank long")
    negative = parts(df.where("label = 0"), [], ranks, hashed(key, seed)).where("_part = 0").drop("_part")
    return positive.unionByName(negative)


def pu_relabel(df: DataFrame, score: str = "probability", bound: float = 0.5) -> DataFrame:
    """1 for known positives, 2 for unlabelled rows predicted positive, 0 for the rest."""
    return df.withColumn("new_label", F.when(c("label") == 1, 1).when(c(score) > bound, 2).otherwise(0))


def sort_output(df: DataFrame) -> DataFrame:
    return df.orderBy("label", "age") if "label" in df.columns else df.orderBy("age")


def grid_nodes(spark, ages: list[int], res: float) -> DataFrame:
    """All nodes of a global grid, both ends of each axis, for each age."""
    nlon, nlat = round(360 / res) + 1, round(180 / res) + 1
    nodes = spark.range(nlon * nlat * len(ages))
    k = (c("id") / (nlon * nlat)).cast("int")
    rest = c("id") % (nlon * nlat)
    age = F.element_at(F.array(*map(F.lit, ages)), k + 1)
    return nodes.select(age.alias("age"), rest.alias("node_index"), (rest % nlon * res - 180).alias("lon"), (F.floor(rest / nlon) * res - 90).alias("lat"))


def random_points(spark, ages: list[int], n: int, inside, seed: int = 42, factor: int = 8) -> DataFrame:
    """Exactly n points of each age, uniform on the sphere, among those that ``inside(df)`` keeps.

    Draws ``factor`` times as many as asked for, and further ones while some age falls short; where 4096
    times as many don't do, what ``inside`` keeps is too small, and that is an error.
    """
    kept, start = None, 0
    while True:
        end = len(ages) * n * factor
        ids = spark.range(start, end).withColumn("age", F.element_at(F.array(*map(F.lit, ages)), (c("id") % len(ages) + 1).cast("int")))
        u = [(F.pmod(F.xxhash64(F.lit(seed + k), "id"), F.lit(1 << 53)) + 0.5) / float(1 << 53) for k in (0, 1)]
        drawn = ids.select(c("id").alias("point_id"), "age", (u[0] * 360 - 180).alias("lon"), F.degrees(F.asin(2 * u[1] - 1)).alias("lat"), F.lit(1.0).alias("weight"))
        new = materialise(inside(drawn), "drawn")
        kept = new if kept is None else kept.unionByName(new)
        sizes = {r["age"]: r["n"] for r in kept.groupBy("age").agg(F.count("*").alias("n")).collect()}
        if all(sizes.get(a, 0) >= n for a in ages):
            ranks = spark.createDataFrame([(a, n) for a in ages], f"age {kept.schema['age'].dataType.simpleString()}, rank long")
            return parts(kept, ["age"], ranks, hashed("point_id", seed)).where("_part = 0").drop("_part")
        if factor >= 4096:
            raise ValueError(f"fewer than {n} of {n * factor} points of some age are kept")
        start, factor = end, factor * 4
