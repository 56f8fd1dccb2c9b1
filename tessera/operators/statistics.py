"""Aggregations by age and place, windows over time, histograms, correlations, curves and grids."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.sphere import EARTH_RADIUS_KM, clip
from tessera.plans.components import connected_components
from tessera.plans.ordered import grouped_quantiles, quantiles, running_sums
from tessera.plans.tables import materialise

c = F.col


def cell_area_m2(lat: Column, res: float) -> Column:
    return (res * EARTH_RADIUS_KM * 1e3 * math.pi / 180) ** 2 * F.cos(F.radians(lat))


def flux_grid(trench: DataFrame, quantity: str, res: float, skip_null: bool = True) -> DataFrame:
    """Per age and cell: the sum of quantity x arc length x rate over the cell's area; known cells only."""
    nlon, nlat = round(360 / res), round(180 / res)
    i = F.least(F.floor((c("lon") + 180) / res), F.lit(nlon - 1)).cast("int")
    j = F.least(F.floor((c("lat") + 90) / res), F.lit(nlat - 1)).cast("int")
    amount = c(quantity) * F.radians("arc_len_deg") * EARTH_RADIUS_KM * 1e3 * c("conv_rate_orth_cm_yr") * 1e4
    rows = trench.select("age", i.alias("i"), j.alias("j"), clip(amount, 0).alias("x"))
    total = F.sum("x") if skip_null else F.when(F.count("x") == F.count("*"), F.sum("x"))
    grid = rows.groupBy("age", "i", "j").agg(total.alias("x"))
    return grid.select("age", "i", "j", (c("x") / cell_area_m2((c("j") + 0.5) * res - 90, res)).alias("flux"))


def cumulative_flux(grid: DataFrame, ages: DataFrame, lag: int | None = None) -> DataFrame:
    """Per cell and age: the sum from the oldest age down to it, or over the ages up to ``lag`` before it."""
    full = grid.select("i", "j").distinct().crossJoin(ages.select("age").distinct())
    full = full.join(grid, ["age", "i", "j"], "left").withColumn("flux", F.coalesce("flux", F.lit(0.0)))
    order = Window.partitionBy("i", "j").orderBy(-c("age"))
    frame = order.rangeBetween(Window.unboundedPreceding if not lag else -lag, 0)
    return full.select("age", "i", "j", F.sum("flux").over(frame).alias("total"))


def mean_by_age(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.groupBy("age").agg(*[F.avg(x).alias(x) for x in columns])


def spread_by_age(df: DataFrame, name: str, kind: str = "std", scale: bool = False) -> DataFrame:
    """Sample standard deviation, or median absolute deviation, optionally scaled to one."""
    if kind == "std":
        return df.groupBy("age").agg(F.stddev_samp(name).alias("spread"))
    rows = df.select("age", c(name).cast("double").alias("_v"))
    middle = grouped_quantiles(rows, "age", ["_v"], [0.5]).select("age", c("q")[0].alias("_m"))
    away = grouped_quantiles(rows.join(middle, "age").select("age", F.abs(c("_v") - c("_m")).alias("_v")), "age", ["_v"], [0.5])
    spread = away.select("age", (c("q")[0] * (1.4826 if scale else 1.0)).alias("spread"))
    return df.where(c("age").isNotNull()).select("age").distinct().join(spread, "age", "left")


def mean_by_location(df: DataFrame, columns: list[str], high: str | None = None) -> DataFrame:
    rows = df if high is None else df.where(c(high) > 0.5)
    return rows.groupBy("node_index").agg(*[F.avg(x).alias(x) for x in columns])


def age_histogram(df: DataFrame, width: int, last: int) -> DataFrame:
    """Counts of bins of a width up to ``last``, whose edge belongs to the last bin."""
    at = F.least(F.floor(c("age") / width), F.lit(max(0, math.ceil(last / width) - 1)))
    return df.where(c("age").between(0, last)).groupBy((at * width).cast("long").alias("low")).agg(F.count("*").alias("n"))


def density_histogram(df: DataFrame, name: str, bins: int, reference: Column, group: str) -> DataFrame:
    """Densities by group over equal bins whose edges come from the rows that ``reference`` marks."""
    edges = df.where(reference).agg(F.min(name).alias("_lo"), F.max(name).alias("_hi"))
    rows = df.crossJoin(F.broadcast(edges)).where(c(name).between(c("_lo"), c("_hi")))
    width = (c("_hi") - c("_lo")) / bins
    rows = rows.withColumn("bin", F.least(F.floor((c(name) - c("_lo")) / width), F.lit(bins - 1)).cast("int")).withColumn("_w", width)
    counts = rows.groupBy(group, "bin").agg(F.count("*").alias("n"), F.max("_w").alias("_w"))
    total = F.sum("n").over(Window.partitionBy(group))
    return counts.select(group, "bin", (c("n") / (total * c("_w"))).alias("density"))


def box_stats(df: DataFrame, name: str, group: str, whiskers: tuple[float, float] = (0.05, 0.95)) -> DataFrame:
    """Whiskers, quartiles and the number of values beyond the whiskers, by group."""
    q = grouped_quantiles(df, group, [name], [whiskers[0], 0.25, 0.5, 0.75, whiskers[1]])
    stats = df.select(c(group).alias("_k")).distinct().join(q, c("_k").eqNullSafe(c(group)), "left").select(c("_k").alias(group), "q")
    out = stats.select(group, *[c("q")[i].alias(k) for i, k in enumerate(("low", "q1", "median", "q3", "high"))])
    outlier = df.join(out, group).where((c(name) < c("low")) | (c(name) > c("high"))).groupBy(group).agg(F.count("*").alias("n_outliers"))
    return out.join(outlier, group, "left").withColumn("n_outliers", F.coalesce("n_outliers", F.lit(0)))


def colour_limits(df: DataFrame, name: str, kind: str = "general") -> DataFrame:
    """Fixed for an obliquity, 0 to p99 for a quantity that is not negative, else p1 to p99."""
    if kind == "obliquity":
        return df.agg(F.lit(-90.0).alias("low"), F.lit(90.0).alias("high"))
    low, high = quantiles(df, name, [0.01, 0.99]) or (None, None)
    return df.sparkSession.range(1).select(F.lit(0.0 if kind == "positive" else low).cast("double").alias("low"), F.lit(high).cast("double").alias("high"))


CLASSES = ["Very low", "Low", "Moderate", "High", "Very high"]


def quantile_breaks(df: DataFrame, name: str, k: int = 5) -> list[float]:
    """k + 1 quantile edges; equal width if some fall together; an error without values."""
    q = quantiles(df.where(~F.isnan(name)), name, [i / k for i in range(k + 1)])
    if q is None:
        raise ValueError("no finite values")
    return q if len(set(q)) == k + 1 else [q[0] + (q[-1] - q[0]) * i / k for i in range(k + 1)]


def classify(df: DataFrame, name: str, edges: list[float]) -> DataFrame:
    kind = F.lit(CLASSES[len(edges) - 2])
    for i in reversed(range(len(edges) - 2)):
        kind = F.when(c(name) <= edges[i + 1], CLASSES[i]).otherwise(kind)
    return df.withColumn("class", F.when(c(name).isNotNull(), kind))


def prediction_area_curve(cells: DataFrame, deposits: DataFrame, value: str, n: int = 100) -> DataFrame:
    """For n thresholds in [0, 1]: percent of deposits, and of known cells, at or above it.

    Values are counted by the last threshold that they reach; counts are then added from the top down.
    """
    spark = cells.sparkSession
    steps = spark.range(n).select(c("id").cast("int").alias("k"), (c("id") / (n - 1)).alias("threshold"))

    def share(df: DataFrame, out: str) -> DataFrame:
        rough = F.floor(c(value) * (n - 1))
        k = F.when((rough + 1) / (n - 1) <= c(value), rough + 1).when(rough / (n - 1) > c(value), rough - 1).otherwise(rough)
        binned = df.where(c(value).isNotNull()).groupBy(F.least(k, F.lit(n - 1)).cast("int").alias("k")).agg(F.count("*").alias("m"))
        full = steps.select("k").join(binned, "k", "left").withColumn("m", F.coalesce("m", F.lit(0)))
        total = binned.agg(F.sum("m").alias("total"))
        above = F.sum("m").over(Window.orderBy(F.desc("k")))  # n rows
        return full.withColumn("above", above).crossJoin(F.broadcast(total)).select("k", (100.0 * c("above") / c("total")).alias(out))

    return steps.join(share(deposits, "deposits_pct"), "k").join(share(cells, "area_pct"), "k").drop("k")


def pa_intersection(curve: DataFrame) -> DataFrame:
    """Where the two percentages add up to 100, by linear interpolation."""
    order = Window.orderBy("threshold")  # the curve has n rows
    rows = curve.withColumn("s", c("deposits_pct") + c("area_pct") - 100)
    after = {f"n_{k}": F.lead(k).over(order) for k in ("threshold", "s", "deposits_pct", "area_pct")}
    rows = rows.withColumns(after).where((c("s") >= 0) & (c("n_s") < 0)).orderBy("threshold").limit(1)
    w = c("s") / (c("s") - c("n_s"))
    return rows.select(*[(c(k) + w * (c(f"n_{k}") - c(k))).alias(k) for k in ("threshold", "deposits_pct", "area_pct")])


def average_ranks(df: DataFrame, name: str, out: str) -> DataFrame:
    """Average ranks, by counts of distinct values that run up over ranges of them."""
    counts = df.where(c(name).isNotNull()).groupBy(name).agg(F.count("*").alias("_n"))
    counts = running_sums(counts, name, {"_n": "_to"})
    return df.join(counts.select(name, (c("_to") - c("_n") + (c("_n") + 1) / 2).alias(out)), name, "left")


def spearman_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Long form ``(feature_a, feature_b, rho)``, rounded to 3, over rows complete in the columns."""
    rows = df.dropna(subset=columns).select(F.monotonically_increasing_id().alias("_row"), *[c(x).cast("double").alias(x) for x in columns])
    rows = materialise(rows, "complete")
    long = rows.select("_row", F.inline(F.array(*[F.struct(F.lit(i).alias("_x"), c(x).alias("_v")) for i, x in enumerate(columns)])))
    counts = running_sums(long.groupBy("_x", "_v").agg(F.count("*").alias("_n")), "_v", {"_n": "_to"}, within="_x")
    ranks = counts.select("_x", "_v", (c("_to") - c("_n") + (c("_n") + 1) / 2).alias("_r"))
    rows = long.join(ranks, ["_x", "_v"]).groupBy("_row").agg(*[F.max(F.when(c("_x") == i, c("_r"))).alias(f"_r_{x}") for i, x in enumerate(columns)])
    pairs = [(a, b) for a in columns for b in columns]
    one = rows.agg(*[F.corr(f"_r_{a}", f"_r_{b}").alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
    listed = F.array(*[F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.round(f"p{i}", 3).alias("rho")) for i, (a, b) in enumerate(pairs)])
    return one.select(F.inline(listed))


def strong_pairs(corr: DataFrame, bound: float = 0.8) -> DataFrame:
    """Per feature with any: the others that are strongly correlated, positives down, negatives up."""
    strong = corr.where((c("feature_a") != c("feature_b")) & (F.abs("rho") >= bound))
    order = lambda s: F.array_sort(F.collect_list(s))
    lists = strong.groupBy("feature_a").agg(
        order(F.when(c("rho") > 0, F.struct((-c("rho")).alias("k"), "feature_b"))).alias("up"),
        order(F.when(c("rho") < 0, F.struct(c("rho").alias("k"), "feature_b"))).alias("down"),
    )
    text = lambda x: F.array_join(F.transform(x, lambda e: e["feature_b"]), ",")
    return lists.select("feature_a", text("up").alias("positive"), text("down").alias("negative"), F.size("up").cast("long").alias("n_positive"), F.size("down").cast("long").alias("n_negative"))


def correlation_report(pairs: DataFrame) -> DataFrame:
    text = F.format_string("%s: %d strong (+ %s; - %s)", "feature_a", c("n_positive") + c("n_negative"), "positive", "negative")
    return pairs.select("feature_a", text.alias("report")).crossJoin(F.broadcast(pairs.agg(F.count("*").alias("n_features"))))


def missing_report(df: DataFrame, exclude: tuple[str, ...] = ("valid",)) -> DataFrame:
    names = [n for n in df.columns if n not in exclude]
    one = df.agg(F.count("*").alias("_all"), *[F.count_if(c(n).isNull()).alias(n) for n in names])
    rows = one.select("_all", F.inline(F.array(*[F.struct(F.lit(n).alias("column"), c(n).alias("missing")) for n in names])))
    return rows.where("missing > 0").select("column", "missing", (100.0 * c("missing") / c("_all")).alias("percent"))


def strain_history(samples: DataFrame, value: str, dt: str, key: str, window: int = 10) -> DataFrame:
    """Per point over the window: slope from the first to the last known rate, and mean; two are needed."""
    rows = samples.where(c(value).isNotNull() & c(dt).between(0, window - 1))
    slope = (F.min_by(value, dt) - F.max_by(value, dt)) / F.nullif(F.max(dt) - F.min(dt), F.lit(0))
    return rows.groupBy(key).agg(F.count("*").alias("n"), slope.alias("diff"), F.avg(value).alias("mean")).where("n >= 2").drop("n")


def feature_clusters(corr: DataFrame, cutoff: float = 0.8) -> DataFrame:
    """Single-linkage clusters: connected features with abs(rho) at the cutoff or above; smallest name."""
    edges = corr.where(F.abs("rho") >= cutoff).select(c("feature_a").alias("u"), c("feature_b").alias("v"))
    groups = connected_components(edges)
    names = corr.select(c("feature_a").alias("node")).distinct()
    return names.join(groups, "node", "left").select(c("node").alias("feature"), F.coalesce("component", "node").alias("cluster"))


def cluster_count_sweep(corr: DataFrame, n: int = 100) -> DataFrame:
    """The number of clusters for n cutoffs in [0, 1]: all cutoffs in one run, the cutoff part of a node's name."""
    steps = corr.sparkSession.range(n).select(c("id").cast("int").alias("k"), (c("id") / (n - 1)).alias("cutoff"))
    node = lambda f: F.concat_ws("|", F.lpad(c("k").cast("string"), 6, "0"), f)
    each = corr.join(F.broadcast(steps), F.abs("rho") >= c("cutoff")).select(node("feature_a").alias("u"), node("feature_b").alias("v"))
    groups = connected_components(each)
    names = corr.select("feature_a").distinct().crossJoin(F.broadcast(steps)).select("cutoff", node("feature_a").alias("node"))
    found = names.join(groups, "node", "left").withColumn("cluster", F.coalesce("component", "node"))
    return found.groupBy("cutoff").agg(F.count_distinct("cluster").alias("n_clusters"))


def merge_segment_names(segments: DataFrame) -> DataFrame:
    return segments.groupBy("polarity", "type", "over_plate").agg(F.array_join(F.array_sort(F.collect_set("name")), ":").alias("names"))


def distinct_ages(df: DataFrame) -> DataFrame:
    return df.select("age").distinct()


def gaussian_smooth(series: DataFrame, value: str, fwhm: float, dt: float = 1.0) -> DataFrame:
    """A series ``(age, value)`` of even spacing, smoothed with its edge values repeated."""
    sigma = fwhm / 2.355 / dt
    radius = int(4 * sigma + 0.5)
    place = (F.row_number().over(Window.orderBy("age")) - 1).alias("k")  # one row for each age
    rows = series.select("age", value, place)
    last = rows.agg(F.max("k").alias("last"))
    weight = F.exp(-0.5 * (c("d") / sigma) ** 2)
    offsets = rows.select("age", "k", F.explode(F.sequence(F.lit(-radius), F.lit(radius))).alias("d")).crossJoin(F.broadcast(last))
    at = F.least(F.greatest(c("k") + c("d"), F.lit(0)), c("last"))
    both = offsets.select("age", at.alias("k"), weight.alias("w")).join(rows.select("k", value), "k")
    return both.groupBy("age").agg((F.sum(c("w") * c(value)) / F.sum("w")).alias(value))


def minmax_normalise(df: DataFrame, name: str, out: str | None = None) -> DataFrame:
    span = df.agg(F.min(name).alias("_lo"), F.max(name).alias("_hi"))
    scaled = F.when(c("_hi") > c("_lo"), (c(name) - c("_lo")) / F.nullif(c("_hi") - c("_lo"), F.lit(0.0))).when(c(name).isNotNull(), 0.0)
    return df.crossJoin(F.broadcast(span)).withColumn(out or name, scaled).drop("_lo", "_hi")


def order_by_median(df: DataFrame, columns: list[str]) -> DataFrame:
    found = grouped_quantiles(df.select(F.lit(0).alias("_all"), *columns), "_all", columns, [0.5])
    every = df.sparkSession.createDataFrame([(x,) for x in columns], "feature string")
    rows = every.join(found.select(c("name").alias("feature"), c("q")[0].alias("median")), "feature", "left")
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.desc("median"), "feature")))  # one row a feature


def age_trend(df: DataFrame, name: str, ages: DataFrame, fwhm: float, high: str | None = None, kind: str = "std", scale: bool = False) -> DataFrame:
    """Mean by age of (high) rows, gaps filled, smoothed, with the spread beside it, of the kind and scale
    of :func:`spread_by_age`."""
    from tessera.operators.spatial import complete_ages

    rows = df if high is None else df.where(c(high) > 0.5)
    mean = materialise(complete_ages(mean_by_age(rows, [name]), ages, name), "trend")
    return gaussian_smooth(mean, name, fwhm).join(spread_by_age(rows, name, kind, scale), "age", "left")


# --- grids ---------------------------------------------------------------------------------------


def grid_exact(df: DataFrame, value: str, lon0: float, lat0: float, res: float, key: str, on: list[str]) -> DataFrame:
    """Values at the nodes on which points lie; the point with the largest key wins."""
    x, y = (c("lon") - lon0) / res, (c("lat") - lat0) / res
    rows = df.withColumns({"i": F.round(x).cast("int"), "j": F.round(y).cast("int")}).where((F.abs(x - c("i")) < 1e-6) & (F.abs(y - c("j")) < 1e-6))
    return rows.groupBy(*on, "i", "j").agg(F.max_by(value, key).alias("value"))


def grid_nearest(df: DataFrame, value: str, lon0: float, lat0: float, res: float, shape: tuple[int, int], key: str, on: list[str]) -> DataFrame:
    """Nodes with the value of the nearest point in degrees, if it is within one cell; ties to the smaller key."""
    i, j = F.round((c("lon") - lon0) / res).cast("int"), F.round((c("lat") - lat0) / res).cast("int")
    rows = df.select(*on, key, value, "lon", "lat", F.explode(F.sequence(i - 1, i + 1)).alias("i"), j.alias("_j"))
    rows = rows.withColumn("j", F.explode(F.sequence(c("_j") - 1, c("_j") + 1))).where(c("i").between(0, shape[0] - 1) & c("j").between(0, shape[1] - 1))
    d = F.sqrt((c("lon") - (c("i") * res + lon0)) ** 2 + (c("lat") - (c("j") * res + lat0)) ** 2)
    rows = rows.withColumn("_d", F.round(d, 9)).where(c("_d") <= res)
    return rows.groupBy(*on, "i", "j").agg(F.min_by(value, F.struct("_d", key)).alias("value"))


def infer_resolution(df: DataFrame, name: str) -> DataFrame:
    """Extent of a coordinate, and the least gradient of its sorted distinct values."""
    order = Window.orderBy(name)  # distinct coordinates, few
    v = df.select(name).distinct().where(c(name).isNotNull())
    v = v.withColumns({"_a": F.lag(name).over(order), "_b": F.lead(name).over(order)})
    gap = F.when(c("_a").isNull(), c("_b") - c(name)).when(c("_b").isNull(), c(name) - c("_a")).otherwise((c("_b") - c("_a")) / 2)
    return v.agg(F.min(name).alias("low"), F.max(name).alias("high"), F.min(gap).alias("resolution"))
