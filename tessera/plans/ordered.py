"""Running sums and exact quantiles of tables of any size, by ranges of a column."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.tables import drop_files, materialise, shuffle_partitions


def running_sums(df: DataFrame, by: str, sums: dict[str, str], descending: bool = False, within: str | None = None) -> DataFrame:
    """``df`` with, for each ``column: name``, the column's sum from the first row in the order of ``by``
    up to the row, or from the first of its group ``within``. Values of ``by`` are distinct, in a group.

    Rows are dealt into ranges of ``by``; sums run within a range and start at the total of the ranges
    before, so no task holds all rows. Only the totals, one row a range, go through a window of their own.
    """
    order = F.desc(by) if descending else F.asc(by)
    group = [within] if within else []
    ranged = df.repartitionByRange(shuffle_partitions(df.sparkSession), *group, order).withColumn("_range", F.spark_partition_id())
    ranged = materialise(ranged, "ranges")
    totals = ranged.groupBy(*group, "_range").agg(*[F.sum(x).alias(f"_b_{n}") for x, n in sums.items()])
    before = (Window.partitionBy(*group) if within else Window).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*group, "_range", *[F.coalesce(F.sum(f"_b_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums.values()])
    own = Window.partitionBy(*group, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    added = ranged.withColumns({n: F.sum(x).over(own) for x, n in sums.items()}).join(totals, [*group, "_range"])
    return added.withColumns({n: F.col(n) + F.col(f"_b_{n}") for n in sums.values()}).select(*df.columns, *sums.values())


def quantiles(df: DataFrame, name: str, shares: list[float]) -> list[float] | None:
    """Exact quantiles, interpolated between the two nearest ranks; None without a value.

    Values are counted, the counts run up by ranges, and one aggregation takes the values at the ranks
    asked for: no buffer holds the column's distinct values.
    """
    counts = df.where(F.col(name).isNotNull()).groupBy(F.col(name).cast("double").alias("v")).agg(F.count("*").alias("n"))
    run = materialise(running_sums(counts, "v", {"n": "to"}), "counts")
    total = run.agg(F.max("to").alias("n")).first()["n"]
    if not total:
        return None
    places = [p * (total - 1) for p in shares]
    ranks = sorted({int(f(x)) for x in places for f in (math.floor, math.ceil)})
    row = run.agg(*[F.min(F.when(F.col("to") > r, F.col("v"))).alias(f"r{r}") for r in ranks]).first()
    drop_files(run)
    at = lambda r: row[f"r{int(r)}"]
    return [at(math.floor(x)) + (x - math.floor(x)) * (at(math.ceil(x)) - at(math.floor(x))) for x in places]  # equal ends stay as they are


def grouped_quantiles(df: DataFrame, by: str, columns: list[str], shares: list[float]) -> DataFrame:
    """``(by, name, q)``: exact quantiles of each column within each group, interpolated between the two
    nearest ranks, for all groups and columns at once; a group without a value of a column has no row.

    Values are counted by group and column, the counts run up by ranges of both, and one aggregation takes
    the values at the ranks asked for: no buffer holds a group's values, and no task a whole group.
    """
    each = F.inline(F.array(*[F.struct(F.lit(x).alias("name"), F.col(x).cast("double").alias("v")) for x in columns]))
    rows = df.select(F.col(by).alias("_by"), each).where("v is not null")
    counts = rows.groupBy(F.struct("_by", "name").alias("_g"), "v").agg(F.count("*").alias("n"))
    run = materialise(running_sums(counts, "v", {"n": "to"}, within="_g"), "counts")
    both = run.join(run.groupBy("_g").agg((F.max("to") - 1).alias("_last")), "_g")
    at = lambda rank: F.min(F.when(F.col("to") > rank, F.col("v")))
    ends = [x.alias(f"_{k}{i}") for i, p in enumerate(shares) for k, x in (("a", at(F.floor(p * F.col("_last")))), ("b", at(F.ceil(p * F.col("_last")))))]
    found = both.groupBy("_g").agg(F.first("_last").alias("_last"), *ends)
    part = lambda p: p * F.col("_last") - F.floor(p * F.col("_last"))
    between = [F.when(part(p) == 0, F.col(f"_a{i}")).otherwise(F.col(f"_a{i}") + part(p) * (F.col(f"_b{i}") - F.col(f"_a{i}"))) for i, p in enumerate(shares)]
    return found.select(F.col("_g._by").alias(by), F.col("_g.name").alias("name"), F.array(*between).alias("q"))
