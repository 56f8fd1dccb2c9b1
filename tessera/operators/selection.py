"""The k rows of a group that come first in a hashed order, without a sort or a window.

The hash of the k-th row is found by counting rows by the leading bits of their hashes, and then by the
next bits of those that share the k-th row's; each round is one aggregation, and after two or three no
bucket holds a row too many. A filter by the hash found then gives the rows: any number of them, of
groups of any size, exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col
BITS, WIDTH = 64, 12


def _same(names: list[str], left: DataFrame, right: DataFrame) -> list[Column]:
    return [left[x].eqNullSafe(right[x]) for x in names]


def thresholds(rows: DataFrame, by: list[str], ranks: DataFrame, order: str = "_h") -> DataFrame:
    """``(by, rank, t)``: for each rank asked for, the highest value of ``order`` among that many first rows.

    ``ranks`` has ``(by, rank)``, few enough for the driver. ``order`` is a long, different for each row of
    a group; among equal ones at a threshold all are taken. A rank beyond a group's size takes all of it, a
    rank below 1 and an empty group give null.
    """
    spark, names = rows.sparkSession, [x for x in by]
    kinds = ", ".join(f"{x} {rows.schema[x].dataType.simpleString()}" for x in names)
    shape = ", ".join(x for x in (kinds, "rank long") if x)
    wanted = [tuple(r) for r in ranks.select(*names, c("rank").cast("long")).collect()]
    # what is left to look for: (group, rank) -> (rank within the prefix, prefix)
    left = {w: (w[-1], None) for w in wanted if w[-1] >= 1}
    found: dict[tuple, int | None] = {}
    shift = BITS
    while left:
        last, shift = shift, max(0, shift - WIDTH)
        bucket = F.shiftright(order, shift)
        here = rows.select(*names, bucket.alias("_b"))
        if last < BITS:
            known = spark.createDataFrame(list({(*w[:-1], p) for w, (_, p) in left.items()}), ", ".join(x for x in (kinds, "_p long") if x))
            here = here.alias("l").join(F.broadcast(known).alias("r"), [*(c(f"l.{x}").eqNullSafe(c(f"r.{x}")) for x in names), F.shiftright("l._b", last - shift) == c("r._p")], "left_semi")
        counts = here.groupBy(*names, "_b").agg(F.count("*").alias("_n"))
        prefix = F.shiftright("_b", last - shift) if last < BITS else F.lit(None).cast("long")
        lists = counts.groupBy(*names, prefix.alias("_p")).agg(F.array_sort(F.collect_list(F.struct("_b", "_n"))).alias("_c"))  # 2 ** WIDTH entries at most
        asked = spark.createDataFrame([(*w, k, p) for w, (k, p) in left.items()], shape + ", _k long, _q long")
        both = lists.alias("l").join(F.broadcast(asked).alias("r"), [*(c(f"l.{x}").eqNullSafe(c(f"r.{x}")) for x in names), c("_p").eqNullSafe(c("_q"))])
        start = F.struct(F.lit(0).cast("long").alias("before"), F.lit(None).cast("long").alias("b"), F.lit(0).cast("long").alias("n"))

        def step(s: Column, e: Column) -> Column:
            done = s["b"].isNotNull() & (s["before"] + s["n"] >= c("_k"))
            return F.when(done, s).otherwise(F.struct((s["before"] + s["n"]).alias("before"), e["_b"].alias("b"), e["_n"].alias("n")))

        hit = both.select(*[c(f"r.{x}").alias(x) for x in names], "rank", "_k", F.aggregate("_c", start, step).alias("s")).collect()
        seen, left, before = set(), {}, left
        for r in hit:
            w, k, s = (*[r[x] for x in names], r["rank"]), r["_k"], r["s"]
            seen.add(w)
            if k >= s["before"] + s["n"] or shift == 0:  # the bucket ends with the row looked for
                found[w] = (s["b"] << shift) + (1 << shift) - 1
            else:
                left[w] = (k - s["before"], s["b"])
        found.update(dict.fromkeys(set(before) - seen))
    return spark.createDataFrame([(*w, found.get(w)) for w in wanted], shape + ", t long")


def parts(df: DataFrame, by: list[str], ranks: DataFrame, order: Column) -> DataFrame:
    """``df`` with ``_part``: how many of its group's thresholds a row lies beyond.

    Rows of groups for which no rank is asked have 0.
    """
    rows = df.withColumn("_h", order)
    marks = thresholds(rows, by, ranks).groupBy(*by).agg(F.collect_list(F.coalesce("t", F.lit(-(1 << 63)))).alias("_t"))
    on = [c(f"l.{x}").eqNullSafe(c(f"r.{x}")) for x in by] or F.lit(True)
    both = rows.alias("l").join(F.broadcast(marks).alias("r"), on, "left")
    passed = F.coalesce(F.size(F.filter("_t", lambda t: t < c("_h"))), F.lit(0))
    return both.select(*[c(f"l.{x}").alias(x) for x in df.columns], F.greatest(passed, F.lit(0)).alias("_part"))
