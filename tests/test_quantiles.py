import math
import random

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import prepare as R
from tessera.operators import statistics as T
from tessera.plans.ordered import grouped_quantiles, quantiles


def test_grouped_quantiles_equal_sorted_ones(spark):
    rnd = random.Random(8)
    rows = [(rnd.choice([1, 2, 3, None]), rnd.choice([rnd.gauss(0, 1), 0.1, 0.3, None]), float(rnd.randint(0, 3))) for _ in range(3000)]
    rows += [(9, None, 1.5), (10, 7.0, None)]
    df = spark.createDataFrame(rows, "age int, a double, b double").repartition(7)
    shares = [0.0, 0.05, 0.3, 0.5, 0.75, 1.0]
    got = {(r["age"], r["name"]): r["q"] for r in grouped_quantiles(df, "age", ["a", "b"], shares).collect()}
    for k in {r[0] for r in rows}:
        for i, name in ((1, "a"), (2, "b")):
            v = [r[i] for r in rows if r[0] == k and r[i] is not None]
            if v:
                assert np.allclose(got.pop((k, name)), np.quantile(v, shares), atol=1e-12)
    assert not got
    same = spark.range(50).select(F.lit(0.1).alias("a"), F.lit(1).alias("age"))
    assert quantiles(same, "a", [0.3]) == [0.1] and grouped_quantiles(same, "age", ["a"], [0.3]).first()["q"] == [0.1]
    assert grouped_quantiles(df.limit(0), "age", ["a"], [0.5]).count() == 0


def test_groups_without_values_stay(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 4.0), (1, 9.0), (2, None), (None, 1.0)], "age int, v double")
    assert {r["age"]: r["spread"] for r in T.spread_by_age(df, "v", "mad").collect()} == {1: 2.0, 2: None}
    box = {r["age"]: (r["median"], r["n_outliers"]) for r in T.box_stats(df, "v", "age").collect()}
    assert box == {1: (4.0, 2), 2: (None, 0), None: (1.0, 0)}
    filled = R.impute_median(df.withColumn("w", F.lit(None).cast("double")), ["v", "w"]).collect()
    assert {(r["age"], r["v"], r["w"]) for r in filled} == {(1, 2.0, 0.0), (1, 4.0, 0.0), (1, 9.0, 0.0), (2, 0.0, 0.0), (None, 1.0, 0.0)}
    ranked = T.order_by_median(df.withColumn("w", F.lit(None).cast("double")), ["w", "v"]).collect()
    assert [(r["feature"], r["place"]) for r in sorted(ranked, key=lambda r: r["place"])] == [("v", 1), ("w", 2)]
    assert math.isclose(ranked[0]["median"] or ranked[1]["median"], 3.0)
