from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import attribution as A
from tessera.operators import model as M


def score(leaves, x):
    """By walking to the one leaf of each tree that a row keeps to."""
    return sum(own.value for own in leaves if all(not v <= low and (v <= high or high == np.inf) for v, low, high in zip(x[own.features], own.low, own.high)))


def by_subsets(leaves, x, background, weights):
    """The definition: every set of features, with the others from each background row."""
    n = len(x)

    def value(s):
        rows = background.copy()
        rows[:, list(s)] = x[list(s)]
        return sum(w * score(leaves, z) for w, z in zip(weights, rows)) / sum(weights)

    sets = {s: value(s) for k in range(n + 1) for s in combinations(range(n), k)}
    return [sum(factorial(len(s)) * factorial(n - len(s) - 1) / factorial(n) * (sets[tuple(sorted({*s, i}))] - v) for s, v in sets.items() if i not in s) for i in range(n)]


def rows_of(spark, rnd, n, names, extra=()):
    x = rnd.normal(size=(n, len(names)))
    label = ((x[:, 0] + x[:, 1] * x[:, 2] > 0) ^ (rnd.random(n) < 0.1)).astype(int)
    data = [(k, float(1 + k % 3), int(y), *map(float, v)) for k, (y, v) in enumerate(zip(label, x))]
    return x, spark.createDataFrame(data, "point_id long, weight double, label int, " + ", ".join(f"{f} double" for f in names))


def test_equals_the_subsets_on_four_features(spark):
    rnd, names = np.random.default_rng(3), ["a", "b", "d", "e"]
    x, df = rows_of(spark, rnd, 60, names)
    model = M.fit_forest(df, names, trees=4, depth=5)
    leaves = A.forest_leaves(model)
    scored = {r["point_id"]: r["probability"] for r in M.probability(df, model, names).collect()}
    assert all(abs(score(leaves, v) - scored[k]) < 1e-12 for k, v in enumerate(x))
    got = {}
    for r in A.tree_attributions(df.where("point_id < 12"), df, leaves, names, weight="weight").collect():
        got.setdefault(r["point_id"], {})[r["feature"]] = r["attribution"]
    weights = [1 + k % 3 for k in range(60)]
    mean = sum(w * scored[k] for k, w in enumerate(weights)) / sum(weights)
    for k in range(12):
        want = by_subsets(leaves, x[k], x, weights)
        assert [got[k][f] for f in names] == pytest.approx(want, abs=1e-12)
        assert sum(want) == pytest.approx(scored[k] - mean, abs=1e-12)


def test_many_features_missing_values_and_no_rows(spark):
    rnd, names = np.random.default_rng(5), [f"f{k}" for k in range(27)]
    x, df = rows_of(spark, rnd, 300, names)
    model = M.fit_forest(df, names, trees=5, depth=7)
    leaves = A.forest_leaves(model)
    odd = df.withColumn("f0", F.when(F.col("point_id") % 7 == 0, None).otherwise(F.col("f0")))
    got = A.tree_attributions(odd, odd, leaves, names).groupBy("point_id").agg(F.sum("attribution").alias("s"), F.count("*").alias("n")).collect()
    y = x.copy()
    y[::7, 0] = np.nan
    all_ = [score(leaves, v) for v in y]
    assert len(got) == 300 and all(r["n"] == 27 and abs(r["s"] - (all_[r["point_id"]] - np.mean(all_))) < 1e-9 for r in got)
    assert A.tree_attributions(odd.limit(0), odd, leaves, names).count() == 0
    assert {r["attribution"] for r in A.tree_attributions(odd.limit(2), odd.limit(0), leaves, names).collect()} == {0.0}


def test_folds_explain_every_row(spark):
    _, df = rows_of(spark, np.random.default_rng(6), 90, ["a", "b", "d", "e"])
    got = A.attributions_cv(df, ["a", "b", "d", "e"], folds=3, repeats=1, trees=2, depth=3)
    n = got.agg(F.count("*").alias("n"), F.count_distinct("point_id", "feature").alias("d"), F.count_distinct("fold").alias("f")).first()
    assert (n["n"], n["d"], n["f"]) == (360, 360, 3)
