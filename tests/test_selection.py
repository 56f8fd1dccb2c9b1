import contextlib
import io
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.operators import prepare as R
from tessera.operators import selection as K


def plain(rows, ranks):
    by = {}
    for g, h in rows:
        by.setdefault(g, []).append(h)
    return {(g, k): sorted(by.get(g, []))[:k] for g, k in ranks}


@pytest.mark.parametrize("width", [12, 3])
def test_thresholds_take_exactly_the_first(spark, width, monkeypatch):
    monkeypatch.setattr(K, "WIDTH", width)
    rnd = random.Random(width)
    near = [(1 << 40) + k for k in range(60)]  # differ in their last bits alone
    rows = [("a", rnd.getrandbits(64) - (1 << 63)) for _ in range(500)] + [("b", h) for h in near] + [(None, h) for h in (-(1 << 63), (1 << 63) - 1, 0, -1)]
    ranks = [("a", 1), ("a", 250), ("a", 500), ("a", 501), ("a", 0), ("b", 7), ("b", 59), (None, 1), (None, 3), ("none", 5)]
    df = spark.createDataFrame(rows, "g string, _h long")
    got = {(r["g"], r["rank"]): r["t"] for r in K.thresholds(df, ["g"], spark.createDataFrame(ranks, "g string, rank long")).collect()}
    want = plain(rows, ranks)
    for w, first in want.items():
        taken = sorted(h for g, h in rows if g == w[0] and got[w] is not None and h <= got[w])
        assert taken == first, w


def test_sizes_are_exact_and_nothing_is_sorted(spark):
    df = spark.range(5003).select(F.col("id").alias("point_id"), (F.col("id") % 7 == 0).cast("int").alias("label"))
    parts = R.split(df, [0.5, 0.3, 0.2])
    assert Counter(r["part"] for r in parts.collect()) == {0: 2502, 1: 1500, 2: 1001}
    folds = R.stratified_folds(df, 5, 2)
    n = folds.groupBy("repeat", "label", "fold").count().collect()
    assert len(n) == 20 and all(abs(r["count"] - {0: 4288, 1: 715}[r["label"]] / 5) < 1 for r in n)
    assert R.balance_union(df).count() == 2 * 715
    held = R.random_holdouts(df, 3).where("train").groupBy("split_id").count().collect()
    assert [r["count"] for r in held] == [int(0.7 * 5003)] * 3
    for out in (parts, folds, R.balance_union(df), R.random_holdouts(df, 3)):
        text = io.StringIO()
        with contextlib.redirect_stdout(text):
            out.explain()
        assert "Window" not in text.getvalue() and "Sort" not in text.getvalue()


def test_few_rows(spark):
    df = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "point_id long, label int")
    folds = R.stratified_folds(df, 5).collect()
    assert len(folds) == 3 and len({(r["label"], r["fold"]) for r in folds}) == 3
    assert R.stratified_folds(df.limit(0), 5).count() == R.split(df.limit(0), [0.5, 0.5]).count() == 0
    assert R.stratified_folds(df, 1).select("fold").distinct().collect()[0]["fold"] == 0


def test_random_points_keep_what_was_drawn(spark):
    got = R.random_points(spark, [0, 3], 40, lambda df: df.where("lat > 60"), factor=2)
    assert {r["age"]: r["count"] for r in got.groupBy("age").count().collect()} == {0: 40, 3: 40}
    assert got.select("point_id").distinct().count() == 80
    with pytest.raises(ValueError):
        R.random_points(spark, [0], 40, lambda df: df.where("lat > 89.99"))
