import random

import pytest

from tessera.operators import evaluate as E
from tessera.operators import spatial as S


def plain_auc(scores, hits):
    """The share of pairs of a hit and a miss that are in order, ties counting half."""
    a, b = [s for s, h in zip(scores, hits) if h], [s for s, h in zip(scores, hits) if not h]
    return sum((x > y) + (x == y) / 2 for x in a for y in b) / (len(a) * len(b))


def test_areas_of_classes_and_their_mean(spark):
    rnd = random.Random(1)
    rows = [(rnd.randint(0, 2), *[round(rnd.random(), 1) for _ in range(3)]) for _ in range(300)]
    df = spark.createDataFrame(rows, "label int, a double, b double, d double")
    got = {r["class"]: r["auc"] for r in E.auc_by_class(df, {0: "a", 1: "b", 2: "d"}).collect()}
    want = {k: plain_auc([r[k + 1] for r in rows], [r[0] == k for r in rows]) for k in range(3)}
    assert got == pytest.approx(want | {None: sum(want.values()) / 3})
    curve = E.roc_by_class(df, {0: "a", 1: "b", 2: "d"}).where("class = 1").orderBy("threshold").collect()
    assert len(curve) == len({r[2] for r in rows}) and (curve[0]["tpr"], curve[0]["fpr"]) == (1.0, 1.0)


def test_a_class_without_rows_has_no_area(spark):
    df = spark.createDataFrame([(0, 0.2), (1, 0.7)], "label int, a double")
    got = {r["class"]: r["auc"] for r in E.auc_by_class(df, {0: "a", 1: "a", 5: "a"}).collect()}
    assert got == {0: 0.0, 1: 1.0, 5: None, None: 0.5}


def test_wide_positions(spark):
    steps = spark.createDataFrame([(1, 0, 1.0, 2.0), (1, 1, 3.0, 4.0), (2, 0, 5.0, None)], "point_id long, t int, lon_t double, lat_t double")
    got = {r["point_id"]: (r["lon_0"], r["lat_0"], r["lon_1"], r["lat_1"]) for r in S.wide_positions(steps, [0, 1], []).collect()}
    assert got == {1: (1.0, 2.0, 3.0, 4.0), 2: (5.0, None, None, None)}
