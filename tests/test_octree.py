"""The octree join: crowds, far points, ages of their own density, repeated places, empty tables."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import octree as O

POINT = "point_id long, age int, lon double, lat double"
TARGET = "tid long, age int, lon double, lat double"


def km(a, b):
    p, q = math.radians(a[1]), math.radians(b[1])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    return 2 * 6371 * math.asin(math.sqrt(min(1, h)))


def anywhere(rnd):
    return rnd.uniform(-180, 180), math.degrees(math.asin(rnd.uniform(-1, 1)))


def brute(points, targets):
    out = {}
    for i, age, *p in points:
        near = [(round(km(p, t[2:]), 6), t[0]) for t in targets if t[1] == age]
        if near:
            out[i] = min(near)[1]
    return out


@pytest.fixture(scope="module")
def crowd():
    """Nine targets of ten within some hundred metres, in one of two ages; points near, beside and far."""
    rnd = random.Random(5)
    targets = []
    for i in range(3000):
        if i % 3 == 0:
            place = anywhere(rnd)
        else:
            place = (40 + rnd.gauss(0, 1e-3), 20 + rnd.gauss(0, 1e-3))
        targets.append((i, 0 if i % 10 else 1, *(place if i % 10 else anywhere(rnd))))
    points = [(i, i % 3, *anywhere(rnd)) for i in range(150)]
    points += [(150 + i, 0, 40 + rnd.gauss(0, 10.0 ** -(i % 5)), 20 + rnd.gauss(0, 10.0 ** -(i % 5))) for i in range(150)]
    return points, targets


def test_equals_brute_force_around_a_crowd(spark, crowd):
    points, targets = crowd
    got = O.nearest_ids(spark.createDataFrame(points, POINT), spark.createDataFrame(targets, TARGET), ["age"], "point_id", "tid")
    got = {r.point_id: (r.tid, r.distance_km) for r in got.collect()}
    want = brute(points, targets)
    assert {i: t for i, (t, _) in got.items()} == want
    place = {t[0]: t[2:] for t in targets}
    assert all(d == pytest.approx(km(points[i][2:], place[t]), abs=1e-6) for i, (t, d) in got.items())
    assert not any(points[i][1] == 2 for i in got)  # an age without targets


def test_no_cube_holds_a_crowd_and_sides_differ(spark, crowd):
    _, targets = crowd
    tree, depth = O.octree(spark.createDataFrame(targets, TARGET), ["age"], "tid")
    leaves = tree.where("not _open").groupBy("age", "_level", *O.CUBE).count().collect()
    assert max(r["count"] for r in leaves) <= O.LEAF
    assert sum(r["count"] for r in leaves) == len(targets)
    levels = lambda age: {r._level for r in leaves if r.age == age}
    assert max(levels(0)) > max(levels(1)) + 3 and min(levels(0)) <= max(levels(1)) <= depth
    # leaves and split cubes are disjoint: each cube is one or the other
    assert tree.groupBy("age", "_level", *O.CUBE).agg(F.count_distinct("_open").alias("n")).where("n > 1").count() == 0
    assert tree.where("_open").groupBy("age", "_level", *O.CUBE).count().where("count > 1").count() == 0


def test_no_task_gets_the_crowd(spark):
    """Nine targets of ten lie in one of the cubes that the mean density would give: tasks stay alike."""
    rnd = random.Random(8)
    targets = [(i, 0, *(anywhere(rnd) if i % 10 == 0 else (40 + rnd.random(), 20 + rnd.random()))) for i in range(20000)]
    tree, _ = O.octree(spark.createDataFrame(targets, TARGET), ["age"], "tid")
    dealt = tree.repartition(8, "age", "_level", *O.CUBE).groupBy(F.spark_partition_id()).count().collect()
    sizes = sorted(r["count"] for r in dealt)
    assert len(sizes) == 8 and sizes[-1] <= 3 * sizes[4]


def test_a_point_outside_a_crowd_does_not_meet_all_of_it(spark, monkeypatch):
    """The rows that the steps leave for points far from a crowd don't grow with it."""
    rnd, left, write = random.Random(9), [], O.materialise

    def counting(df, name):
        out = write(df, name)
        if name == "step":
            left.append(out.count())
        return out

    monkeypatch.setattr(O, "materialise", counting)
    points = [(i, 0, -100.0 + i, -20.0) for i in range(20)]
    sums = []
    for n in (500, 8000):
        left.clear()
        rows = [(i, 0, 40 + rnd.random(), 20 + rnd.random()) for i in range(n)]
        got = O.nearest_ids(spark.createDataFrame(points, POINT), spark.createDataFrame(rows, TARGET), ["age"], "point_id", "tid")
        assert {r.point_id: r.tid for r in got.collect()} == brute(points, rows)
        sums.append(sum(left))
    assert sums[1] <= 4 * sums[0]


def test_repeated_places_ties_poles_and_the_date_line(spark):
    targets = [(9, 0, 10.0, 0.0), *[(100 + i, 0, 10.0, 0.0) for i in range(200)], (4, 0, -10.0, 0.0), (5, 0, 180.0, 0.0), (6, 0, 0.0, 90.0), (7, 0, 90.0, -90.0)]
    points = [(1, 0, 0.0, 0.0), (2, 0, 11.0, 0.0), (3, 0, -179.5, 0.0), (4, 0, 123.0, 89.0), (5, 0, -50.0, -90.0), (6, 1, 0.0, 0.0)]
    make = lambda rows, s: spark.createDataFrame(rows, s)
    got = {r.point_id: r.tid for r in O.nearest_ids(make(points, POINT), make(targets, TARGET), ["age"], "point_id", "tid").collect()}
    assert got == {1: 4, 2: 9, 3: 5, 4: 6, 5: 7}
    assert O.nearest_ids(make(points, POINT), make([], TARGET), ["age"], "point_id", "tid").count() == 0
    assert O.nearest_ids(make([], POINT), make(targets, TARGET), ["age"], "point_id", "tid").count() == 0
