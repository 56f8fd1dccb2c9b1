import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import polygons as G

POINT, RING = "point_id long, age int, lon double, lat double", "poly_id int, age int, ring array<struct<lon: double, lat: double>>"


def plain(lon, lat, ring):
    """Even-odd rule over edges that run the shorter way, at the point and whole turns away from it."""
    x, out = ring[0][0], [tuple(ring[0])]
    for (a, _), (b, lat_b) in zip(ring, ring[1:]):
        d = b - a
        x += d - 360 if d > 180 else d + 360 if d < -180 else d
        out.append((x, lat_b))
    if abs(out[-1][0] - out[0][0]) > 180:
        pole = -91 if sum(v[1] for v in ring[:-1]) < 0 else 91
        out += [(out[-1][0], pole), (out[0][0], pole), out[0]]
    odd = False
    for turn in (-720, -360, 0, 360, 720):
        px = lon + turn
        for (x1, y1), (x2, y2) in zip(out, out[1:]):
            if (x1 > px) != (x2 > px) and y1 + (px - x1) / (x2 - x1) * (y2 - y1) > lat:
                odd = not odd
    return odd


def scene():
    rnd = random.Random(9)
    rings = {
        1: [(170, -20), (-160, -20), (-160, 30), (170, 30), (170, -20)],  # over the date line
        2: [(-180, 60), (-90, 70), (0, 55), (90, 65), (180, 60)],  # round the north pole
        3: [(x, -65 + 5 * math.sin(x)) for x in range(-180, 181, 10)],  # round the south pole
        4: [(-180, -75), (0, -72), (180, -75), (180, -90), (-180, -90), (-180, -75)],  # the same, by way of the pole
        5: [(350 + 20 * math.cos(k), 20 * math.sin(k)) for k in [2 * math.pi * i / 500 for i in range(500)]],  # over 360
        6: [(-60 + (8 + 5 * math.sin(9 * k)) * math.cos(k), 10 + (8 + 5 * math.sin(9 * k)) * math.sin(k)) for k in [2 * math.pi * i / 700 for i in range(700)]],
        7: [(10, 10), (12, 10), (12, 10.001), (10, 10.001), (10, 10)],
        8: [(40, 0), (60, 0), (60, 20), (40, 20), (50, 10), (40, 0)],  # concave
        9: [(5, 5)],
        10: [(1e-4, 1e-4), (2e-4, 1e-4), (1.5e-4, 2e-4), (1e-4, 1e-4)],
    }
    for k in (5, 6):
        rings[k].append(rings[k][0])
    points = [(rnd.uniform(-180, 180), math.degrees(math.asin(rnd.uniform(-1, 1)))) for _ in range(1500)]
    points += [(180.0, 0.0), (-180.0, 0.0), (179.9, 12.3), (-179.9, 12.3), (0.0, 90.0), (77.7, -90.0), (180.0, -80.0), (11.0, 10.0005), (1.5e-4, 1.5e-4), (350.0, 0.0), (-10.0, 0.0), (45.0, 10.0), (55.0, 10.0)]
    points += [(rnd.uniform(-75, -45), rnd.uniform(-5, 25)) for _ in range(600)]
    return points, rings


@pytest.mark.parametrize("most", [5, 12])
def test_rings_over_the_date_line_and_the_poles(spark, most):
    points, rings = scene()
    p = spark.createDataFrame([(k, k % 2, *map(float, x)) for k, x in enumerate(points)] + [(-1, 0, None, 3.0), (-2, 0, 3.0, None)], POINT)
    r = spark.createDataFrame([(k, 0, [tuple(map(float, v)) for v in ring]) for k, ring in rings.items()], RING)
    got = sorted((x["point_id"], x["_p"]["poly_id"]) for x in G.polygon_matches(p, r, [], most=most).collect())
    want = sorted((k, i) for k, x in enumerate(points) for i, ring in rings.items() if len(ring) > 1 and plain(*x, ring))
    assert got == want and {i for _, i in want} >= {1, 2, 3, 4, 5, 6, 8}
    if most == 12:
        keyed = sorted((x["point_id"], x["_p"]["poly_id"]) for x in G.polygon_matches(p, r, ["age"]).collect())
        assert keyed == [x for x in want if x[0] % 2 == 0]
        assert G.polygon_matches(p, r.limit(0), []).count() == G.polygon_matches(p.limit(0), r, []).count() == 0


def test_boundary_counts_if_asked(spark):
    points = [(0, 1.0, 0.0), (1, 0.0, 0.0), (2, 1.0, 1.0), (3, 2.0, 1.0), (4, 180.0, 5.0), (5, -180.0, 5.0), (6, 3.0, 1.0)]
    p = spark.createDataFrame(points, "point_id long, lon double, lat double")
    r = spark.createDataFrame([(1, 0, [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0)]), (2, 0, [(170.0, 0.0), (180.0, 0.0), (180.0, 10.0), (170.0, 10.0), (170.0, 0.0)])], RING)
    held = lambda b: sorted(x["point_id"] for x in G.points_in_polygons(p, r, [], b).collect())
    assert held(False) == [2] and held(True) == [0, 1, 2, 3, 4, 5]


def test_a_long_ring_is_copied_into_no_cell(spark):
    n = 100_000
    ring = f"transform(sequence(0, {n}), k -> struct(30 * cos(2 * pi() * (k % {n}) / {n}) AS lon, 30 * sin(2 * pi() * (k % {n}) / {n}) AS lat))"
    r = spark.range(1).select(F.lit(1).alias("poly_id"), F.lit(0).alias("age"), F.expr(ring).alias("ring"))
    found, levels = G.cells(r, "poly_id")
    size = found.select(F.max(F.size("edges")).alias("most"), F.sum(F.size("edges")).alias("all")).first()
    assert size["most"] <= G.MOST and size["all"] < 2 * n and len(levels) > 3
    p = spark.range(20000).selectExpr("id AS point_id", "(id * 7919) % 7200 / 100.0 - 36 AS lon", "(id * 104729) % 7200 / 100.0 - 36 AS lat").selectExpr("point_id", "CAST(lon AS DOUBLE) AS lon", "CAST(lat AS DOUBLE) AS lat")
    far = F.sqrt(F.col("lon") ** 2 + F.col("lat") ** 2)
    got = {x["point_id"] for x in G.polygon_matches(p, r, []).select("point_id").collect()}
    sure = {x["point_id"] for x in p.where(far < 30 - 1e-6).collect()}
    never = {x["point_id"] for x in p.where(far > 30).collect()}
    assert sure <= got and not never & got


@pytest.mark.parametrize("most", [5, 12])
def test_topmost_polygon_without_the_ones_below(spark, most):
    points, rings = scene()
    p = spark.createDataFrame([(k, k % 2, *map(float, x)) for k, x in enumerate(points)] + [(-1, 0, None, 3.0), (-2, 0, 3.0, None)], POINT)
    r = spark.createDataFrame([(k, 0, [tuple(map(float, v)) for v in ring]) for k, ring in rings.items()], RING)
    want = {}
    for k, x in enumerate(points):
        want[k] = max((i * 7 % 11, i) for i in [*(i for i, ring in rings.items() if len(ring) > 1 and plain(*x, ring)), 0])[1]
    got = {x["point_id"]: x["poly_id"] or 0 for x in G.top_polygon(p, r, [], ["poly_id"], [F.col("poly_id") * 7 % 11], most=most).select("point_id", "_top.poly_id").collect()}
    assert got == want | {-1: 0, -2: 0}
    keyed = G.top_polygon(p, r, ["age"], ["poly_id"], [F.col("poly_id") * 7 % 11], most=most).select("point_id", "_top.poly_id").collect()
    assert {x["point_id"]: x["poly_id"] or 0 for x in keyed} == {k: v if k % 2 == 0 else 0 for k, v in got.items()}
    assert G.top_polygon(p, r.limit(0), [], ["poly_id"]).where("_top is null").count() == len(points) + 2 and G.top_polygon(p.limit(0), r, [], []).count() == 0


def test_polygons_upon_each_other_leave_few_in_a_cell(spark):
    """However many lie there, a cell holds those above the topmost that holds all of it."""
    r = spark.range(3000).selectExpr("CAST(id AS INT) AS poly_id", "id * 7919 % 400 / 10.0D AS x", "id * 104729 % 400 / 10.0D AS y", "3.0D + id % 7 AS w")
    corner = lambda x, y: f"named_struct('lon', {x}, 'lat', {y})"
    ring = [corner("x - w", "y"), corner("x", "y - w"), corner("x + w", "y"), corner("x", "y + w"), corner("x - w", "y")]
    r = r.withColumn("ring", F.expr(f"array({', '.join(ring)})"))
    p = spark.range(3000).selectExpr("id AS point_id", "id * 6007 % 5000 / 100.0D - 5 + 0.00371D AS lon", "id * 3571 % 4999 / 100.0D - 5 + 0.0017D AS lat")
    known = r.selectExpr("CAST(poly_id AS LONG) AS _key", "named_struct('a', poly_id) AS _rank", "named_struct('a', poly_id) AS _p", "ring")
    found, levels = G.top_cells(known, [])
    size = found.select(F.avg(F.size("_list")).alias("mean"), F.sum(F.size("_list")).alias("all")).first()
    assert size["mean"] < 6 and size["all"] < 20000  # all cells of all polygons are more than 50 000
    got = {x["point_id"]: x["poly_id"] for x in G.top_polygon(p, r, [], ["poly_id"], [F.col("poly_id")]).select("point_id", "_top.poly_id").collect()}
    want = p.join(r, F.abs(p.lon - r.x) + F.abs(p.lat - r.y) < r.w, "left").groupBy("point_id").agg(F.max("poly_id").alias("top"))
    want = {x["point_id"]: x["top"] for x in want.collect()}
    assert got == want and sum(v is not None for v in want.values()) > 2000
    assert {x["point_id"] for x in G.points_in_polygons(p, r, []).collect()} == {k for k, v in want.items() if v is not None}
