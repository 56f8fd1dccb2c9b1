"""Hand cases and properties that the oracle queries don't reach."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import evaluate as E
from tessera.operators import prepare as R
from tessera.operators import spatial as S
from tessera.operators import statistics as T
from tessera.plans.components import connected_components
from tessera.plans.fixtures import view
from tessera.plans.tables import new_path
from tessera.sources import files

SF = "/root/testdata/sf0.001"
POINT = "point_id long, age int, lon double, lat double"
TRENCH = "trench_id long, age int, lon double, lat double, rate double"


def km(a, b):
    p, q = math.radians(a[1]), math.radians(b[1])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    return 2 * 6371 * math.asin(math.sqrt(min(1, h)))


def test_nearest_across_the_date_line_at_the_poles_and_on_ties(spark):
    points = spark.createDataFrame([(1, 0, 179.9, 0.0), (2, 0, 10.0, 89.9), (3, 0, 0.0, 10.0), (4, 1, 0.0, 0.0), (5, 0, None, 0.0)], POINT)
    trench = spark.createDataFrame([(7, 0, -179.9, 0.0, 1.0), (8, 0, -170.0, 89.9, 2.0), (9, 0, 5.0, 10.0, 3.0), (6, 0, -5.0, 10.0, 4.0), (5, 0, None, 1.0, 5.0)], TRENCH)
    got = {r.point_id: r for r in S.nearest_trench(points, trench, 6.0).collect()}
    assert [got[k].trench_id for k in (1, 2, 3)] == [7, 8, 6]
    assert got[1].distance_to_trench_km == pytest.approx(km((179.9, 0), (-179.9, 0)))
    assert got[4].trench_id is None and got[5].trench_id is None and not got[4].valid
    assert len(got) == 5


@pytest.mark.parametrize("n", [3, 400])
def test_nearest_equals_brute_force(spark, n):
    rnd = random.Random(n)
    make = lambda: (rnd.uniform(-180, 180), math.degrees(math.asin(rnd.uniform(-1, 1))))
    # half of the targets crowd in one place
    places = [make() if i % 2 else (20 + rnd.random(), 30 + rnd.random()) for i in range(n)]
    here = [make() for _ in range(150)]
    points = spark.createDataFrame([(i, 0, *p) for i, p in enumerate(here)], POINT)
    targets = spark.createDataFrame([(i, 0, *p, 0.0) for i, p in enumerate(places)], TRENCH)
    got = {r.point_id: r._t.trench_id for r in S.nearest(points, targets, ["age"], "point_id", "trench_id").collect()}
    assert got == {i: min(range(n), key=lambda j: (round(km(p, places[j]), 6), j)) for i, p in enumerate(here)}


def test_polygon_edges_and_corners(spark):
    ring = spark.createDataFrame([(1, 1, 0, 0, s, float(x), float(y)) for s, (x, y) in enumerate([(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)])], "poly_id int, plate_id int, type_rank int, area_rank int, seq int, lon double, lat double")
    points = spark.createDataFrame([(1, 0, 5.0, 5.0), (2, 0, 0.0, 5.0), (3, 0, 10.0, 10.0), (4, 0, 11.0, 5.0), (5, 0, -5.0, 10.0), (6, 0, None, 1.0)], POINT)
    polys = S.rings(ring, ["plate_id", "type_rank", "area_rank"])
    inside = lambda b: sorted(r.point_id for r in S.points_in_polygons(points, polys, [], b).collect())
    assert inside(False) == [1] and inside(True) == [1, 2, 3]


def test_reconstruction_is_undone_by_its_inverse(spark):
    p, r = view(spark, SF, "fx_point"), view(spark, SF, "fx_rotation")
    there = S.reconstruct(p, r).select("point_id", "age", "plate_id", F.col("lon").alias("a"), F.col("lat").alias("b"), F.col("rec_lon").alias("lon"), F.col("rec_lat").alias("lat"))
    back = S.reconstruct(there, r, inverse=True).where("lon is not null")
    turn = F.pmod(F.col("rec_lon") - F.col("a") + 180, F.lit(360.0)) - 180
    assert back.where((F.abs(turn) > 1e-6) | (F.abs(F.col("rec_lat") - F.col("b")) > 1e-6)).count() == 0 and back.count() > 100


def test_windows_curves_and_areas(spark):
    t, s = view(spark, SF, "fx_trench"), view(spark, SF, "fx_score")
    grid = T.flux_grid(t, "sediment_m", 30.0)
    one, two = (T.cumulative_flux(grid, t, lag) for lag in (None, 9))
    assert one.join(two.withColumnRenamed("total", "b"), ["age", "i", "j"]).where(F.abs(F.col("total") - F.col("b")) > 1e-6).count() == 0
    curve = T.prediction_area_curve(s, s.where("label = 1"), "probability").orderBy("threshold").collect()
    assert all(a[k] >= b[k] for a, b in zip(curve, curve[1:]) for k in ("deposits_pct", "area_pct"))
    squared = s.withColumn("probability", F.col("probability") ** 3)
    assert E.rank_auc(s).first().auc == pytest.approx(E.rank_auc(squared).first().auc) == pytest.approx(E.roc_auc(s).first().auc)


def test_grids_and_clusters(spark):
    p = view(spark, SF, "fx_point").withColumns({"lon": F.round("lon"), "lat": F.round("lat")})
    exact = T.grid_exact(p, "f1", -180.0, -70.0, 2.0, "point_id", ["age"])
    near = T.grid_nearest(p, "f1", -180.0, -70.0, 2.0, (181, 71), "point_id", ["age"])
    assert exact.join(near, ["age", "i", "j"], "left_anti").count() == 0
    corr = spark.createDataFrame([("a", "b", 0.9), ("b", "a", 0.9), ("b", "c", -0.85), ("c", "b", -0.85), ("c", "d", 0.1), ("d", "c", 0.1), ("e", "e", 1.0)], "feature_a string, feature_b string, rho double")
    groups = {r.feature: r.cluster for r in T.feature_clusters(corr, 0.8).collect()}
    assert groups == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "e"}


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5, 5), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(301)} | {1000 + i: 1000 for i in range(200)}


def test_preparation_of_odd_columns(spark):
    df = spark.createDataFrame([(1, 0, None, 2.0), (2, 0, 4.0, 2.0), (3, 1, None, 2.0)], "point_id long, age int, x double, k double")
    assert {r.point_id: r.x for r in R.impute_median(df, ["x"]).collect()} == {1: 4.0, 2: 4.0, 3: 0.0}
    assert R.degenerate_columns(df) == ([], ["x", "k"])
    assert T.minmax_normalise(df, "k").first().k == 0.0
    with pytest.raises(ValueError):
        T.quantile_breaks(df.where("x > 9"), "x")
    assert T.quantile_breaks(df, "k", 2) == [2.0, 2.0, 2.0]


def test_samples_are_exact_and_stable(spark):
    df = spark.range(1000).select(F.col("id").alias("point_id"), (F.col("id") % 3 == 0).cast("int").alias("label"))
    folds = R.stratified_folds(df, 5).groupBy("label", "fold").count().collect()
    assert all(abs(r["count"] - (334 if r.label else 666) / 5) < 1 for r in folds) and len(folds) == 10
    parts = R.split(df, [0.8, 0.2])
    assert sorted(r["count"] for r in parts.groupBy("part").count().collect()) == [200, 800]
    again = R.split(df.repartition(7), [0.8, 0.2])
    assert parts.exceptAll(again).count() == 0
    assert R.balance_union(df).groupBy("label").count().select("count").distinct().count() == 1


def test_files_have_their_edges(spark):
    root = new_path(spark, "grids")
    grid = spark.createDataFrame([(1, 1.0), (180, 2.0)], "age int, value double")
    files.write_grid(grid, root, "carbonate_thickness")
    got = {r.age: r.value for r in files.read_grid(spark, root, "carbonate_thickness", None).collect()}
    assert got == {1: 1.0, 180: 0.0}
    with pytest.raises(FileNotFoundError):
        files.read_grid(spark, root, "carbonate_thickness", [1, 2])
    assert files.read_grid(spark, root, "absent", [1], required=False) is None


def test_running_sums_and_quantiles_equal_plain_ones(spark):
    from tessera.plans.ordered import quantiles, running_sums

    rnd = random.Random(12)
    rows = [(rnd.choice("ab"), k, rnd.randint(0, 9)) for k in range(500)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, k int, n int")
    got = {r.k: (r.up, r.own) for r in running_sums(running_sums(df, "k", {"n": "up"}), "k", {"n": "own"}, descending=True, within="g").collect()}
    for g, k, _ in rows:
        assert got[k] == (sum(n for _, j, n in rows if j <= k), sum(n for h, j, n in rows if h == g and j >= k))
    values = sorted(rnd.choice([rnd.random(), 0.25]) for _ in range(300))
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    shares = [0.0, 0.01, 0.25, 0.5, 0.777, 1.0]
    want = df.agg(F.percentile("v", F.array(*map(F.lit, shares))).alias("q")).first()["q"]
    assert quantiles(df, "v", shares) == pytest.approx(want)
    assert quantiles(df.where("v is null"), "v", [0.5]) is None


def test_basis_adds_up_to_one_at_both_ends(spark):
    from tessera.operators.preserve import bspline_basis

    df = spark.createDataFrame([(x,) for x in (1.0, 1.5, 2.2, 3.1, 3.5, 4.0)], "x double")
    total = sum(bspline_basis(F.col("x"), 1.5, 3.5), F.lit(0.0))
    assert all(r.t == pytest.approx(1.0) for r in df.select(total.alias("t")).collect())


def test_nearest_of_far_points_and_k_nearest_equal_brute_force(spark):
    rnd = random.Random(13)
    line = [(k, 0, -20 + 0.01 * k, 5 + 0.003 * k) for k in range(900)]
    points = [(k, 0, rnd.uniform(-180, 180), math.degrees(math.asin(rnd.uniform(-1, 1)))) for k in range(150)]
    p, t = spark.createDataFrame(points, POINT), spark.createDataFrame(line, "trench_id long, age int, lon double, lat double")
    got = {r.point_id: (r["_t"].trench_id, r.distance_km) for r in S.nearest(p, t, ["age"], "point_id", "trench_id").collect()}
    assert len(got) == 150
    for k, _, lon, lat in points:
        best = min((round(km((lon, lat), (x, y)), 6), j) for j, _, x, y in line)
        assert got[k][1] == pytest.approx(best[0], abs=1e-5) and got[k][0] == best[1]
    near = {}
    for r in S.nearest_k(p, t, 4, ["age"], "point_id", "trench_id").collect():
        near.setdefault(r.point_id, set()).add(r.trench_id)
    for k, _, lon, lat in points:
        far = lambda j: abs(line[j][2] - lon) + abs(line[j][3] - lat)  # noqa: B023, E731
        assert near[k] == set(sorted(range(900), key=lambda j: (far(j), j))[:4])
    few = t.where("trench_id < 3")
    assert S.nearest_k(p, few, 4, ["age"], "point_id", "trench_id").count() == 450


def test_random_points_are_as_many_as_asked_for_or_an_error(spark):
    got = R.random_points(spark, [0, 1], 7, lambda df: df.where("lon > 170"))
    assert sorted(r["count"] for r in got.groupBy("age").count().collect()) == [7, 7]
    with pytest.raises(ValueError):
        R.random_points(spark, [0], 3, lambda df: df.where("lon > 500"))


def test_shapley_values_add_up_and_equal_the_definition(spark):
    from itertools import permutations

    from tessera.operators import model as M

    rnd = random.Random(14)
    rows = [(k, float(rnd.random()), float(rnd.random()), float(rnd.random()), 1.0) for k in range(300)]
    rows = [(*r, int(r[1] + r[2] * r[3] > 0.8)) for r in rows]
    df = spark.createDataFrame(rows, "point_id long, a double, b double, c double, weight double, label int")
    names = ["a", "b", "c"]
    forest = M.fit_forest(df, names, trees=5, depth=3)
    few = df.where("point_id < 6")
    got = {(r.point_id, r.feature): r.attribution for r in M.shapley(few, df, forest, names).collect()}
    base = {f: sorted(r[i + 1] for r in rows)[149:151] for i, f in enumerate(names)}
    base = {f: sum(v) / 2 for f, v in base.items()}
    cases = [(k, s, *[rows[k][i + 1] if s >> i & 1 else base[f] for i, f in enumerate(names)], 1.0) for k in range(6) for s in range(8)]
    score = {(r.point_id, r.s): r.probability for r in M.probability(spark.createDataFrame(cases, "point_id long, s int, a double, b double, c double, weight double"), forest, names).collect()}
    for k in range(6):
        for i, f in enumerate(names):
            gains = [score[k, sum(1 << j for j in o[: o.index(i) + 1])] - score[k, sum(1 << j for j in o[: o.index(i)])] for o in permutations(range(3))]
            assert got[k, f] == pytest.approx(sum(gains) / 6)


def test_k_nearest_of_many_at_one_place(spark):
    """Targets that share places are met as one: each place stands for its k smallest ids."""
    t = spark.range(40_000).selectExpr("id AS trench_id", "0 AS age", "CAST(id % 4 AS DOUBLE) AS lon", "CAST(id % 2 AS DOUBLE) AS lat")
    p = spark.createDataFrame([(k, 0, 0.1 + k % 3, 0.2) for k in range(3000)], POINT)
    got = {}
    for r in S.nearest_k(p, t, 3, ["age"], "point_id", "trench_id").collect():
        got.setdefault(r.point_id, set()).add(r.trench_id)
    places = {(k % 4, k % 2): sorted(range(k, 20, 4)) for k in range(4)}
    for x in range(3):
        best = sorted((abs(u - x - 0.1) + abs(v - 0.2), i) for (u, v), ids in places.items() for i in ids)
        assert all(got[k] == {i for _, i in best[:3]} for k in range(3000) if k % 3 == x)


def test_isotonic_fit_takes_each_score_once(spark, monkeypatch):
    from tessera.operators import model as M

    seen = []
    fit = M.IsotonicRegression.fit
    monkeypatch.setattr(M.IsotonicRegression, "fit", lambda self, df: seen.append(df.count()) or fit(self, df))
    rows = spark.range(5000).selectExpr("id AS point_id", "CAST(id % 7 AS DOUBLE) / 7 AS probability", "CAST(id * 31 % 100 < 10 + 10 * (id % 7) AS INT) AS label", "CAST(id % 3 AS DOUBLE) AS weight")
    fitted = M.calibrate_isotonic(rows)
    plain = fit(M.IsotonicRegression(featuresCol="probability", labelCol="label", weightCol="weight", predictionCol="calibrated"), rows.selectExpr("probability", "CAST(label AS DOUBLE) AS label", "weight"))
    got, want = ([(r.probability, r.calibrated) for r in m.transform(rows.limit(50)).orderBy("point_id").collect()] for m in (fitted, plain))
    assert seen == [7] and all(a == b and x == pytest.approx(y) for (a, x), (b, y) in zip(got, want))
