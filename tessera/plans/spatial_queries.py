"""Queries of the joins on the sphere (C*, W9, I1, I2) and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import physics as P
from tessera.operators import prepare as R
from tessera.operators import spatial as S
from tessera.operators import statistics as T
from tessera.operators import subduction as U
from tessera.plans.registry import query
from tessera.plans.tables import materialise

c = F.col


def hav(a: str, b: str) -> str:
    return f"(2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2)))))"


def xyz(a: str) -> list[str]:
    return [f"cos(radians({a}.lat)) * cos(radians({a}.lon))", f"cos(radians({a}.lat)) * sin(radians({a}.lon))", f"sin(radians({a}.lat))"]


def near_sql(points: str, cells: str, pid: str, cid: str, on: str, extra: str = "true") -> str:
    """All pairs of equal keys, the nearest first."""
    return f"""SELECT p.{pid} AS pid, t.*, {hav('p', 't')} AS km, row_number() OVER (PARTITION BY p.{pid} ORDER BY round({hav('p', 't')}, 6), t.{cid}) AS rn
  FROM {points} p JOIN {cells} t ON {on} WHERE {extra}"""


NEAREST = f"WITH n AS ({near_sql('fx_point', 'fx_trench', 'point_id', 'trench_id', 'p.age = t.age')})"
FLUX = "CASE WHEN n.sediment_m * n.conv_rate_orth_cm_yr IS NULL THEN NULL ELSE greatest(n.sediment_m * n.conv_rate_orth_cm_yr * 0.01, 0.0) END"


@query("flagship_flux_by_age", "fx_point", "fx_trench", sql=f"""{NEAREST}
SELECT age, CAST(count(*) AS BIGINT) AS n, round(avg(km), 3) AS mean_km, round(avg({FLUX}), 5) AS mean_flux, round(stddev_samp({FLUX}), 5) AS std_flux
FROM n WHERE rn = 1 GROUP BY age""")
def flagship(p, t):
    both = S.nearest_trench(p.select("point_id", "age", "lon", "lat"), t)
    both = both.withColumn("flux", P.material_flux(c("sediment_m"), c("conv_rate_orth_cm_yr")))
    out = both.groupBy("age").agg(F.count("*").alias("n"), F.avg("distance_to_trench_km").alias("k"), F.avg("flux").alias("m"), F.stddev_samp("flux").alias("s"))
    return out.select("age", "n", F.round("k", 3).alias("mean_km"), F.round("m", 5).alias("mean_flux"), F.round("s", 5).alias("std_flux"))


@query("c01_nearest_trench", "fx_point", "fx_trench", sql=f"""{NEAREST}
SELECT pid AS point_id, trench_id, conv_rate_orth_cm_yr, round(km, 3) AS km, km <= radians(6.0) * 6371.0 AS valid FROM n WHERE rn = 1""")
def c01_nearest_trench(p, t):
    out = S.nearest_trench(p, t, 6.0)
    return out.select("point_id", "trench_id", "conv_rate_orth_cm_yr", F.round("distance_to_trench_km", 3).alias("km"), "valid")


def mean_sql(pid: str, points: str, on: str, deg: str, fallback: bool = True) -> str:
    """Radius mean with fallback over fx_cell; the chord decides as in the library."""
    p, t = xyz("p"), xyz("t")
    d2 = " + ".join(f"pow({a} - {b}, 2)" for a, b in zip(p, t))
    return f"""WITH q AS (SELECT p.{pid} AS pid, t.z, t.cell_id, {hav('p', 't')} AS km, {d2} AS d2 FROM {points} p JOIN fx_cell t ON {on} WHERE t.z IS NOT NULL),
  m AS (SELECT pid, avg(z) AS z FROM q WHERE d2 <= pow(2 * sin(radians({deg}) / 2), 2) * (1 + 1e-12) GROUP BY pid),
  f AS (SELECT pid, arg_min(z, (round(km, 6), cell_id)) AS z FROM q GROUP BY pid)
  SELECT p.{pid}, round({'coalesce(m.z, f.z)' if fallback else 'm.z'}, 4) AS value FROM {points} p LEFT JOIN m ON m.pid = p.{pid} LEFT JOIN f ON f.pid = p.{pid}"""


@query("c02_plate_radius_mean", "fx_trench", "fx_cell", sql=mean_sql("trench_id", "fx_trench", "p.age = t.age AND p.plate_id = t.plate_id", "6.0"))
def c02_plate_radius_mean(t, g):
    return S.radius_mean(t, g, 6.0, ["age", "plate_id"], "v", "trench_id").select("trench_id", F.round("v", 4).alias("value"))


@query("c03_radius_mean", "fx_trench", "fx_cell", sql=mean_sql("trench_id", "fx_trench", "p.age = t.age", "2.0"))
def c03_radius_mean(t, g):
    return S.radius_mean(t, g, 2.0, ["age"], "v", "trench_id").select("trench_id", F.round("v", 4).alias("value"))


@query("c04_radius_mean_present", "fx_trench", "fx_cell", sql=mean_sql("trench_id", "(SELECT trench_id, age, -lon AS lon, -lat AS lat FROM fx_trench)", "p.age = t.age", "2.0"))
def c04_radius_mean_present(t, g):
    here = t.select("trench_id", "age", (-c("lon")).alias("present_lon"), (-c("lat")).alias("present_lat"))
    return S.radius_mean(here, g, 2.0, ["age"], "v", "trench_id", lon="present_lon", lat="present_lat").select("trench_id", F.round("v", 4).alias("value"))


@query("c05_sample_filled", "fx_trench", "fx_cell", sql=f"""WITH n AS ({near_sql('fx_trench', 'fx_cell', 'trench_id', 'cell_id', 'p.age = t.age AND p.plate_id = t.plate_id', 't.z IS NOT NULL')})
SELECT pid AS trench_id, cell_id, z FROM n WHERE rn = 1""")
def c05_sample_filled(t, g):
    found = S.nearest(t, g.where("z IS NOT NULL"), ["age", "plate_id"], "trench_id", "cell_id")
    return found.select("trench_id", c("_t.cell_id").alias("cell_id"), c("_t.z").alias("z"))


GRID10 = "g AS (SELECT age, CAST(floor((lon + 180) / 10) AS INT) AS i, CAST(floor((lat + 70) / 10) AS INT) AS j, avg(z) AS value FROM fx_cell GROUP BY ALL)"


def grid10(cells):
    i, j = S.grid_index(c("lon"), c("lat"), -180.0, -70.0, 10.0)
    return cells.groupBy("age", i.alias("i"), j.alias("j")).agg(F.avg("z").alias("value"))


@query("c06_resample_grid", "fx_cell", sql=f"""
WITH {GRID10}, t AS (SELECT a.age, x.i, y.j, (x.i + 0.5) * 36 / 24 - 0.5 AS u, least(greatest((y.j + 0.5) * 14 / 10 - 0.5, 0.0), 13.0) AS v
  FROM (SELECT DISTINCT age FROM g) a CROSS JOIN range(24) x(i) CROSS JOIN range(10) y(j)),
k AS (SELECT age, i, j, ((CAST(floor(u) AS INT) + di + 36) % 36) AS ci, least(CAST(floor(v) AS INT) + dj, 13) AS cj,
  (CASE WHEN di = 1 THEN u - floor(u) ELSE 1 - (u - floor(u)) END) * (CASE WHEN dj = 1 THEN v - floor(v) ELSE 1 - (v - floor(v)) END) AS w
  FROM t CROSS JOIN (VALUES (0), (1)) a(di) CROSS JOIN (VALUES (0), (1)) b(dj))
SELECT k.age, CAST(k.i AS INT) AS i, CAST(k.j AS INT) AS j, round(CASE WHEN count(g.value) = count(*) THEN sum(g.value * w) END, 4) AS value
FROM k LEFT JOIN g ON g.age = k.age AND g.i = ci AND g.j = cj WHERE w > 0 GROUP BY k.age, k.i, k.j""")
def c06_resample_grid(g):
    return S.resample_regular(grid10(g), (36, 14), (24, 10), ["age"]).select("age", "i", "j", F.round("value", 4).alias("value"))


@query("c07_sample_grid", "fx_point", "fx_cell", sql=f"""
WITH {GRID10}, t AS (SELECT point_id, age, (lon + 175) / 10 AS u, least(greatest((lat + 65) / 10, 0.0), 13.0) AS v FROM fx_point),
k AS (SELECT point_id, age, ((CAST(floor(u) AS INT) + di + 36) % 36) AS ci, least(CAST(floor(v) AS INT) + dj, 13) AS cj,
  (CASE WHEN di = 1 THEN u - floor(u) ELSE 1 - (u - floor(u)) END) * (CASE WHEN dj = 1 THEN v - floor(v) ELSE 1 - (v - floor(v)) END) AS w
  FROM t CROSS JOIN (VALUES (0), (1)) a(di) CROSS JOIN (VALUES (0), (1)) b(dj)),
l AS (SELECT k.point_id, CASE WHEN count(g.value) = count(*) THEN sum(g.value * w) END AS value FROM k LEFT JOIN g ON g.age = k.age AND g.i = ci AND g.j = cj WHERE w > 0 GROUP BY k.point_id)
SELECT t.point_id, round(g.value, 4) AS nearest, round(l.value, 4) AS linear FROM t JOIN l USING (point_id)
LEFT JOIN g ON g.age = t.age AND g.i = (CAST(floor(u + 0.5) AS INT) + 36) % 36 AND g.j = CAST(floor(v + 0.5) AS INT)""")
def c07_sample_grid(p, g):
    cells = grid10(g)
    p = p.select("point_id", "age", "lon", "lat")
    one = S.sample_regular(p, cells, -175.0, -65.0, 10.0, 36, 14, ["age"], "nearest", "nearest")
    both = S.sample_regular(one, cells, -175.0, -65.0, 10.0, 36, 14, ["age"], "linear", "linear")
    return both.select("point_id", F.round("nearest", 4).alias("nearest"), F.round("linear", 4).alias("linear"))


EDGES = "e AS (SELECT poly_id, plate_id, type_rank, area_rank, lon AS x1, lat AS y1, lead(lon) OVER w AS x2, lead(lat) OVER w AS y2 FROM fx_ring WINDOW w AS (PARTITION BY poly_id ORDER BY seq))"


def inside_sql(points: str, pid: str, boundary: bool = False) -> str:
    """(pid, polygon columns) of each polygon that holds a point."""
    cross = f"((x2 - x1) * ({points}.lat - y1) - ({points}.lon - x1) * (y2 - y1))"
    on = f"max(CASE WHEN {cross} = 0 AND {points}.lon BETWEEN least(x1, x2) AND greatest(x1, x2) AND {points}.lat BETWEEN least(y1, y2) AND greatest(y1, y2) THEN 1 ELSE 0 END)"
    odd = f"sum(CASE WHEN ((y1 > {points}.lat) <> (y2 > {points}.lat)) AND (({cross} > 0) = (y2 > y1)) THEN 1 ELSE 0 END) % 2 = 1"
    test = f"({odd} OR {on} = 1)" if boundary else f"({odd} AND {on} = 0)"
    return f"SELECT {points}.{pid}, e.poly_id, e.plate_id AS poly_plate, e.type_rank, e.area_rank FROM {points} CROSS JOIN e WHERE x2 IS NOT NULL GROUP BY ALL HAVING {test}"


def polygons(ring):
    return S.rings(ring, ["plate_id", "type_rank", "area_rank"])


@query("c08_points_in_polygons", "fx_point", "fx_ring", sql=f"""
WITH {EDGES}, a AS (SELECT DISTINCT point_id FROM ({inside_sql('fx_point', 'point_id')})), b AS (SELECT DISTINCT point_id FROM ({inside_sql('fx_point', 'point_id', True)}))
SELECT point_id, 'within' AS kind FROM a UNION ALL SELECT point_id, 'intersects' FROM b""")
def c08_points_in_polygons(p, r):
    within = S.points_in_polygons(p, polygons(r), []).select("point_id", F.lit("within").alias("kind"))
    return within.union(S.points_in_polygons(p, polygons(r), [], True).select("point_id", F.lit("intersects").alias("kind")))


PLATE = f"""{EDGES}, h AS ({inside_sql('fx_point', 'point_id')}), a AS (SELECT point_id, arg_max(poly_plate, (type_rank, area_rank)) AS plate FROM h WHERE poly_id < 3 GROUP BY point_id),
b AS (SELECT point_id, arg_max(poly_plate, (type_rank, area_rank)) AS plate FROM h GROUP BY point_id)"""


@query("c09_assign_plate", "fx_point", "fx_ring", sql=f"WITH {PLATE} SELECT p.point_id, CAST(coalesce(a.plate, b.plate, -1) AS INT) AS plate_id FROM fx_point p LEFT JOIN a USING (point_id) LEFT JOIN b USING (point_id)")
def c09_assign_plate(p, r):
    return S.assign_plate(p, polygons(r).where("poly_id < 3"), polygons(r), []).select("point_id", "plate_id")


ELIGIBLE = "SELECT * FROM fx_segment WHERE over_plate NOT IN (-1, 0) AND polarity NOT IN ('None', 'Unknown') AND lower(type) NOT LIKE '%slab edge%' AND lower(name) NOT LIKE '%flat slab%'"


def _cross(u, v):
    return [f"(({u[1]}) * ({v[2]}) - ({u[2]}) * ({v[1]}))", f"(({u[2]}) * ({v[0]}) - ({u[0]}) * ({v[2]}))", f"(({u[0]}) * ({v[1]}) - ({u[1]}) * ({v[0]}))"]


def _dot(u, v):
    return "(" + " + ".join(f"({a}) * ({b})" for a, b in zip(u, v)) + ")"


_A, _B, _N, _V = ([f"{v}_{k}" for k in "xyz"] for v in "abnv")
_ENDS = [f"2 * asin(sqrt(least(1.0, pow(sin(radians(s.lat{k} - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(s.lat{k})) * pow(sin(radians(s.lon{k} - p.lon) / 2), 2))))" for k in "12"]
def zone_sql(points: str) -> str:
    return f"""s AS (SELECT *, {', '.join(f'{x} AS a_{k}, {y} AS b_{k}' for k, x, y in zip('xyz', [z.replace('q.lon', 'lon1').replace('q.lat', 'lat1') for z in xyz('q')], [z.replace('q.lon', 'lon2').replace('q.lat', 'lat2') for z in xyz('q')]))} FROM ({ELIGIBLE})),
s2 AS (SELECT *, {', '.join(f'{x} AS n_{k}' for k, x in zip('xyz', _cross(_A, _B)))} FROM s),
v AS (SELECT *, {', '.join(f'{x} AS v_{k}' for k, x in zip('xyz', [z.replace('q.lon', 'lon').replace('q.lat', 'lat') for z in xyz('q')]))} FROM {points}),
h AS (SELECT p.point_id, p.plate_id, s.segment_id, s.over_plate, s.polarity, {_dot(_V, _N)} / sqrt({_dot(_N, _N)}) AS height, least({_ENDS[0]}, {_ENDS[1]}) AS ends,
  {_dot(_cross(_N, _A), _V)} >= 0 AND {_dot(_cross(_B, _N), _V)} >= 0 AS between_ends FROM v p JOIN s2 s ON p.age = s.age),
zone AS (SELECT *, degrees(CASE WHEN between_ends THEN asin(least(abs(height), 1.0)) ELSE ends END) AS deg FROM h WHERE (polarity = 'Left' AND height > 0) OR (polarity <> 'Left' AND height < 0))"""


ZONE = zone_sql("fx_point")


@query("c10_one_sided", "fx_point", "fx_segment", sql=f"WITH {ZONE} SELECT point_id, segment_id, round(deg, 5) AS deg FROM zone WHERE deg <= 6.0")
def c10_one_sided(p, s):
    return S.one_sided(p, S.eligible_segments(s)).withColumn("deg", F.round("deg", 5))


@query("c11_eligible_segments", "fx_segment", sql=f"SELECT segment_id, polarity, over_plate FROM ({ELIGIBLE})")
def c11_eligible_segments(s):
    return S.eligible_segments(s).select("segment_id", "polarity", "over_plate")


@query("c12_clip_to_plate", "fx_point", "fx_segment", sql=f"WITH {ZONE} SELECT z.point_id, segment_id FROM zone z JOIN fx_point p USING (point_id) WHERE deg <= 6.0 AND z.plate_id = over_plate AND lon BETWEEN -120 AND 120 AND lat BETWEEN -40 AND 40")
def c12_clip_to_plate(p, s):
    here = S.clip_to_extent(p, (-120, 120), (-40, 40))
    return S.one_sided(here, S.eligible_segments(s), same_plate=True).select("point_id", "segment_id")


def turn_sql(p: str, sign: str = "") -> str:
    x = [z.replace("q.", f"{p}.") for z in xyz("q")]
    k = [z.replace("q.lon", "r.pole_lon").replace("q.lat", "r.pole_lat") for z in xyz("q")]
    cr, d = _cross(k, x), _dot(k, x)
    a = f"radians({sign}r.angle_deg)"
    v = [f"(({x[i]}) * cos({a}) + {cr[i]} * sin({a}) + ({k[i]}) * {d} * (1 - cos({a})))" for i in range(3)]
    return f"degrees(atan2({v[1]}, {v[0]})) AS rlon, degrees(asin(least(greatest({v[2]}, -1.0), 1.0))) AS rlat"


@query("c13_reconstruct", "fx_point", "fx_rotation", sql=f"""
WITH t AS (SELECT p.point_id, p.age, p.lon, p.lat, r.angle_deg, {turn_sql('p')} FROM fx_point p LEFT JOIN fx_rotation r USING (plate_id, age))
SELECT point_id, round(CASE WHEN age = 0 THEN lon ELSE rlon END, 5) AS lon, round(CASE WHEN age = 0 THEN lat ELSE rlat END, 5) AS lat FROM t""")
def c13_reconstruct(p, r):
    return S.reconstruct(p, r).select("point_id", F.round("rec_lon", 5).alias("lon"), F.round("rec_lat", 5).alias("lat"))


STEPS = f"st AS (SELECT p.point_id, CAST(s.t AS INT) AS t, CASE WHEN s.t = 0 THEN p.lon ELSE rlon END AS lon, CASE WHEN s.t = 0 THEN p.lat ELSE rlat END AS lat FROM (SELECT p.*, u.t, {turn_sql('p')} FROM fx_point p CROSS JOIN range(5) u(t) LEFT JOIN fx_rotation r ON r.plate_id = p.plate_id AND r.age = u.t WHERE u.t <= p.age) s JOIN fx_point p USING (point_id))"


@query("c14_reconstruct_steps", "fx_point", "fx_rotation", sql=f"WITH {STEPS} SELECT point_id, t, round(lon, 5) AS lon, round(lat, 5) AS lat FROM st")
def c14_reconstruct_steps(p, r):
    return S.reconstruct_steps(p, r).select("point_id", "t", F.round("lon_t", 5).alias("lon"), F.round("lat_t", 5).alias("lat"))


_WIDE = ", ".join(f"round(max(st.{x}) FILTER (st.t = {t}), 5) AS {x}_{t}" for t in range(5) for x in ("lon", "lat"))


@query("c14_wide_positions", "fx_point", "fx_rotation", sql=f"WITH {STEPS} SELECT point_id, p.age, {_WIDE} FROM st JOIN fx_point p USING (point_id) GROUP BY point_id, p.age")
def c14_wide_positions(p, r):
    wide = S.wide_positions(S.reconstruct_steps(p, r), list(range(5)), ["age"])
    return wide.select("point_id", "age", *[F.round(f"{x}_{t}", 5).alias(f"{x}_{t}") for t in range(5) for x in ("lon", "lat")])


@query("c15_always_on_continent", "fx_point", "fx_rotation", "fx_ring", sql=f"""
WITH {STEPS}, sp AS (SELECT *, point_id || ':' || t AS pt FROM st WHERE lon IS NOT NULL), {EDGES}, h AS (SELECT DISTINCT pt FROM ({inside_sql('sp', 'pt')}))
SELECT DISTINCT point_id FROM fx_point WHERE point_id NOT IN (SELECT point_id FROM sp WHERE pt NOT IN (SELECT pt FROM h))""")
def c15_always_on_continent(p, r, ring):
    return S.always_on_continent(S.reconstruct_steps(p, r), polygons(ring), [])


C16 = f"""n0 AS (SELECT CAST(n AS BIGINT) AS node_index, n % 73 * 5.0 - 180 AS lon, floor(n / 73) * 5.0 - 90 AS lat FROM range(2701) y(n)),
{EDGES}, hn AS ({inside_sql('n0', 'node_index')}), pn AS (SELECT node_index, CAST(arg_max(poly_plate, (type_rank, area_rank)) AS INT) AS plate_id FROM hn GROUP BY node_index),
en AS (SELECT n0.node_index * 1000 + a.age AS point_id, n0.node_index, CAST(a.age AS INT) AS age, pn.plate_id, n0.lon, n0.lat FROM n0 JOIN pn USING (node_index) CROSS JOIN (SELECT DISTINCT age FROM fx_rotation) a),
tn AS (SELECT en.*, {turn_sql('en')} FROM en LEFT JOIN fx_rotation r USING (plate_id, age)),
mv AS (SELECT point_id, node_index, age, plate_id, lon AS present_lon, lat AS present_lat, CASE WHEN age = 0 THEN lon ELSE rlon END AS lon, CASE WHEN age = 0 THEN lat ELSE rlat END AS lat FROM tn),
mk AS (SELECT * FROM mv WHERE lon IS NOT NULL), {zone_sql('mk')}, hz AS (SELECT DISTINCT point_id FROM zone WHERE deg <= 6.0),
mz AS (SELECT * FROM mk WHERE point_id IN (SELECT point_id FROM hz)), hm AS (SELECT DISTINCT point_id FROM ({inside_sql('mz', 'point_id')}))"""


@query("c16_continental_nodes", "fx_ring", "fx_rotation", "fx_segment", sql=f"""WITH {C16}
SELECT node_index, age, CAST(present_lon AS DOUBLE) AS present_lon, CAST(present_lat AS DOUBLE) AS present_lat, round(lon, 5) AS lon, round(lat, 5) AS lat FROM mz WHERE point_id IN (SELECT point_id FROM hm)""")
def c16_continental_nodes(ring, r, s):
    """A 5-degree grid on present continents, assigned to plates, at each age in the zone and on a continent."""
    polys = polygons(ring)
    nodes = R.grid_nodes(ring.sparkSession, [0], 5.0).drop("age")
    nodes = S.assign_plate(S.points_in_polygons(nodes, polys, [], pid="node_index"), polys, None, [], "node_index")
    ages = r.select("age").distinct()
    each = nodes.join(F.broadcast(ages)).withColumn("point_id", c("node_index") * 1000 + c("age"))
    moved = S.reconstruct(each, r).select("point_id", "node_index", "age", "plate_id", c("lon").alias("present_lon"), c("lat").alias("present_lat"), c("rec_lon").alias("lon"), c("rec_lat").alias("lat"))
    moved = materialise(moved, "moved")
    kept = S.points_in_polygons(S.in_zone(moved, S.eligible_segments(s)), polys, [])
    return kept.select("node_index", "age", c("present_lon").cast("double").alias("present_lon"), c("present_lat").cast("double").alias("present_lat"), F.round("lon", 5).alias("lon"), F.round("lat", 5).alias("lat"))


LOOKUP = "least(greatest(CAST(floor({x} / 1000.0 + 0.5) AS INT), 0), 9)", "least(greatest(CAST(floor(({x} - 600) / 50.0 + 0.5) AS INT), 0), 19)"


@query("c17_lookup_nearest", "fx_trench", "fx_lookup", sql=f"""
SELECT trench_id, l.value FROM fx_trench t LEFT JOIN fx_lookup l ON l.table_id = 0 AND l.p_idx = {LOOKUP[0].format(x='(t.slab_dip_deg * 130)')} AND l.t_idx = {LOOKUP[1].format(x='(t.seafloor_age_myr * 9)')}""")
def c17_lookup_nearest(t, lookup):
    return S.lookup_nearest(t, lookup, 0, c("slab_dip_deg") * 130, c("seafloor_age_myr") * 9, "value").select("trench_id", "value")


@query("c18_complete_ages", "fx_score", "fx_point", sql="""
WITH a AS (SELECT age, avg(probability) AS p FROM fx_score WHERE age <> 3 GROUP BY age)
SELECT d.age, round(coalesce(a.p, (SELECT avg(p) FROM a)), 6) AS probability FROM (SELECT DISTINCT age FROM fx_point) d LEFT JOIN a USING (age)""")
def c18_complete_ages(s, p):
    mean = T.mean_by_age(s.where("age <> 3"), ["probability"])
    return S.complete_ages(mean, p, "probability").withColumn("probability", F.round("probability", 6))


@query("c19_attach_coordinates", "fx_score", "fx_point", sql="""
WITH a AS (SELECT node_index, avg(probability) AS p FROM fx_score GROUP BY node_index), n AS (SELECT s.node_index, min((p.lon, p.lat)) AS q FROM fx_score s JOIN fx_point p USING (point_id) GROUP BY s.node_index)
SELECT node_index, round(p, 6) AS probability, q[1] AS present_lon, q[2] AS present_lat FROM a LEFT JOIN n USING (node_index)""".replace("q[1]", "struct_extract(q, 1)").replace("q[2]", "struct_extract(q, 2)"))
def c19_attach_coordinates(s, p):
    nodes = s.select("point_id", "node_index").join(p.select("point_id", c("lon").alias("present_lon"), c("lat").alias("present_lat")), "point_id")
    return S.attach_coordinates(T.mean_by_location(s, ["probability"]), nodes).withColumn("probability", F.round("probability", 6))


@query("c20_combine_by_key", "fx_score", "fx_point", sql="SELECT age, point_id, round(probability * (erosion_m / 997), 6) AS preserved, lon FROM fx_score JOIN fx_point USING (age, point_id)")
def c20_combine_by_key(s, p):
    both = S.combine_by_key(s.select("age", "point_id", "probability", "erosion_m"), p.select("age", "point_id", "lon"), ["age", "point_id"])
    return both.select("age", "point_id", F.round(P.preserved(c("probability"), c("erosion_m") / 997), 6).alias("preserved"), "lon")


@query("c21_occurrence_values", "fx_point", "fx_cell", sql=f"""WITH {GRID10}
SELECT point_id, round(value, 4) AS value FROM fx_point p JOIN g ON g.age = p.age AND g.i = (CAST(floor((lon + 175) / 10 + 0.5) AS INT) + 36) % 36 AND g.j = least(CAST(floor((least(greatest((lat + 65) / 10, 0.0), 13.0)) + 0.5) AS INT), 13) WHERE label = 1 AND value IS NOT NULL""")
def c21_occurrence_values(p, g):
    found = S.sample_regular(p.where("label = 1"), grid10(g), -175.0, -65.0, 10.0, 36, 14, ["age"])
    return found.where("value is not null").select("point_id", F.round("value", 4).alias("value"))


@query("c22_strain_radius_mean", "fx_trench", "fx_cell", sql=mean_sql("trench_id", "fx_trench", "p.age = t.age AND t.z <> 0", "3.0", False))
def c22_strain_radius_mean(t, g):
    return S.strain_radius_mean(t, g, 3.0, "z", "trench_id").select("trench_id", F.round("mean_z", 4).alias("value"))


@query("c23_first_network", "fx_point", "fx_ring", sql=f"WITH {EDGES}, h AS ({inside_sql('fx_point', 'point_id')}), m AS (SELECT point_id, arg_min(area_rank, poly_id) AS strain FROM h GROUP BY point_id) SELECT p.point_id, CAST(m.strain AS INT) AS area_rank FROM fx_point p LEFT JOIN m USING (point_id)")
def c23_first_network(p, r):
    return S.first_network(p, polygons(r), [], ["area_rank"], "poly_id").select("point_id", "area_rank")


C24 = f"""{EDGES}, hd AS ({inside_sql('fx_point', 'point_id')}), pd AS (SELECT point_id, CAST(arg_max(poly_plate, (type_rank, area_rank)) AS INT) AS plate_id FROM hd GROUP BY point_id),
dd AS (SELECT p.point_id, p.age, p.lon, p.lat, pd.plate_id FROM fx_point p LEFT JOIN pd USING (point_id)), td AS (SELECT dd.*, {turn_sql('dd')} FROM dd LEFT JOIN fx_rotation r USING (plate_id, age)),
md AS (SELECT point_id, age, plate_id, lon AS present_lon, lat AS present_lat, CASE WHEN age = 0 THEN lon ELSE rlon END AS lon, CASE WHEN age = 0 THEN lat ELSE rlat END AS lat FROM td),
mk AS (SELECT * FROM md WHERE lon IS NOT NULL), {zone_sql('mk')}"""


@query("c24_prepare_deposits", "fx_point", "fx_ring", "fx_rotation", "fx_segment", sql=f"""WITH {C24}
SELECT point_id, present_lat, present_lon, age, CAST(1 AS DOUBLE) AS weight, round(lon, 5) AS lon, round(lat, 5) AS lat FROM mk WHERE point_id IN (SELECT point_id FROM zone WHERE deg <= 6.0)""")
def c24_prepare_deposits(p, ring, r, s):
    """Ages in range, weight, step, plate, palaeo-position, in the zone of the step, sorted by age."""
    here = R.default_weight(R.age_range(p.withColumn("age", c("age").cast("string")).drop("weight"), 0, 4)).withColumn("age", R.snap_to_step(c("age")).cast("int"))
    here = S.assign_plate(here, polygons(ring), None, [], missing=None)
    moved = S.reconstruct(here, r).select("point_id", "age", "weight", "plate_id", c("lon").alias("present_lon"), c("lat").alias("present_lat"), c("rec_lon").alias("lon"), c("rec_lat").alias("lat"))
    moved = materialise(moved, "moved")
    kept = S.in_zone(moved, S.eligible_segments(s))
    return R.sort_output(kept.select("point_id", "present_lat", "present_lon", "age", "weight", F.round("lon", 5).alias("lon"), F.round("lat", 5).alias("lat")))


@query("w09_nearest_k", "fx_segment", "fx_cell", sql=f"""
WITH q AS (SELECT s.segment_id, t.cell_id, row_number() OVER (PARTITION BY s.segment_id ORDER BY abs(t.lon - s.lon1) + abs(t.lat - s.lat1), t.cell_id) AS rn FROM fx_segment s JOIN fx_cell t ON s.age = t.age)
SELECT segment_id, cell_id FROM q WHERE rn <= 3""")
def w09_nearest_k(s, g):
    return S.nearest_k(s, g, 3, ["age"], "segment_id", "cell_id", "lon1", "lat1")


@query("i01_grid_points", "fx_ring", "fx_rotation", sql=f"""
WITH p0 AS (SELECT a AS age, CAST(n AS BIGINT) AS node_index, n % 37 * 10.0 - 180 AS lon, floor(n / 37) * 10.0 - 90 AS lat, a || ':' || n AS id FROM range(5) x(a) CROSS JOIN range(703) y(n)),
{EDGES}, h AS (SELECT DISTINCT id FROM ({inside_sql('p0', 'id', True)})),
t AS (SELECT p.*, {turn_sql('p', '-')} FROM p0 p LEFT JOIN fx_rotation r ON r.plate_id = 1 AND r.age = p.age WHERE id IN (SELECT id FROM h))
SELECT CAST(age AS INT) AS age, node_index, CAST(lon AS DOUBLE) AS lon, CAST(lat AS DOUBLE) AS lat, round(CASE WHEN age = 0 THEN lon ELSE rlon END, 5) AS present_lon, round(CASE WHEN age = 0 THEN lat ELSE rlat END, 5) AS present_lat FROM t""")
def i01_grid_points(ring, r):
    nodes = R.grid_nodes(ring.sparkSession, [0, 1, 2, 3, 4], 10.0).withColumns({"point_id": F.struct("age", "node_index"), "plate_id": F.lit(1)})
    kept = S.points_in_polygons(nodes, polygons(ring), [], True)
    back = S.reconstruct(kept, r, inverse=True, out=("present_lon", "present_lat"))
    return back.select("age", "node_index", c("lon").cast("double").alias("lon"), c("lat").cast("double").alias("lat"), F.round("present_lon", 5).alias("present_lon"), F.round("present_lat", 5).alias("present_lat"))


@query("i02_random_points", "fx_point", "fx_ring")
def i02_random_points(p, ring):
    """As many random points on continents for each age of the deposits as there are deposits a hundred."""
    polys = polygons(ring)
    ages = [r["age"] for r in T.distinct_ages(p).orderBy("age").collect()]  # one row a time step
    n = max(10, p.count() // (100 * max(1, len(ages))))
    return R.random_points(p.sparkSession, ages, n, lambda df: S.points_in_polygons(df, polys, []))


@query("s08_plate_thickness", "fx_trench", sql="""
WITH nodes AS (SELECT CAST(a * 2 AS DOUBLE) AS node_age, z * 1000.0 AS z FROM range(92) x(a) CROSS JOIN range(126) y(z)),
heat AS (SELECT node_age, z, 1350.0 * (z / 125e3 + sum(2 / (n * pi()) * sin(n * pi() * z / 125e3) * exp(-0.804e-6 * (n * n) * pow(pi(), 2) * node_age * 3.15576e13 / pow(125e3, 2)))) AS heat
  FROM nodes CROSS JOIN range(1, 61) s(n) GROUP BY node_age, z),
d AS (SELECT node_age, min(z) AS depth FROM heat WHERE heat >= 1150 GROUP BY node_age)
SELECT trench_id, round(a.depth + (seafloor_age_myr - a.node_age) / 2 * (coalesce(b.depth, a.depth) - a.depth), 3) AS thickness_m
FROM fx_trench t LEFT JOIN d a ON a.node_age = floor(seafloor_age_myr / 2) * 2 LEFT JOIN d b ON b.node_age = a.node_age + 2""")
def s08_plate_thickness(t):
    """Depth of the 1150 degree isotherm."""
    return U.plate_thickness(t).select("trench_id", F.round("thickness_m", 3).alias("thickness_m"))


# What comes in with the plate has no fixture of its own: it is made of trench columns, here and in SQL.
INCOMING = {
    "thickness_m": ("seafloor_age_myr", 1013.7123451), "brittle_m": ("seafloor_age_myr", 507.3123467), "water_lithosphere": ("slab_dip_deg", 1.23456781357e-4), "water_crust": ("spreading_km_myr", 1.09876543417e-5),
    "water_sediment": ("slab_dip_deg", 1.12345671893e-4), "carbon_lithosphere": ("slab_dip_deg", 1.34567891237e-3), "carbon_crust": ("spreading_km_myr", 1.01928371239e-4), "carbon_serpentinite": ("slab_dip_deg", 1.12233441237e-5),
    "carbon_sediment": ("slab_dip_deg", 1.01234561237e-4), "carbon_organic_sediments": ("seafloor_age_myr", 1.03456781237e-5),
}


def samples(t):
    return t.withColumns({k: c(x) * f for k, (x, f) in INCOMING.items()})


def capacity_sql(kinds: dict, sizes: dict[str, str]) -> str:
    return ", ".join(f"l{table}.value * {per!r} * ({sizes[k]}) * 1e-9 AS c_{k}" for k, (table, _, per) in kinds.items())


def released_sql(what: str, k: str) -> str:
    return f"CASE WHEN c_{k} IS NULL OR in_{k} IS NULL THEN NULL ELSE greatest(in_{k} - least(c_{k}, in_{k}), 0.0) END"


def storage_sql(what: str, kinds: dict, sizes: dict[str, str], incoming: dict[str, str]) -> str:
    """CTEs that end in one of the operator's name: (trench_id, fluxes, outfluxes, total)."""
    heat = (("1331.0", "58.6"), ("1303.0", "60.23"), ("1622.0", "132.5"))
    phi = "(seafloor_age_myr * 1e6 * (CASE WHEN conv_rate_orth_cm_yr < 0 THEN 0 ELSE conv_rate_orth_cm_yr END * 100) * 1e-5 * sin(radians(least(greatest(slab_dip_deg, 1.0), 90.0))))"
    tables = {table: at for table, at, _ in kinds.values()}
    joins = " ".join(f"LEFT JOIN fx_lookup l{t} ON l{t}.table_id = {t} AND l{t}.p_idx = 9 AND l{t}.t_idx = {LOOKUP[1].format(x=f'({heat[at][0]} - {heat[at][1]} * ln({phi} + 1e-12) + 273.14)')}" for t, at in tables.items())
    base = f"(SELECT *, {', '.join(f'{x} * {f!r} AS {k}' for k, (x, f) in INCOMING.items())} FROM fx_trench)"
    rows = f"{what}_c AS (SELECT s.trench_id, {capacity_sql(kinds, sizes)}, {', '.join(f'{x} AS in_{k}' for k, x in incoming.items())} FROM {base} s {joins})"
    columns = ", ".join(f"in_{k} AS subduction_{what}_flux_{k}, {released_sql(what, k)} AS slab_{what}_outflux_{k}" for k in kinds)
    total = " + ".join(released_sql(what, k) for k in kinds)
    return f"{rows}, {what} AS (SELECT trench_id, {columns}, {total} AS total_slab_{what}_outflux FROM {what}_c)"


BENT = "(brittle_m - 8e3) * (0.13 * (least(greatest(least(greatest(slab_dip_deg, 1.0), 90.0), 0.0), 90.0) / 9 / 100)) * 2900 * 1e-9"
WATER_SQL = storage_sql("water", U.WATER, {"lithosphere": "thickness_m - 7e3", "crust": "7e3", "sediment": "sediment_m"}, {"lithosphere": f"water_lithosphere + {BENT}", "crust": "water_crust", "sediment": "water_sediment"})
_SHARE = " * (12.0107 / 44.0095)"
CARBON_SIZE = {"lithosphere": "(thickness_m - sediment_m - 7e3)", "crust": "12e3", "serpentinite": "450.0", "sediment": "sediment_m", "organic_sediments": "sediment_m"}
CARBON_SQL = storage_sql("carbon", U.CARBON, {k: v + _SHARE for k, v in CARBON_SIZE.items()}, {k: f"carbon_{k}" for k in U.CARBON})
MELT_SQL = """mt AS (SELECT t_idx, avg(value) AS f FROM fx_lookup WHERE table_id = 0 AND p_idx BETWEEN 2 AND 6 GROUP BY t_idx),
melt AS (SELECT trench_id, mt.f / 100 * 3300.0 * 125e3 * 1e-9 AS melting_rate FROM water LEFT JOIN mt ON mt.t_idx = least(greatest(CAST(floor(100 * total_slab_water_outflux * 1e6 / (3300.0 * 125e3 * 1e-3) * 80 + 0.5) AS INT), 0), 19) AND total_slab_water_outflux IS NOT NULL)"""


def storage_columns(what: str, kinds) -> list[str]:
    return [f"{a}_{what}_{b}_{k}" for k in kinds for a, b in (("subduction", "flux"), ("slab", "outflux"))] + [f"total_slab_{what}_outflux"]


def rounded_sql(names: list[str]) -> str:
    return ", ".join(f"round({k}, 9) AS {k}" for k in names)


@query("s20_slab_water_storage", "fx_trench", "fx_lookup", sql=f"WITH {WATER_SQL} SELECT trench_id, {rounded_sql(storage_columns('water', U.WATER))} FROM water")
def s20_slab_water_storage(t, lookup):
    out = U.slab_water_storage(samples(t), lookup)
    return out.select("trench_id", *[F.round(k, 9).alias(k) for k in storage_columns("water", U.WATER)])


@query("s21_slab_carbon_storage", "fx_trench", "fx_lookup", sql=f"WITH {CARBON_SQL} SELECT trench_id, {rounded_sql(storage_columns('carbon', U.CARBON))} FROM carbon")
def s21_slab_carbon_storage(t, lookup):
    out = U.slab_carbon_storage(samples(t), lookup)
    return out.select("trench_id", *[F.round(k, 9).alias(k) for k in storage_columns("carbon", U.CARBON)])


def melt_table(lookup):
    return lookup.where(c("table_id") == 0).where(c("p_idx").between(2, 6))


@query("s23_melting_rate", "fx_trench", "fx_lookup", sql=f"WITH {WATER_SQL}, {MELT_SQL} SELECT trench_id, round(melting_rate, 9) AS melting_rate FROM melt")
def s23_melting_rate(t, lookup):
    out = U.melting_rate(U.slab_water_storage(samples(t), lookup), melt_table(lookup))
    return out.select("trench_id", F.round("melting_rate", 9).alias("melting_rate"))


@query("s31_outflux_features", "fx_trench", "fx_lookup", sql=f"WITH {WATER_SQL}, {MELT_SQL}, {CARBON_SQL} SELECT trench_id, " + ", ".join(f"round({k} * greatest(conv_rate_orth_cm_yr, 0.0) * 1e6, 4) AS {k}" for k in U.FLUXES) + " FROM fx_trench JOIN water USING (trench_id) JOIN melt USING (trench_id) JOIN carbon USING (trench_id)")
def s31_outflux_features(t, lookup):
    out = U.outflux_features(samples(t), lookup, melt_table(lookup))
    return out.select("trench_id", *[F.round(k, 4).alias(k) for k in U.FLUXES])
