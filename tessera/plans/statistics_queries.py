"""Queries of aggregations, windows and grids (D*, W*, G*) and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import spatial as S
from tessera.operators import statistics as T
from tessera.plans.registry import query

c = F.col


def _r(df, places: int = 6, **columns):
    return df.select(*[x for x in df.columns if x not in columns], *[F.round(v, places).alias(k) for k, v in columns.items()])


AMOUNT = "sediment_m * radians(arc_len_deg) * 6371.0 * 1e3 * conv_rate_orth_cm_yr * 1e4"
FLUX = f"""f AS (SELECT age, CAST(least(floor((lon + 180) / 30), 11) AS INT) AS i, CAST(least(floor((lat + 90) / 30), 5) AS INT) AS j,
  sum(CASE WHEN sediment_m IS NULL THEN NULL ELSE greatest({AMOUNT}, 0.0) END) AS x FROM fx_trench GROUP BY ALL),
g AS (SELECT age, i, j, x / (pow(30.0 * 6371.0 * 1e3 * pi() / 180, 2) * cos(radians((j + 0.5) * 30 - 90))) AS flux FROM f)"""
FULL = f"{FLUX}, u AS (SELECT a.age, b.i, b.j, coalesce(g.flux, 0.0) AS flux FROM (SELECT DISTINCT age FROM fx_trench) a CROSS JOIN (SELECT DISTINCT i, j FROM g) b LEFT JOIN g ON g.age = a.age AND g.i = b.i AND g.j = b.j)"


@query("d01_flux_grid", "fx_trench", sql=f"WITH {FLUX} SELECT age, i, j, round(flux, 5) AS flux FROM g")
def d01(t):
    return _r(T.flux_grid(t, "sediment_m", 30.0), 5, flux=c("flux"))


@query("d02_cell_area", "fx_trench", sql="SELECT trench_id, round(pow(0.5 * 6371.0 * 1e3 * pi() / 180, 2) * cos(radians(lat)) / 1e6, 5) AS km2 FROM fx_trench")
def d02(t):
    return t.select("trench_id", F.round(T.cell_area_m2(c("lat"), 0.5) / 1e6, 5).alias("km2"))


@query("w01_cumulative_flux", "fx_trench", sql=f"WITH {FULL} SELECT age, i, j, round(sum(flux) OVER (PARTITION BY i, j ORDER BY -age), 4) AS total FROM u")
def w01(t):
    return _r(T.cumulative_flux(T.flux_grid(t, "sediment_m", 30.0), t), 4, total=c("total"))


@query("w02_lagged_flux", "fx_trench", sql=f"WITH {FULL} SELECT age, i, j, round(sum(flux) OVER (PARTITION BY i, j ORDER BY -age RANGE BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS total FROM u")
def w02(t):
    return _r(T.cumulative_flux(T.flux_grid(t, "sediment_m", 30.0), t, 2), 4, total=c("total"))


@query("w03_subducted_thickness", "fx_trench", sql=f"""
WITH {FULL}, k AS (SELECT age, i, j, sum(flux) OVER (PARTITION BY i, j ORDER BY -age) AS total FROM u)
SELECT trench_id, round(total * (0.6 + 0.4 * least(greatest(conv_rate_cm_yr / 6.8, 0.0), 1.0)), 4) AS subducted FROM fx_trench t
LEFT JOIN k ON k.age = t.age AND k.i = CAST(least(floor((lon + 180) / 30), 11) AS INT) AND k.j = CAST(least(floor((lat + 90) / 30), 5) AS INT)""")
def w03(t):
    """Flux grid, its running sum, and the sum's value back at the trench, corrected for the rate."""
    total = T.cumulative_flux(T.flux_grid(t, "sediment_m", 30.0), t)
    i, j = F.least(F.floor((c("lon") + 180) / 30), F.lit(11)).cast("int"), F.least(F.floor((c("lat") + 90) / 30), F.lit(5)).cast("int")
    both = t.withColumns({"i": i, "j": j}).join(total, ["age", "i", "j"], "left")
    factor = 0.6 + 0.4 * F.least(F.greatest(c("conv_rate_cm_yr") / 6.8, F.lit(0.0)), F.lit(1.0))
    return both.select("trench_id", F.round(c("total") * factor, 4).alias("subducted"))


@query("d03_mean_by_age", "fx_score", sql="SELECT age, round(avg(probability), 6) AS probability, round(avg(erosion_m), 6) AS erosion_m FROM fx_score GROUP BY age")
def d03(s):
    return _r(T.mean_by_age(s, ["probability", "erosion_m"]), probability=c("probability"), erosion_m=c("erosion_m"))


@query("d04_spread_by_age", "fx_score", sql="""
WITH m AS (SELECT age, median(erosion_m) AS m FROM fx_score GROUP BY age)
SELECT age, round(stddev_samp(erosion_m), 6) AS std, round(1.4826 * median(abs(erosion_m - m)), 6) AS mad FROM fx_score JOIN m USING (age) GROUP BY age""")
def d04(s):
    std = T.spread_by_age(s, "erosion_m").withColumnRenamed("spread", "std")
    return _r(std.join(T.spread_by_age(s, "erosion_m", "mad", True).withColumnRenamed("spread", "mad"), "age"), std=c("std"), mad=c("mad"))


@query("d05_mean_by_location", "fx_score", sql="SELECT node_index, round(avg(probability), 6) AS probability, round(avg(erosion_m), 6) AS erosion_m FROM fx_score WHERE probability > 0.5 GROUP BY node_index")
def d05(s):
    return _r(T.mean_by_location(s, ["probability", "erosion_m"], "probability"), probability=c("probability"), erosion_m=c("erosion_m"))


@query("d06_age_histogram", "fx_point", sql="SELECT CAST(least(age // 2, 1) * 2 AS BIGINT) AS low, CAST(count(*) AS BIGINT) AS n FROM fx_point WHERE label = 1 GROUP BY 1")
def d06(p):
    return T.age_histogram(p.where("label = 1"), 2, 4)


@query("d07_density_histogram", "fx_point", sql="""
WITH e AS (SELECT min(f1) AS lo, max(f1) AS hi FROM fx_point WHERE label = 1),
b AS (SELECT label, CAST(least(floor((f1 - lo) / ((hi - lo) / 10)), 9) AS INT) AS bin, (hi - lo) / 10 AS w FROM fx_point CROSS JOIN e WHERE f1 BETWEEN lo AND hi)
SELECT label, bin, round(count(*) / (sum(count(*)) OVER (PARTITION BY label) * max(w)), 9) AS density FROM b GROUP BY label, bin""")
def d07(p):
    return _r(T.density_histogram(p, "f1", 10, c("label") == 1, "label"), 9, density=c("density"))


@query("d08_box_stats", "fx_point", sql="""
WITH q AS (SELECT label, quantile_cont(f1, 0.05) AS low, quantile_cont(f1, 0.25) AS q1, median(f1) AS m, quantile_cont(f1, 0.75) AS q3, quantile_cont(f1, 0.95) AS high FROM fx_point GROUP BY label)
SELECT label, round(low, 4) AS low, round(q1, 4) AS q1, round(m, 4) AS median, round(q3, 4) AS q3, round(high, 4) AS high,
  (SELECT count(*) FROM fx_point p WHERE p.label = q.label AND (f1 < low OR f1 > high)) AS n_outliers FROM q""")
def d08(p):
    names = ("low", "q1", "median", "q3", "high")
    out = T.box_stats(p, "f1", "label")
    return out.select("label", *[F.round(x, 4).alias(x) for x in names], "n_outliers")


@query("d09_colour_limits", "fx_trench", sql="""
SELECT 'obliquity' AS kind, -90.0::DOUBLE AS low, 90.0::DOUBLE AS high UNION ALL SELECT 'positive', 0.0, round(quantile_cont(sediment_m, 0.99), 6) FROM fx_trench
UNION ALL SELECT 'general', round(quantile_cont(conv_rate_orth_cm_yr, 0.01), 6), round(quantile_cont(conv_rate_orth_cm_yr, 0.99), 6) FROM fx_trench""")
def d09(t):
    kinds = {"obliquity": "obliquity_deg", "positive": "sediment_m", "general": "conv_rate_orth_cm_yr"}
    parts = [T.colour_limits(t, v, k).select(F.lit(k).alias("kind"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high")) for k, v in kinds.items()]
    return parts[0].union(parts[1]).union(parts[2])


@query("d10_quantile_breaks", "fx_cell", sql="""
WITH q AS (SELECT quantile_cont(z, 0.2) AS a, quantile_cont(z, 0.4) AS b, quantile_cont(z, 0.6) AS d, quantile_cont(z, 0.8) AS e FROM fx_cell)
SELECT CASE WHEN z <= a THEN 'Very low' WHEN z <= b THEN 'Low' WHEN z <= d THEN 'Moderate' WHEN z <= e THEN 'High' ELSE 'Very high' END AS class, CAST(count(*) AS BIGINT) AS n FROM fx_cell CROSS JOIN q WHERE z IS NOT NULL GROUP BY 1""")
def d10(g):
    return T.classify(g.where("z is not null"), "z", T.quantile_breaks(g, "z")).groupBy("class").agg(F.count("*").alias("n"))


CURVE = """k AS (SELECT CAST(k AS DOUBLE) / 99 AS threshold FROM range(100) t(k)),
a AS (SELECT threshold, 100.0 * (SELECT count(*) FROM fx_score WHERE label = 1 AND probability >= threshold) / (SELECT count(*) FROM fx_score WHERE label = 1) AS d,
  100.0 * (SELECT count(*) FROM fx_score WHERE probability >= threshold) / (SELECT count(*) FROM fx_score) AS g FROM k)"""


@query("d11_prediction_area_curve", "fx_score", sql=f"WITH {CURVE} SELECT round(threshold, 6) AS threshold, round(d, 6) AS deposits_pct, round(g, 6) AS area_pct FROM a")
def d11(s):
    return _r(T.prediction_area_curve(s, s.where("label = 1"), "probability"), threshold=c("threshold"), deposits_pct=c("deposits_pct"), area_pct=c("area_pct"))


@query("d12_pa_intersection", "fx_score", sql=f"""
WITH {CURVE}, s AS (SELECT *, d + g - 100 AS s, lead(threshold) OVER w AS nt, lead(d) OVER w AS nd, lead(g) OVER w AS ng, lead(d + g - 100) OVER w AS ns FROM a WINDOW w AS (ORDER BY threshold))
SELECT round(threshold + s / (s - ns) * (nt - threshold), 6) AS threshold, round(d + s / (s - ns) * (nd - d), 6) AS deposits_pct, round(g + s / (s - ns) * (ng - g), 6) AS area_pct
FROM s WHERE s >= 0 AND ns < 0 ORDER BY 1 LIMIT 1""")
def d12(s):
    return _r(T.pa_intersection(T.prediction_area_curve(s, s.where("label = 1"), "probability")), threshold=c("threshold"), deposits_pct=c("deposits_pct"), area_pct=c("area_pct"))


FEATURES = ["lon", "lat", "f1", "f2", "weight"]
RANKED = "r AS (SELECT " + ", ".join(f"rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0 AS {x}" for x in FEATURES) + " FROM fx_point WHERE f2 IS NOT NULL)"
CORR = f"{RANKED}, corr_ AS (" + " UNION ALL ".join(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(corr({a}, {b}), 3) AS rho FROM r" for a in FEATURES for b in FEATURES) + ")"


def corr(p):
    return T.spearman_matrix(p, FEATURES)


@query("d13_spearman", "fx_point", sql=f"WITH {CORR} SELECT * FROM corr_")
def d13(p):
    return corr(p)


STRONG = f"""{CORR}, p AS (SELECT feature_a, coalesce(string_agg(feature_b, ',' ORDER BY -rho, feature_b) FILTER (rho > 0), '') AS positive, coalesce(string_agg(feature_b, ',' ORDER BY rho, feature_b) FILTER (rho < 0), '') AS negative,
  CAST(count(*) FILTER (rho > 0) AS BIGINT) AS n_positive, CAST(count(*) FILTER (rho < 0) AS BIGINT) AS n_negative FROM corr_ WHERE feature_a <> feature_b AND abs(rho) >= 0.01 GROUP BY feature_a)"""


@query("d14_strong_pairs", "fx_point", sql=f"WITH {STRONG} SELECT * FROM p")
def d14(p):
    return T.strong_pairs(corr(p), 0.01)


@query("d15_correlation_report", "fx_point", sql=f"WITH {STRONG} SELECT feature_a, feature_a || ': ' || (n_positive + n_negative) || ' strong (+ ' || positive || '; - ' || negative || ')' AS report, (SELECT count(*) FROM p) AS n_features FROM p")
def d15(p):
    return T.correlation_report(T.strong_pairs(corr(p), 0.01))


@query("d16_missing_report", "fx_trench", sql="SELECT 'sediment_m' AS \"column\", count(*) - count(sediment_m) AS missing, round(100.0 * (count(*) - count(sediment_m)) / count(*), 6) AS percent FROM fx_trench")
def d16(t):
    return _r(T.missing_report(t), percent=c("percent"))


@query("d17_strain_history", "fx_point", sql="""
SELECT plate_id, round((arg_min(v, age) - arg_max(v, age)) / (max(age) - min(age)), 6) AS diff, round(avg(v), 6) AS mean FROM (SELECT plate_id, age, avg(f2) AS v FROM fx_point GROUP BY ALL) WHERE v IS NOT NULL AND age BETWEEN 0 AND 3 GROUP BY plate_id HAVING count(*) >= 2""")
def d17(p):
    samples = p.groupBy("plate_id", "age").agg(F.avg("f2").alias("v"))
    return _r(T.strain_history(samples, "v", "age", "plate_id", 4), diff=c("diff"), mean=c("mean"))


@query("d18_feature_clusters", "fx_point", sql=f"""
WITH RECURSIVE {CORR}, reach AS (SELECT DISTINCT feature_a AS f, feature_a AS o FROM corr_ UNION SELECT r.f, e.feature_b FROM reach r JOIN corr_ e ON e.feature_a = r.o WHERE abs(e.rho) >= 0.05)
SELECT f AS feature, min(o) AS cluster FROM reach GROUP BY f""")
def d18(p):
    return T.feature_clusters(corr(p), 0.05)


@query("d19_cluster_sweep", "fx_point", sql=f"""
WITH RECURSIVE {CORR}, k AS (SELECT CAST(k AS DOUBLE) / 9 AS cutoff FROM range(10) t(k)), reach AS (SELECT DISTINCT cutoff, feature_a AS f, feature_a AS o FROM corr_ CROSS JOIN k
  UNION SELECT r.cutoff, r.f, e.feature_b FROM reach r JOIN corr_ e ON e.feature_a = r.o WHERE abs(e.rho) >= r.cutoff),
m AS (SELECT cutoff, f, min(o) AS cluster FROM reach GROUP BY ALL)
SELECT round(cutoff, 6) AS cutoff, CAST(count(DISTINCT cluster) AS BIGINT) AS n_clusters FROM m GROUP BY cutoff""")
def d19(p):
    return _r(T.cluster_count_sweep(corr(p), 10), cutoff=c("cutoff")).select("cutoff", "n_clusters")


@query("d20_merge_names", "fx_segment", sql="SELECT polarity, type, over_plate, string_agg(DISTINCT name, ':' ORDER BY name) AS names FROM fx_segment GROUP BY ALL")
def d20(s):
    return T.merge_segment_names(s)


@query("d21_distinct_ages", "fx_point", sql="SELECT DISTINCT age FROM fx_point")
def d21(p):
    return T.distinct_ages(p)


SMOOTH = """k AS (SELECT age, v, row_number() OVER (ORDER BY age) - 1 AS k FROM m), z AS (SELECT max(k) AS z FROM k),
o AS (SELECT CAST(d AS INT) AS d FROM range(-CAST(4 * ({f} / 2.355) + 0.5 AS INT), CAST(floor(4 * ({f} / 2.355) + 0.5) AS INT) + 1) t(d)),
s AS (SELECT k.age, sum(exp(-0.5 * pow(d / ({f} / 2.355), 2)) * n.v) / sum(exp(-0.5 * pow(d / ({f} / 2.355), 2))) AS v FROM k CROSS JOIN z CROSS JOIN o JOIN k n ON n.k = least(greatest(k.k + d, 0), z) GROUP BY k.age)""".replace("-CAST(4 * ({f} / 2.355) + 0.5 AS INT)", "-CAST(floor(4 * ({f} / 2.355) + 0.5) AS INT)")


@query("w04_gaussian_smooth", "fx_score", sql=f"WITH m AS (SELECT age, avg(probability) AS v FROM fx_score GROUP BY age), {SMOOTH.format(f='2.5')} SELECT age, round(v, 6) AS probability FROM s")
def w04(s):
    return _r(T.gaussian_smooth(T.mean_by_age(s, ["probability"]), "probability", 2.5), probability=c("probability"))


@query("d22_age_trend", "fx_score", sql=f"""WITH h AS (SELECT * FROM fx_score WHERE probability > 0.5), m AS (SELECT a.age, coalesce(b.v, (SELECT avg(v) FROM (SELECT avg(erosion_m) AS v FROM h GROUP BY age))) AS v FROM (SELECT DISTINCT age FROM fx_score) a LEFT JOIN (SELECT age, avg(erosion_m) AS v FROM h GROUP BY age) b USING (age)), {SMOOTH.format(f='2.5')}
SELECT s.age, round(s.v, 6) AS erosion_m, round(d.spread, 6) AS spread FROM s LEFT JOIN (SELECT age, stddev_samp(erosion_m) AS spread FROM h GROUP BY age) d USING (age)""")
def d22(s):
    return _r(T.age_trend(s, "erosion_m", s, 2.5, "probability"), erosion_m=c("erosion_m"), spread=c("spread"))


@query("d22_age_trend_mad", "fx_score", sql=f"""WITH h AS (SELECT * FROM fx_score WHERE probability > 0.5), m AS (SELECT a.age, coalesce(b.v, (SELECT avg(v) FROM (SELECT avg(erosion_m) AS v FROM h GROUP BY age))) AS v FROM (SELECT DISTINCT age FROM fx_score) a LEFT JOIN (SELECT age, avg(erosion_m) AS v FROM h GROUP BY age) b USING (age)), {SMOOTH.format(f='2.5')}
SELECT s.age, round(s.v, 6) AS erosion_m, round(d.spread * 1.4826, 6) AS spread FROM s LEFT JOIN (SELECT age, mad(erosion_m) AS spread FROM h GROUP BY age) d USING (age)""")
def d22_mad(s):
    return _r(T.age_trend(s, "erosion_m", s, 2.5, "probability", "mad", True), erosion_m=c("erosion_m"), spread=c("spread"))


@query("w05_minmax_normalise", "fx_score", sql="SELECT point_id, round((erosion_m - lo) / (hi - lo), 6) AS erosion_m FROM fx_score CROSS JOIN (SELECT min(erosion_m) AS lo, max(erosion_m) AS hi FROM fx_score)")
def w05(s):
    return T.minmax_normalise(s, "erosion_m").select("point_id", F.round("erosion_m", 6).alias("erosion_m"))


@query("w07_sort_output", "fx_point", sql="SELECT label, age, point_id FROM fx_point")
def w07(p):
    from tessera.operators.prepare import sort_output

    return sort_output(p).select("label", "age", "point_id")


@query("w08_order_by_median", "fx_point", sql="""
WITH m AS (SELECT 'lon' AS feature, median(lon) AS m FROM fx_point UNION ALL SELECT 'lat', median(lat) FROM fx_point UNION ALL SELECT 'f1', median(f1) FROM fx_point)
SELECT feature, round(m, 6) AS median, CAST(row_number() OVER (ORDER BY m DESC, feature) AS INT) AS place FROM m""")
def w08(p):
    return _r(T.order_by_median(p, ["lon", "lat", "f1"]), median=c("median")).select("feature", "median", "place")


NODES = "(SELECT point_id, age, round(lon) AS lon, round(lat) AS lat, f1 FROM fx_point)"


@query("g01_grid_exact", "fx_point", sql=f"SELECT age, CAST(round((lon + 180) / 2) AS INT) AS i, CAST(round((lat + 70) / 2) AS INT) AS j, arg_max(f1, point_id) AS value FROM {NODES} WHERE (lon + 180) % 2 = 0 AND (lat + 70) % 2 = 0 GROUP BY ALL")
def g01(p):
    rows = p.withColumns({"lon": F.round("lon"), "lat": F.round("lat")})
    return T.grid_exact(rows, "f1", -180.0, -70.0, 2.0, "point_id", ["age"])


GRID = """x AS (SELECT p.age, CAST(i AS INT) AS i, CAST(j AS INT) AS j, f1, point_id, round(sqrt(pow(lon - (i * 5.0 - 180), 2) + pow(lat - (j * 5.0 - 70), 2)), 9) AS d FROM fx_point p JOIN range(73) a(i) ON abs(lon - (i * 5.0 - 180)) <= 5 JOIN range(29) b(j) ON abs(lat - (j * 5.0 - 70)) <= 5 {w})"""


@query("g02_grid_nearest", "fx_point", sql=f"WITH {GRID.format(w='')} SELECT age, i, j, arg_min(f1, (d, point_id)) AS value FROM x WHERE d <= 5 GROUP BY ALL")
def g02(p):
    return T.grid_nearest(p, "f1", -180.0, -70.0, 5.0, (73, 29), "point_id", ["age"])


@query("g03_infer_resolution", "fx_cell", sql="""
WITH v AS (SELECT lon, lag(lon) OVER (ORDER BY lon) AS a, lead(lon) OVER (ORDER BY lon) AS b FROM (SELECT DISTINCT lon FROM fx_cell))
SELECT min(lon) AS low, max(lon) AS high, min(CASE WHEN a IS NULL THEN b - lon WHEN b IS NULL THEN lon - a ELSE (b - a) / 2 END) AS resolution FROM v""")
def g03(g):
    return T.infer_resolution(g, "lon")


@query("g04_time_slice_grids", "fx_score", "fx_point", sql="SELECT p.age, CAST(round((round(lon) + 180) / 2) AS INT) AS i, CAST(round((round(lat) + 70) / 2) AS INT) AS j, arg_max(probability, point_id) AS probability, arg_max(erosion_m, point_id) AS erosion_m FROM fx_point p JOIN fx_score s USING (point_id) WHERE (round(lon) + 180) % 2 = 0 AND (round(lat) + 70) % 2 = 0 AND p.age IN (1, 2) GROUP BY ALL")
def g04(s, p):
    """Grids of several metrics for chosen times, all in one job."""
    rows = p.select("point_id", "age", F.round("lon").alias("lon"), F.round("lat").alias("lat")).join(s.drop("age"), "point_id").where(c("age").isin(1, 2))
    one, two = (T.grid_exact(rows, m, -180.0, -70.0, 2.0, "point_id", ["age"]).withColumnRenamed("value", m) for m in ("probability", "erosion_m"))
    return one.join(two, ["age", "i", "j"])


@query("g05_present_day_grid", "fx_score", "fx_point", sql="""
WITH a AS (SELECT node_index, avg(probability) AS p FROM fx_score WHERE probability > 0.5 GROUP BY node_index), n AS (SELECT s.node_index, min((p.lon, p.lat)) AS q FROM fx_score s JOIN fx_point p USING (point_id) GROUP BY s.node_index),
k AS (SELECT node_index, p, struct_extract(q, 1) AS lon, struct_extract(q, 2) AS lat FROM a JOIN n USING (node_index)),
x AS (SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, p, node_index, round(sqrt(pow(lon - (i * 5.0 - 180), 2) + pow(lat - (j * 5.0 - 70), 2)), 9) AS d FROM k JOIN range(73) a(i) ON abs(lon - (i * 5.0 - 180)) <= 5 JOIN range(29) b(j) ON abs(lat - (j * 5.0 - 70)) <= 5)
SELECT i, j, round(arg_min(p, (d, node_index)), 6) AS probability FROM x WHERE d <= 5 GROUP BY i, j""")
def g05(s, p):
    nodes = s.select("point_id", "node_index").join(p.select("point_id", "lon", "lat"), "point_id")
    mean = S.attach_coordinates(T.mean_by_location(s, ["probability"], "probability"), nodes, lon="lon", lat="lat")
    return T.grid_nearest(mean, "probability", -180.0, -70.0, 5.0, (73, 29), "node_index", []).select("i", "j", F.round("value", 6).alias("probability"))
