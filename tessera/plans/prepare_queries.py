"""Queries of sources, filters, imputation, scaling, unions and sampling (A*, B*, I*, M1, M3, M5, U*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import prepare as R
from tessera.plans.registry import query
from tessera.plans.tables import new_path
from tessera.sources import files

c = F.col


def _by_session(key: str, *views: str, sql: str | None = None):
    """Like ``query`` for functions that also take the session."""
    def add(f):
        query(key, *views, sql=sql)(lambda *dfs: f(dfs[0].sparkSession, *dfs))
        return f

    return add


@_by_session("a01_read_points", "fx_point", sql="SELECT point_id, age, lon, lat, weight FROM fx_point")
def a01_read_points(spark, p):
    path = new_path(spark, "points")
    files.write_table(p.select("point_id", "age", "lon", "lat", "weight"), path, "csv")
    return files.read_points(spark, path)


@_by_session("a02_write_table", "fx_point", sql="SELECT point_id, f1, f2 FROM fx_point")
def a02_write_table(spark, p):
    path = new_path(spark, "table")
    files.write_table(p.select("point_id", "f1", "f2"), path)
    return spark.read.parquet(path)


@_by_session("a03_read_grid", "fx_cell", sql="SELECT cell_id, age, lon, lat, z AS value FROM fx_cell WHERE age IN (1, 3)")
def a03_read_grid(spark, g):
    root = new_path(spark, "grids")
    files.write_grid(g.withColumnRenamed("z", "value"), root, "thickness", "double")
    return files.read_grid(spark, root, "thickness", [1, 3]).select("cell_id", "age", "lon", "lat", "value")


@_by_session("a04_write_grid", "fx_cell", sql="SELECT cell_id, age, CAST(CAST(z AS FLOAT) AS DOUBLE) AS value FROM fx_cell")
def a04_write_grid(spark, g):
    root = new_path(spark, "grids")
    files.write_grid(g.withColumnRenamed("z", "value"), root, "thickness")
    return files.read_grid(spark, root, "thickness", None).select("cell_id", "age", c("value").cast("double").alias("value"))


@_by_session("a05_read_lookup", "fx_lookup", sql="SELECT p_idx, t_idx, p_bar, t_k, value FROM fx_lookup")
def a05_read_lookup(spark, lookup):
    path = new_path(spark, "lookup")
    lines = lookup.select(F.concat(F.lit("  "), c("t_k"), F.lit("   "), c("p_bar"), F.lit("  "), "value").alias("value"))
    head = spark.range(12).select(F.concat(F.lit("header "), c("id")).alias("value"))
    # one small text file, as such tables come
    numbered = head.withColumn("o", F.lit(0)).unionByName(lines.withColumn("o", F.lit(1))).coalesce(1).sortWithinPartitions("o", "value")
    numbered.select("value").write.text(path)
    return files.read_lookup(spark, path, 0).select("p_idx", "t_idx", "p_bar", "t_k", "value")


@_by_session("a06_materialise_once", "fx_point", sql="SELECT age, CAST(count(*) AS BIGINT) AS n FROM fx_point GROUP BY age")
def a06_materialise_once(spark, p):
    root = new_path(spark, "stages")
    build = lambda: p.groupBy("age").agg(F.count("*").alias("n"))
    files.materialise_once(spark, root, "by_age", {"step": 1}, build)
    return files.materialise_once(spark, root, "by_age", {"step": 1}, lambda: 1 / 0)


B1 = "conv_rate_cm_yr >= 0 AND conv_rate_orth_cm_yr >= 0"


@query("b01_filter_physical_strict", "fx_trench", sql=f"SELECT trench_id FROM fx_trench WHERE {B1} AND sediment_m >= 0 AND obliquity_deg BETWEEN -90 AND 90")
def b01(t):
    return R.filter_physical(t, True, fluxes=("sediment_m",)).select("trench_id")


@query("b02_filter_physical", "fx_trench", sql=f"SELECT trench_id FROM fx_trench WHERE {B1}")
def b02(t):
    return R.filter_physical(t, False).select("trench_id")


@query("b03_within_trench_distance", "fx_score", sql="SELECT point_id FROM fx_score WHERE erosion_m <= radians(6.0) * 6371.0")
def b03(s):
    return R.within_trench_distance(s, 6.0, "erosion_m").select("point_id")


@query("b04_age_range", "fx_point", sql="SELECT point_id, CAST(age AS DOUBLE) AS age FROM fx_point WHERE point_id % 7 <> 0 AND age BETWEEN 1 AND 3")
def b04(p):
    text = F.when(c("point_id") % 7 == 0, "unknown").otherwise(c("age").cast("string"))
    return R.age_range(p.withColumn("age", text), 1, 3).select("point_id", "age")


@query("b05_snap_to_step", "fx_score", sql="""
SELECT point_id, CAST(ceil(erosion_m / 10 / 5 - 0.5) * 5 AS DOUBLE) AS step, list_extract(list_sort(list_transform([0.0, 7.0, 20.0, 55.0], lambda s: struct_pack(d := abs(erosion_m / 10 - s), s := CAST(s AS DOUBLE)))), 1).s AS listed FROM fx_score""")
def b05(s):
    out = R.snap_to_steps(s.withColumn("a", c("erosion_m") / 10), [0, 7, 20, 55], "a", "listed")
    return out.select("point_id", R.snap_to_step(c("a"), 5).cast("double").alias("step"), "listed")


@query("b06_default_weight", "fx_vote", sql="SELECT point_id, tree_id, 1.0::DOUBLE AS weight FROM fx_vote")
def b06(v):
    return R.default_weight(v).select("point_id", "tree_id", "weight")


@query("b07_drop_incomplete", "fx_point", sql="SELECT point_id FROM fx_point WHERE f2 IS NOT NULL")
def b07(p):
    return R.drop_incomplete(p, ["f2", "absent"]).select("point_id")


@query("b08_drop_degenerate", "fx_point", sql="SELECT point_id, lon, f2 FROM fx_point")
def b08(p):
    return R.drop_degenerate_columns(p.select("point_id", "lon", "f2", F.lit(None).cast("double").alias("none"), F.lit(4.0).alias("one")))


@query("b09_project_features", "fx_point", sql="SELECT f1, CAST(NULL AS DOUBLE) AS absent, f2 FROM fx_point")
def b09(p):
    return R.project_features(p, ["lon", "lat"], ["lon", "f1", "absent", "f2"])


@query("b10_high_only", "fx_score", sql="SELECT point_id FROM fx_score WHERE probability > 0.5")
def b10(s):
    return R.high_only(s, "probability").select("point_id")


@query("b11_deposit_age_class", "fx_point", sql="SELECT point_id, CASE WHEN age - 1 <= 2.5 THEN 'new' ELSE 'old' END AS age_class FROM fx_point WHERE age >= 1")
def b11(p):
    return R.deposit_age_class(p, 1).select("point_id", "age_class")


@query("b12_valid_only", "fx_score", sql="SELECT point_id FROM fx_score WHERE erosion_m <= 300")
def b12(s):
    return R.valid_only(s.withColumn("valid", c("erosion_m") <= 300)).select("point_id")


@query("b13_iqr_fence", "fx_score", sql="SELECT round(q3 + 1.5 * (q3 - q1), 6) AS fence FROM (SELECT quantile_cont(erosion_m, 0.25) AS q1, quantile_cont(erosion_m, 0.75) AS q3 FROM fx_score)")
def b13(s):
    return R.iqr_upper_fence(s, "erosion_m").select(F.round("fence", 6).alias("fence"))


@query("b14_exclude_zero", "fx_score", sql="SELECT point_id FROM fx_score WHERE erosion_m > 0")
def b14(s):
    return R.exclude_zero(s, "erosion_m").select("point_id")


@query("b15_points_at_time", "fx_point", "fx_rotation", sql="SELECT point_id, weight FROM fx_point p WHERE age >= 2 AND EXISTS (SELECT 1 FROM fx_rotation r WHERE r.plate_id = p.plate_id AND r.age = 2)")
def b15(p, r):
    from tessera.operators.spatial import reconstruct_steps

    return reconstruct_steps(p, r).where("t = 2 and lon_t is not null").select("point_id", "weight")


@query("m01_impute_median", "fx_point", sql="SELECT point_id, round(coalesce(f2, m, 0.0), 6) AS f2 FROM fx_point JOIN (SELECT age, median(f2) AS m FROM fx_point GROUP BY age) USING (age)")
def m01(p):
    return R.impute_median(p, ["f2"]).select("point_id", F.round(c("f2"), 6).alias("f2"))


@query("m03_robust_scale", "fx_point", sql="SELECT point_id, round((f1 - m) / s, 6) AS f1 FROM fx_point CROSS JOIN (SELECT median(f1) AS m, quantile_cont(f1, 0.75) - quantile_cont(f1, 0.25) AS s FROM fx_point WHERE label = 1)")
def m03(p):
    return R.apply_scale(p, R.robust_scale(p.where("label = 1"), ["f1"])).select("point_id", F.round("f1", 6).alias("f1"))


@query("m05_pu_relabel", "fx_score", sql="SELECT point_id, CAST(CASE WHEN label = 1 THEN 1 WHEN probability > 0.5 THEN 2 ELSE 0 END AS INT) AS new_label FROM fx_score")
def m05(s):
    return R.pu_relabel(s).select("point_id", "new_label")


@query("u01_stack_labelled", "fx_point", "fx_score", sql="SELECT point_id, f1, CAST(NULL AS DOUBLE) AS erosion_m, CAST(1 AS INT) AS label FROM fx_point UNION ALL SELECT point_id, NULL, erosion_m, 0 FROM fx_score")
def u01(p, s):
    return R.stack_labelled(p.select("point_id", "f1"), s.select("point_id", "erosion_m")).select("point_id", "f1", "erosion_m", "label")


@query("u02_balance_union", "fx_point", sql="SELECT CAST(label AS INT) AS label, (SELECT count(*) FROM fx_point WHERE label = 1) AS n FROM (VALUES (0), (1)) t(label)")
def u02(p):
    positive, flipped = p.where("label = 1"), p.where("label = 0")
    most = flipped.unionByName(flipped.withColumn("point_id", -c("point_id") - 1))
    return R.balance_union(positive.unionByName(most)).groupBy("label").agg(F.count("*").alias("n"))


def order_by(seed: int):
    """A hashed order of points that SQL has as well."""
    return F.conv(F.substring(F.md5(F.concat(c("point_id").cast("string"), F.lit(f":{seed}"))), 1, 15), 16, 10).cast("long")


def order_sql(seed: str) -> str:
    return f"CAST('0x' || substr(md5(point_id || ':' || {seed}), 1, 15) AS BIGINT)"


@query("i03_downsample", "fx_point", sql=f"""
WITH e AS (SELECT list_sort(list_distinct(quantile_cont(CAST(age AS DOUBLE), [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS e FROM fx_point),
a AS (SELECT p.*, len(e) AS m, greatest(len(list_filter(e, lambda x: x < p.age)), 1) AS b FROM fx_point p CROSS JOIN e),
g AS (SELECT *, min(lon) OVER w AS x0, max(lon) OVER w AS x1, min(lat) OVER w AS y0, max(lat) OVER w AS y1 FROM a WINDOW w AS (PARTITION BY b)),
k AS (SELECT *, coalesce(least(floor((lon - x0) / nullif(x1 - x0, 0) * 4), 3), 0) AS i, coalesce(least(floor((lat - y0) / nullif(y1 - y0, 0) * 4), 3), 0) AS j FROM g),
n AS (SELECT b, count(DISTINCT (i, j)) AS k FROM k GROUP BY b),
r AS (SELECT k.*, greatest(1, floor(floor(500 / greatest(m - 1, 1)) / n.k)) AS most, row_number() OVER (PARTITION BY b, i, j ORDER BY {order_sql("42")}) AS rk FROM k JOIN n USING (b))
SELECT point_id, age, lon, lat FROM r WHERE rk <= most""")
def i03(p):
    return R.downsample(p, 500, 5, 4, order=order_by(42)).select("point_id", "age", "lon", "lat")


@query("i04_split", "fx_point", sql="""
WITH n AS (SELECT count(*) AS n FROM fx_point) SELECT CAST(0 AS INT) AS part, CAST(round(n * 0.6) AS BIGINT) AS n FROM n
UNION ALL SELECT 1, CAST(round(n * 0.8) - round(n * 0.6) AS BIGINT) FROM n UNION ALL SELECT 2, CAST(n - round(n * 0.8) AS BIGINT) FROM n""")
def i04(p):
    return R.split(p, [0.6, 0.2, 0.2]).groupBy("part").agg(F.count("*").alias("n"))


@query("i05_stratified_folds", "fx_point", sql=f"""
WITH r AS (SELECT point_id, label, t.r, row_number() OVER (PARTITION BY label, t.r ORDER BY {order_sql("(42 + t.r)")}) AS rk, count(*) OVER (PARTITION BY label, t.r) AS n FROM fx_point CROSS JOIN (SELECT CAST(r AS INT) AS r FROM range(2) q(r)) t)
SELECT point_id, label, r AS "repeat", CAST((rk > n * 1 // 5) AS INT) + CAST((rk > n * 2 // 5) AS INT) + CAST((rk > n * 3 // 5) AS INT) + CAST((rk > n * 4 // 5) AS INT) AS fold FROM r""")
def i05(p):
    return R.stratified_folds(p, 5, 2, order=lambda r: order_by(42 + r)).select("point_id", "label", "repeat", "fold")


@query("i06_random_holdouts", "fx_point", sql="SELECT CAST(s AS BIGINT) AS split_id, (SELECT CAST(floor(0.7 * count(*)) AS BIGINT) FROM fx_point) AS n FROM range(5) t(s)")
def i06(p):
    return R.random_holdouts(p, 5).where("train").groupBy("split_id").agg(F.count("*").alias("n"))


