"""Deterministic views over the star-schema tables, in the shapes of the library's inputs.

The SQL is the same for both engines; Spark gets the tables as arguments, an oracle as views.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tessera.plans.tables import read_table

TABLES = ("part", "orders", "region", "supplier")
VIEWS = {
    "fx_trench": """
SELECT p_partkey AS trench_id, CAST(p_partkey % 5 AS INT) AS age,
  CAST((p_partkey*7919) % 3600 AS DOUBLE)/10 - 180 AS lon,
  CAST((p_partkey*104729) % 1400 AS DOUBLE)/10 - 70 AS lat,
  CAST(p_size % 6 AS INT) AS plate_id,
  CAST((p_partkey*31) % 1500 AS DOUBLE)/100 - 1 AS conv_rate_orth_cm_yr,
  CAST((p_partkey*31) % 1500 AS DOUBLE)/100 AS conv_rate_cm_yr,
  CAST((p_partkey*43) % 240 AS DOUBLE) - 120 AS obliquity_deg,
  CAST(p_size AS DOUBLE)/100 AS arc_len_deg,
  CAST(1 + (p_partkey*17) % 180 AS DOUBLE) AS seafloor_age_myr,
  CAST(10 + (p_partkey*29) % 120 AS DOUBLE) AS spreading_km_myr,
  CASE WHEN p_size % 11 = 0 THEN NULL ELSE CAST((p_partkey*13) % 500 AS DOUBLE) END AS sediment_m,
  CAST(5 + (p_partkey*7) % 80 AS DOUBLE) AS slab_dip_deg
FROM part""",
    "fx_point": """
SELECT o_orderkey AS point_id, CAST(o_orderkey % 5 AS INT) AS age,
  CAST((o_orderkey*6007+o_custkey) % 3600 AS DOUBLE)/10 - 180 + 3e-2 AS lon,
  CAST((o_orderkey*3571+o_custkey*7) % 1400 AS DOUBLE)/10 - 70 + 7e-2 AS lat,
  CAST(o_custkey % 6 AS INT) AS plate_id,
  CAST(1 + o_custkey % 3 AS DOUBLE) AS weight,
  CASE WHEN o_orderstatus='F' THEN 1 ELSE 0 END AS label,
  o_totalprice AS f1,
  CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE o_totalprice/(1.00009+o_custkey) END AS f2
FROM orders""",
    "fx_cell": """
SELECT p_partkey*5 + r_regionkey AS cell_id, CAST(r_regionkey AS INT) AS age,
  CAST((p_partkey*7549 + r_regionkey*11) % 720 AS DOUBLE)/2 - 180 AS lon,
  CAST((p_partkey*5701 + r_regionkey*3) % 280 AS DOUBLE)/2 - 70 AS lat,
  CASE WHEN p_size % 10 = 0 THEN NULL ELSE p_retailprice + 1.234567e-5 END AS z,
  CAST(p_size % 6 AS INT) AS plate_id
FROM part CROSS JOIN region""",
    "fx_score": """
SELECT o_orderkey AS point_id, CAST(o_orderkey % 5 AS INT) AS age, o_custkey AS node_index,
  CAST((o_orderkey*37+o_custkey) % 1000 AS DOUBLE)/1000 AS probability,
  CAST((o_orderkey*53) % 997 AS DOUBLE) AS erosion_m,
  CAST(1 + o_custkey % 3 AS DOUBLE) AS weight,
  CASE WHEN o_orderstatus='F' THEN 1 ELSE 0 END AS label
FROM orders""",
    "fx_vote": """
SELECT o_orderkey AS point_id, CAST(r_regionkey AS INT) AS tree_id,
  CASE WHEN (o_orderkey*(r_regionkey+3)) % 7 < 3 THEN 1 ELSE 0 END AS vote
FROM orders CROSS JOIN region""",
    "fx_rotation": """
SELECT CAST(p_partkey % 6 AS INT) AS plate_id, CAST(floor(CAST(p_partkey % 30 AS DOUBLE)/6) AS INT) AS age,
  CAST(sum((p_partkey*11) % 140) % 140 AS DOUBLE) - 70 AS pole_lat,
  CAST(sum((p_partkey*23) % 360) % 360 AS DOUBLE) - 180 AS pole_lon,
  floor(CAST(p_partkey % 30 AS DOUBLE)/6) * CAST(1 + p_partkey % 5 AS DOUBLE) AS angle_deg
FROM part GROUP BY p_partkey % 6, floor(CAST(p_partkey % 30 AS DOUBLE)/6), p_partkey % 5""",
    "fx_lookup": """
SELECT CAST(floor(CAST(k AS DOUBLE)/200) AS INT) AS table_id, CAST(k % 10 AS INT) AS p_idx,
  CAST(floor(CAST(k % 200 AS DOUBLE)/10) AS INT) AS t_idx,
  CAST(1000 * (k % 10) AS DOUBLE) AS p_bar,
  CAST(600 + 50 * floor(CAST(k % 200 AS DOUBLE)/10) AS DOUBLE) AS t_k,
  CAST(sum((p_partkey*p_partkey) % 97) % 97 AS DOUBLE)/10 AS value
FROM (SELECT p_partkey, p_partkey % 1600 AS k FROM part) q GROUP BY k""",
    "fx_segment": """
SELECT p_partkey AS segment_id, CAST(p_partkey % 5 AS INT) AS age,
  CAST((p_partkey*7919) % 3400 AS DOUBLE)/10 - 170 + 1.1e-2 AS lon1,
  CAST((p_partkey*104729) % 1300 AS DOUBLE)/10 - 65 + 1.3e-2 AS lat1,
  CAST((p_partkey*7919) % 3400 AS DOUBLE)/10 - 167 + 1.1e-2 AS lon2,
  CAST((p_partkey*104729) % 1300 AS DOUBLE)/10 - 63 + 1.3e-2 AS lat2,
  CASE WHEN p_partkey % 3 = 0 THEN 'Left' WHEN p_partkey % 3 = 1 THEN 'Right' ELSE 'None' END AS polarity,
  CAST(p_size % 6 - 1 AS INT) AS over_plate, p_type AS type, p_name AS name
FROM part""",
    "fx_ring": """
SELECT poly_id, plate_id, type_rank, area_rank, seq, CAST(x AS DOUBLE) AS lon, CAST(y AS DOUBLE) AS lat
FROM (VALUES
 (1,1,2,1,0,-120,-50),(1,1,2,1,1,20,-50),(1,1,2,1,2,20,50),(1,1,2,1,3,-120,50),(1,1,2,1,4,-120,-50),
 (2,2,2,2,0,-40,-30),(2,2,2,2,1,60,-30),(2,2,2,2,2,10,40),(2,2,2,2,3,-40,-30),
 (3,3,0,3,0,80,-60),(3,3,0,3,1,170,-60),(3,3,0,3,2,120,0),(3,3,0,3,3,170,60),(3,3,0,3,4,80,60),(3,3,0,3,5,80,-60)
) AS t(poly_id, plate_id, type_rank, area_rank, seq, x, y)
UNION ALL
SELECT CAST(10 + s_suppkey AS INT) AS poly_id, CAST(s_suppkey % 6 AS INT) AS plate_id, CAST(s_suppkey % 4 AS INT) AS type_rank,
  CAST(10 + s_suppkey AS INT) AS area_rank, CAST(seq AS INT) AS seq,
  CAST((s_suppkey*7919) % 3400 AS DOUBLE)/10 - 170 + 1.3e-2 + (3 + s_suppkey % 7) * dx AS lon,
  CAST((s_suppkey*104729) % 1200 AS DOUBLE)/10 - 60 + 1.7e-2 + (3 + s_suppkey % 7) * dy AS lat
FROM supplier CROSS JOIN (VALUES (0,-1,0),(1,0,-1),(2,1,0),(3,0,1),(4,-1,0)) AS d(seq, dx, dy)""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture view as a DataFrame, without registering anything."""
    text = VIEWS[name]
    used = [t for t in TABLES if re.search(rf"(?:FROM|JOIN) {t}\b", text)]
    for t in used:
        text = re.sub(rf"(FROM|JOIN) {t}\b", rf"\1 {{{t}}} {t}", text)
    return spark.sql(text, **{t: read_table(spark, sf_dir, t) for t in used})


def with_views(sql: str) -> str:
    """An oracle's SQL with the views that it names as common table expressions."""
    used = [n for n in VIEWS if re.search(rf"\b{n}\b", sql)]
    head = ", ".join(f"{n} AS ({VIEWS[n]})" for n in used)
    body = sql.strip()
    if re.match(r"(?i)with\s+recursive\b", body):
        return f"WITH RECURSIVE {head}, {body[14:].strip()}"
    if re.match(r"(?i)with\b", body):
        return f"WITH {head}, {body[4:].strip()}"
    return f"WITH {head} {body}" if head else body
