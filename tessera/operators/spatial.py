"""Joins on the sphere: nearest, within a radius, in polygons, beside lines, in lookup tables.

Tables have ``lon`` and ``lat`` in degrees. All joins pair rows of equal keys (the age, and the plate
where one is asked for) and equal cubes of the unit sphere, which have no seam at the date line or
the poles; no join pairs all rows with all others.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.sphere import chord, clip, rotated, xyz
from tessera.operators.lines import eligible_segments, in_zone, one_sided  # noqa: F401
from tessera.operators.octree import nearest_ids
from tessera.operators.polygons import assign_plate, points_in_polygons, polygon_matches, rings, top_polygon  # noqa: F401
from tessera.plans.tables import materialise

c = F.col


def _cubes(df: DataFrame, side: float, neighbours: bool, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Unit vectors as _x, _y, _z and the cube(s) of a row as _cx, _cy, _cz."""
    df = df.withColumns(dict(zip(("_x", "_y", "_z"), xyz(c(lon), c(lat)))))
    cells = {f"_c{a}": F.floor(c(f"_{a}") / side) for a in "xyz"}
    df = df.withColumns(cells)
    if neighbours:
        for a in "xyz":
            df = df.withColumn(f"_c{a}", F.explode(F.array(*[c(f"_c{a}") + d for d in (-1, 0, 1)])))
    return df


def pairs_within(left: DataFrame, right: DataFrame, side: float, on: list[str]) -> DataFrame:
    """Rows of ``left`` (all columns) with each row of ``right`` (a struct ``_r``) at a chord of at most ``side``."""
    r = _cubes(right, side, True).select(*on, "_cx", "_cy", "_cz", F.struct(*right.columns).alias("_r"), c("_x").alias("_u"), c("_y").alias("_v"), c("_z").alias("_w"))
    both = _cubes(left, side, False).join(r, [*on, "_cx", "_cy", "_cz"])
    d2 = (c("_x") - c("_u")) ** 2 + (c("_y") - c("_v")) ** 2 + (c("_z") - c("_w")) ** 2
    return both.withColumn("_d2", d2).where(c("_d2") <= side * side * (1 + 1e-12)).select(*left.columns, "_r", "_d2")


def nearest(points: DataFrame, targets: DataFrame, on: list[str], pid: str, tid: str, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """``(pid, _t, distance_km)``: the nearest target of equal keys as a struct; ties to the smaller id.

    Ids are unique within their keys; only ids and places go through the octree of the targets (see
    :func:`tessera.operators.octree.nearest_ids`). Points without coordinates or without a target of
    their keys are absent.
    """
    targets = targets.where(c("lon").isNotNull() & c("lat").isNotNull())
    points = points.where(c(lon).isNotNull() & c(lat).isNotNull()).select(pid, *on, c(lon).alias("lon"), c(lat).alias("lat"))
    found = nearest_ids(points, targets, on, pid, tid)
    full = targets.dropDuplicates([*on, tid]).select(*on, tid, F.struct(*targets.columns).alias("_t"))
    return found.join(full, [*on, tid]).select(pid, "_t", "distance_km")


def nearest_k(points: DataFrame, targets: DataFrame, k: int, on: list[str], pid: str, tid: str, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """``(pid, tid)``: the k targets of equal keys with the least sum of differences in degrees, ties to
    the smaller id.

    Targets at one place are met as one, by their k smallest ids, and so are points at one place. Places
    meet in tiles; one that finds k targets within a tile's width is done, the rest look in
    tiles four times as wide, up to the whole plane for those that have fewer than k.
    """
    spot = [*on, "_u", "_v"]
    each = targets.select(*on, c(tid).alias("_id"), c("lon").alias("_u"), c("lat").alias("_v"))
    lean = materialise(window_rank(each, k, spot, [c("_id")]).groupBy(*spot).agg(F.collect_list("_id").alias("_ids")), "places")
    where = points.select(pid, *on, c(lon).alias("_x"), c(lat).alias("_y"))
    here = [*on, "_x", "_y"]
    rest = where.select(*here).distinct()
    n = lean.groupBy(*on).agg(F.count("*").alias("n")).agg(F.avg("n").alias("n")).first()["n"] or 1.0
    width, out = math.sqrt(360 * 180 * 2 * k / n), None
    while True:
        last = width >= 540
        tiles = [F.explode(F.array(*[F.floor(c(x) / width) + d for d in (-1, 0, 1)])) for x in ("_u", "_v")]
        right = lean.withColumn("_i", tiles[0]).withColumn("_j", tiles[1])
        both = rest.withColumns({"_i": F.floor(c("_x") / width), "_j": F.floor(c("_y") / width)}).join(right, [*on, "_i", "_j"])
        both = both.withColumn("_far", F.abs(c("_u") - c("_x")) + F.abs(c("_v") - c("_y"))).where(c("_far") <= width)
        ranked = window_rank(both.select(*here, "_far", F.explode("_ids").alias("_id")), k, here, [c("_far"), c("_id")])
        got = materialise(ranked.groupBy(*here).agg(F.collect_list("_id").alias("_found")), "nearest-k")
        if not last:
            got = got.where(F.size("_found") == k)
        out = got if out is None else out.union(got)
        if last:
            break
        rest = materialise(rest.join(got.select(*here), here, "left_anti"), "far")
        if not rest.limit(1).count():
            break
        width *= 4
    return where.join(out, here).select(pid, F.explode("_found").alias(tid))


def nearest_trench(points: DataFrame, trench: DataFrame, max_deg: float | None = None, pid: str = "point_id", tid: str = "trench_id") -> DataFrame:
    """Every point with the columns of its age's nearest trench sample that it lacks, and the distance.

    With ``max_deg`` a column ``valid`` tells whether it is that near. Points of an age without samples
    keep NULL.
    """
    found = nearest(points, trench, ["age"], pid, tid)
    new = [x for x in trench.columns if x not in points.columns]
    out = points.join(found, pid, "left").select(*points.columns, *[c("_t")[x].alias(x) for x in new], c("distance_km").alias("distance_to_trench_km"))
    if max_deg is not None:
        out = out.withColumn("valid", F.coalesce(c("distance_to_trench_km") <= math.radians(max_deg) * 6371.0, F.lit(False)))
    return out


def radius_mean(points: DataFrame, grid: DataFrame, degrees: float, on: list[str], out: str, pid: str = "point_id", cid: str = "cell_id", value: str = "z", lon: str = "lon", lat: str = "lat", fallback: bool = True) -> DataFrame:
    """``points`` with the mean of the known cells within a radius, else the nearest known cell's value.

    ``on`` holds the keys that must agree, such as the age, and the plate for values of one plate.
    """
    known = grid.where(c(value).isNotNull()).select(*dict.fromkeys([*on, cid, "lon", "lat", value]))
    here = points.where(c(lon).isNotNull() & c(lat).isNotNull()).select(pid, *on, c(lon).alias("lon"), c(lat).alias("lat"))
    mean = pairs_within(here, known, chord(degrees), on).groupBy(pid).agg(F.avg(c("_r")[value]).alias("_mean"))
    found = points.join(mean, pid, "left")
    if not fallback:
        return found.select(*points.columns, c("_mean").alias(out))
    found = materialise(found, "radius")
    near = nearest(found.where(c("_mean").isNull()), known, on, pid, cid, lon, lat)
    return found.join(near, pid, "left").select(*points.columns, F.coalesce("_mean", c("_t")[value]).alias(out))


def clip_to_extent(points: DataFrame, lon: tuple[float, float], lat: tuple[float, float]) -> DataFrame:
    return points.where(c("lon").between(*lon) & c("lat").between(*lat))


def reconstruct(points: DataFrame, rotation: DataFrame, at: str = "age", inverse: bool = False, out: tuple[str, str] = ("rec_lon", "rec_lat")) -> DataFrame:
    """Positions at the age in column ``at``, by the plate's total rotation; from there with ``inverse``.

    Age 0 is the identity. Without a plate or rotation the position is NULL. There is a rotation for
    each plate and age, few enough to broadcast below the session's bound.
    """
    r = rotation.select("plate_id", c("age").alias(at), "pole_lat", "pole_lon", "angle_deg")
    turned = rotated(c("lon"), c("lat"), c("pole_lon"), c("pole_lat"), -c("angle_deg") if inverse else c("angle_deg"))
    both = points.join(r, ["plate_id", at], "left")
    new = {o: F.when(c(at) == 0, c(i)).otherwise(t) for o, i, t in zip(out, ("lon", "lat"), turned)}
    return both.withColumns(new).select(*points.columns, *out)


def reconstruct_steps(points: DataFrame, rotation: DataFrame, step: int = 1) -> DataFrame:
    """A row for each step from 0 to the point's age, with the position then."""
    each = points.withColumn("t", F.explode(F.sequence(F.lit(0), c("age"), F.lit(step))))
    return reconstruct(each, rotation, "t").withColumnsRenamed({"rec_lon": "lon_t", "rec_lat": "lat_t"})


def wide_positions(steps: DataFrame, ages: list[int], keep: list[str], pid: str = "point_id") -> DataFrame:
    """One row a point with ``lon_{t}`` and ``lat_{t}`` for each age, NULL beyond its own, from a row a step.

    Columns of ``keep`` are the same in all steps of a point.
    """
    at = lambda x, t: F.max(F.when(c("t") == t, c(f"{x}_t"))).alias(f"{x}_{t}")
    return steps.groupBy(pid, *keep).agg(*[at(x, t) for t in ages for x in ("lon", "lat")])


def always_on_continent(steps: DataFrame, continents: DataFrame, on: list[str], pid: str = "point_id") -> DataFrame:
    """The points of which every known position is in a continent."""
    known = steps.select(pid, "t", *[k for k in on if k != "t"], c("lon_t").alias("lon"), c("lat_t").alias("lat"))
    held = top_polygon(known, continents, on, []).withColumn("_fine", c("lon").isNull() | c("lat").isNull() | c("_top").isNotNull())
    return held.groupBy(pid).agg(F.bool_and("_fine").alias("_fine")).where("_fine").select(pid)


def lookup_nearest(df: DataFrame, lookup: DataFrame, table: int, p: Column, t: Column, out: str) -> DataFrame:
    """The value at the nearest node of a regular pressure-temperature table; out of range takes the edge.

    The grid's corner and spacing are found from the table, of which one slice is a few thousand rows.
    """
    own = lookup.where(c("table_id") == table)
    g = own.agg(*[f(x).alias(f"{f.__name__}_{x}") for f in (F.min, F.max) for x in ("p_bar", "t_k", "p_idx", "t_idx")]).first()

    def index(x: Column, value: str, idx: str) -> Column:
        low, high = g[f"min_{value}"], g[f"max_{value}"]
        step = (high - low) / max(1, g[f"max_{idx}"] - g[f"min_{idx}"]) if low is not None else 1.0
        at = F.floor((x - (low or 0.0)) / (step or 1.0) + 0.5) + (g[f"min_{idx}"] or 0)
        return F.when(x.isNotNull(), F.least(F.greatest(at, F.lit(g[f"min_{idx}"] or 0)), F.lit(g[f"max_{idx}"] or 0))).cast("int")

    here = df.withColumns({"_pi": index(p, "p_bar", "p_idx"), "_ti": index(t, "t_k", "t_idx")})
    nodes = own.select(c("p_idx").alias("_pi"), c("t_idx").alias("_ti"), c("value").alias(out))
    return here.join(nodes, ["_pi", "_ti"], "left").drop("_pi", "_ti")


def complete_ages(agg: DataFrame, ages: DataFrame, value: str) -> DataFrame:
    """All ages, gaps filled with the mean of the aggregate."""
    mean = agg.agg(F.avg(value).alias("_mean"))
    return ages.select("age").distinct().join(agg, "age", "left").crossJoin(F.broadcast(mean)).select("age", F.coalesce(value, "_mean").alias(value))


def attach_coordinates(agg: DataFrame, nodes: DataFrame, key: str = "node_index", lon: str = "present_lon", lat: str = "present_lat") -> DataFrame:
    """Aggregates with the coordinates of their node, taken from the node's smallest row."""
    own = nodes.groupBy(key).agg(F.min(F.struct(lon, lat)).alias("_c")).select(key, c(f"_c.{lon}"), c(f"_c.{lat}"))
    return agg.join(own, key, "left")


def combine_by_key(prob: DataFrame, erosion: DataFrame, keys: list[str]) -> DataFrame:
    return prob.join(erosion, keys)


def strain_radius_mean(points: DataFrame, samples: DataFrame, degrees: float, value: str, pid: str = "point_id", sid: str = "cell_id") -> DataFrame:
    """Mean of the non-zero values within a radius; NULL if there is none."""
    return radius_mean(points, samples.where(c(value) != 0), degrees, ["age"], f"mean_{value}", pid, sid, value, fallback=False)


def first_network(points: DataFrame, networks: DataFrame, on: list[str], carry: list[str], order: str, pid: str = "point_id") -> DataFrame:
    """The columns of the first network polygon, in list order, that holds the point; else NULL."""
    found = top_polygon(points, networks.where(c(order).isNotNull()), on, carry, [-c(order)])
    return found.select(*points.columns, *[c("_top")[x].alias(x) for x in carry])


def grid_index(lon: Column, lat: Column, lon0: float, lat0: float, res: float) -> tuple[Column, Column]:
    return F.floor((lon - lon0) / res).cast("int"), F.floor((lat - lat0) / res).cast("int")


def sample_regular(points: DataFrame, grid: DataFrame, lon0: float, lat0: float, res: float, nlon: int, nlat: int, on: list[str], method: str = "nearest", out: str = "value", pid: str = "point_id") -> DataFrame:
    """Values of a regular grid ``(i, j, value)``, i eastward with wrap, j northward, at points.

    ``(lon0, lat0)`` is the centre of cell (0, 0). ``linear`` weighs the four cells around a point, by
    an equi-join on cell numbers; a point next to an unknown cell gets NULL.
    """
    x, y = (c("lon") - lon0) / res, clip((c("lat") - lat0) / res, 0, nlat - 1)
    cells = grid.select(*on, c("i").alias("_i"), c("j").alias("_j"), "value")
    if method == "nearest":
        here = points.withColumns({"_i": F.pmod(F.floor(x + 0.5), F.lit(nlon)).cast("int"), "_j": F.floor(y + 0.5).cast("int")})
        return here.join(cells.withColumnRenamed("value", out), [*on, "_i", "_j"], "left").drop("_i", "_j")
    i, j = F.floor(x), F.floor(y)
    u, v = x - i, y - j
    corners = F.array(*[F.struct(F.pmod(i + di, F.lit(nlon)).cast("int").alias("i"), F.least(j + dj, F.lit(nlat - 1)).cast("int").alias("j"), ((u if di else 1 - u) * (v if dj else 1 - v)).alias("w")) for di in (0, 1) for dj in (0, 1)])
    each = points.withColumn("_k", F.explode(corners)).select(pid, *on, c("_k.i").alias("_i"), c("_k.j").alias("_j"), c("_k.w").alias("_w"))
    each = each.where("_w > 0").join(cells, [*on, "_i", "_j"], "left")
    total = F.when(F.count("value") == F.count("*"), F.sum(c("value") * c("_w")))
    return points.join(each.groupBy(pid).agg(total.alias(out)), pid, "left")


def resample_regular(grid: DataFrame, shape: tuple[int, int], new: tuple[int, int], on: list[str]) -> DataFrame:
    """A regular grid ``(i, j, value)`` brought to another shape by linear weights, with wrap in i."""
    (m, n), (a, b) = shape, new
    spark = grid.sparkSession
    cells = spark.range(a * b).select((c("id") % a).cast("int").alias("i"), F.floor(c("id") / a).cast("int").alias("j"))
    x = (c("i") + 0.5) * m / a - 0.5
    y = clip((c("j") + 0.5) * n / b - 0.5, 0, n - 1)
    keys = grid.select(*on).distinct() if on else None
    cells = (cells.crossJoin(F.broadcast(keys)) if on else cells).withColumn("_id", F.struct(*on, "i", "j"))
    i, j = F.floor(x), F.floor(y)
    u, v = x - i, y - j
    corners = F.array(*[F.struct(F.pmod(i + di, F.lit(m)).cast("int").alias("i"), F.least(j + dj, F.lit(n - 1)).cast("int").alias("j"), ((u if di else 1 - u) * (v if dj else 1 - v)).alias("w")) for di in (0, 1) for dj in (0, 1)])
    each = cells.withColumn("_k", F.explode(corners)).select("_id", *on, c("_k.i").alias("i"), c("_k.j").alias("j"), c("_k.w").alias("_w")).where("_w > 0")
    each = each.join(grid.select(*on, "i", "j", "value"), [*on, "i", "j"], "left")
    value = F.when(F.count("value") == F.count("*"), F.sum(c("value") * c("_w")))
    return each.groupBy("_id").agg(value.alias("value")).select("_id.*", "value")


def window_rank(df: DataFrame, k: int, by: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_at", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(c("_at") <= k).drop("_at")
