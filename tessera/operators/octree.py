"""Nearest targets on the sphere by an octree whose cubes split where targets crowd.

The unit sphere lies in a cube that is cut into 4 x 4 x 4 cubes again and again. A cube of at most
``LEAF`` places is a leaf, so sides differ from one key (an age, a plate) to another and from place to
place, and no cube holds a crowd. Only cubes below the root or below one that was split are kept.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.sphere import EARTH_RADIUS_KM, haversine_km, xyz
from tessera.plans.tables import drop_files, materialise

c = F.col

#: Most places in a cube that isn't split.
LEAF = 32
#: Levels at most: the side of a cube is then some 20 cm, and places in one are all compared.
DEEPEST = 13
#: The root cube's side and its lowest corner, some way off the sphere.
SIDE, LOW = 2.5, -1.25
PLACE, CUBE = ("_u", "_v", "_w"), ("_i", "_j", "_k")


def _placed(df: DataFrame) -> DataFrame:
    """Places as ``_u, _v, _w`` in the root cube, from 0 to 1."""
    return df.withColumns({a: (x - LOW) / SIDE for a, x in zip(PLACE, xyz(c("lon"), c("lat")))})


def _squares(xs: list[Column]) -> Column:
    # a product would be computed from two copies of each term
    return sum((F.pow(x, F.lit(2)) for x in xs[1:]), F.pow(xs[0], F.lit(2)))


def _cuts() -> Column:
    """The cubes along an axis at ``_level``, a power of 4, so that cubes nest without rounding."""
    return F.expr("shiftleft(1L, 2 * _level)")


def _own_cubes(df: DataFrame, depth: int) -> DataFrame:
    """Each row with the cube of every level that holds it."""
    each = df.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(depth))))
    return each.withColumns({k: F.floor(c(a) * _cuts()) for a, k in zip(PLACE, CUBE)})


def _within(reach: Column) -> Column:
    """Whether a cube of the sphere's surface has a point within ``reach`` of a place."""
    side = 1 / _cuts()
    near = _squares([F.greatest(c(k) * side - c(a), c(a) - (c(k) + 1) * side, F.lit(0.0)) for a, k in zip(PLACE, CUBE)])
    out = F.sqrt(_squares([(c(k) + 0.5) * side - 0.5 for k in CUBE]))
    return (near <= reach * reach) & (F.abs(out - 1 / SIDE) <= side * 0.8661)


def octree(targets: DataFrame, on: list[str], tid: str, leaf: int = LEAF) -> tuple[DataFrame, int]:
    """``(on, _level, _i, _j, _k, _open, _r)`` and the deepest level.

    A leaf has a row for each of its places, ``_r`` holding the smallest id there; a cube that was split
    (``_open``) has one for the place nearest to its centre.
    """
    places = materialise(_placed(targets.groupBy(*on, "lon", "lat").agg(F.min(tid).alias("_id"))), "places")
    most = places.groupBy(*on).count().agg(F.max("count").alias("n")).first()["n"] or 1
    # a level has some 16 times as many cubes on the sphere as the one above it
    depth, cube = min(DEEPEST, 1 + math.ceil(math.log(max(1.0, most / leaf), 16))), [*on, "_level", *CUBE]
    target = F.struct("_id", "lon", "lat", *PLACE)
    while True:
        each = _own_cubes(places, depth)
        middle = _squares([c(a) * _cuts() - c(k) - 0.5 for a, k in zip(PLACE, CUBE)])
        cubes = materialise(each.groupBy(*cube).agg(F.count("*").alias("_n"), F.min(F.struct(middle.alias("d"), target.alias("r"))).alias("_mid")), "cubes")
        crowded = c("_n") > leaf
        if depth == DEEPEST or not cubes.where(crowded & (c("_level") == depth)).limit(1).count():
            break
        drop_files(cubes)
        depth = min(DEEPEST, depth + 2)
    open_ = crowded & (c("_level") < depth)
    above = cubes.where(open_).select(*on, (c("_level") + 1).alias("_level"), *[c(k).alias(f"_p{k}") for k in CUBE])
    below = cubes.withColumns({f"_p{k}": F.shiftright(k, 2) for k in CUBE}).where("_level > 0").join(above, [*on, "_level", *[f"_p{k}" for k in CUBE]], "left_semi")
    kept = cubes.where("_level = 0").select(*cube, "_n", "_mid").unionByName(below.select(*cube, "_n", "_mid"))
    leaves = each.join(kept.where(~open_).select(*cube), cube, "left_semi").select(*cube, F.lit(False).alias("_open"), target.alias("_r"))
    tree = materialise(leaves.unionByName(kept.where(open_).select(*cube, F.lit(True).alias("_open"), c("_mid.r").alias("_r"))), "octree")
    drop_files(places)
    drop_files(cubes)
    return tree, depth


def nearest_ids(points: DataFrame, targets: DataFrame, on: list[str], pid: str, tid: str, leaf: int = LEAF) -> DataFrame:
    """``(pid, on, tid, distance_km)``: the nearest target of equal keys, ties (to a millimetre) to the smaller id.

    A point first meets the places of the leaf around it and the middles of the split cubes around it;
    the least distance bounds how far its nearest is, and only numbers are aggregated. Then it meets the
    leaves that reach into that bound. Split cubes that do so are opened level by level, while the bound
    shrinks with each middle met, so a point outside a crowd goes down at its near side alone. Points and
    targets have coordinates.
    """
    tree, depth = octree(targets, on, tid, leaf)
    cube, point = [*on, "_level", *CUBE], [pid, *on, "lon", "lat"]
    apart = _squares([c(a) - c("_r")[a] for a in PLACE])
    km = haversine_km(c("lon"), c("lat"), c("_r.lon"), c("_r.lat"))
    met = F.struct(F.round(km, 6).alias("km"), c("_r._id").alias("id"), km.alias("exact"))
    # wider than the millimetre of a tie
    reach = lambda far: far * (1 + 1e-9) + 1e-9

    home = F.max(F.when(~c("_open"), c("_level")))
    found = _own_cubes(_placed(points.select(*point)), depth).join(tree, cube).groupBy(*point)
    found = materialise(found.agg(reach(F.sqrt(F.min(apart))).alias("_reach"), home.alias("_home")), "bounds")

    span = lambda low, high: F.explode(F.when(low <= high, F.sequence(low, high)))
    ball = lambda a, sign: F.greatest(F.floor((c(a) + sign * c("_reach")) * _cuts()), F.lit(0))
    last = F.greatest(F.least(F.floor(-F.log(c("_reach")) / math.log(4)), F.lit(depth)), F.lit(0)).cast("int")
    near = _placed(found).withColumn("_last", last).withColumn("_level", F.explode(F.sequence(F.lit(0), c("_last"))))
    for a, k in zip(PLACE, CUBE):
        near = near.withColumn(k, span(ball(a, -1), ball(a, 1)))
    own = F.lit(True)
    for a, k in zip(PLACE, CUBE):
        own = own & (c(k) == F.floor(c(a) * _cuts()))
    # around the point's leaf there are split cubes alone, within it there are none
    known = own & c("_home").isNotNull() & ((c("_level") > c("_home")) | (c("_level") < F.least("_home", "_last")))
    near, steps = near.where(_within(c("_reach")) & ~known), []
    while True:
        both = near.select(*point, *PLACE, "_reach", "_last", "_level", *CUBE).join(tree, cube).withColumn("_far", F.sqrt(apart))
        both = both.where(F.when(c("_open"), c("_level") == c("_last")).otherwise(c("_far") <= c("_reach")))
        split = F.when(c("_open"), F.struct("_level", *CUBE)).alias("_split")
        step = both.groupBy(*point, split).agg(F.min(met).alias("_best"), F.least(F.min("_reach"), reach(F.min("_far"))).alias("_reach"))
        steps.append(step := materialise(step, "step"))
        if not step.where("_split is not null").limit(1).count():
            break
        bound = F.min("_reach").over(Window.partitionBy(pid, *on))
        near = _placed(step.withColumn("_reach", bound).where("_split is not null").select(*point, "_reach", "_split.*")).where(_within(c("_reach")))
        near = near.withColumnsRenamed({k: f"_p{k}" for k in CUBE}).withColumn("_level", c("_level") + 1).withColumn("_last", c("_level"))
        for a, k in zip(PLACE, CUBE):
            low, high = c(f"_p{k}") * 4, c(f"_p{k}") * 4 + 3
            near = near.withColumn(k, span(F.greatest(low, ball(a, -1)), F.least(high, ball(a, 1))))
        near = near.where(_within(c("_reach")))
    every = steps[0].select(pid, *on, "_best")
    for t in steps[1:]:
        every = every.unionByName(t.select(pid, *on, "_best"))
    out = every.groupBy(pid, *on).agg(F.min("_best").alias("_best")).select(pid, *on, c("_best.id").alias(tid), c("_best.exact").alias("distance_km"))
    out = materialise(out, "nearest")
    for t in [tree, found, *steps]:
        drop_files(t)
    return out
