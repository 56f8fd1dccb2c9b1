"""Points in polygons by cells that adapt to the rings.

Edges are straight in longitude and latitude and run the shorter way round, so a ring may cross the date
line. A ring that runs round a pole holds the pole that its vertices are nearer to. The plane is cut into
square cells; those within a ring accept points without a test, those at its border hold only the edges
that touch them and whether their corner is inside, which the crossings of the way from there to a point
make the answer. A cell that many edges touch is cut into four.

Where one polygon of a point's is asked for, the topmost or any, a polygon that holds a whole cell hides
those below it there, so that a cell holds few polygons however many lie upon each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.tables import materialise, spread

c = F.col
#: The widest cells; a corner of theirs, off any round coordinates; edges that a cell at the border may
#: have before it is cut; how often cells are halved at most; slack when edges are dealt to cells.
TILE, EAST, NORTH, MOST, DEPTH, SLACK = 30.0, 0.0123456789, 0.0234567891, 12, 14, 1e-7
#: Bytes of cells, about, up to which they go to all tasks, so that points needn't be shuffled.
BROADCAST = 32 << 20
EDGE = ("x1", "y1", "x2", "y2")
#: How often cells of a polygon are halved, beyond what its own edges need, where many polygons' edges meet.
CROWDED = 2


def rings(vertices: DataFrame, keep: list[str], poly: str = "poly_id") -> DataFrame:
    """Polygons with their vertices in order as one array, closed."""
    ring = F.transform(F.array_sort(F.collect_list(F.struct("seq", "lon", "lat"))), lambda v: F.struct(v["lon"].alias("lon"), v["lat"].alias("lat")))
    return vertices.groupBy(poly, *keep).agg(ring.alias("ring"))


def ring_edges(polygons: DataFrame, key: str) -> DataFrame:
    """``(key, x1, y1, x2, y2, real)`` for each edge, longitudes going on over the date line.

    A ring that ends a whole turn from where it began is closed along the pole by edges that aren't
    ``real``: they bound nothing and no point lies on them.
    """
    n = F.size("ring")
    edge = lambda a, b: F.struct(a["lon"].alias("x1"), a["lat"].alias("y1"), b["lon"].alias("x2"), b["lat"].alias("y2"))
    pairs = F.zip_with(F.slice("ring", 1, n - 1), F.slice("ring", 2, n - 1), edge)
    each = polygons.where(n > 1).select(key, F.posexplode(pairs).alias("at", "e")).select(key, "at", "e.*")
    turn = F.when(c("x2") - c("x1") > 180, -360.0).when(c("x2") - c("x1") < -180, 360.0).otherwise(0.0)
    ring = Window.partitionBy(key).orderBy("at")  # one ring, as its array was
    each = each.withColumn("turn", turn).withColumn("before", F.coalesce(F.sum("turn").over(ring.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    each = each.withColumns({"x1": c("x1") + c("before"), "x2": c("x2") + c("before") + c("turn")})
    own = each.groupBy(key).agg(F.sum(c("x2") - c("x1")).alias("net"), F.avg("y1").alias("mid"), F.min_by(F.struct("x1", "y1"), "at").alias("a"), F.max_by(F.struct("x2", "y2"), "at").alias("b"))
    pole = F.when(c("mid") < 0, -91.0).otherwise(91.0)
    way = [(c("b.x2"), c("b.y2")), (c("b.x2"), pole), (c("a.x1"), pole), (c("a.x1"), c("a.y1"))]
    legs = F.array(*[F.struct(p[0].alias("x1"), p[1].alias("y1"), q[0].alias("x2"), q[1].alias("y2")) for p, q in zip(way, way[1:])])
    closing = own.where(F.abs("net") > 180).select(key, F.explode(legs).alias("e")).select(key, "e.*", F.lit(False).alias("real"))
    return each.select(key, *EDGE, F.lit(True).alias("real")).unionByName(closing)


def _side(x1: Column, y1: Column, x2: Column, y2: Column, x: Column, y: Column) -> Column:
    """Positive to the left of an edge, zero on its line."""
    return (x2 - x1) * (y - y1) - (x - x1) * (y2 - y1)


def _left(e: tuple[Column, ...], x: Column, y: Column) -> Column:
    """Whether a place lies to the left of an edge; one on its line counts as a hair further east, or north."""
    x1, y1, x2, y2 = e
    side = _side(*e, x, y)
    return (side > 0) | ((side == 0) & ((y2 < y1) | ((y2 == y1) & (x2 > x1))))


def _crossed(e: tuple[Column, ...], x: Column, y: Column, cx: Column, cy: Column) -> Column:
    """Whether an edge crosses the way from a point up or down to the height of a corner and then along.

    An end on the way counts as lying left of the upright part and below the level one.
    """
    x1, y1, x2, y2 = e
    here, bend, corner = (_left(e, *q) for q in ((x, y), (x, cy), (cx, cy)))
    upright = ((x1 > x) != (x2 > x)) & (here != bend)
    level = ((y1 > cy) != (y2 > cy)) & (bend != corner)
    return upright != level


def _edge_touches(e: tuple[Column, ...], west: Column, south: Column, size: Column) -> Column:
    """Whether an edge may touch a cell: what of it lies above the cell's width reaches the cell's height."""
    x1, y1, x2, y2 = e
    low, high = F.greatest(F.least(x1, x2), west - SLACK), F.least(F.greatest(x1, x2), west + size + SLACK)
    at = lambda x: F.when(x1 == x2, y1).otherwise(y1 + (x - x1) / (x2 - x1) * (y2 - y1))
    ends = [F.when(x1 == x2, q).otherwise(at(x)) for q, x in ((y1, low), (y2, high))]
    return (low <= high) & (F.least(*ends) <= south + size + SLACK) & (F.greatest(*ends) >= south - SLACK)


def _size(level: Column) -> Column:
    return F.lit(TILE) / F.pow(F.lit(2.0), level)


def cells(polygons: DataFrame, key: str, most: int = MOST, depth: int = DEPTH) -> tuple[DataFrame, list[int]]:
    """``(key, level, i, j, inside, edges)``, the cells of each polygon, and the levels that occur. ``edges``
    is empty where the whole cell lies within; else ``inside`` tells of the cell's upper left corner, and
    edges are those that touch the cell, of which there are more than ``most`` only at the last level.

    The first cells of a polygon are about a quarter of it wide; a cell's edges are then tried against its
    own quarters alone, so no ring is copied into the cells that it crosses.
    """
    tried = _over_cells(_first_cells(ring_edges(polygons, key), key, depth))
    out, levels = None, set()
    while True:
        found = materialise(_judged(tried, [key, "level", "i", "j"]), "polygon-cells")
        fine = (F.size("edges") <= most) | (c("level") >= depth)
        out = found.where(fine) if out is None else out.unionByName(found.where(fine))
        seen = found.agg(F.collect_set("level").alias("levels"), F.max(~fine).alias("more")).first()
        levels |= set(seen["levels"])
        if not seen["more"]:
            return out, sorted(levels)
        tried = _quarters(found.where(~fine), [key])


def _first_cells(edges: DataFrame, key: str, depth: int) -> DataFrame:
    """Edges with the level of their polygon's first cells and the numbers of these, ``is`` and ``js``."""
    box = edges.groupBy(key).agg(F.min(F.least("x1", "x2")).alias("w"), F.max(F.greatest("x1", "x2")).alias("e"), F.min(F.least("y1", "y2")).alias("s"), F.max(F.greatest("y1", "y2")).alias("n"))
    level = F.greatest(F.lit(0), F.least(F.lit(depth), F.ceil(F.log2(4 * TILE / F.greatest(c("e") - c("w"), c("n") - c("s"), F.lit(1e-9)))))).cast("int")
    box = box.withColumn("level", level).withColumn("size", _size(c("level")))
    span = lambda low, high, base: F.sequence(F.floor((low - base - SLACK) / c("size")), F.floor((high - base + SLACK) / c("size")))
    # the first corner, from which those of the cells are judged, lies outside
    box = box.select(key, "level", "size", (c("w") - 1).alias("cx"), (c("n") + 1).alias("cy"), F.lit(False).alias("corner"), span(c("w"), c("e"), EAST).alias("is"), span(c("s"), c("n"), NORTH).alias("js"))
    return edges.join(box, key)


def _over_cells(first: DataFrame) -> DataFrame:
    return first.withColumn("i", F.explode("is")).withColumn("j", F.explode("js")).drop("is", "js")


def _judged(tried: DataFrame, cell: list[str]) -> DataFrame:
    """Cells with the edges that touch them, and whether their corner is inside; none that lie outside."""
    e, (west, top) = tuple(c(k) for k in EDGE), _corner("i", "j", "size")
    touches = _edge_touches(e, west, top - c("size"), c("size"))
    inside = (F.first("corner").cast("int") + F.sum(_crossed(e, west, top, c("cx"), c("cy")).cast("int"))) % 2 == 1
    found = tried.groupBy(*cell).agg(inside.alias("inside"), F.collect_list(F.when(touches, F.struct(*EDGE, "real"))).alias("edges"))
    return found.where(c("inside") | (F.size("edges") > 0))


def _quarters(coarse: DataFrame, keep: list[str]) -> DataFrame:
    """The edges of cells, to be tried against the cells' quarters."""
    size = _size(c("level"))
    west, top = _corner("i", "j", size)
    cut = coarse.select(*keep, (c("level") + 1).alias("level"), (size / 2).alias("size"), west.alias("cx"), top.alias("cy"), c("inside").alias("corner"), "i", "j", F.explode("edges").alias("e"))
    quarter = F.explode(F.array(*[F.struct((2 * c("i") + a).alias("i"), (2 * c("j") + b).alias("j")) for a in (0, 1) for b in (0, 1)]))
    return cut.select(*keep, "level", "size", "cx", "cy", "corner", "e.*", quarter.alias("q")).select("*", "q.*").drop("q")


def _unturned() -> dict[str, Column]:
    """The turns that a ring's cell has gone on over the date line, and its number without them."""
    size = _size(c("level"))
    around = F.floor(c("i") * size / 360)
    return {"_turn": around, "_i": c("i") - around * (360 / size).cast("long")}


def top_cells(polygons: DataFrame, on: list[str], most: int = MOST, depth: int = DEPTH) -> tuple[DataFrame, list[int]]:
    """``(_on_*, level, _i, j, _list)``, cells with the polygons that may be the topmost of a place there,
    and the levels that occur. ``polygons`` has ``on``, ``_key``, ``_rank``, ``_p`` and ``ring``.

    All cells of a level are made at once, wide ones first. A polygon that holds a whole cell (no
    ``edges``) drops those of no higher rank from the cell and from the cells within, of which only one
    such stays; what is left is cut further while a cell has more than ``most`` edges of all polygons, up to
    ``CROWDED`` times, or of one.
    """
    keys, cell = [f"_on_{x}" for x in on], [*[f"_on_{x}" for x in on], "_i", "j"]
    known = polygons.select("_key", *[c(x).alias(k) for x, k in zip(on, keys)], "_rank", "_p", "ring")
    first = materialise(_first_cells(ring_edges(known, "_key"), "_key", depth), "first-cells")
    starts = sorted(r["level"] for r in first.select("level").distinct().collect())
    attributes = known.join(first.select("_key", c("level").alias("_start")).distinct(), "_key").drop("ring")
    attributes = materialise(attributes, "polygons")
    seen = lambda tried: _judged(tried, ["_key", "level", "i", "j"]).withColumns(_unturned()).join(attributes, "_key")
    level, carried, out, covers = min(starts, default=0), None, [], {}
    while starts or carried is not None:
        found = None if carried is None else seen(carried)
        if level in starts:
            new = seen(_over_cells(first.where(c("level") == level)))
            # cells that were cut lie below no earlier cover, or they'd not be left
            for above, hidden in covers.items():
                up = F.shiftright(c("_i"), level - above) == c("_ui"), F.shiftright(c("j"), level - above) == c("_uj")
                hiding = hidden.select(*[c(k).alias(f"_u{k}") for k in keys], c("_i").alias("_ui"), c("j").alias("_uj"), c("_rank").alias("_over")).distinct()
                new = new.join(hiding, [*[c(k) == c(f"_u{k}") for k in keys], *up], "left").where("_over is null or _rank > _over").select(*new.columns)
            found = new if found is None else found.unionByName(new)
            starts.remove(level)
        if found is not None:
            bare, own = F.size("edges") == 0, Window.partitionBy(*cell)
            found = found.withColumn("_cover", F.max(F.when(bare, F.struct("_rank", "_key"))).over(own))
            found = found.where(F.when(bare, c("_key") == c("_cover._key")).otherwise(c("_cover").isNull() | (c("_rank") > c("_cover._rank"))))
            crowded = (F.sum(F.size("edges")).over(own) > most) & (F.lit(level) < c("_start") + CROWDED)
            cut = F.lit(level < depth) & ((F.size("edges") > most) | crowded)
            found = materialise(found.withColumn("_cut", cut), "polygon-cells")
            covers[level] = found.where(bare)
            out.append(found.where(~c("_cut") | bare).select("level", *cell, F.struct("_rank", "_p", "i", "_turn", "inside", "edges").alias("_e")))
            carried = found.where(c("_cut") & ~bare)
            carried = _quarters(carried, ["_key"]) if carried.limit(1).count() else None
        level += 1
    if not out:
        return attributes.limit(0), []
    every = out[0]
    for part in out[1:]:
        every = every.unionByName(part)
    found = materialise(every.groupBy("level", *cell).agg(F.collect_list("_e").alias("_list")), "top-cells")
    return found, sorted(covers)


def top_polygon(points: DataFrame, polygons: DataFrame, on: list[str], carry: list[str], rank: list[Column] | None = None, boundary: bool = False, most: int = MOST, out: str = "_top") -> DataFrame:
    """``points`` with the columns ``carry`` of the topmost polygon of equal keys that holds each, as a struct;
    NULL where none does.

    The topmost has the highest ``rank``; without one, any will do. No pair of a point and a polygon
    below the topmost that holds the whole cell is met, points stay where they are while the cells fit a
    broadcast, and rows are judged each by its own.
    """
    ranks = F.struct(*[r.alias(f"r{k}") for k, r in enumerate(rank or [F.lit(0)])])
    known = polygons.withColumns({"_rank": ranks, "_p": F.struct(*carry) if carry else F.struct(F.lit(True).alias("held"))})
    # rings that are alike are one
    known = known.groupBy(*on, "ring").agg(F.max(F.struct("_rank", "_p")).alias("_m")).select(*on, "ring", "_m.*")
    known = materialise(known.withColumn("_key", F.monotonically_increasing_id()), "rings")
    found, levels = top_cells(known, on, most)
    if not levels:
        return points.withColumn(out, F.lit(None).cast(known.schema["_p"].dataType))
    bounded = (found.agg(F.sum(F.aggregate("_list", F.lit(100), lambda s, e: s + 100 + 40 * F.size(e["edges"]))).alias("n")).first()["n"] or 0) <= BROADCAST
    lon = c("lon") - 360 * F.floor((c("lon") + 180) / 360)
    here, best = spread(points).withColumn("_lon", lon), []
    for k in levels:
        size = TILE / 2**k
        across, i = int(360 / size), F.floor((c("_lon") - EAST) / size)
        own = found.where(c("level") == k).select(*[c(f"_on_{x}").alias(f"_on_{x}_{k}") for x in on], c("_i").alias(f"_i_{k}"), c("j").alias(f"_j_{k}"), c("_list").alias(f"_list_{k}"))
        meet = [F.pmod(i, F.lit(across)) == c(f"_i_{k}"), F.floor((c("lat") - NORTH) / size) == c(f"_j_{k}"), *[c(x) == c(f"_on_{x}_{k}") for x in on]]
        here = here.join(own.hint("broadcast") if bounded else own, meet, "left")

        x = c("_lon") - 360 * F.floor(i / across)
        hit = F.filter(c(f"_list_{k}"), _entry_holds(boundary, x, c("lat"), size, (c(f"_j_{k}") + 1) * size + NORTH))
        best.append(F.array_max(F.transform(hit, lambda e: F.struct(e["_rank"].alias("_rank"), e["_p"].alias("_p")))))
    top = best[0] if len(best) == 1 else F.greatest(*best)
    return here.select(*[here[x] for x in points.columns], top["_p"].alias(out))


def _corner(i: str, j: str, size: Column | str) -> tuple[Column, Column]:
    """West and top of a cell."""
    size = c(size) if isinstance(size, str) else size
    return c(i) * size + EAST, (c(j) + 1) * size + NORTH


def _holds(boundary: bool, x: Column, y: Column, cx: Column, cy: Column, edges: Column, inside: Column) -> Column:
    """Whether a polygon holds a point of a cell at its border."""
    at = lambda e: tuple(e[k] for k in EDGE)

    def on(e: Column) -> Column:
        x1, y1, x2, y2 = at(e)
        return e["real"] & (_side(x1, y1, x2, y2, x, y) == 0) & x.between(F.least(x1, x2), F.greatest(x1, x2)) & y.between(F.least(y1, y2), F.greatest(y1, y2))

    touches = F.exists(edges, on)
    odd = F.aggregate(edges, inside, lambda s, e: s != _crossed(at(e), x, y, cx, cy))
    return (odd | touches) if boundary else (odd & ~touches)


def _entry_holds(boundary: bool, x: Column, y: Column, size: float, cy: Column):
    return lambda e: (F.size(e["edges"]) == 0) | _holds(boundary, x + 360 * e["_turn"], y, e["i"] * size + EAST, cy, e["edges"], e["inside"])


def polygon_matches(points: DataFrame, polygons: DataFrame, on: list[str], boundary: bool = False, most: int = MOST) -> DataFrame:
    """Each point with each polygon of equal keys that holds it (a struct ``_p`` of all its columns but ``ring``).

    A point on an edge is held if ``boundary`` says so. Points meet cells of each width that occurs, by an
    equi-join; polygons of no two vertices hold nothing. Points without coordinates are held by none.
    """
    names = [x for x in polygons.columns if x != "ring"]
    known = materialise(polygons.withColumn("_key", F.monotonically_increasing_id()), "polygons")
    found, levels = cells(known, "_key", most)
    attributes = known.select("_key", *[c(x).alias(f"_on_{x}") for x in on], F.struct(*names).alias("_p"))
    found = found.withColumns(_unturned()).join(attributes, "_key")

    bounded = (found.agg(F.sum(100 + 40 * F.size("edges")).alias("n")).first()["n"] or 0) <= BROADCAST

    lon = c("lon") - 360 * F.floor((c("lon") + 180) / 360)
    here = spread(points).withColumn("_level", F.explode(F.array(*[F.lit(k) for k in levels]).cast("array<int>"))).withColumns({"_lon": lon, "_size": _size(c("_level"))})
    i = F.floor((c("_lon") - EAST) / c("_size"))
    across = (360 / c("_size")).cast("long")
    here = here.withColumns({"_i": F.pmod(i, across), "_w": F.floor(i / across), "_j": F.floor((c("lat") - NORTH) / c("_size"))})
    both = here.join(found.hint("broadcast") if bounded else found, [here["_level"] == found["level"], here["_i"] == found["_i"], here["_j"] == found["j"], *[here[k] == found[f"_on_{k}"] for k in on]])
    both = both.withColumns({"_x": c("_lon") + 360 * (c("_turn") - c("_w")), "_y": c("lat")})
    cx, cy = _corner("i", "j", "_size")
    return both.where((F.size("edges") == 0) | _holds(boundary, c("_x"), c("_y"), cx, cy, c("edges"), c("inside"))).select(*[here[x] for x in points.columns], "_p")


def points_in_polygons(points: DataFrame, polygons: DataFrame, on: list[str], boundary: bool = False, pid: str = "point_id") -> DataFrame:
    """The points that some polygon of equal keys holds."""
    return top_polygon(points, polygons, on, [], boundary=boundary).where("_top is not null").drop("_top")


def assign_plate(points: DataFrame, polygons: DataFrame, static: DataFrame | None, on: list[str], pid: str = "point_id", missing: int | None = -1) -> DataFrame:
    """The plate of the topmost polygon: highest type rank, then smallest area; then static polygons."""
    rank = [c("type_rank"), c("area_rank")]
    out = top_polygon(points.drop("plate_id"), polygons, on, ["plate_id"], rank, out="_a")
    plate = c("_a.plate_id")
    if static is not None:
        out = top_polygon(out, static, [], ["plate_id"], rank, out="_b")
        plate = F.coalesce(plate, "_b.plate_id")
    return out.withColumn("plate_id", F.coalesce(plate, F.lit(missing).cast("int"))).drop("_a", "_b")
