"""SimHash fingerprints and near-duplicates by covering locality-sensitive hashing."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.tokens import small
from tessera.plans.components import connected_components
from tessera.plans.tables import drop_files, materialise, read_table, release

BITS, SEED = 64, 42
#: Buckets of up to so many fingerprints are compared pair by pair; larger ones through midpoints.
PAIRWISE = 48


def shingle_hashes(text: str | bytes | None, words: int) -> np.ndarray:
    """XXH64 of each shingle of the lower-cased text; of the whole sequence if it is shorter."""
    if not text:
        return np.zeros(0, np.uint64)
    raw = text if isinstance(text, bytes) else text.encode()
    cut = raw.lower().split()  # bytes: A-Z only, and the six white spaces of ASCII
    if len(cut) > words:
        cut = map(b" ".join, zip(*(cut[i:] for i in range(words))))
    else:
        cut = [b" ".join(cut)] if cut else []
    digest = xxhash.xxh64_intdigest
    return np.array([digest(s, SEED) for s in cut], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half of the hashes; zero without hashes. Signed 64 bits."""
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 8192):
        part = hashes[k : k + 8192].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True)


def _fingerprints(words: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            prints = [fingerprint(shingle_hashes(t.as_py(), words)) for t in b.column(1)]
            yield pa.record_batch([b.column(0), pa.array(prints, pa.int64())], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """``(doc_id, fp)`` of each row, fp a signed 64-bit fingerprint."""
    return docs.select("doc_id", "text").mapInArrow(_fingerprints(words), "doc_id long, fp long")


def covering_masks(radius: int, seed: int = 7) -> list[int]:
    """``2**(radius + 1) - 1`` masks such that any ``radius`` bits lie outside one of them.

    Each bit position gets a vector of ``radius + 1`` bits, the vectors dealt evenly. The mask of a
    nonzero vector v holds the positions whose vector has an odd product with v. The vectors of
    ``radius`` positions span less than the whole space, so some v is orthogonal to all of them: two
    fingerprints that differ there only agree under its mask.
    """
    size = radius + 1
    vectors = [1 + i % (2**size - 1) for i in range(BITS)]
    random.Random(seed).shuffle(vectors)
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, 2**size)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """Edges ``(u, v)`` between distinct fingerprints that connect all pairs within ``radius``.

    ``prints`` has a column fp without repeats. In buckets of up to ``PAIRWISE`` fingerprints all
    pairs within the radius are linked. A larger bucket is linked exactly too, without its pairs:
    for a radius of 2, two fingerprints are within it just if some string is at most one flipped bit
    from both, so all that reach one such midpoint are linked to the smallest of them. For other
    radii its fingerprints are dealt into blocks, and each block is compared with each.
    """
    masks = [_signed(m) for m in covering_masks(radius)]
    table = F.posexplode(F.array(*[F.lit(m) for m in masks])).alias("t", "mask")
    keyed = prints.select("fp", table).select("fp", "t", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    keyed = materialise(keyed, "covering")
    sizes = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    full = materialise(keyed.join(sizes, ["t", "key"]), "buckets")
    a = full.where(F.col("n") <= PAIRWISE).select("t", "key", F.col("fp").alias("u"))
    b = a.withColumnRenamed("u", "v")
    pairs = a.join(b, ["t", "key"]).where((F.col("u") < F.col("v")) & (_distance(F.col("u"), F.col("v")) <= radius)).select("u", "v")
    large = full.where(F.col("n") > PAIRWISE)
    if radius == 2:
        flips = F.explode(F.array(F.lit(0), *[F.lit(_signed(1 << i)) for i in range(BITS)])).alias("flip")
        middle = large.select("fp").distinct().select("fp", flips).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("middle"))
        least = middle.groupBy("middle").agg(F.min("fp").alias("v"), F.max("fp").alias("most")).where("v < most")
        stars = middle.join(least, "middle").where("fp != v").select(F.col("fp").alias("u"), "v")
    else:
        stars = _block_pairs(large, radius)
    return pairs.union(stars).distinct()


def _block_pairs(large: DataFrame, radius: int, size: int = 256) -> DataFrame:
    """Links of large buckets: their fingerprints in hashed blocks, each block against each of its bucket."""
    count = F.ceil(F.col("n") / size)
    blocks = large.withColumn("block", F.pmod(F.xxhash64("fp"), count)).withColumn("last", count - 1)
    left = blocks.select("t", "key", F.col("fp").alias("u"), F.col("block").alias("i"), F.explode(F.sequence("block", "last")).alias("j"))
    right = blocks.select("t", "key", F.col("fp").alias("v"), F.explode(F.sequence(F.lit(0).cast("long"), "block")).alias("i"), F.col("block").alias("j"))
    near = (F.col("u") != F.col("v")) & (_distance(F.col("u"), F.col("v")) <= radius)
    pairs = left.join(right, ["t", "key", "i", "j"]).where(near)
    return pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """``(doc_id, fp, component_id)`` for each row of ``(doc_id, text)``.

    Documents whose fingerprints differ in at most ``radius`` bits are linked; component_id is the
    smallest doc_id reachable, the document's own without a link. A null text and one without words
    have fingerprint zero, linked like any other. Repeated rows each give a row; a null doc_id takes
    part, and has a null component only if all of its component are null. Other columns are ignored;
    an empty table gives no rows.

    Copies fall together first: a fingerprint is a class, and only classes are compared. What one
    class holds, however many rows, is only ever counted or aggregated by ``min``.
    """
    prints = materialise(fingerprints(docs, words), "fingerprints")
    classes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    groups = connected_components(links(classes.select("fp"), radius))
    found = classes.join(groups, classes.fp == groups.node, "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    least = found.groupBy("component").agg(F.min("first").alias("component_id"))
    ids = found.join(least, "component").select("fp", "component_id")
    return prints.join(ids, "fp").select("doc_id", "fp", "component_id")


def op5_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- the pipeline's stage: texts, not fingerprints alone, decide -------------------------------------

SKETCH = "id long, fp long, hashes binary, bands array<long>"
#: Bins of a document's smallest hashes, and bins in a band.
BINS, BAND = 64, 4


def sketch_bands(hashes: np.ndarray) -> np.ndarray:
    """One hash for each band of ``BAND`` of the ``BINS`` bins, each bin keeping its smallest hash.

    An empty bin takes the value of the bin that a fixed walk of its own reaches first.
    """
    bins = (hashes >> np.uint64(58)).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))  # hashes are sorted
    least, filled = np.zeros(BINS, np.uint64), np.zeros(BINS, bool)
    least[bins[first]], filled[bins[first]] = hashes[first], True
    if not filled.all():
        todo = np.flatnonzero(~filled)
        values, step = least.copy(), 0
        while len(todo):
            step += 1
            reach = ((todo * 2654435761 + step * 40503 + (todo * step) ** 2 * 97) >> 5) % BINS
            got = filled[reach]
            values[todo[got]] = least[reach[got]] + np.uint64(step)
            todo = todo[~got]
            if step > 4000:
                values[todo] = hashes[0]
                break
        least = values
    rows = least.reshape(-1, BAND)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), i) for i, r in enumerate(rows)], np.uint64).view(np.int64)


def _sketches(words: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            out = []
            for t in b.column(1):
                hashes = shingle_hashes(t.as_py(), words)
                own = np.unique(hashes)
                bands = sketch_bands(own).tolist() if len(own) else []
                id_ = xxhash.xxh64_intdigest(own.tobytes(), len(own))
                short = np.unique((own >> np.uint64(32)).astype("<u4")).tobytes()
                out.append((int(np.uint64(id_).view(np.int64)), fingerprint(hashes), short, bands))
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
            yield pa.record_batch([b.column(0), *(pa.array(c, k) for c, k in zip(zip(*out), kinds))], ["doc_id", "id", "fp", "hashes", "bands"])

    return run


def _similar(threshold: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            keep = []
            for x, y in zip(b.column("x"), b.column("y")):
                p, q = np.frombuffer(x.as_py(), "<u4"), np.frombuffer(y.as_py(), "<u4")
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(both >= threshold * (len(p) + len(q) - both) - 1e-9)
            yield pa.record_batch([b.column("u"), b.column("v")], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def shared_buckets(keyed: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of buckets of two ids or more, each with the bucket's size ``n`` and smallest id ``v``."""
    sizes = keyed.groupBy(*keys).agg(F.count("*").alias("n"), F.min("id").alias("v")).where("n > 1")
    return materialise(keyed.join(sizes, keys), "buckets")


#: In a bucket each id is first compared with so many next ones and the smallest.
WIDTH = 2
#: Buckets of up to so many ids are then compared pair by pair, larger ones block by block.
CROWD = 13


def bucket_pairs(full: DataFrame, keys: list[str], width: int = WIDTH) -> DataFrame:
    """Pairs ``(u, v)`` of ids that share a bucket: each with the ``width`` next ones and the first.

    Buckets of up to ``width + 1`` ids give all their pairs. In a larger one these links tie copies of one
    text together, in as many rows as it has ids, times a constant; what they leave apart is compared
    by :func:`split_pairs` and :func:`crowd_links`. Ids are dealt in shares of a bucket, each ranked on its
    own, so no task holds a whole crowd.
    """
    stars = full.select(F.col("id").alias("u"), "v")
    dealt = full.where("n > 2").withColumn("share", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / 512)))
    order = Window.partitionBy(*keys, "share").orderBy("id")
    after = F.collect_list("id").over(order.rowsBetween(1, width))
    chains = dealt.select(F.col("id").alias("v"), after.alias("after")).select("v", F.explode("after").alias("u"))
    both = stars.union(chains.select("u", "v")).where("u != v")
    return both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def split_buckets(full: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of buckets of over ``WIDTH + 1`` ids that lie in several components, with their number
    ``n``, ``component``, and the bucket's commonest one, ``main``."""
    rows = full.where(F.col("n") > WIDTH + 1).select(*keys, "id", "n").join(groups.select(F.col("node").alias("id"), "component"), "id", "left")
    rows = rows.withColumn("component", F.coalesce("component", "id"))
    kinds = rows.groupBy(*keys, "component").agg(F.count("*").alias("m"))
    split = kinds.groupBy(*keys).agg(F.count("*").alias("kinds"), F.max_by("component", F.struct("m", "component")).alias("main")).where("kinds > 1")
    return materialise(rows.join(split.select(*keys, "main"), keys), "split")


def split_pairs(split: DataFrame, keys: list[str]) -> DataFrame:
    """All pairs ``(u, v, cu, cv)`` of buckets of up to ``CROWD`` ids whose components ``cu, cv`` differ."""
    rows = split.where(F.col("n") <= CROWD)
    one = rows.select(*keys, F.col("id").alias("u"), F.col("component").alias("cu"))
    two = rows.select(*keys, F.col("id").alias("v"), F.col("component").alias("cv"))
    return one.join(two, keys).where("u > v and cu != cv").select("u", "v", "cu", "cv").distinct()


#: Ids in a block of a crowd, and shingle hashes in it, at most (both but for chance).
BLOCK, BLOCK_HASHES = 512, 1 << 18
#: Shares of a crowd that meet its count apart.
SHARES = 32


def common_counts(xs: list[np.ndarray], ys: list[np.ndarray]) -> np.ndarray:
    """How many values each set of ``xs`` shares with each of ``ys``."""
    out = np.zeros((len(xs), len(ys)), np.float32)
    _, place = np.unique(np.concatenate([*xs, *ys]), return_inverse=True)
    cut = sum(map(len, xs))
    shared = np.zeros(place.max(initial=-1) + 1, bool)
    shared[place[:cut]] = True
    other = np.zeros_like(shared)
    other[place[cut:]] = True
    shared &= other
    column = np.cumsum(shared) - 1
    sides = []
    for sets, own in ((xs, place[:cut]), (ys, place[cut:])):
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        keep = shared[own]
        row, own = row[keep], column[own[keep]]
        order = np.argsort(own, kind="stable")
        sides.append((len(sets), row[order], own[order]))
    for k in range(0, int(shared.sum()), 4096):
        dense = []
        for n, row, at in sides:
            s, e = np.searchsorted(at, [k, k + 4096])
            table = np.zeros((n, 4096), np.float32)
            table[row[s:e], at[s:e] - k] = 1
            dense.append(table)
        out += dense[0] @ dense[1].T
    return out


def _joined_by(threshold: float) -> Callable:
    """Of two blocks: the pairs of components that some similar pair of their sets joins."""

    def run(table: pa.Table) -> pa.Table:
        side, group = table["side"].to_numpy(), table["component"].to_numpy()
        sets = [np.frombuffer(h, "<u4") for h in table["hashes"].to_pylist()]
        x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        y = y if len(y) else x  # a block against itself
        size = np.array([len(s) for s in sets], np.float32)
        both = common_counts([sets[i] for i in x], [sets[i] for i in y])
        alike = both >= threshold * (size[x][:, None] + size[y] - both).astype(np.float64) - 1e-9
        i, j = np.nonzero(alike & (group[x][:, None] != group[y]))
        found = np.unique(np.sort(np.stack([group[x[i]], group[y[j]]], 1), 1), axis=0)
        return pa.table({"u": pa.array(found[:, 0], pa.int64()), "v": pa.array(found[:, 1], pa.int64())})

    return run


def crowd_links(split: DataFrame, sets: DataFrame, threshold: float) -> DataFrame | None:
    """Edges ``(u, v)`` between components that a similar pair of one crowd joins.

    All pairs of a split bucket of over ``CROWD`` ids are compared, but those already in one component.
    A bucket's ids are dealt into blocks by the size of their sets, the ids of its commonest component
    apart; block meets block under a key of its own, so a crowd spreads over tasks. Blocks whose sizes
    can't be similar don't meet, nor two blocks of the commonest component. None if there is none.
    """
    keys = ["t", "key"]
    large = split.where(F.col("n") > CROWD).drop("n")
    lengths = sets.select("id", (F.length("hashes") / 4).alias("size"))
    base = 1 / (threshold - 0.01)  # similar sets are at most one class apart, rounding included
    rows = large.join(lengths, "id")
    rows = rows.withColumn("class", F.floor(F.log(F.greatest("size", F.lit(1.0))) / float(np.log(base))))
    rows = rows.withColumn("class", F.col("class") * 2 + F.when(F.col("component") == F.col("main"), 1).otherwise(0))
    rows = materialise(rows.select(*keys, "id", "component", "class"), "crowds")
    if not rows.limit(1).count():
        return None
    most = F.least(F.lit(float(BLOCK)), F.greatest(F.lit(16.0), BLOCK_HASHES / F.pow(F.lit(base), F.floor(F.col("class") / 2) + 1)))
    counts = rows.groupBy(*keys, "class").agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / most)).drop("n")
    block = F.shiftleft("class", 32) + F.pmod(F.xxhash64("id"), F.col("blocks"))
    # a crowd's rows meet its count in shares, not in one task
    shared = counts.withColumn("share", F.explode(F.array(*map(F.lit, range(SHARES)))))
    rows = rows.withColumn("share", F.pmod(F.xxhash64(F.lit("share"), "id"), F.lit(SHARES)).cast("int"))
    rows = rows.join(shared, [*keys, "class", "share"]).select(*keys, "id", "component", block.alias("block"))
    names = counts.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("at"), "class")
    names = names.select(*keys, (F.shiftleft("class", 32) + F.col("at")).alias("left"), F.col("class").alias("c"))
    others = names.select(*keys, F.col("left").alias("right"), F.col("c").alias("d"))
    meet = (F.col("left") <= F.col("right")) & (F.abs(F.floor(F.col("c") / 2) - F.floor(F.col("d") / 2)) <= 1) & (F.col("c") % 2 + F.col("d") % 2 < 2)
    meeting = materialise(names.join(others, keys).where(meet).select(*keys, "left", "right"), "meeting")
    one = rows.join(meeting.withColumn("block", F.col("left")), [*keys, "block"]).withColumn("side", F.lit(0))
    two = rows.join(meeting.where("left != right").withColumn("block", F.col("right")), [*keys, "block"]).withColumn("side", F.lit(1))
    dealt = one.unionByName(two).join(sets, "id").select(*keys, "left", "right", "side", "component", "hashes")
    return dealt.groupBy(*keys, "left", "right").applyInArrow(_joined_by(threshold), "u long, v long")


#: Slots of a filter at most, one bit each.
MOST_SLOTS = 1 << 23


def may_be_in(ids: DataFrame, name: str) -> Callable[[Column], Column]:
    """A test that every id of the table passes, and few others: it keeps rows out of a shuffle.

    The test is one hashed slot an id, of 16 slots for an id up to ``MOST_SLOTS``: its size is bounded
    whatever the corpus. Rows that pass go on to an exact join, so no result depends on it; where ids
    are so many that most slots are taken, it keeps out little.
    """
    n = ids.count()
    slots = min(MOST_SLOTS, max(64, 1 << (16 * n).bit_length()))
    slot = lambda x: F.pmod(F.xxhash64(x), F.lit(slots).cast("long"))
    bit = F.call_function("shiftleft", F.lit(1), (F.col("at") % 8).cast("int"))
    at = ids.select(slot(F.col(name)).alias("at"))
    held = at.select(F.floor(F.col("at") / 8).alias("byte"), bit.alias("bit")).groupBy("byte").agg(F.bit_or("bit").alias("bits"))
    held = held.toArrow()  # MOST_SLOTS / 8 rows at most
    full = np.zeros(slots // 8, np.uint8)
    full[held["byte"].to_numpy()] = held["bits"].to_numpy()
    literal = F.lit(bytearray(full.tobytes()))

    def passes(x: Column) -> Column:
        byte = F.conv(F.hex(F.substring(literal, (F.floor(slot(x) / 8) + 1).cast("int"), 1)), 16, 10).cast("int")
        return byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), (slot(x) % 8).cast("int"))) != 0

    return passes


def near_copy_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = 2) -> DataFrame:
    """``docs`` with a column ``component_id``: the smallest doc_id of the document's near copies.

    Candidates are pairs within ``radius`` bits by covering hashing, and pairs whose smallest shingle
    hashes agree in a band, as texts that are 0.8 alike commonly differ in 3 to 12 bits, which no
    affordable radius covers. Shingles are compared by 32 bits of their hashes. Either kind counts only if the texts' sets of ``words``-word shingles
    have a Jaccard similarity of at least ``similarity``. A bucket is first tied together by a few links a
    text; then all its pairs that are still in different components are compared, however many. Texts
    with equal shingle sets are one class and compared once; null texts count as empty, a text of any
    length is read whole, rows that repeat a doc_id are one document. Texts without words are copies of each other.
    """
    rows = docs.select("doc_id", "text").mapInArrow(_sketches(words), "doc_id long, " + SKETCH)
    rows = materialise(rows, "sketches")
    light = rows.groupBy("id").agg(F.min("doc_id").alias("first"), F.min("fp").alias("fp"), F.min("bands").alias("bands"))
    classes = materialise(light, "classes")
    masks = F.posexplode(F.array(*[F.lit(_signed(m)) for m in covering_masks(radius)])).alias("t", "mask")
    near = classes.select("id", "fp", masks).select("id", F.col("t").cast("int"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    bands = classes.select("id", F.posexplode("bands").alias("t", "key")).select("id", (F.col("t") + 1000).alias("t"), "key")
    full = shared_buckets(near.union(bands), ["t", "key"])
    keys = ["t", "key"]
    pairs = materialise(bucket_pairs(full, keys), "pairs")
    needed = pairs.select(F.col("u").alias("id")).union(pairs.select(F.col("v"))).distinct()
    needed = materialise(needed, "needed")
    near_rows = rows.where(may_be_in(needed, "id")(F.col("id"))).select("id", "hashes")
    sets = near_rows.join(needed, "id", "left_semi").groupBy("id").agg(F.min("hashes").alias("hashes"))
    sets = materialise(sets, "sets")
    release(docs.sparkSession)

    def similar(pairs: DataFrame, u: str, v: str) -> DataFrame:
        x = pairs.join(sets.select(F.col("id").alias("u"), F.col("hashes").alias("x")), "u")
        both = x.join(sets.select(F.col("id").alias("v"), F.col("hashes").alias("y")), "v")
        return both.select(F.col(u).alias("u"), F.col(v).alias("v"), "x", "y").mapInArrow(_similar(similarity), "u long, v long")

    groups = connected_components(similar(pairs, "u", "v"))
    found = classes.join(groups, classes.id == groups.node, "left").select("id", "first", F.coalesce("component", "id").alias("component"))
    split = split_buckets(full, groups, keys)
    release(docs.sparkSession)
    if split.limit(1).count():
        more, crowds = similar(split_pairs(split, keys), "cu", "cv"), crowd_links(split, sets, similarity)
        top = connected_components(more if crowds is None else more.union(crowds))
        top = top.select(F.col("node").alias("component"), F.col("component").alias("top"))
        found = found.join(top, "component", "left").select("id", "first", F.coalesce("top", "component").alias("component"))
    found = materialise(found, "found")
    for table in (full, pairs, needed, sets, split):
        drop_files(table)
    release(docs.sparkSession)
    least = found.groupBy("component").agg(F.min("first").alias("component_id"))
    ids = found.join(least, "component").select("id", "component_id")
    return rows.select("doc_id", "id").join(ids, "id").select("doc_id", "component_id")


def drop_near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """Keep the document with the smallest doc_id of each group of near copies.

    Of rows that repeat a doc_id that stays the smallest, by all columns in turn, stays; rows with a null
    doc_id stay. A null or empty text is a copy of any other text without words. All columns are kept; an
    empty table stays empty.
    """
    groups = near_copy_groups(docs.where("doc_id is not null"), words, similarity)
    info = groups.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("component_id").alias("component_id"))
    info = materialise(info, "groups")
    special = may_be_in(info.where("doc_id != component_id or n > 1").select("doc_id"), "doc_id")(F.col("doc_id"))
    out = docs.where(F.col("doc_id").isNull() | ~special)
    rest = docs.where(F.col("doc_id").isNotNull() & special)
    kept = info.where("doc_id = component_id")
    out = out.unionByName(rest.join(kept.where("n = 1"), "doc_id", "left_semi").select(docs.columns))
    if kept.where("n > 1").limit(1).count():
        many = rest.join(kept.where("n > 1"), "doc_id", "left_semi")
        row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
        out = out.union(many.groupBy("doc_id").agg(F.min(row).alias("_row")).select("_row.*"))
    return out


__all__ = ["covering_masks", "drop_near_copies", "fingerprint", "fingerprints", "links", "near_copy_groups", "near_duplicates", "op5_simhash_near_dedup", "shingle_hashes"]
