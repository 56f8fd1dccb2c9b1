"""A Merkle manifest of a dataset: one digest that commits to every document, with proofs for each.

Nodes are levels of a tree of 16 (``FAN``) children a node, one tree for each source and one over the
sources. Only every ``stride``-th level is persisted. A proof's missing nodes are computed again from the
stored nodes below them, an aligned subtree at a time, and not kept.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from tessera.plans.tables import drop_files, materialise, new_path, read_table, shuffle_partitions

FAN = 16
#: Leaves in a range that one task sorts, about.
ROWS = 1_000_000
STEP = "array<struct<left: string, right: string>>"
c = F.col


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts one after the other."""
    return F.sha2(F.concat(*parts), 256)


def leaf_digest(*values: Column) -> Column:
    """Digest of a row: each value as its UTF-8 byte count, a colon and itself, or ``-`` for null."""
    text = [v.cast("string") for v in values]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text])


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with ``value`` computed once, however often ``f`` names it."""
    return F.transform(F.array(value), f)[0]


def _above(nodes: Column) -> Column:
    """The digests of each run of ``FAN`` digests; a single node stands for itself."""
    runs = lambda d: F.transform(F.sequence(F.lit(0), F.floor((F.size(d) - 1) / FAN).cast("int")), lambda i: F.sha2(F.array_join(F.slice(d, i * FAN + 1, FAN), ""), 256))
    return runs(nodes)


def _positions(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``position`` from 0 in each ``tree`` by ``order``, and the tree's size ``nodes``.

    Rows are dealt into sorted ranges of all trees at once; a row's place is its place in its range and
    what the ranges before hold of its tree. So no tree meets in one task, nor do equal rows.
    """
    parts = max(shuffle_partitions(rows.sparkSession), rows.count() // ROWS + 1)
    keys = ["tree", *order, "_nth"]
    ranged = rows.withColumn("_nth", F.monotonically_increasing_id()).repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("_nth")
    ranged = materialise(ranged.withColumn("_row", F.monotonically_increasing_id()), "ranges")  # the range, then the place in it
    part = F.shiftright("_row", 33)
    held = ranged.groupBy("tree", part.alias("_part")).agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    tree = Window.partitionBy("tree")
    ahead = F.coalesce(F.sum("_n").over(tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = held.select("tree", "_part", (ahead - c("_first")).alias("_shift"), F.sum("_n").over(tree).alias("nodes"))
    both = ranged.withColumn("_part", part).join(shift, ["tree", "_part"])
    return both.select(*rows.columns, (c("_row") + c("_shift")).alias("position"), "nodes")


def _subtrees(nodes: DataFrame, stride: int, *more: str) -> DataFrame:
    """The stored nodes of each aligned subtree, at most ``FAN ** stride``, in order as arrays."""
    rows = F.array_sort(F.collect_list(F.struct("position", "digest", *more)))
    up = nodes.groupBy("tree", F.shiftright("position", 4 * stride).alias("position"), "nodes").agg(rows.alias("rows"))
    return up.withColumn("digests", F.transform("rows", lambda r: r["digest"]))


def _climb(nodes: DataFrame, stride: int) -> DataFrame:
    """The nodes ``stride`` levels higher; a tree that ends before keeps its last node."""
    up = _subtrees(nodes, stride)
    level = c("digests")
    for k in range(stride):
        level = F.when(c("nodes") > FAN**k, _above(level)).otherwise(level)
    size = F.ceil(c("nodes") / FAN**stride).cast("long")
    return up.select("tree", "position", level[0].alias("digest"), size.alias("nodes"))


def _run(level: Column, place: Column) -> Column:
    """What stands left and right of a place among its siblings."""
    first = (place - place % FAN).cast("int")
    left = F.array_join(F.slice(level, first + 1, (place - first).cast("int")), "")
    right = F.array_join(F.slice(level, (place + 2).cast("int"), (F.lit(FAN - 1) - (place - first)).cast("int")), "")
    return F.struct(left.alias("left"), right.alias("right"))


def _descend(nodes: DataFrame, parents: DataFrame, stride: int, *more: str) -> DataFrame:
    """``nodes`` with ``path``, their siblings level by level up to the root, and what else parents hold."""
    below = _subtrees(nodes, stride, *more).join(parents, ["tree", "position"])
    carried = [x for x in parents.columns if x not in ("tree", "position", "path")]

    def entries(levels: list[Column]) -> Column:
        """Each stored node with its siblings on the levels of the subtree, the lowest first."""
        def own(row: Column, i: Column) -> Column:
            steps = [F.when(c("nodes") > FAN**k, F.array(_run(level, F.floor(i / FAN**k)))).otherwise(F.array().cast(STEP)) for k, level in enumerate(levels)]
            return F.struct(row.alias("row"), F.concat(*steps).alias("steps"))

        return F.transform("rows", own)

    def regenerated(levels: list[Column]) -> Column:
        return entries(levels) if len(levels) == stride else _let(_above(levels[-1]), lambda up: regenerated([*levels, up]))

    each = below.select("tree", "path", *carried, F.explode(regenerated([c("digests")])).alias("e"))
    return each.select("tree", "e.row.*", F.concat("e.steps", "path").alias("path"), *carried)


@dataclass
class Manifest:
    """Where a manifest lies and its root, None for a table without rows."""

    path: str
    stride: int
    levels: dict[str, int]
    root: str | None

    def nodes(self, spark: SparkSession, kind: str, level: int) -> DataFrame:
        return spark.read.parquet(f"{self.path}/{kind}/level-{level}")


def _tree(spark: SparkSession, leaves: DataFrame, path: str, stride: int) -> int:
    """Write the stored levels above ``leaves``; the number of the last, where each tree has one node."""
    leaves.write.parquet(f"{path}/level-0")
    level = 0
    while True:
        below = spark.read.parquet(f"{path}/level-{level}").select("tree", "position", "digest", "nodes")
        if level and not below.where("nodes > 1").limit(1).count():
            return level
        level += stride
        _climb(below, stride).write.parquet(f"{path}/level-{level}")


def write_manifest(docs: DataFrame, path: str, stride: int = 2, keep: dict[str, Column] | None = None) -> Manifest:
    """Persist the manifest of ``(doc_id, source, lang, n_chars, text)`` under ``path``.

    A leaf is the digest of the five values; any may be null. A source's leaves stand in the order of
    doc_id, null first; rows that repeat a doc_id in the order of their digests, so equal rows are
    neighbours. Null is a source of its own, the first. A text of any length is digested whole. ``keep``
    names further columns, made from those of ``docs``, to lie beside the leaves; other columns are
    ignored. An empty table has no root.

    Written are the leaves (``documents/level-0``) and every ``stride``-th level above (``level-2``, ...),
    likewise for the tree over the sources (``sources``). The texts are read once.
    """
    spark = docs.sparkSession
    names = ["doc_id", "source", "lang", "n_chars", "text"]
    tree = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))  # null sorts first, all else by its bytes
    leaves = docs.select(tree.alias("tree"), "doc_id", leaf_digest(*[c(x) for x in names]).alias("digest"), *[x.alias(k) for k, x in (keep or {}).items()])
    leaves = materialise(leaves, "leaves")
    top = {"documents": _tree(spark, _positions(leaves, ["doc_id", "digest"]), f"{path}/documents", stride)}
    subroots = spark.read.parquet(f"{path}/documents/level-{top['documents']}")
    subroots = subroots.select(F.lit("").alias("tree"), c("tree").alias("label"), "digest")
    top["sources"] = _tree(spark, _positions(subroots, ["label"]), f"{path}/sources", stride)
    last = spark.read.parquet(f"{path}/sources/level-{top['sources']}").first()  # one row at most
    drop_files(leaves)
    return Manifest(path, stride, top, last["digest"] if last else None)


def _paths(spark: SparkSession, m: Manifest, kind: str, parents: DataFrame, *more: str) -> DataFrame:
    """Paths of the leaves of a kind from those of its trees' last nodes, one stored level after the other."""
    for level in range(m.levels[kind] - m.stride, -1, -m.stride):
        parents = _descend(m.nodes(spark, kind, level), parents, m.stride, *(more if level == 0 else ()))
        if level:
            parents = materialise(parents.drop("digest"), "paths")  # one for each stored inner node
    return parents


def proofs(spark: SparkSession, m: Manifest, *keep: str) -> DataFrame:
    """For each document ``doc_id, leaf, subroot, root``, the kept columns and ``path``.

    ``path`` holds for each level, from the leaf's up to the root's, the digests of the siblings to the
    left and to the right, one after the other; a lone leaf of a lone source has an empty path.
    """
    begin = m.nodes(spark, "sources", m.levels["sources"]).select("tree", "position", F.array().cast(STEP).alias("path"))
    tops = _paths(spark, m, "sources", begin, "label")
    tops = materialise(tops.select(c("label").alias("tree"), F.lit(0).cast("long").alias("position"), "path", c("digest").alias("subroot")), "subroots")
    rows = _paths(spark, m, "documents", tops, "doc_id", *keep)
    return rows.select("doc_id", c("digest").alias("leaf"), "subroot", F.lit(m.root).cast("string").alias("root"), *keep, "path")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda own, s: F.sha2(F.concat(s["left"], own, s["right"]), 256))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' proofs, and what a verifier finds who is shown the tampered texts of one in five."""
    docs = read_table(spark, sf_dir, "documents")
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    tampered = F.crc32(c("doc_id").cast("string")) % 5 == 0
    changed = leaf_digest(c("doc_id"), c("source"), c("lang"), c("n_chars"), F.translate("text", upper, lower))
    m = write_manifest(docs, new_path(spark, "manifest"), keep={"tampered": F.when(tampered, changed)})
    found = proofs(spark, m, "tampered")
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    found = found.withColumn("folded_root", folded(F.coalesce("tampered", "leaf"), c("path")))
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root", (c("folded_root") == c("root")).alias("verified"))


def _op11_sql(levels: int = 6) -> str:
    """The same rows from windows over every level of both trees (up to ``16 ** levels`` leaves each)."""
    part = lambda x: f"coalesce(strlen(CAST({x} AS VARCHAR)) || ':' || {x}, '-')"
    leaf = lambda text: f"sha256({' || '.join(part(x) for x in ('doc_id', 'source', 'lang', 'n_chars', text))})"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    bit = lambda c: f"CASE WHEN {c} & 1 = 1 THEN xor({c} >> 1, 3988292384::UBIGINT) ELSE {c} >> 1 END"
    byte = f"list_reduce(list_concat([xor(s, ascii(b)::UBIGINT)], range(8)::UBIGINT[]), lambda s2, i: {bit('s2')})"
    crc = f"xor(list_reduce(list_concat(['4294967295'], string_split(CAST(doc_id AS VARCHAR), '')), lambda a, b: CAST({byte.replace('xor(s,', 'xor(a::UBIGINT,')} AS VARCHAR))::UBIGINT, 4294967295::UBIGINT)"
    out = [f"""d AS (SELECT *, {leaf('text')} AS leaf, CASE WHEN doc_id IS NOT NULL AND {crc} % 5 = 0 THEN {leaf(low)} ELSE {leaf('text')} END AS shown FROM documents),
a0 AS (SELECT source AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY source) AS n, leaf AS h, doc_id, shown FROM d)"""]

    def climb(a: str) -> None:
        for k in range(levels):
            out.append(f"{a}{k + 1} AS (SELECT tree, p // 16 AS p, CASE WHEN n > 1 THEN (n + 15) // 16 ELSE 1 END AS n, CASE WHEN n > 1 THEN sha256(string_agg(h, '' ORDER BY p)) ELSE any_value(h) END AS h FROM {a}{k} GROUP BY tree, p // 16, n)")
            w = f"OVER (PARTITION BY x.tree, x.p // 16 ORDER BY x.p ROWS BETWEEN"
            out.append(f"{a}s{k} AS (SELECT tree, p, n > 1 AS live, coalesce(string_agg(h, '') {w} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(h, '') {w} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {a}{k} x)")

    climb("a")
    out.append(f"b0 AS (SELECT '' AS tree, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS p, count(*) OVER () AS n, h, tree AS source FROM a{levels})")
    climb("b")
    steps = [("a", k) for k in range(levels)] + [("b", k) for k in range(levels)]
    f = "q.shown"
    for a, k in steps:
        f = f"f{a}{k}"
    joins = " ".join([f"JOIN as{k} ON as{k}.tree IS NOT DISTINCT FROM q.tree AND as{k}.p = q.p // {16**k}" for k in range(levels)] + ["JOIN b0 ON b0.source IS NOT DISTINCT FROM q.tree"] + [f"JOIN bs{k} ON bs{k}.p = b0.p // {16**k}" for k in range(levels)])
    cols = ", ".join(f"{a}s{k}.live AS {a}v{k}, {a}s{k}.l AS {a}l{k}, {a}s{k}.r AS {a}r{k}" for a, k in steps)
    out.append(f"z AS (SELECT q.doc_id, q.h AS leaf, b0.h AS subroot, q.shown AS f0, {cols} FROM a0 q {joins})")
    last = "z"
    for i, (a, k) in enumerate(steps):
        out.append(f"z{i} AS (SELECT * EXCLUDE (f{i}), CASE WHEN {a}v{k} THEN sha256({a}l{k} || f{i} || {a}r{k}) ELSE f{i} END AS f{i + 1} FROM {last})")
        last = f"z{i}"
    proof = " || ".join(f"CASE WHEN {a}v{k} THEN {a}l{k} || {a}r{k} ELSE '' END" for a, k in steps)
    root = f"(SELECT h FROM b{levels})"
    return f"WITH {', '.join(out)} SELECT doc_id, leaf, subroot, {root} AS root, sha256({proof}) AS proof_sha256, f{len(steps)} AS folded_root, f{len(steps)} = {root} AS verified FROM {last}"


OP11_SQL = _op11_sql()
