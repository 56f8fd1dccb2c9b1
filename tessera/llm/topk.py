"""Exact top-k inner products by a three-phase uniform threshold over blocks of dimensions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.plans.tables import drop_files, materialise, read_table, shuffle_partitions

#: Vectors in a chunk and queries in a block: what one task multiplies at once.
CHUNK, QUERIES = 2048, 512
CHUNK_SQL = "dims int, rows binary, matrix binary, held binary, ids binary"
ENTRY_SQL = "query long, row long, score long, ids array<long>"


def integer_vectors(vectors: DataFrame, vec_id: str, embedding: str, scale: int) -> DataFrame:
    """``(vec_id, x)``, x the components as ``floor(scale * c)``; rows with an id or vector that is
    null, or a component that is null or not finite, are left out."""
    c = F.col(embedding)
    fine = c.isNotNull() & F.col(vec_id).isNotNull() & ~F.exists(c, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    whole = F.transform(c, lambda v: F.floor(v.cast("double") * scale).cast("long"))
    return vectors.where(fine).select(F.col(vec_id).cast("long").alias("vec_id"), whole.alias("x"))


def _matrix(raw: bytes, rows: int, dims: int) -> np.ndarray:
    """A packed matrix; its size tells how many bytes a number has."""
    width = len(raw) // (rows * dims) if rows * dims else 8
    return np.frombuffer(raw, f"<i{width}").reshape(rows, dims).astype("<i8")


def _bytes(matrix: np.ndarray) -> bytes:
    """The numbers in the fewest bytes that hold all of them."""
    most = int(np.abs(matrix).max(initial=0))
    return matrix.astype("<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8").tobytes()


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of classes as one matrix each, with their ids; the classes of a chunk share their number of
    dimensions."""
    for b in batches:
        dims = np.array([len(x) for x in b.column("x")], np.int64)
        for d in np.unique(dims):
            own = b.filter(pa.array(dims == d))
            for k in range(0, own.num_rows, CHUNK):
                part = own.slice(k, CHUNK)
                flat = part.column("x").flatten().to_numpy(zero_copy_only=False).astype("<i8")
                rows = part.column("row").to_numpy(zero_copy_only=False).astype("<i8")
                ids = part.column("ids")
                held = np.array([len(x) for x in ids], "<i4")
                packed = [pa.array([int(d)], pa.int32()), *(pa.array([x]) for x in (rows.tobytes(), _bytes(flat), held.tobytes(), ids.flatten().to_numpy(zero_copy_only=False).astype("<i8").tobytes()))]
                yield pa.record_batch(packed, ["dims", "rows", "matrix", "held", "ids"])


def _products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact integer products: in floating point while no sum can reach 2**53, else in integers."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * max(1, q.shape[1])
    if most < 2**53:
        return (q.astype(np.float64) @ v.astype(np.float64).T).astype(np.int64)
    return q @ v.T


def _local(keep: Callable, nodes: int) -> Callable:
    """For each pair of a query block and a chunk, the entries that ``keep`` selects from the nodes' parts,
    each with its full score and the ids of its class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1).to_pylist()[0]
                edges = np.linspace(0, r["dims"], nodes + 1).astype(int)
                queries, rows = np.frombuffer(r["queries"], "<i8"), np.frombuffer(r["rows"], "<i8")
                held, ids = np.frombuffer(r["held"], "<i4").astype(np.int64), np.frombuffer(r["ids"], "<i8")
                q = _matrix(r["query_matrix"], len(queries), r["dims"])
                v = _matrix(r["matrix"], len(rows), r["dims"])
                parts = [_products(q[:, i:j], v[:, i:j]) for i, j in zip(edges, edges[1:])]
                at, row, score = keep(parts, r.get("cut"))
                n, first = held[row], (np.cumsum(held) - held)[row]
                offsets = np.concatenate([[0], np.cumsum(n)])
                own = ids[np.repeat(first - offsets[:-1], n) + np.arange(offsets[-1])]
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(own))
                yield pa.record_batch([pa.array(queries[at]), pa.array(rows[row]), pa.array(score), lists], ["query", "row", "score", "ids"])

    return run


def _best(k: int) -> Callable:
    """The k best entries of each node's list for each query, scored in full."""

    def keep(parts: list[np.ndarray], _: object) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = min(k, parts[0].shape[1])
        named = np.zeros(parts[0].shape, bool)
        for part in parts:
            np.put_along_axis(named, np.argpartition(-part, n - 1, axis=1)[:, :n], True, axis=1)
        at, row = np.nonzero(named)
        return at, row, sum(part[at, row] for part in parts)

    return keep


def _over(parts: list[np.ndarray], cut: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The entries that reach an equal share of their query's cutoff in some node; of these, resolved in
    full, those that reach the cutoff."""
    s = np.array(cut, np.int64)
    sent = np.zeros(parts[0].shape, bool)
    for part in parts:
        sent |= part >= -(-s // len(parts))[:, None]
    at, row = np.nonzero(sent)
    score = sum(part[at, row] for part in parts)
    fine = score >= s[at]
    return at[fine], row[fine], score[fine]


def top_k(vectors: DataFrame, is_query, k: int = 5, scale: int = 256, nodes: int = 2, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's k highest integer inner products.

    ``is_query`` is a condition on ``vec_id``. Candidates are all rows but those with the query's own
    id; ties go to the smaller vec_id; vectors with another number of dimensions than the query are
    no candidates. Rows that repeat an id and a vector count once; rows with an unusable vector take no part; a
    query without candidates gives no row. Other columns are ignored.

    Equal vectors are one class, scored once: a class keeps its k + 1 smallest ids, found in hashed
    shares first, so copies that make up a third of all rows never meet in one task. A score is a sum
    over nodes, a node being a block of dimensions whose list is spread over chunks of classes:

    1. every node names its k + 1 best classes of a chunk for a query; the k + 1 best of all chunks, by
       their full scores, give a score s that the k-th best of all can't fall below;
    2. s is the query's cutoff: a class that reaches s must reach s / nodes (rounded up) in some
       node, so every node collects the entries at or over that;
    3. the entries collected are resolved in full where they lie; those that reach s, hardly more than
       k + 1 for a query, are ranked.

    Chunks are dealt by a salt and stay; blocks of queries, far fewer, are sent to every salt, by a shuffle:
    nothing that grows with the vectors or queries is broadcast. A block of
    ``QUERIES`` and a chunk of ``CHUNK`` vectors are multiplied at once.
    """
    spark = vectors.sparkSession
    ids = integer_vectors(vectors, vec_id, embedding, scale)
    shares = F.pmod(F.xxhash64("vec_id"), F.lit(max(16, shuffle_partitions(spark))))
    first = Window.partitionBy("x", "share").orderBy("vec_id")
    few = ids.withColumn("share", shares).dropDuplicates(["x", "share", "vec_id"]).withColumn("at", F.row_number().over(first)).where(F.col("at") <= k + 1)
    classes = few.groupBy("x").agg(F.slice(F.sort_array(F.collect_list("vec_id")), 1, k + 1).alias("ids"))
    classes = materialise(classes.withColumn("row", F.monotonically_increasing_id()), "classes")
    asked = ids.where(is_query).select(F.col("vec_id").alias("query_id"), "x").distinct()
    asked = materialise(asked.join(classes.select("x", "row").hint("merge"), "x").select("query_id", "row"), "asked")
    chosen = classes.join(asked.select("row").distinct().hint("merge"), "row", "left_semi")

    chunks = materialise(classes.select("row", "x", "ids").mapInArrow(_packed, CHUNK_SQL), "chunks")
    blocks = materialise(_cut_blocks(chosen.select("row", "x", "ids").mapInArrow(_packed, CHUNK_SQL)), "blocks")
    salts = max(1, min(chunks.count(), max(2 * shuffle_partitions(spark), chunks.count() // 8)))
    salted = chunks.withColumn("salt", F.pmod(F.xxhash64("rows"), F.lit(salts)).cast("int"))
    def sides(more: DataFrame | None = None) -> DataFrame:
        own = blocks.select("dims", "block", "queries", "query_matrix")
        own = own.join(more.hint("merge"), "block") if more is not None else own
        copies = own.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        # blocks look small on disk, their copies are not: a broadcast would bring them all to the driver
        return salted.join(copies.hint("merge"), ["dims", "salt"])

    best = sides().mapInArrow(_local(_best(k + 1), nodes), ENTRY_SQL)
    descending = Window.partitionBy("query").orderBy(F.desc("score"), "row")
    # k + 1 ids, as one of them may be the query's own
    few = best.select("query", "row", "score", F.size("ids").cast("long").alias("held")).withColumn("at", F.row_number().over(descending)).where(F.col("at") <= k + 1)
    few = few.withColumn("sum", F.sum("held").over(descending.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("sum") >= k + 1)
    cutoff = few.groupBy("query").agg(F.max("score").alias("s"))
    cuts = blocks.select("block", F.posexplode("query_rows").alias("pos", "query")).join(cutoff.hint("merge"), "query", "left")
    least = F.coalesce(F.col("s"), F.lit(-(1 << 62)))
    cuts = cuts.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("pos", least.alias("least")))).alias("all"))
    cuts = materialise(cuts.select("block", F.transform("all", lambda e: e["least"]).alias("cut")), "cutoffs")
    final = sides(cuts).mapInArrow(_local(_over, nodes), ENTRY_SQL)
    # only k + 1 ids of each query's best classes can be among its k best, and so only k + 1 classes
    ranked = Window.partitionBy("query").orderBy(F.desc("score"), "least")
    final = final.withColumn("least", F.col("ids")[0]).withColumn("at", F.row_number().over(ranked)).where(F.col("at") <= k + 1)
    final = final.select("query", "score", F.explode("ids").alias("vec_id"))
    top = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    final = final.withColumn("at", F.row_number().over(top)).where(F.col("at") <= k + 1).drop("at")
    answers = asked.join(final.hint("merge"), asked.row == final["query"]).where("vec_id != query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    found = answers.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    found = materialise(found, "top-k")
    for table in (classes, asked, chunks, blocks, cuts):
        drop_files(table)
    return found


def _cut_blocks(blocks: DataFrame) -> DataFrame:
    """Query matrices cut into blocks of ``QUERIES`` rows, each with a number of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                rows = np.frombuffer(r["rows"], "<i8")
                matrix = _matrix(r["matrix"], len(rows), r["dims"])
                for k in range(0, len(rows), QUERIES):
                    part = rows[k : k + QUERIES]
                    block = f"{r['dims']}:{part[0]}"
                    yield pa.record_batch([pa.array([r["dims"]], pa.int32()), pa.array([block]), pa.array([part.tobytes()]), pa.array([part.tolist()]), pa.array([_bytes(matrix[k : k + QUERIES])])], ["dims", "block", "queries", "query_rows", "query_matrix"])

    return blocks.mapInArrow(run, "dims int, block string, queries binary, query_rows array<long>, query_matrix binary")


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


OP3_SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.x, v.x) AS BIGINT) AS score
  FROM e q JOIN e v ON q.vec_id % 50 = 0 AND v.vec_id != q.vec_id AND len(q.x) = len(v.x)),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
"""
