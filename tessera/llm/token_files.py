"""Token ids of whole texts in files under a canonical, length-limited Huffman code.

File format (a Parquet table, one row for each chunk of consecutive documents, in ascending doc_id
order by ``shard``, ``chunk``):

- ``shard``, ``chunk``: place in the order; ``before``: ids of the shard before this chunk.
- ``doc_ids``, ``doc_tokens``: the documents and how many ids each has, its end id included.
- ``checkpoints``: the bit at which each block of ``block`` ids starts; blocks decode on their own.
- ``payload``: the ids' code words, most significant bit first, with 4 zero bytes at the end.

The code is a second table ``(id, length)``; lengths alone define a canonical code.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.tokens import id_rows, ids_crc32, public_vocabulary, small
from tessera.plans.tables import drop_files, materialise, new_path, read_table, shuffle_partitions

#: Longest code word in bits. 16 would leave no choice for 50 000 ids; 20 loses under 0.1 % here.
LONGEST = 20
#: Ids in a block, and ids after which a chunk is closed at the end of a document.
BLOCK, CHUNK = 512, 1 << 16
#: Files whose sizes are added up in one task.
GROUP = 4096

CHUNKS = pa.schema([("shard", pa.int32()), ("chunk", pa.int32()), ("before", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())), ("checkpoints", pa.list_(pa.int64())), ("payload", pa.binary())])
CHUNKS_SQL = "shard int, chunk int, before long, doc_ids array<long>, doc_tokens array<long>, checkpoints array<long>, payload binary"


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Optimal code word lengths of at most ``longest`` bits, by package-merge. Unused ids get 0."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << longest:
        raise ValueError(f"{len(used)} ids need code words of over {longest} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    weights = counts[used].astype(np.float64)
    merged, leaf = weights, [np.ones(len(used), bool)]
    for _ in range(longest - 1):
        pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([weights, pairs])
        order = np.argsort(both, kind="stable")
        merged = both[order]
        leaf.append(order < len(weights))
    take = 2 * len(used) - 2
    for level in reversed(leaf):
        leaves = int(level[:take].sum())
        lengths[used[:leaves]] += 1
        take = 2 * (take - leaves)
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Code words by length, then id."""
    codes = np.zeros(len(lengths), np.uint32)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    code = last = 0
    per_length = np.bincount(lengths[order], minlength=2)
    at = 0
    for length, n in enumerate(per_length):
        if n:
            code <<= length - last
            codes[order[at : at + n]] = code + np.arange(n)
            code, last, at = code + int(n), length, at + int(n)
    return codes


def decode_table(lengths: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """For each ``longest`` bits: the id they start with, times 32, plus its length."""
    codes, table = canonical_codes(lengths), np.zeros(1 << longest, np.uint32)
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    spans = 1 << (longest - lengths[order].astype(np.int64))
    table[: spans.sum()] = np.repeat(order.astype(np.uint32) * 32 + lengths[order], spans)
    assert len(order) == 0 or codes[order[0]] == 0
    return table


def encode_ids(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray, block: int = BLOCK) -> tuple[bytes, np.ndarray]:
    """The code words of ``ids`` as bytes, and the bit at which each block starts."""
    n = lengths[ids].astype(np.int64)
    ends = np.cumsum(n)
    starts = ends - n
    bits = int(ends[-1]) if len(ids) else 0
    words = np.zeros(bits // 32 + 3, np.uint64)
    at = starts >> 5
    value = codes[ids].astype(np.uint64) << (64 - n - (starts & 31)).astype(np.uint64)
    first = np.flatnonzero(np.diff(at, prepend=-1))  # code words that start in one 32-bit word
    if len(first):
        total = np.bitwise_or.reduceat(value, first)
        words[at[first]] |= total >> np.uint64(32)
        words[at[first] + 1] |= total & np.uint64(0xFFFFFFFF)
    return words.astype(">u4").tobytes()[: (bits + 7) // 8] + bytes(4), starts[::block]


def decode_blocks(payload: bytes, checkpoints: np.ndarray, sizes: np.ndarray, table: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """All blocks at once, one id of each block in a step. ``sizes``: ids in each block."""
    total = int(sizes.sum())
    out = np.zeros(total, np.uint32)
    if not total:
        return out
    windows = np.ndarray(len(payload) - 3, ">u4", payload, strides=(1,))
    order = np.argsort(-sizes, kind="stable")
    at, where = checkpoints[order].astype(np.int64), (np.cumsum(sizes) - sizes)[order]
    alive = np.searchsorted(-sizes[order], -np.arange(int(sizes.max())), side="left")
    shift, mask = 32 - longest, np.uint32((1 << longest) - 1)
    for step, n in enumerate(alive):
        now = at[:n]
        peek = windows[now >> 3].astype(np.uint32) >> (shift - (now & 7)).astype(np.uint32)
        found = table[peek & mask]
        out[where[:n] + step] = found >> 5
        now += found & 31
    return out


def _count(size: int, dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in small(batches):
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype), minlength=size)
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used), pa.array(total[used])], ["id", "n"])

    return run


def _write_chunks(lengths: np.ndarray, dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, shard = canonical_codes(lengths), TaskContext.get().partitionId()
        chunk = before = held = 0
        docs, parts = [], []

        def close() -> pa.RecordBatch:
            ids = np.concatenate(parts)
            payload, checkpoints = encode_ids(ids, lengths, codes)
            row = [[shard], [chunk], [before], [docs], [[len(p) for p in parts]], [checkpoints], [payload]]
            return pa.record_batch([pa.array(x, f.type) for x, f in zip(row, CHUNKS)], schema=CHUNKS)

        for batch in batches:
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.frombuffer(raw.as_py(), dtype)
                docs.append(doc_id)
                parts.append(ids)
                held += len(ids)
                if held >= CHUNK:
                    yield close()
                    chunk, before, held, docs, parts = chunk + 1, before + held, 0, [], []
        if docs:
            yield close()

    return run


def _read_chunks(lengths: np.ndarray, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decode_table(lengths)
        for batch in batches:
            for k in range(0, batch.num_rows, 16):
                rows = batch.slice(k, 16).to_pylist()
                payload, points, sizes, n_ids, base = [], [], [], [], 0
                for r in rows:
                    n = sum(r["doc_tokens"])
                    payload.append(r["payload"])
                    points.append(np.array(r["checkpoints"], np.int64) + 8 * base)
                    sizes.append(np.minimum(BLOCK, n - BLOCK * np.arange(len(r["checkpoints"]))))
                    n_ids.append(n)
                    base += len(r["payload"])
                ids, at, out = decode_blocks(b"".join(payload), np.concatenate(points), np.concatenate(sizes), table), 0, []
                for r in rows:
                    before = r["before"]
                    for doc_id, n in zip(r["doc_ids"], r["doc_tokens"]):
                        own = ids[at : at + n]
                        out.append((r["shard"], before, doc_id, *((n, ids_crc32(own)) if digest else (own.astype("<u4").tobytes(),))))
                        at, before = at + n, before + n
                kinds = [pa.int32(), pa.int64(), pa.int64()] + ([pa.int64(), pa.int64()] if digest else [pa.binary()])
                names = ["shard", "before", "doc_id"] + (["n_tokens", "ids_crc32"] if digest else ["ids"])
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 2) -> None:
    """Write the ids of ``(doc_id, text)``, each document's followed by ``end_id``, under ``path``.

    A null or empty text is its end id alone; rows that repeat a doc_id are all written, in the order of
    their ids' CRC-32 and then of the input, so that many of them need not meet in one task; a null
    doc_id comes first. A text of any length is one document of one chunk. Other columns are ignored; an empty table gives empty files.

    Texts are tokenised once into the shared folder. The driver holds a count and a code length for
    each id of the vocabulary, whose size doesn't depend on the corpus. Documents are dealt by ranges of
    doc_id, of which there are as many as the ids need at about 2 million each.
    """
    tokenizer = tokenizer or public_vocabulary()
    from tokenizers import Tokenizer

    size = max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1)
    dtype = "<u2" if size <= 1 << 16 else "<u4"
    ids = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(id_rows(tokenizer, end_id), "doc_id long, ids binary")
    ids = materialise(ids, "ids")
    counted = ids.select("ids").mapInArrow(_count(size, dtype), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    counts = np.zeros(size, np.int64)
    for r in counted.collect():  # one row for each id of the vocabulary at most
        counts[r["id"]] = r["n"]
    lengths = code_lengths(counts)
    spark = docs.sparkSession
    code = [(i, int(n)) for i, n in enumerate(lengths)]
    spark.createDataFrame(code, "id long, length int").coalesce(1).write.parquet(f"{path}/code")
    parts = max(shuffle_partitions(spark), int(counts.sum()) // 2_000_000 + 1)
    place = ids.select("doc_id", "ids", F.crc32("ids").alias("crc"), F.monotonically_increasing_id().alias("nth"))
    sorted_ids = place.repartitionByRange(parts, "doc_id", "crc", "nth").sortWithinPartitions("doc_id", "crc", "nth")
    sorted_ids.select("doc_id", "ids").mapInArrow(_write_chunks(lengths, dtype), CHUNKS_SQL).write.option("compression", "none").parquet(f"{path}/chunks")
    drop_files(ids)


def read_token_files(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """``(doc_id, start, ids)``: the ids as little-endian 32-bit bytes; start counts all ids before.

    With ``digest`` their number and CRC-32, ``n_tokens`` and ``ids_crc32``, stand for the ids, which
    then don't leave the task that decodes them.
    """
    code = spark.read.parquet(f"{path}/code").collect()  # one row for each id of the vocabulary
    lengths = np.zeros(len(code), np.uint8)
    for r in code:
        lengths[r["id"]] = r["length"]
    chunks = spark.read.schema(CHUNKS_SQL).parquet(f"{path}/chunks")
    ends = chunks.select("shard", F.aggregate("doc_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    ends = ends.groupBy("shard").agg(F.sum("n").alias("n")).withColumn("group", F.floor(F.col("shard") / GROUP))
    before = lambda w: F.coalesce(F.sum("n").over(w.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = ends.groupBy("group").agg(F.sum("n").alias("n")).withColumnRenamed("group", "shard")
    groups = groups.select(F.col("shard").alias("group"), before(Window).alias("base"))  # one row for GROUP files
    firsts = ends.withColumn("before", before(Window.partitionBy("group"))).join(groups, "group")
    firsts = firsts.select("shard", (F.col("base") + F.col("before")).alias("first"))
    what = "n_tokens long, ids_crc32 long" if digest else "ids binary"
    ids = chunks.mapInArrow(_read_chunks(lengths, digest), f"shard int, before long, doc_id long, {what}")
    start = (F.col("first") + F.col("before")).alias("start")
    return ids.join(firsts, "shard").select("doc_id", start, *[c for c in ids.columns[3:]])


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-files")
    write_token_files(read_table(spark, sf_dir, "documents"), path)
    return read_token_files(spark, path, digest=True)
