"""Packing of whole documents into training sequences by best-fit decreasing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.tokens import encoded, ids_crc32, public_vocabulary
from tessera.plans.tables import materialise, read_table, shuffle_partitions

PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])
PIECE_SQL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"


class CapacityTree:
    """A segment tree over remaining capacities that finds the tightest open one."""

    def __init__(self, window: int) -> None:
        self.size = 1 << window.bit_length()
        self.open = [0] * (2 * self.size)

    def add(self, capacity: int, bins: int) -> None:
        node = capacity + self.size
        while node:
            self.open[node] += bins
            node //= 2

    def tightest(self, length: int) -> int | None:
        """The smallest capacity of at least ``length`` that some bin has."""
        node = length + self.size
        if self.open[node]:
            return length
        while node > 1:
            if node % 2 == 0 and self.open[node + 1]:
                node += 1
                while node < self.size:
                    node = 2 * node if self.open[2 * node] else 2 * node + 1
                return node - self.size
            node //= 2
        return None


def best_fit_decreasing(counts: dict[int, int], window: int) -> tuple[dict[int, list[tuple]], int]:
    """Best-fit decreasing over how often each length occurs, so the plan's size has a fixed bound.

    Pieces of one length are alike and bins of one content are alike, so both move in runs: a run
    ``(first rank, end rank, first bin, pieces a bin, offset)`` places the pieces of a length by their
    rank among those of that length. At most one run is split for each length; ``window`` lengths
    bound the runs however many pieces there are. Returns the runs by length, and the bins used.
    """
    tree, groups, plan, used = CapacityTree(window), {}, {}, 0
    for length in sorted(counts, reverse=True):
        left, rank, runs = counts[length], 0, []
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                capacity, first, bins = window, used, -(-left // (window // length))
                used += bins
            else:
                first, bins = groups[capacity].pop()
                tree.add(capacity, -bins)
            each = capacity // length
            placed = min(left, bins * each)
            runs.append((rank, rank + placed, first, each, window - capacity))
            full, rest = divmod(placed, each)
            parts = [(full, capacity - each * length), (1, capacity - rest * length) if rest else (0, 0)]
            parts.append((bins - sum(n for n, _ in parts), capacity))
            for n, after in parts:
                if n and after:
                    groups.setdefault(after, []).append((first, n))
                    tree.add(after, n)
                first += n
            rank, left = rank + placed, left - placed
        plan[length] = runs
    return plan, used


def cut_documents(docs: DataFrame, tokenizer: str, end_id: int, window: int, ids: bool = True) -> DataFrame:
    """One row for each piece: full windows from the start of a document, then what is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, every, at in encoded(batches, tokenizer, end_id):
            n = np.diff(at)
            pieces = -(-n // window)
            doc = np.repeat(np.arange(len(n)), pieces)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * window
            length = np.minimum(window, n[doc] - start)
            first = at[doc] + start
            parts = [every[s : s + k] for s, k in zip(first.tolist(), length.tolist())]
            raw = [p.tobytes() for p in parts] if ids else [None] * len(parts)
            columns = [b.column(0).take(pa.array(doc)), start, length, [ids_crc32(p) for p in parts], n[doc], raw]
            yield pa.record_batch([pa.array(c, f.type) if not isinstance(c, pa.Array) else c.cast(f.type) for c, f in zip(columns, PIECE)], schema=PIECE)

    return docs.select("doc_id", "text").mapInArrow(run, PIECE_SQL)


def pack(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, window: int = 2048, ids: bool = True) -> DataFrame:
    """Pack documents ``(doc_id, text)`` into sequences of at most ``window`` tokens.

    Returns a row for each piece: doc_id, start, length, ids_crc32, doc_tokens, ids (little-endian
    16-bit, or 32-bit for a larger vocabulary; null without ``ids``), sequence_id and offset. A sequence
    gets no padding where its pieces fill ``window`` or another power of two, which the pieces' lengths
    and offsets tell. A null or empty text is its end id alone; a text of any length is cut whole. Rows that repeat a document are packed each for itself; a null doc_id is kept. Equal
    lengths take places in the order of doc_id within a hashed share. An empty table gives no rows;
    other columns are ignored.

    Texts are tokenised once. Only the count of each length (``window`` numbers at most) reaches the
    driver, which plans the bins; a piece finds its place by its rank among the pieces of its length,
    ranked in hashed shares so that a length that many copies have is spread over all tasks.
    """
    pieces = materialise(cut_documents(docs, tokenizer or public_vocabulary(), end_id, window, ids), "pieces")
    spark = docs.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan, _ = best_fit_decreasing(counts, window)
    shape = "length long, runs array<struct<low: long, high: long, bin: long, each: long, base: long>>"
    places = spark.createDataFrame(list(plan.items()), shape)

    shares = max(64, 2 * shuffle_partitions(spark))
    share = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(shares)).cast("int")
    pieces = pieces.withColumn("share", share)
    sizes = pieces.groupBy("length", "share").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "share", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "share").orderBy("doc_id", "start", "ids_crc32")
    ranked = pieces.withColumn("at", F.row_number().over(within) - 1).join(sizes, ["length", "share"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("at")).join(F.broadcast(places), "length")
    run = F.filter("runs", lambda r: (r["low"] <= F.col("rank")) & (F.col("rank") < r["high"]))[0]
    ranked = ranked.withColumn("run", run).withColumn("step", F.col("rank") - F.col("run.low"))
    return ranked.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids",
        (F.col("run.bin") + F.floor(F.col("step") / F.col("run.each"))).cast("long").alias("sequence_id"),
        (F.col("run.base") + F.col("step") % F.col("run.each") * F.col("length")).cast("long").alias("offset"),
    )


def op8_packing(spark, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"), ids=False).drop("ids")
