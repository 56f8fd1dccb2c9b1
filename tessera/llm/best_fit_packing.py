"""Packing into as few sequences as possible by linear grouping, configurations and best fit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.packing import CapacityTree
from tessera.llm.tokens import encoded, ids_crc32, public_vocabulary
from tessera.plans.tables import materialise, read_table, shuffle_partitions

PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])
PIECE_SQL = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


def linear_groups(counts: dict[int, int], groups: int) -> list[list[tuple[int, int]]]:
    """``(length, pieces)`` in falling order, dealt into groups of equally many pieces.

    A length may be split between two groups. Each group's size, to which its members are rounded up,
    is its first length.
    """
    total = sum(counts.values())
    out, now, room = [], [], 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if not room:
                if now:
                    out.append(now)
                now, at = [], len(out)
                room = total * (at + 1) // groups - total * at // groups
                if not room:  # fewer pieces than groups
                    out.append([])
                    continue
            n = min(left, room)
            now.append((length, n))
            left, room = left - n, room - n
    merged: dict[int, list] = {}  # groups that one length fills are one group
    for g in [*out, now]:
        if g:
            merged.setdefault(g[0][0], []).extend(g)
    return [merged[s] for s in sorted(merged, reverse=True)]


def _dearest(sizes: np.ndarray, value: np.ndarray, window: int) -> np.ndarray:
    """How often each size stands in the most valuable filling of a window (an unbounded knapsack).

    The best value for each room with one piece more, until none more adds to it.
    """
    rooms = np.arange(window + 1) - sizes[:, None]
    fits, rooms = rooms >= 0, np.maximum(rooms, 0)
    best, picks = [np.zeros(window + 1)], []
    for _ in range(window // int(sizes.min())):
        gain = np.where(fits, best[-1][rooms] + value[:, None], 0.0)
        pick = gain.argmax(axis=0)
        now = gain[pick, np.arange(window + 1)]
        if now[window] <= best[-1][window] + 1e-12:
            break
        best.append(now)
        picks.append(np.where(now > best[-2], pick, -1))
    chosen, room = np.zeros(len(sizes), np.int64), window
    for pick in reversed(picks):
        k = int(pick[room])
        if k >= 0:
            chosen[k] += 1
            room -= int(sizes[k])
    return chosen


def configurations(sizes: list[int], demand: list[int], window: int) -> list[tuple[tuple[int, ...], int]]:
    """``(times of each size, windows)``: whole parts of the best mixture of fillings for a demand.

    The linear program over all fillings is solved by the revised simplex method; the filling that
    enters next is the dearest at the present prices, so only as many fillings as there are sizes are
    ever held. What the whole parts leave of the demand is less than one window for each size.
    """
    s, d = np.array(sizes), np.array(demand, float)
    basis = np.diag(window // s).astype(float)
    for _ in range(40 * len(sizes) + 100):  # each step is feasible; stopping early costs windows only
        inverse = np.linalg.inv(basis)
        prices, amount = inverse.sum(axis=0), inverse @ d
        new = _dearest(s, prices, window)
        if prices @ new <= 1 + 1e-7:
            break
        direction = inverse @ new
        grows = direction > 1e-9
        ratio = np.where(grows, amount / np.where(grows, direction, 1.0), np.inf)
        basis[:, int(ratio.argmin())] = new
    amount = np.linalg.inv(basis) @ d
    left, out = np.array(demand), []
    for k in np.argsort(-amount, kind="stable"):
        filling = basis[:, k].astype(np.int64)
        used = filling > 0
        times = int(min(max(0, np.floor(amount[k] + 1e-6)), (left[used] // filling[used]).min()))
        if times:
            left -= times * filling
            out.append((tuple(filling.tolist()), times))
    return out


def linear_grouping(counts: dict[int, int], window: int, groups: int = 256, small: float = 1 / 3) -> tuple[dict[int, list[tuple]], int]:
    """Places for pieces of each length in as few windows as the method finds, and how many these are.

    Pieces that fill a window have it for themselves. Lengths over ``small`` of a window are rounded up within ``groups`` groups of equally many pieces;
    few sizes are left, for which the best fillings are known. The places of a filling then take the
    actual pieces of the group, the longest first. Pieces that the whole fillings leave over and the
    small ones go, the longest first, where they fit best, into windows begun or new ones.

    Alike windows and alike pieces move together: a run ``(first rank, end rank, first window, pieces a
    window, offset)`` places the pieces of a length by their rank among those of that length. Runs are
    bounded by the window and the groups, however many pieces there are.
    """
    large = {x: n for x, n in counts.items() if small * window < x < window}
    taken = dict.fromkeys(counts, 0)
    plan: dict[int, list[tuple]] = {x: [] for x in counts}
    open_: dict[int, list[tuple[int, int]]] = {}
    used = 0
    if large:
        members = linear_groups(large, groups)
        found = configurations([g[0][0] for g in members], [sum(n for _, n in g) for g in members], window)
        queues = [list(reversed(g)) for g in members]  # the longest last, to be taken first
        for filling, times in found:
            slots = [k for k, n in enumerate(filling) for _ in range(n)]
            columns = []  # each slot's pieces as (length, windows), the longest windows first
            for k in slots:
                column, need = [], times
                while need:
                    length, n = queues[k].pop()
                    if n > need:
                        queues[k].append((length, n - need))
                    column.append((length, min(n, need)))
                    need -= min(n, need)
                columns.append(column)
            cuts = sorted({0, times, *(int(x) for column in columns for x in np.cumsum([n for _, n in column]))})
            for low, high in zip(cuts, cuts[1:]):
                offset = 0
                for column in columns:
                    ends = np.cumsum([n for _, n in column])
                    length = column[int(np.searchsorted(ends, low, "right"))][0]
                    rank = taken[length]
                    plan[length].append((rank, rank + high - low, used + low, 1, offset))
                    taken[length] = rank + high - low
                    offset += length
                if offset < window:
                    open_.setdefault(window - offset, []).append((used + low, high - low))
            used += times
    tree = CapacityTree(window)
    for capacity, runs in open_.items():
        tree.add(capacity, sum(n for _, n in runs))
    for length in sorted(counts, reverse=True):
        rank, end = taken[length], counts[length]
        while rank < end:
            capacity = tree.tightest(length)
            if capacity is None:
                capacity, first, bins = window, used, -(-(end - rank) // (window // length))
                used += bins
            else:
                first, bins = open_[capacity].pop()
                tree.add(capacity, -bins)
            each = capacity // length
            placed = min(end - rank, bins * each)
            plan[length].append((rank, rank + placed, first, each, window - capacity))
            full, rest = divmod(placed, each)
            parts = [(full, capacity - each * length), (1, capacity - rest * length) if rest else (0, 0)]
            parts.append((bins - sum(n for n, _ in parts), capacity))
            for n, after in parts:
                if n and after:
                    open_.setdefault(after, []).append((first, n))
                    tree.add(after, n)
                first += n
            rank += placed
    return plan, used


def cut_back(docs: DataFrame, tokenizer: str, end_id: int, window: int, ids: bool = True) -> DataFrame:
    """One row for each piece: what doesn't fill a window comes first, then full windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, every, at in encoded(batches, tokenizer, end_id):
            n = np.diff(at)
            pieces = -(-n // window)
            doc = np.repeat(np.arange(len(n)), pieces)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            ahead = (n - (pieces - 1) * window)[doc]  # the first piece's ids
            start = np.where(piece > 0, ahead + (piece - 1) * window, 0)
            length = np.where(piece > 0, window, ahead)
            parts = [every[s : s + k] for s, k in zip((at[doc] + start).tolist(), length.tolist())]
            raw = [p.tobytes() for p in parts] if ids else [None] * len(parts)
            columns = [b.column(0).take(pa.array(doc)), piece, start, length, [ids_crc32(p) for p in parts], raw]
            yield pa.record_batch([pa.array(c, f.type) if not isinstance(c, pa.Array) else c.cast(f.type) for c, f in zip(columns, PIECE)], schema=PIECE)

    return docs.select("doc_id", "text").mapInArrow(run, PIECE_SQL)


def placed(pieces: DataFrame, plan: dict[int, list[tuple]]) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset`` from the runs planned for their lengths.

    A piece's rank among those of its length is the number in the shares before its ``_share`` and its
    place in its own, so a length that many copies have is spread over all tasks. The plan is sent to all tasks;
    its size is bounded by the window.
    """
    spark = pieces.sparkSession
    sizes = pieces.groupBy("length", "_share").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_share").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "_share", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("length", "_share").orderBy("doc_id", "start", "ids_crc32")
    ranked = pieces.withColumn("_at", F.row_number().over(within) - 1).join(sizes, ["length", "_share"])
    ranked = ranked.withColumn("_rank", F.col("_before") + F.col("_at"))
    shape = "length long, runs array<struct<low: long, high: long, bin: long, each: long, base: long>>"
    places = F.broadcast(spark.createDataFrame([(x, sorted(runs)) for x, runs in plan.items()], shape))
    run = F.filter("runs", lambda r: (r["low"] <= F.col("_rank")) & (F.col("_rank") < r["high"]))[0]
    found = ranked.join(places, "length").withColumn("_run", run).withColumn("_step", F.col("_rank") - F.col("_run.low"))
    return found.select(
        *[x for x in pieces.columns if x != "_share"],
        (F.col("_run.bin") + F.floor(F.col("_step") / F.col("_run.each"))).cast("long").alias("sequence_id"),
        (F.col("_run.base") + F.col("_step") % F.col("_run.each") * F.col("length")).cast("long").alias("offset"),
    )


def pack_tightly(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0, window: int = 2048, groups: int = 256, small: float = 1 / 3, ids: bool = True) -> DataFrame:
    """Pack documents ``(doc_id, text)`` into as few sequences of at most ``window`` tokens as found.

    Returns a row for each piece: doc_id, piece, start, length, ids_crc32, ids (little-endian 16-bit, or
    32-bit for a larger vocabulary; null without ``ids``), sequence_id and offset. Only documents longer
    than a window are cut; their first piece may be shorter than the others. A null or empty text is its
    end id alone; a text of any length is cut whole. Rows that repeat a document are packed each for
    itself; a null doc_id is kept. Pieces of one length are alike to the plan; which of them stands where
    is settled by hashed shares and doc_id. An empty table gives no rows; other columns are ignored.

    Texts are tokenised once. Only the count of each length (``window`` numbers at most) reaches the
    driver, which plans by :func:`linear_grouping`.
    """
    shares = max(64, 2 * shuffle_partitions(docs.sparkSession))
    share = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", F.monotonically_increasing_id()), F.lit(shares)).cast("int")
    pieces = materialise(cut_back(docs, tokenizer or public_vocabulary(), end_id, window, ids).withColumn("_share", share), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan, _ = linear_grouping(counts, window, groups, small)
    return placed(pieces, plan)


def op12_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_tightly(read_table(spark, sf_dir, "documents"), ids=False).drop("ids")
