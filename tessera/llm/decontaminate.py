"""Benchmark decontamination by latent semantic retrieval of paraphrased and copied items."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.tokens import by_bytes
from tessera.plans.tables import drop_files, materialise, read_table, release

#: Hashed words of the vocabulary, latent dimensions kept, and extra ones for the random projection.
FEATURES, RANK, EXTRA = 1 << 15, 40, 8
#: Words in a block; a passage is two blocks in a row, and passages start with every block.
STEP = 24
#: Words found in a larger share of blocks are stop words without weight.
COMMON = 0.01
#: Least cosine of a candidate, and least share of an item's words in common order around a passage.
NEAR, SHARED = 0.25, 0.7
#: Words at the end of an item that count as its answer, and the share of them that must be there.
ANSWER, ANSWERED = 6, 0.5

_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_VALUE = np.arange(1, 257, dtype=np.uint64)
_VALUE[65:91] += np.uint64(32)
_PRIME = np.uint64(1099511628211)
with np.errstate(over="ignore"):
    _POWERS = np.cumprod(np.full(64, _PRIME), dtype=np.uint64)


def word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of UTF-8 bytes: a 32-bit hash of each word, lower-cased A-Z, and the byte where it starts.

    Words are runs of letters, digits and bytes of other scripts. A word's hash is a sum of its bytes
    times a power for their place, its length added, so all words are hashed in a few array steps.
    """
    inside = _LETTER[raw]
    edge = np.diff(inside.view(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.zeros(0, np.uint32), start
    rest = raw[start[0] :]
    place = np.arange(len(rest)) - np.repeat(start - start[0], np.diff(np.append(start, len(raw))))
    value = np.where(inside[start[0] :], _VALUE[rest], np.uint64(0)) * _POWERS[place & 63]
    total = np.add.reduceat(value, start - start[0])
    total = (total ^ (total >> np.uint64(29))) * _PRIME + (end - start).astype(np.uint64)
    return (total ^ (total >> np.uint64(32))).astype(np.uint32), start


def features(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint32(FEATURES - 1)).astype(np.int32)


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of all texts in a row, and for each text the place of its first; at last their number."""
    raw = [np.frombuffer(t.as_buffer(), np.uint8) if t.is_valid else np.zeros(0, np.uint8) for t in texts.cast(pa.large_binary())]
    gap = np.zeros(1, np.uint8)
    words, at = word_hashes(np.concatenate([gap, *(x for r in raw for x in (r, gap))]))
    return words, np.searchsorted(at, np.cumsum([1, *(len(r) + 1 for r in raw)]))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in by_bytes(batches, size=1_000_000):
        words, at = words_of(b.column(1))
        column = pa.BinaryArray.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer((at * 4).astype(np.int32)), pa.py_buffer(words)])
        yield pa.record_batch([b.column(0), column], ["doc_id", "words"])


def hashed_words(docs: DataFrame) -> DataFrame:
    """``(doc_id, words)`` of ``(doc_id, text)``, written: every text's words as 32-bit hashes, so that
    texts are read and hashed once for all passes."""
    return materialise(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_hashed, "doc_id long, words binary"), "words")


class Batch:
    """The words of a batch of texts, in blocks of ``STEP`` words that cover each text."""

    def __init__(self, words: np.ndarray, at: np.ndarray) -> None:
        self.words, self.ids = words, features(words)
        self.first, self.last = at[:-1].astype(np.int64), at[1:].astype(np.int64)
        blocks = -(-(self.last - self.first) // STEP)
        self.doc = np.repeat(np.arange(len(blocks)), blocks)
        nth = np.arange(len(self.doc)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        self.start = np.repeat(self.first, blocks) + nth * STEP
        self.block = np.repeat(np.arange(len(self.doc)), np.diff(np.append(self.start, len(self.ids))))

    @classmethod
    def of_texts(cls, texts: pa.Array) -> Batch:
        return cls(*words_of(texts))

    def weighted(self, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Features and blocks of the words that have a weight."""
        keep = np.flatnonzero(weight[self.ids] > 0)
        return self.ids[keep], self.block[keep]

    def sums(self, table: np.ndarray, ids: np.ndarray, block: np.ndarray) -> np.ndarray:
        """For each block, the sum of ``table`` over its words."""
        out = np.zeros((len(self.doc), table.shape[1]), np.float32)
        first = np.flatnonzero(np.diff(block, prepend=-1))
        if len(first):
            out[block[first]] = np.add.reduceat(table[ids], first, axis=0)
        return out


def _spread(values: np.ndarray, ids: np.ndarray, block: np.ndarray, into: np.ndarray) -> None:
    """Add to each feature's row, for each of its words, the row of the word's block."""
    order = np.argsort(ids.astype(np.uint16), kind="stable")
    ids = ids[order]
    first = np.flatnonzero(np.diff(ids, prepend=-1))
    if len(first):
        into[ids[first]] += np.add.reduceat(values[block[order]], first, axis=0)


def _signatures(words: np.ndarray, rare: np.ndarray, groups: np.ndarray, n: int) -> np.ndarray:
    """For each group, which of 512 bits its words set: four 64-bit numbers of rare words, four of others."""
    out = np.zeros((n, 8), np.uint64)
    bit = np.uint64(1) << (words >> np.uint32(15) & np.uint32(63)).astype(np.uint64)
    part = (words >> np.uint32(21) & np.uint32(3)).astype(np.int8) + np.where(rare, 0, 4).astype(np.int8)
    for h in range(8):
        own = np.flatnonzero(part == h)
        first = np.flatnonzero(np.diff(groups[own], prepend=-1))
        if len(first):
            out[groups[own][first], h] = np.bitwise_or.reduceat(bit[own], first)
    return out


class Spans:
    """The bits set in any run of blocks, from those of runs of 1, 2, 4, ... blocks."""

    def __init__(self, signs: np.ndarray, longest: int) -> None:
        self.levels = [signs]
        while 2 << len(self.levels) - 1 <= longest:
            half, last = 1 << len(self.levels) - 1, self.levels[-1]
            level = last.copy()
            level[:-half] |= last[half:]
            self.levels.append(level)

    def set(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The bits that some block from ``first`` up to ``end`` sets."""
        out = np.zeros_like(self.levels[0], shape=(len(first), self.levels[0].shape[1]))
        level = np.frexp(end - first)[1] - 1  # of the longest run that fits
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            out[at] = self.levels[k][first[at]] | self.levels[k][end[at] - (1 << k)]
        return out


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Batch]]:
    """Of ``(doc_id, words)``: parts of about half a MB of words, of whole rows."""
    for b in batches:
        raw = b.column(b.schema.get_field_index("words")).cast(pa.large_binary())
        at = np.frombuffer(raw.buffers()[1], np.int64, len(raw) + 1, 8 * raw.offset)
        every = np.frombuffer(raw.buffers()[2], "<u4") if at[-1] > at[0] else np.zeros(0, np.uint32)
        at = at // 4
        cuts = [0, *(np.flatnonzero(np.diff((at[:-1] - at[0]) >> 17)) + 1).tolist(), b.num_rows]
        for s, e in zip(cuts, cuts[1:]):
            if e > s:
                yield b.slice(s, e - s), Batch(every[at[s] : at[e]], at[s : e + 1] - at[s])


def _block_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, blocks = np.zeros(FEATURES, np.int64), 0
    for _, x in _batches(batches):
        blocks += len(x.doc)
        pairs = np.sort(x.block.astype(np.int64) * FEATURES + x.ids)
        total += np.bincount(pairs[np.diff(pairs, prepend=-1) > 0] % FEATURES, minlength=FEATURES)
    used = np.flatnonzero(total)
    rows = [np.append(used, -1), np.append(total[used], blocks)]
    yield pa.record_batch([pa.array(r) for r in rows], ["feature", "n"])


def _projected(table: np.ndarray, weight: np.ndarray) -> Callable:
    """This task's part of ``A' A table``, A being the weighted blocks: one row for each feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros_like(table, dtype=np.float32)
        for _, x in _batches(batches):
            ids, block = x.weighted(weight)
            _spread(x.sums(table, ids, block), ids, block, total)
        used = np.flatnonzero(np.abs(total).sum(1))
        for k in range(0, len(used), 8192):
            rows = used[k : k + 8192]
            flat = pa.array(total[rows].ravel())
            yield pa.record_batch([pa.array(rows), pa.FixedSizeListArray.from_arrays(flat, total.shape[1]).cast(pa.list_(pa.float32()))], ["feature", "row"])

    return run


def latent_space(words: DataFrame, seed: int = 11) -> np.ndarray:
    """A ``FEATURES`` x ``RANK`` matrix of weighted latent coordinates of hashed words; 0 for stop words.

    Weights are inverse frequencies over the blocks of all texts, none for stop words. With A the
    weighted blocks of all texts and R random directions, each task adds up its part of ``Y = A' A R``
    and the parts are summed feature by feature. The driver, which holds two matrices whose size
    depends on ``FEATURES`` alone, takes the singular value decomposition that Y and ``R' Y`` give
    (Nyström's form of the randomised SVD, which needs no second pass): right singular vectors of A,
    the ``RANK`` of largest singular value, span the space.
    """
    counted = words.select("words").mapInArrow(_block_counts, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    counted = counted.toArrow()  # FEATURES + 1 rows at most
    found = dict(zip(counted["feature"].to_pylist(), counted["n"].to_pylist()))
    blocks = found.pop(-1, 0)
    weight = np.zeros(FEATURES)
    for f, n in found.items():
        if n <= max(COMMON * blocks, 5):
            weight[f] = np.log((1 + blocks) / n)
    directions = np.random.default_rng(seed).standard_normal((FEATURES, RANK + EXTRA)) * (weight > 0)[:, None]
    table = (directions * weight[:, None]).astype(np.float32)
    rows = words.select("words").mapInArrow(_projected(table, weight), "feature long, row array<float>")
    summed = rows.groupBy("feature").agg(*[F.sum(F.col("row")[i]).alias(f"c{i}") for i in range(RANK + EXTRA)])
    y = np.zeros((FEATURES, RANK + EXTRA))
    summed = summed.toArrow()  # FEATURES rows at most
    for i in range(RANK + EXTRA):
        y[summed["feature"].to_numpy(), i] = summed[f"c{i}"].to_numpy()
    del summed
    release(words.sparkSession)
    vectors, values = singular_vectors(y * weight[:, None], directions)
    keep = vectors[:, :RANK] * (values[:RANK] > 0)
    return (keep * weight[:, None]).astype(np.float32)


def singular_vectors(y: np.ndarray, directions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors and singular values of A, the largest first, from ``y = A' A directions``."""
    shift = 1e-7 * max(float(np.linalg.norm(y)), 1e-30)
    y = y + shift * directions
    small = directions.T @ y
    values, turn = np.linalg.eigh((small + small.T) / 2)
    root = turn / np.sqrt(np.maximum(values, shift * 1e-3))
    basis, size, _ = np.linalg.svd(y @ root, full_matrices=False)
    return basis, np.sqrt(np.maximum(size**2 - shift, 0))


def word_places(item: np.ndarray) -> dict[int, int]:
    """For each word of a short sequence, the places where it stands, as bits."""
    masks: dict[int, int] = {}
    for i, w in enumerate(item.tolist()):
        masks[w] = masks.get(w, 0) | 1 << i
    return masks


def common_order(masks: dict[int, int], n: int, b: list[int], least: int = 0) -> int:
    """Length of the longest common subsequence of ``n`` words with places ``masks`` and of ``b``, by
    bit-parallel steps; 0 if it can't reach ``least``. Words that only ``b`` has change nothing."""
    hits = [m for m in map(masks.get, b) if m]
    if len(hits) < least:
        return 0
    row = full = (1 << n) - 1
    for m in hits:
        hit = row & m
        row = ((row + hit) | (row - hit)) & full
    return n - row.bit_count()


class Items:
    """Benchmark items as word hashes, and their parts of at most a passage with latent vectors.

    Parts overlap and cover all words; they only find candidates, which are checked against ``whole``.
    """

    def __init__(self, rows: list[tuple[int, str]], space: np.ndarray) -> None:
        self.space, self.weight, self.item, self.part = space, np.abs(space).sum(1), [], []
        self.whole, self.at = [], []  # of each part: its item's words, and where in them it starts
        for item_id, text in rows:
            words, _ = word_hashes(np.frombuffer(text.encode(), np.uint8))
            if len(words) < 4:
                continue
            last = max(0, len(words) - 2 * STEP)
            for k in [*range(0, last, STEP), last]:
                self.item.append(item_id)
                self.part.append(words[k : k + 2 * STEP])
                self.whole.append(words)
                self.at.append(k)
        n = np.array([len(w) for w in self.whole], np.int64)
        words = np.concatenate(self.whole) if self.whole else np.zeros(0, np.uint32)
        self.signs = _signatures(words, self.weight[features(words)] > 0, np.repeat(np.arange(len(n)), n), len(n))
        self.need = np.ceil(SHARED * n - 1e-9).astype(np.int64)
        # words that an item may lack, so that the rest can still be in common order: no other bound
        self.spare = n - self.need
        self.masks = [word_places(w) for w in self.whole]
        self.answer = [word_places(w[-ANSWER:]) for w in self.whole]
        # blocks before and after a passage's first one that its window reaches
        at, size = np.array(self.at, np.int64), np.array([len(p) for p in self.part], np.int64)
        self.before, self.after = -(-(at + size) // STEP), -(-(2 * STEP - at + n) // STEP)
        vectors = [space[features(p)].sum(0) for p in self.part]
        self.vectors = _unit(np.array(vectors, np.float32).reshape(-1, space.shape[1]))
        # parts of stop words alone have no place in the space: every passage is their candidate
        self.plain = np.array([i for i, p in enumerate(self.part) if not (self.weight[features(p)] > 0).any()], np.int64)

    def found(self, x: Batch) -> list[tuple[int, int]]:
        """``(text, item)`` of each text that holds an item, copied or reworded in part."""
        if not len(x.doc) or not self.item:
            return []
        ids, block = x.weighted(self.weight)
        vectors = x.sums(self.space, ids, block)
        signs = _signatures(x.words, self.weight[x.ids] > 0, x.block, len(x.doc))
        pair = np.flatnonzero(x.doc[1:] == x.doc[:-1])
        vectors[pair] += vectors[pair + 1]
        vectors = _unit(vectors)
        blocks = np.bincount(x.doc, minlength=len(x.first))
        end = np.cumsum(blocks)[x.doc]  # of each block's text, in blocks
        begin = end - blocks[x.doc]
        spans = Spans(signs, min(int(blocks.max()), int((self.before + self.after).max())))
        reach, kind = np.unique(np.stack([self.before, self.after], 1), axis=0, return_inverse=True)
        at, hits = np.arange(len(vectors)), set()
        step = max(256, (1 << 23) // len(self.part))
        for k, (before, after) in enumerate(reach):  # parts that look equally far around a passage
            lacked = ~spans.set(np.maximum(at - before, begin), np.minimum(at + after, end))
            own = np.flatnonzero(kind.ravel() == k)
            plain = np.isin(own, self.plain)
            for low in range(0, len(vectors), step):
                near = vectors[low : low + step] @ self.vectors[own].T >= NEAR
                near[:, plain] = True
                p, i = np.nonzero(near)
                p, i = p + low, own[i]
                for part in (slice(0, 4), slice(0, 8)):  # rare words first, as they rule out most
                    fine = np.bitwise_count(self.signs[i, part] & lacked[p, part]).sum(1) <= self.spare[i]
                    p, i = p[fine], i[fine]
                self._check(x, p, i, hits)
        return sorted(hits)

    def _check(self, x: Batch, p: np.ndarray, i: np.ndarray, hits: set[tuple[int, int]]) -> None:
        """Add to ``hits`` the candidates, passage ``p`` and part ``i``, around which the item is found:
        enough of its words in its order, and enough of its answer."""
        for p, i in zip(p.tolist(), i.tolist()):
            d = int(x.doc[p])
            if (d, self.item[i]) in hits:
                continue
            n, begin = len(self.whole[i]), int(x.start[p]) - self.at[i]  # where the item starts if the part does here
            low = max(begin - len(self.part[i]), int(x.first[d]))
            window = x.words[low : min(begin + 2 * STEP + n, int(x.last[d]))].tolist()
            if common_order(self.masks[i], n, window, int(self.need[i])) >= self.need[i]:
                answer = min(ANSWER, n)
                if common_order(self.answer[i], answer, window) >= ANSWERED * answer:
                    hits.add((d, self.item[i]))


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)


#: Bytes of benchmark text that a task holds at once, about; a larger benchmark is dealt into groups.
GROUP = 8 << 20


def load_items(benchmark: DataFrame, space: np.ndarray) -> Iterator[Items]:
    """The benchmark's items in groups of about ``GROUP`` bytes, each small enough for the driver and
    for every task. A benchmark is a stated list of questions: one group commonly holds it."""
    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), "text").distinct()
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    groups = 1 + size // GROUP
    for g in range(groups):
        own = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == g).orderBy("item_id", "text")
        yield Items([(r["item_id"], r["text"]) for r in own.collect()], space)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(doc_id, item_id)`` for each document that holds a benchmark item, wholly or in part.

    Passages near an item in the latent space are candidates; a candidate counts if the longest common
    subsequence of its surroundings and the item has ``SHARED`` of the item's words and the item's
    last words, its answer, are among them. Items of fewer than 4 words, and null ones, find nothing;
    null and empty texts hold nothing; a text of any length is searched whole; repeated rows give one
    pair; other columns are ignored; an empty table gives no rows.
    """
    words = hashed_words(docs)
    pairs = reduce(DataFrame.union, [words.mapInArrow(_finder(items), "doc_id long, item_id long") for items in load_items(benchmark, latent_space(words))])
    pairs = materialise(pairs.distinct(), "contaminated")
    drop_files(words)
    return pairs


def _finder(items: Items) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, x in _batches(batches):
            ids = b.column(0).to_pylist()
            found = [(ids[d], i) for d, i in items.found(x)]
            doc, item = zip(*found) if found else ((), ())
            yield pa.record_batch([pa.array(doc, pa.int64()), pa.array(item, pa.int64())], ["doc_id", "item_id"])

    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark item (see :func:`contaminated`).

    Each row is judged by its own text: null and empty texts stay, repeated rows share their fate, all
    columns are kept whatever their names, and an empty table stays empty.
    """
    words = hashed_words(docs)
    for items in load_items(benchmark, latent_space(words)):
        docs = docs.mapInArrow(_without(items, docs.columns.index("text")), docs.schema)
    drop_files(words)
    return docs


def _without(items: Items, text: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, text, 1_000_000):
            keep = np.ones(b.num_rows, bool)
            keep[[d for d, _ in items.found(Batch.of_texts(b.column(text)))]] = False
            yield b.filter(pa.array(keep))

    return run


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
