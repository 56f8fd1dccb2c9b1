"""Which tokens of one tokenizer end where those of another do, and how often over a corpus.

Two tokens are linked where their byte ranges end together. One then is a suffix of the other, so the
vocabularies alone bound the distinct pairs (:func:`most_pairs`: 324 302 for the public files), and
so the tables of counts that tasks hold, however large the corpus is.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import tokens
from tessera.llm.tokens import by_bytes, public_vocabulary
from tessera.plans.tables import drop_files, materialise, read_table

#: Counts in a slice of the vector that tasks add up; partial sums of a slice in the first step of the tree.
SLICE, BRANCHES = 8192, 16
#: Stretches given to a tokenizer as one text, and the word before each; bytes that an aligner remembers.
CHAIN, WORD, MEMORY = 2000, " a", 64 << 20
NONE = pa.array([], pa.large_string())


@lru_cache(maxsize=1)
def _byte_level() -> dict[str, int]:
    """The bytes behind the characters of byte-level entries: printable ones stand for themselves, the
    others in order for the characters from 256 on."""
    fine = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in fine]
    return {chr(b): b for b in fine} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """A tokenizer of either library, with the bytes of each id. Special tokens in texts are plain text.

    ``spaced``: it puts a space before a text by itself, so texts are given without theirs.
    """

    def __init__(self, path: str) -> None:
        self.spaced = path.endswith(".model")
        if self.spaced:
            import sentencepiece

            self.model = sentencepiece.SentencePieceProcessor(model_file=path)
            pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
            plain = lambda i: pieces[i].replace("▁", " ").encode()
            self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else plain(i) for i, p in enumerate(pieces)]
            self.space = self.model.piece_to_id("▁")
            # no piece goes on behind a space, or from a letter to an ASCII character that is none
            used = [p for i, p in enumerate(pieces) if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i))]
            mixed = re.compile("[^▁]▁|[A-Za-z][\\x00-@\\[-`{-\\x7f]")
            self.cuts = not any(mixed.search(p) for p in used) and self.model.encode("a  b, ") == sum(map(self.model.encode, ("a", " b")), []) + [self.model.piece_to_id(","), self.space]
        else:
            from tokenizers import Tokenizer
            from tokenizers.pre_tokenizers import ByteLevel

            self.model = Tokenizer.from_file(path)
            self.model.encode_special_tokens = True
            before, added = self.model.pre_tokenizer, self.model.get_added_tokens_decoder()
            self.cuts = isinstance(before, ByteLevel) and before.use_regex and not before.add_prefix_space and self.model.normalizer is None
            back, self.bytes = _byte_level(), [b""] * self.model.get_vocab_size()
            for token, i in self.model.get_vocab(True).items():
                self.bytes[i] = token.encode() if i in added else bytes(back[x] for x in token)
        self.width = np.array([len(b) for b in self.bytes], np.int64)
        self.flat, self.first = np.frombuffer(b"".join(self.bytes), np.uint8), np.cumsum(self.width) - self.width
        self.names = pa.array(map(str, range(len(self.bytes))), pa.large_string())

    def spelt(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ids, one after the other."""
        return tokens._gathered(self.flat, self.first[ids], self.width[ids])

    def encode(self, text: str) -> list[int]:
        """Ids of a text that begins with a space."""
        if self.spaced:
            return self.model.encode(text[1:], num_threads=1) or [self.space]
        return self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids


@lru_cache(maxsize=1)
def _vocabularies(a: str, b: str) -> tuple[Vocabulary, Vocabulary]:
    """The worker's tokenizers: their size is fixed, so they may outlive a task."""
    return Vocabulary(a), Vocabulary(b)


def _spaced(texts: DataFrame) -> Column:
    """The text behind a space; null for none."""
    return F.when(texts["text"] != "", F.concat(F.lit(" "), texts["text"])).alias("text")


def most_pairs(a: str, b: str) -> int:
    """How many pairs can be linked at most: those of which one's bytes end the other's."""
    one, two = (Counter(v.bytes) for v in _vocabularies(a, b))
    ends = lambda xs, ys, least: sum(n * ys[x[k:]] for x, n in xs.items() for k in range(least, len(x)))
    return ends(one, two, 0) + ends(two, one, 1)


@dataclass
class Aligned:
    """Distinct stretches of text: ids and groups of each, and its links as ``a << 32 | b`` in a row."""

    texts: pa.Array
    valid: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_links: np.ndarray
    pairs: np.ndarray
    groups: pa.Array  # as text, `a1,a2|b1` joined by `;`

    def take(self, at: np.ndarray) -> Aligned:
        first = np.cumsum(self.n_links) - self.n_links
        n = self.n_links[at]
        return Aligned(self.texts.take(pa.array(at)), self.valid[at], self.n_a[at], self.n_b[at], n, tokens._gathered(self.pairs, first[at], n), self.groups.take(pa.array(at)))

    def with_(self, other: Aligned) -> Aligned:
        both = lambda k: np.concatenate([getattr(self, k), getattr(other, k)])
        strings = lambda k: pa.concat_arrays([getattr(self, k), getattr(other, k)])
        return Aligned(strings("texts"), both("valid"), both("n_a"), both("n_b"), both("n_links"), both("pairs"), strings("groups"))

    @property
    def nbytes(self) -> int:
        return sum(getattr(self, k).nbytes for k in self.__dataclass_fields__)


def _sure(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the characters whose last bytes stand at these places are surely no white space."""
    return tokens._SIGN[raw[at]] | (tokens._END[raw[at]] & tokens._BEFORE[raw[np.maximum(at - 1, 0)]] & (at > 0))


def _joined(texts: pa.Array, first: np.ndarray, by: str) -> pa.Array:
    """The texts from each place up to the next, joined."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(first, pa.int32()), texts), pa.scalar(by, pa.large_string()))


class Aligner:
    """Aligns texts: cut where both tokenizers end a token for sure (before spaces, and between a letter
    and an ASCII character that is none), each distinct stretch between the cuts is tokenised and aligned
    once, and what texts need is put together from these.

    Stretches are remembered up to ``MEMORY`` bytes; then those of the last texts alone are. No
    result depends on it. Tokenizers for which no cut is sure get whole texts.
    """

    def __init__(self, a: str, b: str) -> None:
        self.a, self.b = _vocabularies(a, b)
        self.cuts = self.a.cuts and self.b.cuts
        self.known = self._align(NONE)

    def _ids(self, v: Vocabulary, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A tokenizer's ids of all texts in a row, how many each has, and whether they spell it.

        Texts that end with a sure sign are given to the tokenizer many at a time, each behind a word
        of its own, from which the tokenizer cuts it again on either side. A line that isn't spelt by its
        ids is halved until the text at fault is found.
        """
        raw, at = tokens._buffers(texts)
        n, valid, parts, order = np.zeros(len(texts), np.int64), np.zeros(len(texts), bool), [], []
        sure = _sure(raw, at[1:] - 1) if self.cuts else np.zeros(len(texts), bool)
        chain, alone = np.flatnonzero(sure), np.flatnonzero(~sure)
        lines = [chain[k : k + CHAIN] for k in range(0, len(chain), CHAIN)] + [alone[k : k + 1] for k in range(len(alone))]
        before = WORD if self.cuts else ""
        while lines:
            own = lines.pop()
            behind = pc.binary_join_element_wise(pa.scalar(before, pa.large_string()), texts.take(pa.array(own)), pa.scalar("", pa.large_string()))
            line, ends = tokens._buffers(behind)
            ids = np.array(v.encode(line.tobytes().decode()), np.int64)
            to = np.append(0, np.cumsum(v.width[ids]))
            first, last = ends[:-1] + len(before), ends[1:]
            low, high = np.searchsorted(to, first), np.searchsorted(to, last)
            fine = np.array_equal(v.spelt(ids), line) and np.array_equal(to[low], first) and np.array_equal(to[high], last)
            if not fine and len(own) > 1:
                lines += [own[: len(own) // 2], own[len(own) // 2 :]]
            elif fine:
                n[own], valid[own] = high - low, True
                parts.append(tokens._gathered(ids, low, high - low))
                order.append(own)
        order = np.concatenate([np.zeros(0, np.int64), *order])
        start = np.zeros(len(texts), np.int64)
        start[order] = np.cumsum(n[order]) - n[order]
        return tokens._gathered(np.concatenate([np.zeros(0, np.int64), *parts]), start, n), n, valid

    def _align(self, texts: pa.Array) -> Aligned:
        """Each text, which begins with a space or follows a letter, on its own."""
        (x, n_a, spelt_a), (y, n_b, spelt_b) = (self._ids(v, texts) for v in (self.a, self.b))
        fine = spelt_a & spelt_b
        x, y = x[np.repeat(fine, n_a)], y[np.repeat(fine, n_b)]
        n_a, n_b = n_a * fine, n_b * fine
        _, at = tokens._buffers(texts)
        ends_a, ends_b = np.cumsum(self.a.width[x]), np.cumsum(self.b.width[y])  # of the texts one after the other
        both = np.intersect1d(ends_a, ends_b, assume_unique=True)
        at_a, at_b = np.searchsorted(ends_a, both), np.searchsorted(ends_b, both)
        last = np.searchsorted(both, np.cumsum(np.diff(at) * fine), "right")
        sides = [_joined(v.names.take(pa.array(ids)), np.append(0, k + 1), ",") for v, ids, k in ((self.a, x, at_a), (self.b, y, at_b))]
        groups = _joined(pc.binary_join_element_wise(*sides, pa.scalar("|", pa.large_string())), np.append(0, last), ";")
        return Aligned(texts, fine, n_a, n_b, np.diff(last, prepend=0), x[at_a] << 32 | y[at_b], groups)

    def __call__(self, spaced: pa.Array) -> tuple[Aligned, np.ndarray, np.ndarray]:
        """Stretches of texts that begin with a space, which of them stand in the texts one after the
        other, and for each text the place of its first, at last their number. A text that is null or not
        given back by both tokenizers has none."""
        spaced = spaced.cast(pa.large_string())
        raw, at = tokens._buffers(spaced)
        if not len(raw):
            return self.known.take(np.zeros(0, np.int64)), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
        cut = np.zeros(len(raw), bool)
        if self.cuts:
            cut[1:] = tokens._OTHER[raw[1:]] & tokens._LETTER[raw[:-1]]
            space = np.flatnonzero(raw[1:] == 32) + 1
            cut[space] |= _sure(raw, space - 1)
        cut[at[:-1][at[:-1] < len(raw)]] = True
        starts = np.flatnonzero(cut)
        offsets = np.append(starts, len(raw)).astype(np.int64)
        found = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw))).dictionary_encode()
        place = pc.index_in(found.dictionary, value_set=self.known.texts)
        new = found.dictionary.filter(place.is_null())
        own = self._align(new)
        at_known = place.fill_null(-1).to_numpy().astype(np.int64)
        at_known[at_known < 0] = len(self.known.texts) + np.arange(len(new))
        self.known = self.known.with_(own)
        own = self.known.take(at_known)
        if self.known.nbytes > MEMORY:
            self.known = own if own.nbytes <= MEMORY else self._align(NONE)
        which = found.indices.to_numpy().astype(np.int64)
        first = np.searchsorted(starts, at)
        wrong = np.flatnonzero(~own.valid)
        if len(wrong):
            own, which, first = self._whole(spaced, own, which, first, wrong)
        return own, which, first

    def _whole(self, spaced: pa.Array, own: Aligned, which: np.ndarray, first: np.ndarray, wrong: np.ndarray) -> tuple[Aligned, np.ndarray, np.ndarray]:
        """Texts with a stretch that isn't given back are judged as a whole; those that fail lose all."""
        bad = np.isin(which, wrong)
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        failed = np.unique(doc[bad])
        whole = self._align(spaced.take(pa.array(failed)))
        size = np.diff(first)
        parts, n = [], size.copy()
        n[failed] = whole.valid.astype(np.int64)
        at = dict(zip(failed.tolist(), range(len(failed))))
        for d, (s, e) in enumerate(zip(first[:-1], first[1:])):
            if d not in at:
                parts.append(which[s:e])
            elif whole.valid[at[d]]:
                parts.append(np.array([len(own.valid) + at[d]]))
        return own.with_(whole), np.concatenate([np.zeros(0, np.int64), *parts]), np.concatenate([[0], np.cumsum(n)])


@lru_cache(maxsize=1)
def _aligner(a: str, b: str) -> Aligner:
    """The worker's aligner: what it remembers is bounded, so it may outlive a task and serve the next."""
    return Aligner(a, b)


class PairCounts:
    """Sorted distinct pairs and their counts, of which new ones are added in."""

    def __init__(self) -> None:
        self.pairs, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, pairs: np.ndarray, n: np.ndarray) -> None:
        self.pairs, at = np.unique(np.concatenate([self.pairs, pairs]), return_inverse=True)
        sums = np.zeros(len(self.pairs), np.int64)
        np.add.at(sums, at, np.concatenate([self.n, n]))
        self.n = sums


def _count(a: str, b: str) -> Callable:
    """A task's distinct pairs and how often its texts hold them linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align, counts = _aligner(a, b), PairCounts()
        for batch in by_bytes(batches, 0, tokens.STRETCH):
            own, which, _ = align(batch.column(0))
            times = np.bincount(which, minlength=len(own.valid))
            counts.add(own.pairs, np.repeat(times, own.n_links))
        seen = counts.n > 0
        yield pa.record_batch([pa.array([x[seen].tobytes()], pa.binary()) for x in (counts.pairs, counts.n)], ["pairs", "n"])

    return run


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = np.zeros(0, np.int64)
    for batch in batches:
        for x in batch.column(0):
            found = np.union1d(found, np.frombuffer(x.as_buffer(), np.int64))
    yield pa.record_batch([pa.array(found)], ["pair"])


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """Hashes of keys: each of the seeds gives a function of its own."""
    x = keys.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15 * (2 * seed + 1) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """A minimal perfect hash of distinct keys: n keys get the numbers 0 to n - 1.

    On each level the keys left are thrown at twice as many places. A key alone on its place has found
    it, others go on to the next level. A key's number is how many found places lie before its own. The
    keys are kept by number, so that a key that isn't among them is told from those that are.
    """

    def __init__(self, keys: np.ndarray) -> None:
        self.levels, self.before, found, left = [], [], 0, np.asarray(keys, np.int64)
        self.keys = np.zeros(len(left), np.int64)
        while len(left):
            place = (_mixed(left, len(self.levels)) % np.uint64(2 * len(left))).astype(np.int64)
            taken = np.bincount(place, minlength=2 * len(left)) == 1
            rank = (found + np.cumsum(taken) - taken).astype(np.int32)  # a pair table is far below 2 ** 31
            alone = taken[place]
            self.keys[rank[place[alone]]] = left[alone]
            self.levels.append(np.where(taken, rank, -1).astype(np.int32))
            found, left = found + int(taken.sum()), left[~alone]

    def __len__(self) -> int:
        return len(self.keys)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The numbers of keys; -1 for those that it wasn't made of."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for k, level in enumerate(self.levels):
            got = level[(_mixed(keys[left], k) % np.uint64(len(level))).astype(np.int64)]
            out[left[got >= 0]] = got[got >= 0]
            left = left[got < 0]
        known = out >= 0
        known[known] = self.keys[out[known]] == keys[known]
        return np.where(known, out, -1)


@dataclass
class PairTable:
    """Counts of all linked pairs of a corpus, by a perfect hash of the pairs."""

    hash: PerfectHash
    n: np.ndarray

    def __post_init__(self) -> None:
        b = self.hash.keys & 0xFFFFFFFF
        most = np.zeros(int(b.max(initial=0)) + 1, np.int64)
        np.maximum.at(most, b, self.n)
        self.best = self.n == most[b]

    def __call__(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of pairs, and whether each is the highest of its second id; 0 and no for unknown ones."""
        at = self.hash(pairs)
        known = at >= 0
        n, best = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), bool)
        n[known], best[known] = self.n[at[known]], self.best[at[known]]
        return n, best


def _vectors(table: Broadcast) -> Callable:
    """A task's counts as slices of the dense vector over all pairs; empty slices are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = table.value
        total = np.zeros(-(-len(index) // SLICE) * SLICE, np.int64)
        for batch in batches:
            for x, n in zip(*batch.columns):
                at = index(np.frombuffer(x.as_buffer(), np.int64))
                total[at] += np.frombuffer(n.as_buffer(), np.int64)
        for k, part in enumerate(total.reshape(-1, SLICE)):
            if part.any():
                yield pa.record_batch([pa.array([k], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["slice", "n"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One sum for each slice."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, n in zip(batch.column(0).to_pylist(), batch.column(1)):
            part = np.frombuffer(n.as_buffer(), np.int64)
            sums[k] = sums[k] + part if k in sums else part.copy()
    if sums:
        yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["slice", "n"])


def count_pairs(texts: DataFrame, a: str | None = None, b: str | None = None) -> PairTable:
    """Counts of the linked pairs of ``text``, the first pass over a corpus.

    Each task gives its own distinct pairs and counts, written to the shared folder. The distinct pairs
    of all tasks get a minimal perfect hash; by it the counts become dense vectors, which are added up in
    two steps. The vocabularies bound the pairs, so the driver and each task hold one vector at most.
    """
    a, b = a or public_vocabulary("byte_bpe_50k.json"), b or public_vocabulary("piece_bpe_32k.model")
    spark, slices = texts.sparkSession, "slice int, n binary"
    own = materialise(texts.select(_spaced(texts)).mapInArrow(_count(a, b), "pairs binary, n binary"), "pairs")
    distinct = own.select("pairs").mapInArrow(_distinct, "pair long").distinct()
    index = PerfectHash(np.sort(np.array([r["pair"] for r in distinct.toLocalIterator()], np.int64)))
    shared = spark.sparkContext.broadcast(index)
    parts = own.mapInArrow(_vectors(shared), slices).withColumn("_branch", F.spark_partition_id() % BRANCHES)
    parts = parts.repartition("slice", "_branch").select("slice", "n").mapInArrow(_added, slices)
    parts = parts.repartition("slice").mapInArrow(_added, slices)
    n = np.zeros(-(-len(index) // SLICE) * SLICE, np.int64)
    for r in parts.collect():
        n[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = np.frombuffer(r["n"], np.int64)
    drop_files(own)
    shared.unpersist()
    return PairTable(index, n[: len(index)])


ALIGNED_SQL = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def align(docs: DataFrame, table: PairTable, a: str | None = None, b: str | None = None, groups: bool = False) -> DataFrame:
    """``(doc_id, text)`` aligned again, with what ``table`` holds of its links: the second pass.

    Returns doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, and with ``groups`` the
    groups as text: ids of both tokenizers between two places where both end a token, as in
    ``a1,a2|b1;a3|b2,b3``. A text that is null or empty or that the tokens of either don't spell has
    zeros and empty strings. Texts of any length are aligned whole; each row stands for itself, repeated
    and null doc_ids included; other columns are ignored. Pairs that ``table`` lacks count 0 and are not best.
    """
    a, b = a or public_vocabulary("byte_bpe_50k.json"), b or public_vocabulary("piece_bpe_32k.model")
    shared = docs.sparkSession.sparkContext.broadcast(table)
    names = [x.split()[0] for x in ALIGNED_SQL.split(", ")] + ["groups"] * groups

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, look_up = _aligner(a, b), shared.value
        for batch in by_bytes(batches, size=tokens.STRETCH):
            own, which, first = aligner(batch.column(1))
            n, best = look_up(own.pairs)
            ends = np.cumsum(own.n_links)
            total = lambda x, s, e: (c := np.concatenate([[0], np.cumsum(x)]))[e] - c[s]
            each = [own.n_a, own.n_b, own.n_links, own.n_links, *(total(x.astype(np.int64), ends - own.n_links, ends) for x in (best, n))]
            sums = [total(x[which], first[:-1], first[1:]) for x in each]
            text = _joined(own.groups.take(pa.array(which)), first, ";")
            digests = [hashlib.sha256(t.as_buffer()).hexdigest() if k else "" for t, k in zip(text, sums[2])]
            columns = [batch.column(0).cast(pa.int64()), *map(pa.array, sums), pa.array(digests, pa.string())] + [text.cast(pa.string())] * groups
            yield pa.record_batch(columns, names)

    return docs.select(F.col("doc_id").cast("long"), _spaced(docs)).mapInArrow(run, ALIGNED_SQL + ", groups string" * groups)


def op13_token_alignment(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return align(docs, count_pairs(docs))
