"""Token ids of whole texts, with a public tokenizer file, in Arrow batches."""

from __future__ import annotations

import ctypes
import os
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
from tokenizers import Tokenizer  # noqa: E402
from tokenizers.pre_tokenizers import ByteLevel  # noqa: E402

#: Bytes of pieces and their ids that an encoder remembers, about, and bytes of text cut at once, about.
MEMORY, STRETCH = 16 << 20, 6 << 20

# A piece may start at one of these white spaces ...
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 13, 32]] = True
# ... if the character before is surely none: an ASCII sign, or the end of a longer character whose
# byte before the last is none of those that white spaces of any script have there.
_SIGN = np.zeros(256, bool)
_SIGN[33:127] = True
_END = np.zeros(256, bool)
_END[128:] = True
_BEFORE = np.ones(256, bool)
_BEFORE[[0x80, 0x81, 0x9A, 0xA0, 0xBB, 0xC2]] = False
# A piece may also start at an ASCII character that is no letter and follows an ASCII letter.
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_OTHER = np.zeros(256, bool)
_OTHER[:128] = ~_LETTER[:128]


def public_vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=1)
def _tokenizer(path: str) -> Tokenizer:
    """The worker's tokenizer: its size is fixed, so it may outlive a task."""
    return Tokenizer.from_file(path)


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, null ones being empty, and where each starts and the last one ends."""
    texts = texts.fill_null("").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64, len(texts) + 1, 8 * texts.offset)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


class BatchEncoder:
    """Ids of many texts at once: those of ``Tokenizer.encode(text, add_special_tokens=False)``.

    The byte-level pattern ends a token between a letter and what is none, and before every run of
    white space that follows another character; what comes after depends on the text from there on
    alone. Texts are cut at such places, each distinct piece of a stretch is given to the tokenizer once,
    and the ids are put together by array steps. Places where the bytes leave a doubt aren't cut, which
    changes no id, nor are letters cut off where an added token occurs. Pieces are remembered up to
    ``MEMORY`` bytes; then those of the last stretch alone are. No result depends on it. Tokenizers
    of other kinds are given the texts as they are.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = _tokenizer(path)
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        before = self.tokenizer.pre_tokenizer
        self.cuts = isinstance(before, ByteLevel) and before.use_regex and not before.add_prefix_space
        self.cuts = self.cuts and self.tokenizer.normalizer is None and not any(t.split() != [t] for t in added)
        self.cuts = self.cuts and not any(t.lstrip or t.rstrip or t.single_word for t in self.tokenizer.get_added_tokens_decoder().values())
        self.added = [t.encode() for t in added]
        self.width = np.zeros(size, np.int64)  # bytes of text that each id stands for
        for token, i in self.tokenizer.get_vocab(True).items():
            self.width[i] = len(token.encode()) if token in added else len(token)
        self._forget()

    def _forget(self) -> None:
        self.pieces, self.size, self.flat = pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, self.dtype)

    def _encoded(self, pieces: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each piece has, and all ids. Pieces that start with a white space and end with an
        ASCII sign are joined, as they would be cut there again; the ids' widths tell them apart."""
        raw, at = _buffers(pieces)
        joined = _BLANK[raw[at[:-1]]] & _SIGN[raw[at[1:] - 1]]
        chain, alone = np.flatnonzero(joined), np.flatnonzero(~joined)
        size, parts = np.zeros(len(pieces), np.int64), []
        for k in range(0, len(chain), 1000):
            own = chain[k : k + 1000]
            text = "".join(pieces.take(pa.array(own)).to_pylist())
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)
            ends = np.cumsum((at[1:] - at[:-1])[own])
            size[own] = np.diff(np.searchsorted(np.cumsum(self.width[ids]), ends, "right"), prepend=0)
            parts.append(ids)
        for k in range(0, len(alone), 1000):
            own = alone[k : k + 1000]
            for i, e in zip(own, self.tokenizer.encode_batch_fast(pieces.take(pa.array(own)).to_pylist(), add_special_tokens=False)):
                parts.append(np.array(e.ids, self.dtype))
                size[i] = len(e.ids)
        flat = np.concatenate(parts) if parts else np.zeros(0, self.dtype)
        order = np.concatenate([chain, alone])
        start = np.zeros(len(pieces), np.int64)
        start[order] = np.cumsum(size[order]) - size[order]
        return size, _gathered(flat, start, size)

    def _stretch(self, raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of bytes cut at ``starts``, and how many each piece has."""
        offsets = np.append(starts, len(raw)).astype(np.int32)
        cut = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(raw)).dictionary_encode()
        found = pc.index_in(cut.dictionary, value_set=self.pieces)
        new = cut.dictionary.filter(found.is_null())
        size, flat = self._encoded(new)
        at = found.fill_null(-1).to_numpy().astype(np.int64)
        at[at < 0] = len(self.pieces) + np.arange(len(new))
        self.pieces = pa.concat_arrays([self.pieces, new])
        self.size, self.flat = np.concatenate([self.size, size]), np.concatenate([self.flat, flat])
        own, first = self.size[at], (np.cumsum(self.size) - self.size)[at]
        which = cut.indices.to_numpy()
        n = own[which]
        ids = _gathered(self.flat, first[which], n)
        if self.pieces.nbytes + self.size.nbytes + self.flat.nbytes > MEMORY:
            self.pieces, self.size, self.flat = cut.dictionary, own, _gathered(self.flat, first, own)
            if self.pieces.nbytes + self.size.nbytes + self.flat.nbytes > MEMORY:
                self._forget()
        return ids, n

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and for each text the place of its first one; at last their number."""
        if not self.cuts:
            found = [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts.fill_null("").to_pylist(), add_special_tokens=False)]
            return np.concatenate([np.zeros(0, self.dtype), *found]), np.cumsum([0, *map(len, found)])
        raw, at = _buffers(texts)
        if not len(raw):
            return np.zeros(0, self.dtype), np.zeros(len(at), np.int64)
        now, last = raw[1:], raw[:-1]
        cut = np.ones(len(raw), bool)
        cut[1:] = _BLANK[now] & (_SIGN[last] | (_END[last] & np.concatenate([[False], _BEFORE[raw[:-2]]])))
        if not any(t in raw.tobytes() for t in self.added):
            cut[1:] |= _OTHER[now] & _LETTER[last]
        cut[at[:-1][at[:-1] < len(raw)]] = True
        starts = np.flatnonzero(cut)
        out, sizes, low = [], [], 0
        while low < len(starts):
            high = max(low + 1, int(np.searchsorted(starts, starts[low] + STRETCH)))
            end = int(starts[high]) if high < len(starts) else len(raw)
            ids, n = self._stretch(raw[starts[low] : end], starts[low:high] - starts[low])
            out.append(ids)
            sizes.append(n)
            low = high
        before = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        return np.concatenate(out), before[np.searchsorted(starts, at)]


def _gathered(flat: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The runs of ``n`` numbers that start at ``first``, one after the other."""
    kind = np.int32 if max(len(flat), int(n.sum())) < 1 << 31 else np.int64
    return flat[np.repeat((first - (np.cumsum(n) - n)).astype(kind), n) + np.arange(int(n.sum()), dtype=kind)]


def ids_crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def bounded_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Hand at most so many texts at once to Python, where the session keeps Spark's default of 10 000:
    a batch is held by the executor and by its worker, each in full."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))


def _give_back() -> None:
    """Return freed memory to the system: a worker lives on, and waits for its next task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def small(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, so that few texts are held as Python objects at once."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)
    _give_back()


def by_bytes(batches: Iterator[pa.RecordBatch], column: int = 1, size: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``size`` bytes in the numbered text column, of whole rows."""
    for b in batches:
        _, at = _buffers(b.column(column))
        cuts = [0, *(np.flatnonzero(np.diff(at[:-1] // size)) + 1).tolist(), b.num_rows]
        for s, e in zip(cuts, cuts[1:]):
            if e > s:
                yield b.slice(s, e - s)
    _give_back()


@lru_cache(maxsize=1)
def _encoder(path: str) -> BatchEncoder:
    """The worker's encoder: what it remembers is bounded, so it may outlive a task and serve the next."""
    return BatchEncoder(path)


def encoded(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Of each batch ``(doc_id, text)``, in parts: the part, its ids with ``end_id`` after each text's, and
    the place of each text's first id, at last their number."""
    encode = _encoder(path)
    for b in by_bytes(batches, size=STRETCH):
        ids, at = encode(b.column(1))
        yield b, np.insert(ids, at[1:], end_id), at + np.arange(len(at))


def id_rows(path: str, end_id: int) -> Callable:
    """A ``mapInArrow`` function: ``(doc_id, ids as little-endian bytes)`` for each ``(doc_id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, ids, at in encoded(batches, path, end_id):
            offsets = pa.py_buffer((at * ids.itemsize).astype(np.int32))
            yield pa.record_batch([b.column(0), pa.BinaryArray.from_buffers(pa.binary(), b.num_rows, [None, offsets, pa.py_buffer(ids)])], ["doc_id", "ids"])

    return run
