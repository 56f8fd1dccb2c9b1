"""Secrets in texts: fixed patterns, and formats learnt as probabilistic automata."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.tokens import by_bytes
from tessera.plans.tables import drop_files, materialise, read_table

#: The contract's kinds and patterns, in its order. ``learnt`` are the method's own.
KINDS = ("assign", "access", "hex", "learnt")
WORDS = ("passw", "secret", "token", "api")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Shortest candidate: as short as a labelled credential can be.
SHORTEST = 6
#: Probability that an added span must have, and share of decoys that added spans may have.
SURE, DECOYS = 0.9, 0.01

# Characters of candidates, as bits: what a run of them holds tells which letters its format uses.
_BITS = np.zeros(256, np.uint8)
for _bit, _chars in ((1, b"abcdef"), (2, b"ghijklmnopqrstuvwxyz"), (4, b"ABCDEF"), (8, b"GHIJKLMNOPQRSTUVWXYZ"), (16, b"0123456789"), (32, b"+/")):
    _BITS[list(_chars)] = _bit
_BREAKS = b"_=-."  # signs that stand for themselves and end a run
_BITS[list(_BREAKS)] = 64
_INSIDE = _BITS > 0
_INSIDE[ord(".")] = False  # only inside credentials after a name, not inside other candidates
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True
_DIGIT = _BITS == 16


def _symbols() -> tuple[np.ndarray, np.ndarray]:
    """For each set of bits of a run, the symbol of its characters; for each symbol, how many
    characters it stands for."""
    letters = [0, 10, 16, 36, 16, 36, 26, 36, 52, 62]  # by symbol: digits alone, hex, ..., letters of both cases, all
    table = np.zeros(64, np.int64)
    for bits in range(64):
        low, up, hexes, digit = bits & 3, bits & 12, not bits & 10, bits & 16
        if not low and not up:
            table[bits] = 1
        elif low and up:
            table[bits] = 9 if digit else 8
        elif low:
            table[bits] = (2 if hexes else 3) if digit else 6
        else:
            table[bits] = (4 if hexes else 5) if digit else 7
    letters[6] = letters[7] = 26
    width = np.ones(10 + len(_BREAKS) + 1)
    width[:10] = np.maximum(letters, 1)
    return table, width


_TABLE, WIDTH = _symbols()
#: Number of symbols; the one after them stands for the start and the end of a string.
END = len(WIDTH) - 1
_SIGN = np.zeros(256, np.int64)
_SIGN[list(_BREAKS)] = 10 + np.arange(len(_BREAKS))


def symbols(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The automata's symbols of strings in a row that start at ``starts``: one a character, by the kind
    of letters and digits that its run, between signs, holds."""
    bits = _BITS[raw]
    sign = bits == 64
    first = np.zeros(len(raw), bool)
    first[starts] = True
    first |= sign
    first[1:] |= sign[:-1]
    begin = np.flatnonzero(first)
    held = np.bitwise_or.reduceat(bits, begin) if len(begin) else bits
    return np.where(sign, _SIGN[raw], _TABLE[np.repeat(held & 63, np.diff(np.append(begin, len(raw))))])


@dataclass
class State:
    """Of a prefix tree or automaton: how often strings pass and end here, and where each symbol leads."""

    passes: int = 0
    ends: int = 0
    counts: dict[int, int] = field(default_factory=dict)
    to: dict[int, int] = field(default_factory=dict)


class Automaton:
    """A deterministic probabilistic automaton, by merging the compatible states of a prefix tree.

    ``times`` tells how often each string occurs. ``_run`` of a state of the tree is how many steps on there
    is but one symbol, ``_first``, and no end; it is 0 where another symbol or an end may come first, and
    where a fold has changed what follows. ``_clean`` states can't go on by that symbol after these steps.
    """

    def __init__(self, strings: list[list[int]], alpha: float = 0.5, times: list[int] | None = None) -> None:
        self.states, self.alpha, self._parent = [State()], alpha, [-1]
        for s, n in zip(strings, times or [1] * len(strings)):
            at = 0
            for c in s:
                state = self.states[at]
                state.passes += n
                state.counts[c] = state.counts.get(c, 0) + n
                if c not in state.to:
                    state.to[c] = len(self.states)
                    self.states.append(State())
                    self._parent.append(at)
                at = state.to[c]
            self.states[at].passes += n
            self.states[at].ends += n
        self._measure()
        self._merge_all()

    def _measure(self) -> None:
        n = len(self.states)
        self._run, self._first, self._clean = np.zeros(n, np.int64), np.full(n, -1), np.zeros(n, bool)
        self._passes = np.array([max(1, s.passes) for s in self.states], np.float64)
        for i in range(n - 1, -1, -1):  # states come after those that lead to them
            s = self.states[i]
            if len(s.to) == 1 and not s.ends:
                (c, t), = s.to.items()
                on = self._first[t] == c
                self._first[i], self._run[i] = c, 1 + (self._run[t] if on else 0)
                self._clean[i] = self._clean[t] if on else c not in self.states[t].to

    def _changed(self, t: int) -> None:
        """Runs through a state that a fold changes, or whose way does, are known no more."""
        far = 0
        while t >= 0 and (not far or self._run[t] >= far):
            self._run[t] = 0
            t, far = self._parent[t], far + 1

    def _may_fit(self, settled: np.ndarray, b: int) -> np.ndarray:
        """Settled states without those that differ from b for sure: their runs are of other symbols, or one
        ends before the other does."""
        if not self._run[b]:
            return settled
        run, other = self._run[settled], self._first[settled] != self._first[b]
        shorter = np.where(run < self._run[b], self._clean[settled], self._clean[b]) & (run != self._run[b])
        bound = math.sqrt(0.5 * math.log(2 / self.alpha)) * (1 / np.sqrt(self._passes[settled]) + 1 / np.sqrt(self._passes[b]))
        return settled[~((run > 0) & (other | shorter) & (bound < 1))]

    def _differ(self, f: int, n: int, g: int, m: int) -> bool:
        """Whether two observed frequencies differ by more than their Hoeffding bound."""
        if not n or not m:
            return False
        bound = math.sqrt(0.5 * math.log(2 / self.alpha)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))
        return abs(f / n - g / m) > bound

    def _compatible(self, a: int, b: int) -> bool:
        pairs = [(a, b)]
        while pairs:
            a, b = pairs.pop()
            x, y = self.states[a], self.states[b]
            if self._differ(x.ends, x.passes, y.ends, y.passes):
                return False
            for c in x.counts.keys() | y.counts.keys():
                if self._differ(x.counts.get(c, 0), x.passes, y.counts.get(c, 0), y.passes):
                    return False
                if c in x.to and c in y.to and x.to[c] != y.to[c]:
                    pairs.append((x.to[c], y.to[c]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the tree under b to state a."""
        pairs = [(a, b)]
        while pairs:
            a, b = pairs.pop()
            x, y = self.states[a], self.states[b]
            self._changed(a)
            x.passes += y.passes
            x.ends += y.ends
            for c, n in y.counts.items():
                x.counts[c] = x.counts.get(c, 0) + n
                if c in x.to:
                    pairs.append((x.to[c], y.to[c]))
                else:
                    x.to[c] = y.to[c]

    def _merge_all(self) -> None:
        """Settled states stay; the states they lead to, in the order of the tree, are folded into the
        first compatible settled one, or settle."""
        settled, inside, at = [0], {0}, 0
        array = np.zeros(len(self.states), np.int64)
        while at < len(settled):
            open_ = [c for c in sorted(self.states[settled[at]].to) if self.states[settled[at]].to[c] not in inside]
            if not open_:
                at += 1
                continue
            b = self.states[settled[at]].to[open_[0]]
            for a in self._may_fit(array[: len(settled)], b).tolist():
                if self._compatible(a, b):
                    self._changed(settled[at])
                    self.states[settled[at]].to[open_[0]] = a
                    self._fold(a, b)
                    at = 0  # a fold may open steps of states before
                    break
            else:
                array[len(settled)] = b
                settled.append(b)
                inside.add(b)
        number = {s: i for i, s in enumerate(settled)}
        self.states = [self.states[s] for s in settled]
        for s in self.states:
            s.to = {c: number[t] for c, t in s.to.items()}

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """For each state and symbol (``END``: the string ends), its log-probability and the next state.

        One more state, where strings that left the format are, takes all symbols for equally likely.
        """
        n, away = END + 1, len(self.states)
        logs, to = np.full((away + 1, n), -math.log(n)), np.full((away + 1, n), away)
        for i, s in enumerate(self.states):
            count = np.full(n, 0.05)
            for c, k in s.counts.items():
                count[c] += k
                to[i, c] = s.to[c]
            count[END] += s.ends
            logs[i] = np.log(count / count.sum())
        return logs, to


@dataclass
class Formats:
    """Tables of an automaton for each labelled kind with the log-likelihood ratio that it asks for, the
    background's log-probabilities of a symbol after another, and the least lead of an added span."""

    automata: list[tuple[np.ndarray, np.ndarray, float]]
    background: np.ndarray
    least: float

    def leads(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """For each string, by how much the log-likelihood ratio of a format to the background exceeds
        what the format asks for; that of the best format.

        All strings take a step at once; a symbol stands for as many characters in both, so these cancel.
        """
        return self.leads_of(symbols(raw, offsets[:-1]) if len(raw) else np.zeros(0, np.int64), offsets)

    def leads_of(self, x: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The same, of the strings' symbols."""
        n = np.diff(offsets)
        if not self.automata or not len(n):
            return np.full(len(n), -math.inf)
        before = np.concatenate([[END], x[:-1]])
        before[offsets[:-1]] = END
        plain = np.add.reduceat(self.background[before, x], offsets[:-1]) + self.background[x[offsets[1:] - 1], END]
        order = np.argsort(-n, kind="stable")
        alive = np.searchsorted(-n[order], -np.arange(int(n.max())), side="left")
        best = np.full(len(n), -math.inf)
        for logs, to, asked in self.automata:
            state, total, start = np.zeros(len(n), np.int64), np.zeros(len(n)), offsets[:-1][order]
            for step, k in enumerate(alive.tolist()):
                if k < 4:  # few long strings are followed one by one
                    break
                c = x[start[:k] + step]
                total[:k] += logs[state[:k], c]
                state[:k] = to[state[:k], c]
            else:
                step = len(alive)
            for i in range(int(np.searchsorted(-n[order], -step, side="left")) if step < len(alive) else 0):
                at, sum_ = int(state[i]), float(total[i])
                for c in x[start[i] + step : start[i] + n[order[i]]].tolist():
                    sum_ += logs[at, c]
                    at = int(to[at, c])
                state[i], total[i] = at, sum_
            best[order] = np.maximum(best[order], total + logs[state, END] - plain[order] - asked)
        return best


class Scan:
    """Of a batch of texts: the base spans of each, and the candidates that overlap none of them.

    ``spans[k]`` are ``(kind, start, end)`` of text k in code points. Candidates are distinct strings,
    ``raw`` cut at ``offsets``; number ``which[j]`` stands in text ``doc[j]`` at bytes ``begin[j]`` on.
    """

    def __init__(self, texts: pa.Array) -> None:
        self.texts = [t or "" for t in texts.to_pylist()]
        coded = [t.encode() for t in self.texts]
        self.starts = np.cumsum([0, *(len(c) + 1 for c in coded)])
        raw = np.frombuffer(b"\n".join([*coded, b""]), np.uint8)
        self.spans, covered, self._places = [], np.zeros(len(raw) + 1, bool), {}
        hexes = _runs(_HEX[raw], 24)
        owner = np.searchsorted(self.starts, hexes[0], side="right") - 1
        by_text: dict[int, list[tuple[int, int]]] = {}
        for d, s, e in zip(owner.tolist(), (hexes[0] - self.starts[owner]).tolist(), (hexes[1] - self.starts[owner]).tolist()):
            by_text.setdefault(d, []).append((s, e))
        for d, text in enumerate(self.texts):
            spans, low = [], text.lower()
            if any(w in low for w in WORDS):
                spans += [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
            if "AKIA" in text:
                spans += [(1, m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
            for s, e in by_text.get(d, ()):
                first = self._character(d, s)
                spans.append((2, first, first + e - s))
            spans.sort(key=lambda x: (x[1], x[0]))
            for _, s, e in spans:
                covered[self.starts[d] + self._byte(d, s) : self.starts[d] + self._byte(d, e)] = True
            self.spans.append(spans)
        begin, end = _runs(_INSIDE[raw], SHORTEST)
        if covered.any():
            before = np.concatenate([[0], np.cumsum(covered)])
            free = before[end] == before[begin]
            begin, end = begin[free], end[free]
        keep = np.zeros(len(raw) + 1, np.int8)
        keep[begin], keep[end] = 1, -1
        held = raw[np.cumsum(keep[:-1]) > 0]
        offsets = np.concatenate([[0], np.cumsum(end - begin)]).astype(np.int32)
        cut = pa.BinaryArray.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(held)]).dictionary_encode()
        self.which, self.begin, self.end = cut.indices.to_numpy(), begin, end
        self.doc = np.searchsorted(self.starts, begin, side="right") - 1
        n = len(cut.dictionary)
        self.offsets = np.frombuffer(cut.dictionary.buffers()[1], np.int32, n + 1).astype(np.int64) if n else np.zeros(1, np.int64)
        self.raw = np.frombuffer(cut.dictionary.buffers()[2], np.uint8, self.offsets[-1]) if n else raw[:0]

    def _bytes_before(self, d: int) -> np.ndarray | None:
        """The byte at which each character of a text starts; none if they are all of one byte."""
        if d not in self._places:
            self._places[d] = None
            if not self.texts[d].isascii():
                code = np.frombuffer(self.texts[d].encode("utf-32-le"), "<u4")
                self._places[d] = np.concatenate([[0], np.cumsum(1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000))])
        return self._places[d]

    def _byte(self, d: int, character: int) -> int:
        before = self._bytes_before(d)
        return character if before is None else int(before[character])

    def _character(self, d: int, byte: int) -> int:
        before = self._bytes_before(d)
        return byte if before is None else int(np.searchsorted(before, byte))

    def value(self, d: int, kind: int, start: int, end: int) -> str:
        """The credential in a base span."""
        return ASSIGN.match(self.texts[d], start)[2] if kind == 0 else self.texts[d][start:end]

    def likely(self, formats: Formats) -> list[list[tuple[int, int, float, bool]]]:
        """For each text its candidates of at least ``formats.least``: start, end, lead, has a digit."""
        leads = formats.leads(self.raw, self.offsets)
        out: list[list[tuple[int, int, float, bool]]] = [[] for _ in self.texts]
        for j in np.flatnonzero(leads[self.which] >= formats.least).tolist():
            d, w = int(self.doc[j]), int(self.which[j])
            s = self._character(d, int(self.begin[j] - self.starts[d]))
            digit = bool(_DIGIT[self.raw[self.offsets[w] : self.offsets[w + 1]]].any())
            out[d].append((s, s + int(self.end[j] - self.begin[j]), float(leads[w]), digit))
        return out


def _runs(inside: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values that are at least so long."""
    edge = np.diff(inside.view(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = end - start >= least
    return start[long], end[long]


def _evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Credentials of base spans, and how often a symbol of a candidate follows another."""
    after = np.zeros((END + 1) ** 2, np.int64)
    names = ["kind", "value", "pair", "n"]
    for b in by_bytes(batches, 0, 2_000_000):
        x = Scan(b.column(0))
        values: dict[tuple[int, str], int] = {}
        for d, spans in enumerate(x.spans):
            for k, s, e in spans:
                key = k, x.value(d, k, s, e)
                values[key] = values.get(key, 0) + 1
        if values:
            kind, value = zip(*values)
            yield pa.record_batch([pa.array(kind, pa.int32()), pa.array(value), pa.nulls(len(kind), pa.int32()), pa.array(values.values(), pa.int64())], names)
        if len(x.raw):
            often = np.bincount(x.which, minlength=len(x.offsets) - 1)
            n = np.diff(x.offsets)
            s = symbols(x.raw, x.offsets[:-1])
            before = np.concatenate([[END], s[:-1]])
            before[x.offsets[:-1]] = END
            pairs = np.concatenate([before * (END + 1) + s, s[x.offsets[1:] - 1] * (END + 1) + END])
            after += np.bincount(pairs, np.concatenate([np.repeat(often, n), often]), len(after)).astype(np.int64)
    used = np.flatnonzero(after)
    yield pa.record_batch([pa.nulls(len(used), pa.int32()), pa.nulls(len(used), pa.string()), pa.array(used, pa.int32()), pa.array(after[used])], names)


def _shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The symbols of credentials, a byte each; how many credentials have them, how often these occur."""
    for b in batches:
        shapes: dict[tuple[int, bytes], list[int]] = {}
        for kind, value, n in zip(*(c.to_pylist() for c in b.columns)):
            shape = symbols(np.frombuffer(value.encode(), np.uint8), np.zeros(1, np.int64)).astype(np.uint8).tobytes()
            of = shapes.setdefault((kind, shape), [0, 0])
            of[0] += 1
            of[1] += n
        if shapes:
            kind, shape = zip(*shapes)
            values, n = zip(*shapes.values())
            yield pa.record_batch([pa.array(kind, pa.int32()), pa.array(shape, pa.binary()), pa.array(values, pa.int64()), pa.array(n, pa.int64())], ["kind", "shape", "times", "n"])


def learn_formats(docs: DataFrame) -> Formats:
    """Automata of the labelled kinds, from distinct credentials, and the background of all candidates.

    ``docs`` has a column text. A labelled kind is learnt from all its credentials, however few, many or
    long: automata read symbols alone, so distinct sequences of symbols with how many credentials have each
    are all that the driver gets. The background counts every candidate of all texts that
    is in no base span. As it holds secrets too that no pattern knows, a string's chance g of being
    labelled, which follows from how many labelled credentials there are for a candidate, is measured
    by the mean chance c of the kind's credentials: g / c must be ``SURE`` (positive and unlabelled data).
    """
    found = docs.select("text").mapInArrow(_evidence, "kind int, value string, pair int, n long")
    found = materialise(found.groupBy("kind", "value", "pair").agg(F.sum("n").alias("n")), "evidence")
    counts = np.zeros((END + 1, END + 1))
    for r in found.where("pair is not null").select("pair", "n").collect():  # (END + 1)**2 rows at most
        counts[divmod(r["pair"], END + 1)] = r["n"]
    background = np.log((counts + 0.5) / (counts + 0.5).sum(1, keepdims=True))
    own = found.where("kind is not null").select("kind", "value", "n").mapInArrow(_shapes, "kind int, shape binary, times long, n long")
    own = own.groupBy("kind", "shape").agg(F.sum("times").alias("times"), F.sum("n").alias("n")).toArrow().sort_by([("kind", "ascending"), ("shape", "ascending")])
    automata = []
    for kind in range(3):
        part = own.filter(pa.compute.equal(own["kind"], kind))
        if part.num_rows:
            shapes, times = part["shape"].to_pylist(), part["times"].to_pylist()
            x, offsets = np.frombuffer(b"".join(shapes), np.uint8).astype(np.int64), np.cumsum([0, *map(len, shapes)])
            logs, to = Automaton([list(s) for s in shapes], times=times).tables()
            prior = math.log(max(1.0, counts[END].sum()) / sum(part["n"].to_pylist()))
            chance = 1 / (1 + np.exp(prior - Formats([(logs, to, 0.0)], background, 0.0).leads_of(x, offsets)))
            bar = SURE * float(np.average(chance, weights=times))
            automata.append((logs, to, prior + math.log(bar / (1 - bar))))
    drop_files(found)
    return Formats(automata, background, 0.0)


def least_lead(likely: DataFrame, least: float) -> float:
    """The lowest lead, from ``least`` up, at which decoys are at most a share ``DECOYS`` of added spans.

    ``likely`` has lead and digit of all candidates of at least ``least``, over all texts. Candidates
    without a digit are ordinary words but for few, so they stand for what is added by mistake.
    Infinite if there is no such lead.
    """
    step = F.floor((F.col("lead") - least) * 2).cast("long").alias("step")
    digit = F.sum(F.col("digit").cast("long")).alias("digit")
    n = decoys = 0
    lowest = math.inf
    bins = likely.groupBy(F.least(step, F.lit(2000)).alias("step")).agg(F.count("*").alias("n"), digit)
    for r in sorted(bins.collect(), key=lambda r: -r["step"]):  # 2001 rows at most
        n, decoys = n + r["digit"], decoys + r["n"] - r["digit"]
        if n and decoys <= DECOYS * n:
            lowest = least + r["step"] / 2
    return lowest


SPANS_SQL = "doc_id long, base array<struct<kind: int, start: long, end: long>>, likely array<struct<start: long, end: long, lead: double, digit: boolean>>"
_BASE = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))
_LIKELY = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lead", pa.float64()), ("digit", pa.bool_())]))


def _spans(formats: Formats) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, 1, 2_000_000):
            x = Scan(b.column(1))
            base = [[dict(zip(("kind", "start", "end"), s)) for s in spans] for spans in x.spans]
            likely = [[dict(zip(("start", "end", "lead", "digit"), s)) for s in spans] for spans in x.likely(formats)]
            yield pa.record_batch([b.column(0), pa.array(base, _BASE), pa.array(likely, _LIKELY)], ["doc_id", "base", "likely"])

    return run


def secret_spans(docs: DataFrame) -> DataFrame:
    """``(doc_id, base, added)`` for each row of ``(doc_id, text)``: arrays of (kind, start, end) and of
    (start, end).

    Spans count code points, end exclusive. Base spans follow the fixed patterns. Candidates are all
    other runs of ``SHORTEST`` or more letters, digits and signs of base64 and of tokens that overlap no
    base span; each is scored, and added if some format is likelier than the background by the least
    lead (see :func:`learn_formats` and :func:`least_lead`). A null or empty text has no spans; a text of
    any length is read whole; without any labelled credential none is added; repeated rows each give a
    row; other columns are ignored; an empty table gives no rows.

    Texts are read twice: for evidence of formats, then for spans, which are written, far smaller.
    """
    formats = learn_formats(docs)
    found = materialise(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_spans(formats), SPANS_SQL), "spans")
    lowest = least_lead(found.select(F.explode("likely").alias("s")).select("s.lead", "s.digit"), formats.least)
    good = F.filter("likely", lambda s: s["lead"] >= lowest)
    return found.select("doc_id", "base", F.transform(good, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("added"))


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for doc_id, base, added in zip(*(c.to_pylist() for c in b.columns)):
            base = [(KINDS[s["kind"]], s["start"], s["end"]) for s in base]
            every = sorted(base + [(KINDS[3], s["start"], s["end"]) for s in added], key=lambda x: (x[1], KINDS.index(x[0])))
            texts = [",".join(f"{k}:{s}:{e}" for k, s, e in spans) for spans in (base, every)]
            out.append((doc_id, *(sum(k == kind for k, _, _ in base) for kind in KINDS[:3]), hashlib.sha256(texts[0].encode()).hexdigest(), texts[1]))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 6, kinds)], names)


def find_secrets(docs: DataFrame) -> DataFrame:
    """A row for each row of ``(doc_id, text)``: base counts and digest, and all spans, as text; those of
    :func:`secret_spans`, added ones as ``learnt``."""
    return secret_spans(docs).mapInArrow(_listed, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(read_table(spark, sf_dir, "documents"))


def redact_secrets(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span of :func:`secret_spans` replaced by ``mark``, and ``n_chars``, where the
    table has it, counted anew where the text changed.

    Each row is judged by its own text: null and empty texts stay as they are, repeated rows are alike,
    overlapping spans are replaced as one, all columns are kept whatever their names and types, and an
    empty table stays empty.
    """
    formats = learn_formats(docs)
    found = docs.select(F.lit(0).cast("long").alias("doc_id"), "text").mapInArrow(_spans(formats), SPANS_SQL)
    found = materialise(found.where(F.size("likely") > 0).select(F.explode("likely").alias("s")).select("s.lead", "s.digit"), "leads")
    formats.least = least_lead(found, formats.least)
    drop_files(found)

    at_text = docs.columns.index("text")

    def clean(text: str, spans: list[tuple[int, int]]) -> str:
        parts, at = [], 0
        for s, e in sorted(spans):
            if s >= at:
                parts += [text[at:s], mark]
            at = max(at, e)
        return "".join([*parts, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, at_text, 2_000_000):
            x, old = Scan(b.column(at_text)), b.column(at_text).to_pylist()
            spans = [[(s, e) for _, s, e in base] + [s[:2] for s in added] for base, added in zip(x.spans, x.likely(formats))]
            new = [clean(t, s) if s else t for t, s in zip(old, spans)]
            names, columns = b.schema.names, list(b.columns)
            columns[at_text] = pa.array(new, b.column(at_text).type)
            if "n_chars" in names:
                at = names.index("n_chars")
                n = columns[at].to_pylist()
                columns[at] = pa.array([o if t == u else len(u) for o, t, u in zip(n, old, new)], columns[at].type)
            yield pa.record_batch(columns, names)

    return docs.mapInArrow(run, docs.schema)
