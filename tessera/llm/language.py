"""Language identification by rank-order n-gram profiles."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.tokens import by_bytes
from tessera.plans.tables import materialise, read_table

#: N-grams in a profile, and most frequent n-grams of a document that are compared to it.
PROFILE, TOP = 1000, 300
#: N-grams that a task adds up before it hands them on.
HELD = 1 << 20
UNKNOWN = "und"
#: Stands before and after each word; no character has this number.
EDGE = 0x110000


@lru_cache(maxsize=1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point, whether it is a letter, and whether it is a letter or a mark on one."""
    kinds = [unicodedata.category(chr(c))[0] for c in range(EDGE)]
    return np.array([k == "L" for k in kinds]), np.array([k in "LM" for k in kinds])


class Words:
    """The words of a batch of texts, lower-cased runs of letters and their marks, and their n-grams.

    ``grams`` are the distinct 1-, 2- and 3-grams in ascending order, as numbers of three code points
    of 21 bits; a 3-gram has a letter in its middle, and edges of words count as a character. ``flat``
    holds the n-grams of each distinct word, by place in ``grams``: ``size`` of them from ``first`` on.
    ``word`` numbers the words of all texts in a row, text k's being those from ``at[k]`` to ``at[k + 1]``.
    """

    def __init__(self, texts: pa.Array) -> None:
        alpha, inside = _letters()
        low = [(t or "").lower() for t in texts.to_pylist()]
        codes = np.frombuffer("".join(low).encode("utf-32-le", "replace"), "<u4")
        ends = np.cumsum([0, *map(len, low)])
        self.has_letter = np.diff(np.concatenate([[0], np.cumsum(alpha[codes])])[ends]) > 0
        letter = inside[codes]
        starts = letter & ~np.concatenate([[False], letter[:-1]])
        starts[ends[:-1][ends[:-1] < len(codes)]] |= letter[ends[:-1][ends[:-1] < len(codes)]]
        self.at = np.concatenate([[0], np.cumsum(starts)])[ends]
        begin = np.flatnonzero(starts[letter])  # of each word, among letters alone
        raw = codes[letter].tobytes()
        offsets = (np.append(begin, letter.sum()) * 4).astype(np.int32)
        cut = pa.BinaryArray.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).dictionary_encode()
        self.word = cut.indices.to_numpy()
        n = np.diff(np.frombuffer(cut.dictionary.buffers()[1], np.int32, len(cut.dictionary) + 1)) // 4 if len(cut.dictionary) else np.zeros(0, np.int32)
        # the distinct words in a row, an edge before each and one at last
        x = np.insert(np.frombuffer(b"".join(cut.dictionary.to_pylist()), "<u4").astype(np.int64), np.cumsum(n) - n, EDGE)
        x = np.append(x, [EDGE, EDGE])
        one, two = x[1:-1], x[:-2] << 21 | x[1:-1]
        three = two << 21 | x[2:]
        keys = np.stack([one, two, three], 1)
        keys[one == EDGE, 0] = keys[one == EDGE, 2] = -1
        keys = keys.ravel()
        self.size = 3 * n.astype(np.int64) + 1
        coded = pa.array(keys[keys >= 0]).dictionary_encode() if len(n) else pa.array([], pa.int64()).dictionary_encode()
        found = coded.dictionary.to_numpy()
        order = np.argsort(found)
        self.grams, place = found[order], np.zeros(len(order), np.int32)
        place[order] = np.arange(len(order))
        self.flat, self.first = place[coded.indices.to_numpy()], np.cumsum(self.size) - self.size

    def of_text(self, k: int) -> np.ndarray:
        """The n-grams of text k, repeats included, by place in ``grams``."""
        own = self.word[self.at[k] : self.at[k + 1]]
        n = self.size[own]
        return self.flat[np.repeat(self.first[own] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]

    def counts(self, texts: np.ndarray) -> np.ndarray:
        """How often each n-gram occurs in the given texts together."""
        words = np.concatenate([np.zeros(0, np.int32), *(self.word[self.at[k] : self.at[k + 1]] for k in texts)])
        often = np.bincount(words, minlength=len(self.size))
        return np.bincount(self.flat, np.repeat(often, self.size), len(self.grams)).astype(np.int64)


def ranked(grams: np.ndarray, top: int, among: int) -> np.ndarray:
    """The ``top`` most frequent of numbers below ``among``, by count and then number."""
    if 8 * len(grams) < among:
        grams, n = np.unique(grams, return_counts=True)
    else:
        n = np.bincount(grams)
        grams = np.flatnonzero(n)
        n = n[grams]
    if len(grams) > top:
        least = np.partition(n, len(n) - top)[len(n) - top]
        keep = n >= least
        grams, n = grams[keep], n[keep]
    return grams[np.lexsort((grams, -n))][:top]


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        for lang, (grams, n) in total.items():
            for k in range(0, len(grams), 1 << 16):
                part = slice(k, k + (1 << 16))
                yield pa.record_batch([pa.array([lang] * len(grams[part]), pa.string()), pa.array(grams[part]), pa.array(n[part])], ["lang", "gram", "n"])
        total.clear()

    for b in by_bytes(batches, 0):
        x, langs = Words(b.column(0)), np.array(b.column(1).to_pylist(), object)
        for lang in sorted(set(langs)):
            n = x.counts(np.flatnonzero(langs == lang))
            used = np.flatnonzero(n)
            grams, n = x.grams[used], n[used]
            if lang in total:
                grams, place = np.unique(np.concatenate([total[lang][0], grams]), return_inverse=True)
                n = np.bincount(place, np.concatenate([total[lang][1], n])).astype(np.int64)
            total[lang] = grams, n
        if sum(len(g) for g, _ in total.values()) > HELD:
            yield from rows()
    yield from rows()


class Profiles:
    """The languages' names, and for each of their n-grams its rank in each language (``PROFILE`` if absent)."""

    def __init__(self, ranks: dict[str, list[int]]) -> None:
        self.names = sorted(ranks)
        self.grams = np.unique(np.array([g for r in ranks.values() for g in r], np.int64))
        self.rank = np.full((len(self.names), len(self.grams) + 1), PROFILE, np.int32)
        for i, name in enumerate(self.names):
            self.rank[i, np.searchsorted(self.grams, ranks[name])] = np.arange(len(ranks[name]))

    def predict(self, texts: pa.Array) -> list[tuple[str, float]]:
        """For each text the language of least out-of-place distance, and how far it is ahead of the
        next, 0 to 1."""
        x, out = Words(texts), []
        at = np.searchsorted(self.grams, x.grams)
        at[at == len(self.grams)] = 0
        known = np.where(self.grams[at] == x.grams, at, len(self.grams)) if len(self.grams) else np.zeros(len(x.grams), int)
        for k in range(len(texts)):
            if not self.names or not x.has_letter[k]:
                out.append((UNKNOWN, 0.0))
                continue
            rank = self.rank[:, known[ranked(x.of_text(k), TOP, len(x.grams))]]
            away = np.abs(rank - np.minimum(np.arange(rank.shape[1]), PROFILE - 1))
            away[rank == PROFILE] = PROFILE
            distance = away.sum(1) / (PROFILE * rank.shape[1])
            best = int(np.argmin(distance))
            rest = np.delete(distance, best)
            lead = 1 - distance[best] if not len(rest) else 1 - distance[best] / rest.min() if rest.min() > 0 else 0.0
            out.append((self.names[best], float(min(1.0, max(0.0, lead)))))
        return out


def learn_profiles(docs: DataFrame) -> Profiles:
    """Profiles of all rows of ``docs`` (text, lang) with a language, from whole texts.

    N-grams are of any script's letters, each counted by itself. Only ``PROFILE`` of them for each
    language reach the driver: their number doesn't grow with the corpus.
    """
    known = docs.where("lang is not null and text is not null").select("text", "lang")
    counts = known.mapInArrow(_gram_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    ranks: dict[str, list[int]] = {}
    for r in counts.withColumn("at", place).where(F.col("at") <= PROFILE).orderBy("lang", "at").collect():
        ranks.setdefault(r["lang"], []).append(r["gram"])
    return Profiles(ranks)


def _predictions(profiles: Profiles, text: int, kept: int) -> Callable:
    """The first ``kept`` columns of a batch, and what column ``text`` is taken for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_bytes(batches, text):
            names, scores = zip(*profiles.predict(part.column(text)))
            rest = [part.column(c) for c in range(kept)]
            yield pa.record_batch([*rest, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*part.schema.names[:kept], "lang_pred", "score"])

    return run


def _fields(df: DataFrame) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema)


def identify(docs: DataFrame, profiles: Profiles, keep: list[str]) -> DataFrame:
    """The columns ``keep``, then ``lang_pred`` and ``score`` (0 to 1), for each row of ``docs``.

    A null text and one without a letter are ``und`` with score 0; so is every text without profiles.
    A text of any length is read whole; repeated rows each give a row; equally near languages go by
    name with score 0; other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(*keep, F.col("text").alias("_text"))
    return rows.mapInArrow(_predictions(profiles, len(keep), len(keep)), f"{_fields(docs.select(*keep))}lang_pred string, score double")


def is_held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", is_held_out())
    profiles = learn_profiles(docs.where(~F.col("held_out")))
    return identify(docs, profiles, ["doc_id", "held_out"])


def least_score(judged: DataFrame) -> float:
    """The score under which calls of labelled documents are more often wrong than right, by the most.

    Wrong calls kept and right ones dropped are fewest together, so no run of mostly right calls is dropped
    for the wrong ones below. Each half of the texts has to show it by itself: a stray label drops nothing.
    ``judged`` has lang, lang_pred, score and half (0 or 1, alike for equal texts). Scores are counted in
    hundredths, from the lowest up.
    """
    own = judged.where(f"lang is not null and lang_pred != '{UNKNOWN}'")
    ahead = F.when(F.col("lang") == F.col("lang_pred"), -1).otherwise(1)
    halves = [F.sum(F.when(F.col("half") == h, ahead).otherwise(0)).alias(f"h{h}") for h in (0, 1)]
    steps = own.groupBy(F.floor(F.col("score") * 100).alias("step")).agg(*halves)
    least = first = second = most = 0
    for r in sorted(steps.collect(), key=lambda r: r["step"]):  # 101 rows at most
        first, second = first + r["h0"], second + r["h1"]
        if min(first, second) > 0 and first + second > most:
            most, least = first + second, r["step"] + 1
    return least / 100


def keep_known_languages(docs: DataFrame, least: float | None = 0.0) -> DataFrame:
    """``docs`` without the documents that identification rejects: no language, or too close a call.

    Profiles are learnt from all rows that have a language. A call is too close if its score is below
    ``least``: by default none is, so texts of two languages stay; None takes :func:`least_score` of the
    labelled documents, and a score of 0 is too close in any case: equally near languages, as for a text
    in a script that no language has. Null texts and texts without a letter go; without any label, no text
    with a letter does. Repeated rows share their fate; all columns are kept; an empty table stays empty.
    """
    profiles = learn_profiles(docs)
    if not profiles.names:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    rows = docs.select([F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    text, lang = docs.columns.index("text"), f"c{docs.columns.index('lang')}"
    judged = rows.mapInArrow(_predictions(profiles, text, len(docs.columns)), f"{_fields(rows)}lang_pred string, score double")
    if least is None:
        judged = materialise(judged.withColumn("half", F.crc32(f"c{text}") % 2), "languages")
        least = least_score(judged.select(F.col(lang).alias("lang"), "lang_pred", "score", "half"))
        judged = judged.where("score > 0")
    kept = judged.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    return kept.select([F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
