import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tessera.llm import alignment
from tessera.llm.alignment import Aligner, PerfectHash, align, count_pairs, most_pairs, op13_token_alignment
from tessera.llm.tokens import public_vocabulary

A, B = public_vocabulary("byte_bpe_50k.json"), public_vocabulary("piece_bpe_32k.model")


def byte_of():
    """Bytes behind byte-level characters, by the rule of their authors' paper."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = iter(range(256, 512))
    return {chr(b) if b in shown else chr(next(others)): b for b in range(256)}


class Plain:
    """Whole texts by the libraries themselves, byte by byte."""

    def __init__(self):
        self.a = Tokenizer.from_file(A)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=B)
        self.back = byte_of()

    def bytes_b(self, i):
        p = self.b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()

    def groups(self, text):
        """[(A ids, B ids)], empty without tokens."""
        if not text:
            return []
        want = (" " + text).encode()
        x = self.a.encode(" " + text, add_special_tokens=False).ids
        y = self.b.encode(text)
        bx = [bytes(self.back[c] for c in self.a.id_to_token(i)) for i in x]
        by = [self.bytes_b(i) for i in y]
        if b"".join(bx) != want or b"".join(by) != want:
            return []
        out, i, j, at, to = [([], [])], 0, 0, 0, 0
        while i < len(x) or j < len(y):
            if at <= to and i < len(x):
                at += len(bx[i])
                out[-1][0].append(x[i])
                i += 1
            else:
                to += len(by[j])
                out[-1][1].append(y[j])
                j += 1
            if at == to and out[-1][1]:
                out.append(([], []))
        return out[:-1]


def plain_rows(docs):
    p = Plain()
    found = [(d, p.groups(t)) for d, t in docs]
    counts = Counter((g[0][-1], g[1][-1]) for _, gs in found for g in gs)
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    rows = []
    for d, gs in found:
        links = [(g[0][-1], g[1][-1]) for g in gs]
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in gs)
        sums = (sum(len(g[0]) for g in gs), sum(len(g[1]) for g in gs), len(gs), len(links), sum(counts[k] == best[k[1]] for k in links), sum(counts[k] for k in links))
        rows.append((d, *sums, hashlib.sha256(text.encode()).hexdigest() if gs else "", text))
    return rows, counts


SIGNS = [" ", "  ", "\t", "\n", "\n\n", "\r\n", "\xa0", "\x85", " ", "　", "​", "﻿", "\x1c", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x0A>", "a", "bc", "é", "ß", "日", "本", "▁"]
SIGNS += ["'s", "don't", "12", "3", "!", "?", "...", "—", "\0", "\U0001f642", "xxxxx", " word", " The", ",", " ,", "(", " a", "a ", "ا", "́", "A1b2"]


@pytest.mark.parametrize("memory", [64 << 20, 2000])
def test_aligner_equals_whole_texts(memory, monkeypatch):
    monkeypatch.setattr(alignment, "MEMORY", memory)
    monkeypatch.setattr(alignment, "CHAIN", 50)
    rnd, p = random.Random(4), Plain()
    texts = ["x" * 5000, "word " * 3000, "ends é", " ", "   ", "é" * 300, "日本" * 200, "a▁b", "▁", "tab\tand\n\n new "]
    texts += ["".join(rnd.choice(SIGNS) for _ in range(rnd.randint(1, 14))) for _ in range(6000)]
    al = Aligner(A, B)
    assert al.cuts
    for part in (texts, texts[:50], []):
        own, which, first = al(pa.array([" " + t for t in part], pa.string()))
        names = own.groups.to_pylist()
        starts = np.cumsum(own.n_links) - own.n_links
        for k, t in enumerate(part):
            want = p.groups(t)
            use = which[first[k] : first[k + 1]]
            assert ";".join(names[i] for i in use) == ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in want), t
            assert [int(x) for i in use for x in own.pairs[starts[i] : starts[i] + own.n_links[i]]] == [x[-1] << 32 | y[-1] for x, y in want]
            assert (own.n_a[use].sum(), own.n_b[use].sum()) == (sum(len(x) for x, _ in want), sum(len(y) for _, y in want))


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 100_000])
def test_perfect_hash(n):
    rnd = np.random.default_rng(n)
    keys = np.unique(rnd.integers(0, 1 << 48, n))
    h = PerfectHash(keys)
    assert np.array_equal(np.sort(h(keys)), np.arange(len(keys)))
    other = np.setdiff1d(rnd.integers(0, 1 << 48, 1000), keys)
    assert (h(other) == -1).all()


def test_vocabularies_bound_the_pairs():
    p = Plain()
    bound = most_pairs(A, B)
    assert bound < 400_000
    seen = {(g[0][-1], g[1][-1]) for t in ["".join(x) for x in zip(*[iter(SIGNS)] * 3)] for g in p.groups(t)}
    names = [bytes(p.back[c] for c in p.a.id_to_token(i)) for i, _ in seen]
    assert all(x.endswith(y) or y.endswith(x) for x, y in zip(names, [p.bytes_b(j) for _, j in seen]))


def odd_documents():
    rows = [(1, "one two three"), (2, None), (3, ""), (4, "word " * 3000), (1, "one two three"), (None, "lost id"), (5, "é" * 500), (6, "a▁b"), (7, "<|endoftext|> plain <s>"), (8, "copied text, with ties.")]
    return rows + [(9, "copied text, with ties.")] * 30 + [(100 + k, f"naïve Wörter {k} über\t alles\n\n") for k in range(40)]


def test_align_on_odd_rows(spark):
    rows = odd_documents()
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, n_a string, groups long").repartition(5)
    table = count_pairs(docs)
    got = align(docs, table, groups=True).collect()
    want, counts = plain_rows(rows)
    assert Counter(tuple(r) for r in got) == Counter(want)
    assert {(int(k) >> 32, int(k) & 0xFFFFFFFF): int(n) for k, n in zip(table.hash.keys, table.n)} == counts
    assert len(table.hash) <= most_pairs(A, B)


def test_unknown_pairs_count_nothing(spark):
    docs = spark.createDataFrame([(1, "one two")], "doc_id long, text string")
    table = count_pairs(docs)
    (row,) = align(spark.createDataFrame([(2, "one zebra")], "doc_id long, text string"), table).collect()
    assert row["n_links"] > row["n_best"] == row["count_sum"] == 1


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    table = count_pairs(docs)
    assert len(table.hash) == 0 and align(docs, table).count() == 0


def test_query_equals_whole_texts(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want, _ = plain_rows(docs)
    assert Counter(tuple(r) for r in op13_token_alignment(spark, sf).collect()) == Counter(w[:-1] for w in want)
