import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tessera.llm import tokens
from tessera.llm.packing import best_fit_decreasing, pack
from tessera.llm.tokens import BatchEncoder, public_vocabulary


def plain_best_fit(lengths, window):
    """Piece by piece, with a plain search for the tightest bin."""
    bins = []
    for x in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(bins) if r >= x]
        if fits:
            i = min(fits, key=lambda i: bins[i])
            bins[i] -= x
        else:
            bins.append(window - x)
    return sorted(bins)


@pytest.mark.parametrize("seed", range(8))
def test_runs_equal_piecewise_best_fit(seed):
    rnd = random.Random(seed)
    window = rnd.choice([8, 31, 64])
    lengths = [rnd.randint(1, window) for _ in range(rnd.randint(1, 300))]
    counts = {x: lengths.count(x) for x in set(lengths)}
    plan, used = best_fit_decreasing(counts, window)
    filled = {}
    for length, runs in plan.items():
        assert runs[0][0] == 0 and runs[-1][1] == counts[length]
        for low, high, first, each, base in runs:
            for k in range(high - low):
                filled.setdefault(first + k // each, []).append((base + k % each * length, length))
    assert len(filled) == used
    for spans in filled.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= window
    assert sorted(window - sum(n for _, n in s) for s in filled.values()) == plain_best_fit(lengths, window)


SIGNS = [" ", "  ", "\t", "\n", "\n\n", "\r", "\r\n", "\xa0", "\x85", "\u2009", "\u3000", "\u200b", "\u180e", "\ufeff", "\x1c", "\x0b", "\x0c", "<|endoftext|>", "<|endof", "text|>", "a", "b", "é", "日", "本"]
SIGNS += ["'s", "'t", "don't", "12", "3", "!", "?", "...", "\u2014", "\0", "\U0001f642", "xxxxx", " ", " ", " ", "\u0627", "\u0100", "©", "ñ", "\u0301"]


@pytest.mark.parametrize("memory", [6 << 20, 1000])
def test_encoder_equals_the_tokenizer(memory, monkeypatch):
    monkeypatch.setattr(tokens, "MEMORY", memory)
    monkeypatch.setattr(tokens, "STRETCH", 5000)
    t = Tokenizer.from_file(public_vocabulary())
    e = BatchEncoder(public_vocabulary())
    rnd = random.Random(3)
    texts = ["", None, "a\tb\tc\n\n", "x\ty\tz\n\n q", "name\tage\tcity\n\n\nBob", "中\n\xa0", "é" * 40 + " \U0001f600 a", "word " * 5000, "w" * 20000]
    texts += ["".join(rnd.choice(SIGNS) for _ in range(rnd.randint(0, 14))) for _ in range(20000)]
    for part in (texts, [x for x in texts if "<|endoftext|>" not in (x or "")], texts[:0], [None, ""]):
        ids, at = e(pa.array(part, pa.string()))
        for i, want in enumerate(t.encode_batch_fast([x or "" for x in part], add_special_tokens=False)):
            assert ids[at[i] : at[i + 1]].tolist() == want.ids, part[i]


def test_pack_places_every_id_once(spark):
    rows = [(1, "one two three", "x"), (2, None, "x"), (3, "", "x"), (4, "word " * 300, "x"), (1, "one two three", "x"), (None, "lost id", "x"), (5, "é" * 500, "x")]
    rows += [(100 + k, "same text here", "x") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string")
    got = pack(docs, window=64).collect()
    t = Tokenizer.from_file(public_vocabulary())
    want = sorted(len(t.encode(r[1] or "").ids) + 1 for r in rows)
    assert sorted(r["doc_tokens"] for r in got if r["start"] == 0) == want
    assert sum(r["length"] for r in got) == sum(want)
    by = {}
    for r in got:
        ids = np.frombuffer(r["ids"], "<u2")
        assert len(ids) == r["length"] and zlib.crc32(ids.astype("<u4").tobytes()) == r["ids_crc32"]
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in by.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= 64
    assert pack(docs.limit(0)).count() == 0
