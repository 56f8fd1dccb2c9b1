import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from tessera.llm.best_fit_packing import configurations, linear_grouping, linear_groups, op12_best_fit_packing, pack_tightly
from tessera.llm.packing import best_fit_decreasing
from tessera.llm.tokens import public_vocabulary


def windows(plan, counts):
    """The spans in each window, after a check that each rank is placed once."""
    filled = {}
    for length, n in counts.items():
        ranks = []
        for low, high, first, each, base in plan[length]:
            ranks += range(low, high)
            for k in range(high - low):
                filled.setdefault(first + k // each, []).append((base + k % each * length, length))
        assert sorted(ranks) == list(range(n))
    return filled


def gapless(filled, window):
    for spans in filled.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= window


@pytest.mark.parametrize("seed", range(12))
def test_plan_holds_all_pieces(seed):
    rnd = random.Random(seed)
    window = rnd.choice([8, 64, 100, 2048])
    counts = Counter(rnd.randint(1, window) for _ in range(rnd.choice([1, 7, 300, 3000])))
    plan, used = linear_grouping(counts, window, rnd.choice([1, 4, 32]), rnd.choice([1 / 8, 1 / 3]))
    filled = windows(plan, counts)
    assert len(filled) == used and set(filled) == set(range(used))
    gapless(filled, window)


def test_empty_plan():
    assert linear_grouping({}, 16) == ({}, 0)


def test_groups_have_equal_cardinality_and_round_up():
    counts = {10: 3, 9: 5, 8: 1, 5: 7, 4: 4}
    found = linear_groups(counts, 5)
    assert sum((Counter(dict([m])) for g in found for m in g), Counter()) == Counter(counts)
    assert all(x <= g[0][0] for g in found for x, _ in g)
    assert [sum(n for _, n in g) for g in linear_groups(dict.fromkeys(range(1, 41), 1), 4)] == [10] * 4


def least_windows(pieces, window):
    """The least number of windows by trying all places."""
    best = [len(pieces)]

    def go(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(pieces):
            best[0] = len(bins)
            return
        for i in sorted({b: i for i, b in enumerate(bins)}.values()):
            if bins[i] >= pieces[k]:
                go(k + 1, [b - pieces[k] if j == i else b for j, b in enumerate(bins)])
        go(k + 1, [*bins, window - pieces[k]])

    go(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(6))
def test_near_the_least_number(seed):
    rnd = random.Random(seed)
    pieces = sorted((rnd.randint(15, 70) for _ in range(11)), reverse=True)
    _, used = linear_grouping(Counter(pieces), 100, 64, 1 / 8)
    assert used <= least_windows(pieces, 100) + 1


def test_configurations_beat_best_fit():
    # best fit puts the two longest lengths together, which leaves thirds of windows open
    counts = {51: 600, 27: 600, 26: 600, 23: 1200}
    _, plain = best_fit_decreasing(counts, 100)
    _, used = linear_grouping(counts, 100, 64, 1 / 8)
    assert plain == 1100 and used <= 905
    sizes, demand = [51, 27, 26, 23], [600, 600, 600, 1200]
    found = configurations(sizes, demand, 100)
    assert all(sum(s * k for s, k in zip(sizes, f)) <= 100 for f, _ in found)
    assert all(sum(f[i] * n for f, n in found) <= demand[i] for i in range(4))


def check_pieces(got, texts, window):
    """``texts``: the multiset of (doc_id, text). Pieces must give back each document's ids."""
    t = Tokenizer.from_file(public_vocabulary())
    want = Counter()
    for doc_id, text in texts:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        first = (len(ids) - 1) % window + 1
        cuts = [0, *range(first, len(ids) + 1, window)]
        for piece, (s, e) in enumerate(zip(cuts, cuts[1:])):
            want[doc_id, piece, s, e - s, zlib.crc32(np.array(ids[s:e], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    filled = {}
    for r in got:
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    gapless(filled, window)
    return len(filled)


def test_pack_tightly_on_odd_rows(spark):
    rows = [(1, "one two three", "x"), (2, None, "x"), (3, "", "x"), (4, "word " * 300, "x"), (1, "one two three", "x"), (None, "lost id", "x"), (5, "é" * 500, "x"), (6, "w" * 64, "x")]
    rows += [(100 + k, "same text here", "x") for k in range(40)] + [(9, "copy of one row", "x")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string")
    got = pack_tightly(docs, window=64).collect()
    assert all(np.frombuffer(r["ids"], "<u2").size == r["length"] and zlib.crc32(np.frombuffer(r["ids"], "<u2").astype("<u4").tobytes()) == r["ids_crc32"] for r in got)
    used = check_pieces(got, [(a, b) for a, b, _ in rows], 64)
    assert used <= -(-sum(r["length"] for r in got) // 64) + 1
    assert pack_tightly(docs.limit(0)).count() == 0


def test_query_on_whole_documents(spark):
    sf = "/root/testdata/sf0.001"
    got = op12_best_fit_packing(spark, sf).collect()
    texts = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    used = check_pieces(got, texts, 2048)
    assert used <= 1.02 * -(-sum(r["length"] for r in got) // 2048) + 1
