import itertools
import random

import pytest
import xxhash

from tessera.llm.simhash import covering_masks, drop_near_copies, links, near_duplicates
from tessera.plans.components import connected_components


def plain_print(text, words=3):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    cut = [w for w in __import__("re").split("[\x20\x09-\x0d]+", low) if w]
    parts = [" ".join(cut[i : i + words]) for i in range(len(cut) - words + 1)] or ([" ".join(cut)] if cut else [])
    hs = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(prints, radius=2):
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= radius:
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_every_pair_within_the_radius_meets(radius):
    masks = covering_masks(radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    for bits in itertools.combinations(range(64), radius):
        differ = sum(1 << b for b in bits)
        assert any(m & differ == 0 for m in masks)


@pytest.mark.parametrize("crowd", [20, 300])
def test_links_connect_what_brute_force_connects(spark, crowd):
    rnd = random.Random(crowd)
    base = [rnd.getrandbits(64) for _ in range(6)]
    prints = {b for b in base}
    for _ in range(crowd):
        x = rnd.choice(base)
        for _ in range(rnd.randint(0, 5)):
            x ^= 1 << rnd.randrange(64)
        prints.add(x)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    got = {r["node"]: r["component"] for r in connected_components(links(df)).collect()}
    want = plain_components(prints)
    groups = {}
    for s, w in zip(signed, want):
        groups.setdefault(w, set()).add(got.get(s, s))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_near_duplicates_equal_brute_force(spark):
    rnd = random.Random(5)
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(rnd.choices(words, k=rnd.choice([1, 2, 3, 40, 200]))) for _ in range(25)]
    texts += [t.upper() for t in texts[:5]] + [texts[7] + " more"] + [None, "", " \n", "É é x", texts[3]] * 2
    texts += ["long text " * 20_000]
    rows = [(k, t, "z") for k, t in enumerate(texts)] + [(3, texts[3], "z")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp string")).collect()
    prints = [plain_print(t) for _, t, _ in rows]
    want = plain_components(prints)
    assert sorted((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in got) == sorted((rows[i][0], prints[i], rows[want[i]][0]) for i in range(len(rows)))
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(empty).count() == 0


def test_stage_keeps_one_of_each_group_and_all_others(spark):
    rnd = random.Random(9)
    make = lambda n: [f"v{rnd.randrange(5000)}" for _ in range(n)]
    base = [make(200) for _ in range(30)]
    rows = [(k, " ".join(b), "en", "s", 1) for k, b in enumerate(base)]
    for k in range(10):  # two words changed: similarity of about 0.9
        b = list(base[k])
        b[50], b[150] = "changed", "also"
        rows += [(100 + k, " ".join(b), "en", "s", 1), (200 + k, " ".join(base[k]), "en", "s", 1)]
    crowd = make(300)
    for k in range(120):
        b = list(crowd)
        b[k], b[299 - k] = f"x{k}", f"y{k}"
        rows.append((1000 + k, " ".join(b), "en", "s", 1))
    rows += [(5, rows[5][1], "en", "s", 1), (2000, None, "en", "s", 1), (2001, "", "en", "s", 1), (None, "no id", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in drop_near_copies(docs).collect())
    assert kept == [-1, *range(30), 1000, 2000]


def test_stage_compares_crowds_in_full(spark):
    """One template with differing edits: most pairs below 0.8, few just above, far apart in order."""
    rnd = random.Random(12)
    template = [f"t{k}" for k in range(240)]

    def edited(words, n, tag):
        out = list(words)
        for k in rnd.sample(range(len(words)), n):
            out[k] = f"{tag}{rnd.randrange(10**6)}"
        return out

    texts = [edited(template, 6, f"e{k}_") for k in range(700)]
    texts += [edited(texts[k], 4, "p") for k in range(0, 60)] + [edited(texts[k], 5, "q") for k in range(60, 160)]
    shingles = [frozenset(tuple(t[i : i + 5]) for i in range(len(t) - 4)) for t in texts]
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links_ = 0
    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(shingles[i] & shingles[j])
        if both >= 0.8 * (len(shingles[i]) + len(shingles[j]) - both):
            links_ += 1
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    want = sorted({find(i) for i in range(len(texts))})
    assert 100 < links_ < 0.01 * len(texts) ** 2 and len(want) > 500
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    kept = drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == want
