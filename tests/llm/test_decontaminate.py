import random
import re

import numpy as np

from tessera.llm.decontaminate import Batch, common_order, contaminated, drop_contaminated, hashed_words, latent_space, singular_vectors, word_hashes, word_places

import pyarrow as pa


def test_word_hashes_are_those_of_the_words():
    text = "  The cat, THE Café 42\n\x85 the-cat".encode()
    hashes, at = word_hashes(np.frombuffer(text, np.uint8))
    words = [m.group().lower() for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+", text)]
    assert len(hashes) == len(words) and [text[i] for i in at][:2] == [ord("T"), ord("c")]
    for i, w in enumerate(words):
        assert [h == hashes[i] for h in hashes] == [w == v for v in words]


def test_blocks_cover_each_text():
    x = Batch.of_texts(pa.array(["a b c", None, "", "w " * 100, "..."]))
    assert x.doc.tolist() == [0, 3, 3, 3, 3, 3] and len(x.words) == 103
    assert np.bincount(x.block).tolist() == [3, 24, 24, 24, 24, 4]


def test_common_order():
    rnd = random.Random(1)
    for _ in range(50):
        a, b = ([rnd.randrange(6) for _ in range(rnd.randrange(20))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, u in enumerate(a):
            for j, v in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if u == v else max(t[i][j + 1], t[i + 1][j])
        assert common_order(word_places(np.array(a, int)), len(a), b) == t[-1][-1]


def test_singular_vectors_are_those_of_the_matrix():
    rng = np.random.default_rng(2)
    left, right = np.linalg.qr(rng.standard_normal((300, 12)))[0], np.linalg.qr(rng.standard_normal((80, 12)))[0]
    size = 2.0 ** -np.arange(12) * 100
    a = left * size @ right.T
    directions = rng.standard_normal((80, 20))
    vectors, values = singular_vectors(a.T @ (a @ directions), directions)
    assert np.allclose(values[:6], size[:6], rtol=5e-3)
    assert np.allclose(np.abs((vectors[:, :6] * right[:, :6]).sum(0)), 1, atol=1e-3)


def test_copies_and_paraphrases_are_found_and_others_kept(spark):
    rnd = random.Random(3)
    vocabulary = ["".join(rnd.choices("abcdefghijklmnop", k=rnd.randint(3, 8))) for _ in range(4000)]
    make = lambda n: rnd.choices(vocabulary, k=n)
    items = [(i, " ".join(make(rnd.choice([15, 30, 55])))) for i in range(12)] + [(100, None), (101, ""), (102, "one two"), (0, "again " * 5 + " ".join(make(10)))]
    rows, want = [], set()
    for k in range(200):
        words = make(rnd.choice([0, 5, 60, 300]))
        if k % 5 == 0:
            item = k // 5 % 12
            copy = items[item][1].split()
            if k % 10 == 0:  # reworded: every ninth word is another
                copy = [rnd.choice(vocabulary) if j % 9 == 4 else w for j, w in enumerate(copy)]
            at = rnd.randint(0, len(words))
            words = words[:at] + copy + words[at:]
            want.add((k, item))
        rows.append((k, " ".join(words).title(), "en", "s", 1))
    rows += [(900, None, "en", "s", 1), (901, "", "en", "s", 1), (902, "x " * 100_000, "en", "s", 1), (0, rows[0][1], "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {tuple(r) for r in contaminated(docs, bench).collect()} == want
    kept = drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r[0] for r in rows if r[0] not in {k for k, _ in want})
    assert contaminated(docs.limit(0), bench).count() == 0 and contaminated(docs, bench.limit(0)).count() == 0
    assert latent_space(hashed_words(docs.limit(0))).shape[1] > 0


def some_words(seed, n=4000):
    rnd = random.Random(seed)
    return rnd, ["".join(rnd.choices("abcdefghijklmnop", k=rnd.randint(4, 9))) for _ in range(n)]


def pairs_of(spark, texts, items):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    return {tuple(r) for r in contaminated(docs, bench).collect()}


def test_items_longer_than_a_passage_are_searched_whole(spark):
    rnd, vocabulary = some_words(21)
    items = [rnd.choices(vocabulary, k=n) for n in (49, 55, 60, 66, 72, 72, 100, 150)]
    texts, want = [], set()
    for i, item in enumerate(items):
        for at in (0, 7, 30, 49):
            for copy in (item, item[-int(len(item) * 0.71 + 1) :], item[:-6]):  # whole; the end with the answer; no answer
                if copy[-6:] == item[-6:]:
                    want.add((len(texts), i))
                texts.append(" ".join(rnd.choices(vocabulary, k=at) + copy + rnd.choices(vocabulary, k=60)))
    assert pairs_of(spark, texts, items) == want


def test_copies_at_every_offset_and_reworded_content_are_found(spark):
    """Every item holds 28 words that all texts use and 20 rare ones; 13 rare ones may be replaced."""
    rnd, vocabulary = some_words(22, 8000)
    common = vocabulary[:30]
    make = lambda n: [rnd.choice(common) if rnd.random() < 0.58 else rnd.choice(vocabulary) for _ in range(n)]
    items, rare = [], []
    for _ in range(12):
        at = sorted(rnd.sample(range(42), 20))
        rare.append(at)
        items.append([rnd.choice(vocabulary[30:]) if k in at else rnd.choice(common) for k in range(48)])
    texts, want = [], set()
    for i, item in enumerate(items):
        for offset in range(0, 48, 2):
            reworded, spread = list(item), list(item)
            for k in rnd.sample(rare[i], 13):
                reworded[k] = rnd.choice(vocabulary[30:])
            for k in rnd.sample(range(44), 13):
                spread[k] = rnd.choice(vocabulary[30:])
            for copy in (item, reworded, spread):
                want.add((len(texts), i))
                texts.append(" ".join(make(offset) + copy + make(80)))
    clean = len(texts)
    texts += [" ".join(make(200)) for _ in range(300)]
    got = pairs_of(spark, texts, items)
    whole = [x for x in want if x[0] % 3 == 0]
    assert not any(t >= clean for t, _ in got) and got <= want
    assert all(x in got for x in whole)
    assert len(got) >= 0.99 * len(want)
