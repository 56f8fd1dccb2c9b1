"""The pipeline against a brute-force version of each stage, each on its own input."""

import itertools
import random
import re

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm.tokens import public_vocabulary
from tessera.plans.tables import materialise

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def common(a, b):
    row = [0] * (len(b) + 1)
    for u in a:
        new = [0]
        for j, v in enumerate(b):
            new.append(row[j] + 1 if u == v else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def words(text):
    return re.findall("[0-9A-Za-z\x80-\U0010ffff]+", text.lower())


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rnd = random.Random(12)
    vocabulary = {lang: ["".join(rnd.choices(letters, k=rnd.randint(3, 8))) for _ in range(900)] for lang, letters in {"xx": "abcdefghij", "yy": "fghijklmnop"}.items()}
    items = [(i, " ".join(rnd.choices(vocabulary["xx"], k=30))) for i in range(5)]
    rows = []
    for k in range(60):
        lang = rnd.choice(["xx", "yy"])
        text = " ".join(rnd.choices(vocabulary[lang], k=rnd.choice([12, 80, 300])))
        if k % 12 == 5:
            text += " " + items[k // 12][1]
        if k % 10 == 3:
            text += f' token = "{rnd.getrandbits(160):040x}" end'
        rows.append((k, text, lang, "s", len(text)))
    for k in range(0, 30, 3):
        w = rows[k][1].split()
        if len(w) > 100:
            w[len(w) // 2] = "edited"
        rows.append((100 + k, " ".join(w), rows[k][2], "s", 0))
    rows += [(200, None, "xx", "s", None), (201, "", None, "s", 0), (202, "12 34 !", "yy", "s", 7), (203, rows[0][1], None, None, 1)]
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, items


def test_stages_equal_brute_force(spark, corpus):
    folder, items = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    names = docs.columns
    rows = {r.doc_id: r for r in docs.collect()}

    docs = materialise(stages["language_id"](spark, docs, folder), "one")
    rows = {k: r for k, r in rows.items() if r.text and any(map(str.isalpha, r.text))}
    assert docs.columns == names and {r.doc_id for r in docs.collect()} == set(rows)

    docs = materialise(stages["near_dedup"](spark, docs, folder), "two")
    first = {k: k for k in rows}
    for i, j in itertools.combinations(sorted(rows), 2):
        a, b = shingles(rows[i].text), shingles(rows[j].text)
        if len(a & b) >= 0.8 * len(a | b):
            old, new = max(first[i], first[j]), min(first[i], first[j])
            first = {k: new if v == old else v for k, v in first.items()}
    rows = {k: r for k, r in rows.items() if first[k] == k}
    assert docs.columns == names and {r.doc_id for r in docs.collect()} == set(rows)

    docs = materialise(stages["decontamination"](spark, docs, folder), "three")
    holds = lambda t: any(common(words(q), words(t)) >= 0.7 * len(words(q)) for _, q in items)
    rows = {k: r for k, r in rows.items() if not holds(r.text)}
    assert docs.columns == names and {r.doc_id for r in docs.collect()} == set(rows)

    docs = materialise(stages["secret_scan"](spark, docs, folder), "four")
    got = {r.doc_id: r for r in docs.collect()}
    assert docs.columns == names and set(got) == set(rows)
    for k, r in rows.items():
        want = re.sub(r'token = "[0-9a-f]{40}', "[secret]", r.text)
        assert got[k].text == want and (want == r.text or got[k].n_chars == len(want))

    pieces = stages["packing"](spark, docs, folder).collect()
    t = Tokenizer.from_file(public_vocabulary())
    sizes = {k: len(t.encode(r.text).ids) + 1 for k, r in got.items()}
    assert {p.doc_id: p.doc_tokens for p in pieces} == sizes
    assert sum(p.length for p in pieces) == sum(sizes.values())
    bins = {}
    for p in pieces:
        bins.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for spans in bins.values():
        ends = np.cumsum([n for _, n in sorted(spans)])
        assert [s for s, _ in sorted(spans)] == [0, *ends[:-1]] and ends[-1] <= 2048


def test_run_is_the_stages_in_turn(spark, corpus):
    folder, _ = corpus
    assert corpus_pipeline.run(spark, folder).count() > 0
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "secret_scan", "packing"]


def test_stages_take_odd_tables(spark, tmp_path):
    """Nulls in any column, repeated rows and ids, columns of clashing names and types, empty tables."""
    rnd = random.Random(31)
    prose = lambda n: " ".join("".join(rnd.choices("abcdefghij", k=rnd.randint(2, 7))) for _ in range(n))
    item, long = prose(30), prose(3000)
    texts = [prose(60) for _ in range(12)]
    rows = [(k, t, "en") for k, t in enumerate(texts)]
    rows += [(3, texts[3], "en"), (3, texts[3], "en"), (4, prose(40), "en"), (None, texts[5], "en"), (None, None, None), (None, prose(50), None)]
    rows += [(20, None, "en"), (21, "", "en"), (22, " \n ", None), (23, "12 34", "en"), (24, long, None), (25, long, "en"), (26, f"{prose(20)} {item} {prose(20)}", "en")]
    rows += [(27, f"{prose(30)} token = 0123456789abcdef0123456789abcdef", "en")]
    names = "doc_id long, text string, lang string, n_chars int, n long, id string, fp double, u int, component_id array<int>, words binary, score float, `a b` string"
    rows = [(*r, len(r[1] or ""), 7, "x", None, k, [k], b"w", 0.5, None) for k, r in enumerate(rows)]
    docs = spark.createDataFrame(rows, names)
    spark.createDataFrame([(1, item), (2, None), (None, "x y z w"), (1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for stage in (docs, docs.limit(0)):
        empty = stage is not docs
        for k, (name, f) in enumerate(corpus_pipeline.STAGES):
            stage = materialise(f(spark, stage, str(tmp_path)), name)
            if k < 4:
                assert stage.schema == docs.schema, name
            if empty:
                assert stage.count() == 0
            elif name == "language_id":
                assert stage.count() == len(rows) - 5
            elif name == "near_dedup":
                ids = [r.doc_id for r in stage.collect()]
                assert ids.count(None) == 2 and sorted(i for i in ids if i is not None) == [*range(12), 24, 26, 27]
            elif name == "decontamination":
                assert 26 not in {r.doc_id for r in stage.collect()}
            elif name == "secret_scan":
                got = {r.doc_id: r for r in stage.collect()}[27]
                assert got.text.endswith(" [secret]") and got.n_chars == len(got.text)
        assert stage.columns[:2] == ["doc_id", "start"]
