import hashlib
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.llm.merkle import OP11_SQL, folded, leaf_digest, op11_merkle_manifest, proofs, write_manifest
from tests.oracle import compare, database

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, position string, digest string, path string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def climb(level):
    """All levels of a tree, and for each leaf its siblings by level."""
    levels = [level]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([sha(*below[i : i + 16]) for i in range(0, len(below), 16)])
    paths = []
    for i in range(len(level)):
        steps = []
        for below in levels[:-1]:
            first = i - i % 16
            steps.append(("".join(below[first:i]), "".join(below[i + 1 : first + 16])))
            i //= 16
        paths.append(steps)
    return levels[-1][0] if level else None, paths


def plain(rows):
    """doc_id, leaf, subroot, root, siblings of each row, one after the other in a list."""
    trees = {}
    for r in rows:
        trees.setdefault(r[1], []).append(r)
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        trees[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    tops = [climb([leaf(r) for r in trees[s]]) for s in order]
    root, upper = climb([t[0] for t in tops])
    return [(r[0], leaf(r), tops[k][0], root, [*tops[k][1][i], *upper[k]]) for k, s in enumerate(order) for i, r in enumerate(trees[s])]


def documents():
    rows = [(k, "hot", "en", 3, f"Text {k}") for k in range(300)]
    rows += [(k, "full", None, 1, "x") for k in range(256)] + [(k, "run", "de", None, None) for k in range(16)] + [(k, "more", "de", 0, "") for k in range(17)]
    rows += [(None, None, None, None, None), (5, None, "fr", 2, "É" * 40000), (7, "", "fr", 2, "a:b"), (8, "é", "fr", 2, "-"), (9, "\U0001f642", "en", 2, "Z"), (10, "Z", "en", 2, "z")]
    rows += [(3, "hot", "en", 3, "Text 3")] * 40 + [(3, "hot", "en", 3, "other")]
    rows += [(None, "hot", "en", 3, "no id"), (-4, "hot", "en", 3, "before zero"), (1 << 40, "hot", "en", 3, "far")]
    rows += [(k, f"s{k}", "en", 1, "one of many sources") for k in range(20)]
    return rows


@pytest.mark.parametrize("stride", [1, 2, 3])
def test_equals_a_plain_tree(spark, tmp_path, stride):
    rows = documents()
    docs = spark.createDataFrame([(*r, "w", "x", "y", "z") for r in rows], SCHEMA)
    m = write_manifest(docs, f"{tmp_path}/m", stride)
    got = proofs(spark, m).withColumn("again", folded(F.col("leaf"), F.col("path"))).collect()
    want = plain(rows)
    assert m.root == want[0][3] and all(r["again"] == m.root for r in got)
    flat = lambda p: "|".join(f"{a},{b}" for a, b in p)
    assert Counter((r["doc_id"], r["leaf"], r["subroot"], r["root"], flat(r["path"])) for r in got) == Counter((*w[:4], flat(w[4])) for w in want)
    # only every stride-th level lies in the folder, the leaves included
    assert set(p.name for p in (tmp_path / "m/documents").iterdir()) == {f"level-{k}" for k in range(0, m.levels["documents"] + 1, stride)}
    assert m.nodes(spark, "documents", 0).count() == len(rows)


def test_a_changed_document_is_found(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"s{k % 3}", "en", 1, f"text {k}") for k in range(100)], "doc_id long, source string, lang string, n_chars long, text string")
    now = F.when(F.col("doc_id") == 50, F.lit("text 51")).otherwise(F.col("text"))
    shown = leaf_digest(*[F.col(x) for x in ("doc_id", "source", "lang", "n_chars")], now)
    found = proofs(spark, write_manifest(docs, f"{tmp_path}/m", keep={"shown": shown}), "shown")
    wrong = found.where(folded(F.col("shown"), F.col("path")) != F.col("root")).collect()
    assert [r["doc_id"] for r in wrong] == [50]


def test_empty_and_single(spark, tmp_path):
    docs = spark.createDataFrame([(1, None, None, None, None)], "doc_id long, source string, lang string, n_chars long, text string")
    m = write_manifest(docs.limit(0), f"{tmp_path}/none")
    assert m.root is None and proofs(spark, m).count() == 0
    m = write_manifest(docs, f"{tmp_path}/one")
    (row,) = proofs(spark, m).collect()
    assert row["leaf"] == row["subroot"] == row["root"] == sha("1:1----") and row["path"] == []


def test_query_equals_its_sql_and_a_plain_one(spark):
    sf = "/root/testdata/sf0.001"
    df = op11_merkle_manifest(spark, sf)
    compare(df, database(sf), OP11_SQL)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    by = {r[0]: r for r in rows}
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    want = {}
    for doc_id, own, sub, root, steps in plain(rows):
        r = by[doc_id]
        h = leaf((*r[:4], r[4].translate(low))) if zlib.crc32(str(doc_id).encode()) % 5 == 0 else own
        for a, b in steps:
            h = sha(a, h, b)
        want[doc_id] = (own, sub, root, sha(*[a + b for a, b in steps]), h, h == root)
    assert {r["doc_id"]: (r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"], r["verified"]) for r in df.collect()} == want
