import math
import random

import pytest
from pyspark.sql import functions as F

import tessera.llm.topk as T


def brute(rows, k, every):
    fine = {(i, tuple(math.floor(256 * float(c)) for c in v)) for i, v in rows if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)}
    out = []
    for q, x in fine:
        if q % every == 0:
            found = sorted({(-sum(a * b for a, b in zip(x, y)), i) for i, y in fine if i != q and len(y) == len(x)})[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("chunk", [7, 2048])
def test_equal_to_brute_force_with_ties_copies_and_bad_rows(spark, monkeypatch, chunk):
    monkeypatch.setattr(T, "CHUNK", chunk)
    monkeypatch.setattr(T, "QUERIES", 3)
    rnd = random.Random(chunk)
    make = lambda: [rnd.choice([-0.5, -0.1, 0.0, 0.25, 0.6]) for _ in range(6)]
    rows = [(i, make()) for i in range(80)]
    hot = make()
    rows += [(100 + i, hot) for i in range(60)]
    rows += [(200, None), (201, [None] * 6), (202, [math.nan] * 6), (203, [math.inf] * 6), (None, hot), (210, [1.0, 2.0]), (220, [1.0, 3.0]), (230, []), (100, hot)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, row int")
    got = T.top_k(df, F.col("vec_id") % 10 == 0).collect()
    rows = [(i, v) for i, v in rows]
    assert sorted(map(tuple, got)) == brute(rows, 5, 10)
    assert T.top_k(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_nothing_is_broadcast(spark, monkeypatch):
    """Blocks look small on disk; copied to every salt they'd all meet at the driver."""
    from tessera.llm import topk

    plans, write = [], topk.materialise
    monkeypatch.setattr(topk, "materialise", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, name))
    rows = [(k, [((k * 31 + i * 7) % 100) / 100.0 for i in range(8)]) for k in range(300)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "vec_id % 50 = 0")
    assert got.count() == 30 and len(plans) == 6 and not any("Broadcast" in p for p in plans)
