import heapq
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tessera.llm.token_files import canonical_codes, code_lengths, decode_blocks, decode_table, encode_ids, read_token_files, write_token_files
from tessera.llm.tokens import public_vocabulary
from tessera.plans.tables import new_path


def huffman_cost(counts):
    heap = [int(c) for c in counts if c]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        cost += a
        heapq.heappush(heap, a)
    return cost


@pytest.mark.parametrize("seed", range(6))
def test_code_is_optimal_limited_and_prefix_free(seed):
    rng = np.random.default_rng(seed)
    counts = (rng.pareto(0.6, 40) * 10).astype(np.int64)
    lengths = code_lengths(counts, 20)
    assert (lengths * counts).sum() == huffman_cost(counts)
    short = code_lengths(counts, 6)
    assert short.max() <= 6 and (short * counts).sum() >= huffman_cost(counts)
    codes = canonical_codes(short)
    words = [format(codes[i], f"0{short[i]}b") for i in np.flatnonzero(short)]
    assert not any(a != b and b.startswith(a) for a in words for b in words)


@pytest.mark.parametrize("n", [0, 1, 2, 511, 512, 513, 5000])
def test_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.02, n), 999).astype(np.uint16)
    lengths = code_lengths(np.bincount(ids, minlength=1000))
    payload, points = encode_ids(ids, lengths, canonical_codes(lengths))
    sizes = np.minimum(512, n - 512 * np.arange(len(points)))
    assert decode_blocks(payload, points, sizes, decode_table(lengths)).tolist() == ids.tolist()
    if len(points) > 2:  # a block on its own
        assert decode_blocks(payload, points[1:2], sizes[1:2], decode_table(lengths)).tolist() == ids[512:1024].tolist()


def test_files_give_back_all_ids_in_order(spark):
    rows = [(k * 7 % 101, f"text {k} " * (k % 9), "x") for k in range(101)]
    rows += [(3, None, "x"), (200, "long " * 70_000, "x"), (201, "", "x"), (5, "again", "x"), (5, "again", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    path = new_path(spark, "files")
    write_token_files(docs, path)
    got = sorted(read_token_files(spark, path).collect(), key=lambda r: r["start"])
    t, at = Tokenizer.from_file(public_vocabulary()), 0
    assert [r["doc_id"] for r in got] == sorted(r[0] for r in rows)
    for r in got:
        assert r["start"] == at
        at += len(r["ids"]) // 4
    want = sorted((r[0], zlib.crc32(np.array([*t.encode(r[1] or "").ids, 2], "<u4").tobytes())) for r in rows)
    assert sorted((r["doc_id"], zlib.crc32(r["ids"])) for r in got) == want
    digests = read_token_files(spark, path, digest=True).collect()
    assert sorted((r["start"], r["n_tokens"], r["ids_crc32"]) for r in digests) == [(r["start"], len(r["ids"]) // 4, zlib.crc32(r["ids"])) for r in got]
    empty = new_path(spark, "files")
    write_token_files(docs.limit(0), empty)
    assert read_token_files(spark, empty).count() == 0
