import random

import pytest

import tessera.llm.url_filter as U


def plain(url, rules, default="allow"):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        for c in "?#":
            rest = rest.split(c, 1)[0]
        host, slash, path = rest.partition("/")
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        path = slash + path
    fit = [(len(h + p), h.count("."), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *max(fit, default=(0, 0, None, default))[2:]


def urls():
    rnd = random.Random(3)
    out = [None, "", "no scheme", "http://", "http://com", "http://COM/en/", "x://a.Example.COM/en/7?q#f", "http://notcom/en/1", "http://ex.com?x/en/", "a://b://c.com/en/1", "http://É.com/en/É\n7", "http://com/en", "http://h.net/de/8" + "x" * 5000]
    for _ in range(400):
        host = ".".join(rnd.choices(["a", "example", "Example", "com", "net", "org", "x"], k=rnd.randint(1, 4)))
        out.append(f"http://{host}/{rnd.choice(['en', 'de', 'es', ''])}/{rnd.randint(0, 99)}{rnd.choice(['', '?a=1', '#b'])}")
    return out + out[:5]


@pytest.mark.parametrize("most", [U.MOST_BITS, 64])
def test_verdicts_equal_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(U, "MOST_BITS", most)
    pages = spark.createDataFrame([(k, u, "x", "y") for k, u in enumerate(urls())], "page_id long, url string, host string, key string")
    rules = U.OP1_RULES + [("allow", "a.com", ""), ("block", "x", "/"), ("allow", "a.com", "/e"), ("block", "com", "/en/"), ("block", "c", "om/en")]
    got = U.judge_urls(pages, rules).collect()
    assert sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got) == sorted((k, *plain(u, rules)) for k, u in enumerate(urls()))
    assert U.judge_urls(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in U.judge_urls(pages, []).collect()} == {"allow"}


def test_cascade_tells_all_keys_apart(spark):
    listed = spark.createDataFrame([(f"k{i * 37}",) for i in range(300)], "key string")
    universe = spark.range(20_000).selectExpr("concat('k', id) AS key")
    levels = U.build_cascade(listed, universe)
    assert len(levels) > 2
    found = universe.where(U.in_cascade(universe.key, levels))
    assert sorted(r.key for r in found.collect()) == sorted(f"k{i * 37}" for i in range(300))


def test_repeated_pages_keep_their_own_verdicts(spark):
    rows = [(1, "http://com/en/1"), (1, "http://a.org/de/1"), (1, "http://com/en/1"), (None, None)]
    got = U.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), U.OP1_RULES).collect()
    assert sorted((r.page_id or 0, r.verdict) for r in got) == [(0, "allow"), (1, "allow"), (1, "block"), (1, "block")]
