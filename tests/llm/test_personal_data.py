import random
import re

from tessera.llm.personal_data import KINDS, find_personal


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        n = int(c) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def plain(text):
    digits = lambda v: re.sub("[^0-9]", "", v)
    patterns = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(p) <= 255 for p in v.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda v: 12 <= len(digits(v)) <= 19 and luhn(digits(v))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 9 <= len(digits(v)) <= 15),
    ]
    return sorted((m.start(), k, m.end()) for k, (p, fine) in enumerate(patterns) for m in re.finditer(p, text) if fine(m.group()))


TEXTS = [
    None, "", "a@b.c", "x..y@b-.c_d@e.f é@b.co \U0001f600 me@mail.example.com, a@b", "1.2.3.4.5 256.1.1.1 001.002.003.004 1.2.3 999999999999999999999.1.1.1",
    "4111 1111 1111 1111 4111111111111112 4111-1111-1111-1111  12", "+1 (017) 555-7713 +12345 +1234567890123456 +49 30 123456-7.", "9 " * 6_000, "a." * 5_000 + "a@b" + ".c" * 8_000,
    "1" * 20_000, "+1" + "-" * 1000 + "2 tel +44 20 7946 0958", "a@b.c@d.e", "x@y.z" * 50,
]


def test_base_spans_equal_the_patterns(spark):
    rnd = random.Random(6)
    bits = ["a", "@", ".", "b.c", "1", "255", "4111111111111111", " ", "-", "+", "(", ")", "é", "\n", "12", "mail"]
    texts = TEXTS + ["".join(rnd.choices(bits, k=rnd.randint(1, 18))) for _ in range(300)]
    docs = spark.createDataFrame([(k, t, 1, 2) for k, t in enumerate(texts)] + [(2, TEXTS[2], 1, 2)], "doc_id long, text string, email int, candidates int")
    got = find_personal(docs).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        assert [tuple(s) for s in r.spans if s.kind < 4] == plain(texts[r.doc_id] or ""), texts[r.doc_id]
    assert find_personal(docs.limit(0)).count() == 0


def test_trees_add_likely_spans_and_leave_others(spark):
    rnd = random.Random(8)
    rows = []
    for k in range(400):
        mail = f"u{rnd.randrange(10**6)}@m{rnd.randrange(50)}.org"
        phone = f"+{rnd.randint(1, 99)} {rnd.randint(100, 999)} {rnd.randint(1000, 9999)} {rnd.randint(10, 99)}"
        rows.append((k, f"Write to {mail} or call tel: {phone}. Order {rnd.randrange(10**9, 10**10)} of {rnd.randint(1900, 2030)}.{rnd.randint(1, 9999)}-{rnd.randint(100, 999)}."))
    rows += [(1000 + k, "Plain prose about nothing, 12 of them in 1999.") for k in range(20)]
    got = {r.doc_id: r.spans for r in find_personal(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all({s.kind for s in got[k]} >= {0, 3} for k in range(400))
    assert not any(got[1000 + k] for k in range(20))
    assert all(KINDS[s.kind] in KINDS for k in got for s in got[k])


def test_spelt_out_addresses_are_proposed_and_sentences_are_not(spark):
    from tessera.llm.personal_data import SPELT_OUT, places
    from pyspark.sql import functions as F

    texts = ["write jo.b (at) mail (dot) org now", "jo at mail dot org", "jo at mail.org", "jo[at]mail.org", "We met at home. Then left.", "at the end."]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = {r.k: [p.value for p in r.p] for r in rows.select("k", places(F.col("t"), SPELT_OUT, F.lit(True)).alias("p")).collect()}
    assert got == {0: ["jo.b (at) mail (dot) org"], 1: ["jo at mail dot org"], 2: ["jo at mail.org"], 3: ["jo[at]mail.org"], 4: [], 5: []}


def planted(rnd, k):
    mail = f"u{rnd.randrange(10**6)}@m{rnd.randrange(50)}.org"
    phone = f"+{rnd.randint(10, 99)} {rnd.randint(100, 999)} {rnd.randint(1000, 9999)} {rnd.randint(10, 99)}"
    return k, f"Write to {mail} or call tel: {phone}. Order {rnd.randrange(10**9, 10**10)} of {rnd.randint(1900, 2030)}.{rnd.randint(1000, 9999)}-{rnd.randint(100, 999)}."


def others(rows, texts):
    return {r.doc_id: [texts[r.doc_id][s.start : s.end] for s in r.spans if s.kind == 4] for r in rows if r.doc_id in texts}


def test_disguised_data_are_added_and_plain_numbers_are_not(spark):
    rnd = random.Random(18)
    rows = [planted(rnd, k) for k in range(400)]
    rows += [(1000 + k, f"Write to jo{k} at mail{k} dot org today.") for k in range(20)]
    rows += [(2000 + k, f"You may call tel: 4{k % 10} {300 + k} 55{10 + k} 7{k % 10} at noon.") for k in range(20)]
    rows += [(3000 + k, f"Order {10**9 + 77777 * k} of the year 1999.{1000 + k}-333 came.") for k in range(20)]
    texts = {k: t for k, t in rows}
    got = others(find_personal(spark.createDataFrame(rows, "doc_id long, text string")).collect(), texts)
    for k in range(20):
        assert got[1000 + k] == [f"jo{k} at mail{k} dot org"]
        assert got[2000 + k] == [f"4{k % 10} {300 + k} 55{10 + k} 7{k % 10}"]
        assert got[3000 + k] == []


def test_copied_numbers_do_not_fill_the_sample(spark):
    rnd = random.Random(19)
    rows = [planted(rnd, k) for k in range(400)]
    feet = [f"Item {rnd.randrange(10**9, 10**10)} of the list" for _ in range(40)]
    rows += [(10_000 + k, feet[k % 40]) for k in range(8000)]
    rows += [(1000 + k, f"Write to jo{k} at mail{k} dot org today.") for k in range(20)]
    texts = {k: t for k, t in rows}
    got = others(find_personal(spark.createDataFrame(rows, "doc_id long, text string"), sample=400).collect(), texts)
    assert all(got[1000 + k] == [f"jo{k} at mail{k} dot org"] for k in range(20))
    assert not any(got[10_000 + k] for k in range(8000))


def test_few_examples_still_teach(spark):
    """Three addresses and two phones are enough: no number of examples switches the method off."""
    rnd = random.Random(20)
    rows = [planted(rnd, k) for k in range(3)]
    rows += [(1000 + k, f"Write to jo{k} at mail{k} dot org today.") for k in range(5)]
    rows += [(3000 + k, f"Order {10**9 + 77777 * k} came.") for k in range(30)]
    texts = {k: t for k, t in rows}
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, email string")
    found = find_personal(docs, keep=["doc_id", "email"])
    assert found.columns == ["doc_id", "email", "spans"]
    got = others(found.collect(), texts)
    assert all(got[1000 + k] == [f"jo{k} at mail{k} dot org"] for k in range(5))
    assert not any(got[3000 + k] for k in range(30))
