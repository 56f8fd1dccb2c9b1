import random
import re
from re import _parser

from tessera.llm.license_rules import BASE, license_rules
from tessera.llm.licenses import detect_licenses


def some_match(rnd, parsed):
    """A string that a pattern of literals, sets, groups and options matches."""
    out = ""
    for kind, arg in parsed:
        kind = str(kind)
        if kind == "LITERAL":
            out += chr(arg)
        elif kind == "IN":
            name, value = rnd.choice(arg)
            out += chr(value if str(name) == "LITERAL" else rnd.randint(*value))
        elif kind == "MAX_REPEAT":
            out += "".join(some_match(rnd, arg[2]) for _ in range(rnd.randint(arg[0], arg[1])))
        elif kind == "SUBPATTERN":
            out += some_match(rnd, arg[3])
        elif kind == "BRANCH":
            out += some_match(rnd, rnd.choice(arg[1]))
        else:
            raise ValueError(kind)
    return out


def test_there_are_hundreds_of_rules_and_their_gates_follow_from_them():
    rules, rnd = license_rules(), random.Random(1)
    assert len(rules) > 250 and len({(r.label, r.pattern) for r in rules}) == len(rules)
    for r in rules:
        for _ in range(60):
            match = some_match(rnd, _parser.parse(r.pattern))
            assert re.fullmatch(r.pattern, match)
            assert r.root in match and r.keyword in match, (r, match)


def plain_places(text):
    """All rules tried everywhere, then suppression, place by place."""
    words = " " + " ".join(re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if c < "\x80" else c for c in text or ""))) + " "
    found = []
    for i, r in enumerate(license_rules()):
        for m in re.finditer(f" (?:{r.pattern})(?= )", words):
            found.append((i, words[: m.start()].count(" "), words[: m.end()].count(" "), r))
    kept = set()
    for i, s, e, r in found:
        hidden = any(j != i and t <= s and u >= e and (q.priority > r.priority or q.priority == r.priority and ((t, u) != (s, e) or j < i)) for j, t, u, q in found)
        if r.base or not hidden:
            kept.add((r.label, s, e, r.score, r.base))
    return kept


def test_labels_equal_a_plain_version(spark):
    rnd = random.Random(2)
    rules = license_rules()
    texts = []
    for _ in range(400):
        parts = []
        for _ in range(rnd.randint(1, 4)):
            parts += [some_match(rnd, _parser.parse(rnd.choice(rules).pattern)), rnd.choice(["", "x", "the", "licen\u017fe", "İ", "v2"])]
        text = rnd.choice([" ", ", ", "\n", " - "]).join(parts)
        texts.append(rnd.choice([str, str.title, str.upper])(text))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in detect_licenses(docs).collect():
        assert {(p.label, p.start, p.end, p.score, p.base) for p in r.places} == plain_places(texts[r.doc_id]), texts[r.doc_id]


def test_names_in_other_words_are_no_licenses(spark):
    want = {"we permit use of expat parser": set(), "a simplified bsd kit": set(), "under the expat license": {"mit"}, "SPDX-License-Identifier: MIT": {"mit"}}
    want |= {"Creative Commons Attribution-ShareAlike 4.0": {"cc-by-sa"}, "Creative Commons Attribution Non Commercial 4.0 International License": {"cc-by-nc"}, "a commit to mit": set()}
    docs = spark.createDataFrame(list(enumerate(want)), "doc_id long, text string")
    got = {r.doc_id: {p.label for p in r.places} for r in detect_licenses(docs).collect()}
    assert [got[k] for k in range(len(want))] == list(want.values())


def test_base_places_and_suppression(spark):
    texts = [
        None, "", "...", "Released under the MIT License. under the mit license", "Licensed under CC BY-NC 4.0.", "cc by nc cc by nc sa x cc by ncx",
        "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3.",
        "ÉCC BY NC \x85 cc by nc\ttail", "word " * 30_000 + "under the MIT license", "prose without any notice", "underthe mit license",
    ]
    docs = spark.createDataFrame([(k, t, 1, 2) for k, t in enumerate(texts)] + [(3, texts[3], 1, 2)], "doc_id long, text string, n_words int, places int")
    got = detect_licenses(docs).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if c < "\x80" else c for c in texts[r.doc_id] or ""))
        assert r.n_words == len(words)
        want = sorted((label, i) for p, label in BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
        assert sorted((p.label, p.start) for p in r.places if p.base) == want
    labels = {r.doc_id: {p.label for p in r.places} for r in got}
    assert labels[3] == {"mit"} and labels[4] == {"cc-by-nc"} and labels[7] == {"gpl-3"} and labels[10] == set()
    assert labels[6] == {"apache-2"}
    assert detect_licenses(docs.limit(0)).count() == 0
