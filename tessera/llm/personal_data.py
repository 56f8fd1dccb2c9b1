"""Personal data in texts: fixed patterns, and candidates judged by boosted trees, in column functions."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.tables import materialise, read_table

#: The contract's kinds in order, and ``other`` for the spans of the method.
KINDS = ("email", "ip", "card", "phone", "other")
#: Distinct examples that trees are fitted on, at most, half of each label: a documented bound of the
#: training sample, in the order of a hash. The threshold rests on all, every candidate is judged.
SAMPLE = 20_000
#: A span is added if at least this share of all examples at its score or above are personal.
PRECISION = 0.995
PLACE = "struct<start: long, end: long, value: string>"

# The contract's patterns, with possessive loops where giving back can't help: such a loop needs no
# stack, however long a run is. An e-mail can only start where a run of its letters starts, or where
# the match before ended.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"

# High-recall proposals; they overlap each other and the base spans.
MAIL_LIKE = r"[^\s@,;:<>()\[\]]{1,64}@[^\s@,;:<>()\[\]]{2,255}"
# Blanks around a dot are taken for a spelt-out one only; else every sentence's end would be proposed.
SPELT_OUT = r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+\s?(?:\(at\)|\[at\]|\{at\}|\sat\s)\s?[a-z0-9-]{1,63}(?:\s?(?:\(dot\)|\[dot\]|\{dot\}|\sdot\s)\s?|\.)[a-z]{2,24}"
NUMBER = r"[+(]?[0-9][0-9\x20().-]{6,28}[0-9]"


def places(text: Column, pattern: str, gate: Column) -> Column:
    """All matches as ``(start, end, value)`` in code points: the gaps between them give their places."""
    none = F.expr(f"cast(array() as array<{PLACE}>)")
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def add(state: Column, i: Column) -> Column:
        start = state["at"] + F.get(gaps, i)
        value = F.get(found, i)
        end = (start + F.length(value)).cast("long")
        place = F.struct(start.cast("long").alias("start"), end.alias("end"), value.alias("value"))
        return F.struct(end.alias("at"), F.concat(state["all"], F.array(place)).alias("all"))

    empty = F.struct(F.lit(0).cast("long").alias("at"), none.alias("all"))
    walked = F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), empty, add)["all"]
    return F.when(gate, F.when(F.size(found) > 0, walked).otherwise(none)).otherwise(none)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _all_places(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Base places of each kind after their checks, and candidates with the text around them."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(*keep, text.alias("_t")).withColumn("_d", F.col("_t").rlike("[0-9]"))
    t, digit = F.col("_t"), F.col("_d")
    at, plus = F.contains(t, F.lit("@")), F.contains(t, F.lit("+"))
    raw = {
        "_email": places(t, EMAIL, at),
        "_ip": places(t, IP, digit & t.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]")),
        "_card": places(t, CARD, digit & t.rlike(r"[0-9](?:[\x20-]?[0-9]){11}")),
        "_phone": places(t, PHONE, digit & plus),
        "_mail_like": places(t, MAIL_LIKE, at),
        "_spelt": places(t, SPELT_OUT, t.rlike(r"(?i)(?:[(\[{]at[)\]}]|\sat\s)\s?[a-z0-9-]{1,63}(?:\s?[\s(\[{]dot[\s)\]}]|\.[a-z])")),
        "_number": places(t, NUMBER, digit & t.rlike(r"[0-9][0-9\x20().-]{6}")),
    }
    rows = rows.select(*keep, "_t", *[c.alias(k) for k, c in raw.items()])
    size = lambda p: F.length(_digits(p["value"]))
    checks = {
        "_email": F.col("_email"),
        "_ip": F.filter("_ip", lambda p: p["value"].rlike(rf"^{PART}\.{PART}\.{PART}\.{PART}$")),
        "_card": F.filter("_card", lambda p: size(p).between(12, 19) & F.call_function("luhn_check", _digits(p["value"]))),
        "_phone": F.filter("_phone", lambda p: size(p).between(9, 15)),
    }
    # a generator's span may run into blanks and signs; what it proposes ends with a digit or letter
    every = F.array_distinct(F.concat("_mail_like", "_spelt", "_number"))

    def around(p: Column) -> Column:
        left = F.substring(F.col("_t"), F.greatest(p["start"] - 23, F.lit(1)).cast("int"), F.least(p["start"], F.lit(24)).cast("int"))
        right = F.substring(F.col("_t"), (p["end"] + 1).cast("int"), F.lit(1))
        return F.struct(p["start"].alias("start"), p["end"].alias("end"), p["value"].alias("value"), left.alias("left"), right.alias("right"))

    return rows.select(*keep, *[c.alias(k) for k, c in checks.items()], F.transform(every, around).alias("_candidates"))


def _count(value: Column, pattern: str) -> Column:
    return F.length(value) - F.length(F.regexp_replace(value, pattern, ""))


def _features(c: Column | dict[str, Column]) -> list[Column]:
    """Format and context of a candidate, as doubles."""
    v, left, digits = c["value"], F.lower(c["left"]), _digits(c["value"])
    flag = lambda x: F.when(x, 1.0).otherwise(0.0)
    counts = [F.length(v), F.length(digits), *[_count(v, p) for p in (r"\.", "-", " ", r"[()]", "@", "[A-Za-z]", r"[^\x00-\x7F]")]]
    longest = F.array_max(F.transform(F.split(v, "[^0-9]+", -1), lambda x: F.length(x)))
    flags = [
        v.rlike(r"^\+"), v.rlike(rf"^{PART}(?:\.{PART}){{3}}$"), F.length(digits).between(12, 19) & F.call_function("luhn_check", digits),
        v.rlike(r"^[^@]+@[^@.]+(?:\.[^@.]+)+$"), v.rlike(r"\.[A-Za-z]{2,}$"), v.rlike(r"(?i)\bat\b|\(at\)"),
        left.rlike(r"(?:tel|phone|call|mobile|fax)[^a-z]*$"), left.rlike(r"(?:mail|contact|write|reach)[^a-z]*$"),
        left.rlike(r"(?:card|visa|account|iban|pay)[^a-z]*$"), left.rlike(r"(?:ip|host|server|addr|address)[^a-z]*$"),
        left.rlike(r"[0-9a-z]$"), c["right"].rlike("^[0-9A-Za-z]"), left.rlike(r"[.,]$"),
    ]
    return [x.cast("double") for x in (*counts, longest)] + [flag(x) for x in flags]


@dataclass
class Judge:
    """Boosted trees as a column expression, and the least score of a span that is added."""

    trees: list[tuple[float, list]]
    least: float

    def score(self, features: list[Column]) -> Column:
        """Probability of being personal, 0 to 1."""
        total = F.lit(0.0)
        for weight, tree in self.trees:
            total = total + F.lit(weight) * _branch(tree, features)
        return 1 / (1 + F.exp(-2 * total))


def _branch(tree: list, features: list[Column]) -> Column:
    if len(tree) == 1:
        return F.lit(tree[0])
    feature, bound, low, high = tree
    return F.when(features[feature] <= bound, _branch(low, features)).otherwise(_branch(high, features))


def _parsed(lines: list[str]) -> list:
    """A tree from the indented description that a fitted tree gives of itself."""
    line = lines.pop(0).strip()
    if line.startswith("Predict"):
        return [float(line.split(":")[1])]
    feature, bound = re.match(r"If \(feature (\d+) <= (\S+)\)", line).groups()
    low = _parsed(lines)
    lines.pop(0)  # the matching Else
    return [int(feature), float(bound), low, _parsed(lines)]


def _overlaps(c: Column, spans: list[Column]) -> Column:
    hit = F.lit(False)
    for s in spans:
        hit = hit | F.exists(s, lambda p: (p["start"] < c["end"]) & (c["start"] < p["end"]))
    return hit


def _examples(c: Column, base: list[Column]) -> Column:
    """What a candidate teaches: structs of (value, left, right, label), none if it is in doubt.

    Spans that overlap a base span are never added, so they don't stand for what may be: from an
    address its spelt-out forms are made, from a phone its number without the plus, and these are the
    positives. Other candidates are negatives, but those in doubt: numbers and addresses after a word
    that announces one, numbers with a code in brackets, and addresses spelt out in full.
    """
    v, left = c["value"], F.lower(c["left"])
    name, host = F.substring_index(v, "@", 1), F.regexp_replace(F.substring_index(v, "@", -1), "[^A-Za-z0-9]+$", "")
    example = lambda value, label: F.struct(value.alias("value"), c["left"].alias("left"), c["right"].alias("right"), F.lit(label).alias("label"))
    spelt = [F.concat(name, F.lit(at), F.regexp_replace(host, r"\.", dot)) for at, dot in ((" at ", " dot "), (" (at) ", " (dot) "), ("[at]", "[dot]"))]
    none = F.filter(F.array(example(v, 0.0)), lambda x: F.lit(False))
    made = F.when(v.rlike(r"@.*\."), F.array(*[example(x, 1.0) for x in spelt])).when(v.startswith("+"), F.array(example(F.substr(v, F.lit(2)), 1.0))).otherwise(none)
    cue = left.rlike(r"(?:tel|phone|call|mobile|fax|mail|contact|write|reach|card|visa|account|iban|pay)[^a-z]*$")
    doubt = cue | v.rlike(r"\([0-9]+\)") | v.rlike(r"(?i)[(\[{]at[)\]}]|\sat\s.*dot")
    return F.when(_overlaps(c, base), made).when(doubt, none).otherwise(F.array(example(v, 0.0)))


def learn_judge(found: DataFrame, sample: int = SAMPLE, precision: float = PRECISION) -> Judge | None:
    """Boosted trees that tell disguised personal data from other candidates; None where either is absent.

    Distinct examples of all candidates are counted. At most half of ``sample`` of each label, in the
    order of a hash, are fitted; all examples, by their counts, give the least score at which the share
    of personal ones is ``precision``, also where they are few.
    """
    base = [F.col(f"_{k}") for k in KINDS[:4]]
    rows = found.where(F.size("_candidates") > 0).select(F.explode(F.flatten(F.transform("_candidates", lambda c: _examples(c, base)))).alias("c"))
    rows = rows.select("c.*").groupBy("value", "left", "right", "label").agg(F.count("*").alias("n"))
    rows = materialise(rows.withColumn("key", F.xxhash64("value", "left")), "pii-examples")
    names = [f"f{i}" for i in range(23)]
    features = [f.alias(n) for n, f in zip(names, _features({k: F.col(k) for k in ("value", "left", "right")}))]
    parts = [rows.where(F.col("label") == k).orderBy("key", "value", "left", "right").limit(sample // 2) for k in (0.0, 1.0)]
    drawn = materialise(parts[0].union(parts[1]).select("label", *features), "pii-sample")
    if drawn.select("label").distinct().count() < 2:
        return None
    vectors = VectorAssembler(inputCols=names, outputCol="features").transform(drawn)
    model = GBTClassifier(maxIter=12, maxDepth=4, seed=5).fit(vectors.select("features", "label"))
    trees = [(float(w), _parsed(t.toDebugString.splitlines()[1:])) for w, t in zip(model.treeWeights, model.trees)]
    judge = Judge(trees, 1.01)
    kept = rows.select("label", "n", *features)
    steps = F.floor(judge.score([F.col(c) for c in names]) * 100).alias("step")
    kept = kept.groupBy(steps).agg(F.sum(F.col("label") * F.col("n")).alias("good"), F.sum("n").alias("n"))
    good = n = 0
    for r in sorted(kept.collect(), key=lambda r: -r["step"]):  # 101 rows at most
        good, n = good + r["good"], n + r["n"]
        if good >= precision * n:
            judge.least = r["step"] / 100
    judge.least = max(judge.least, 0.5)
    return judge


def find_personal(docs: DataFrame, keep: list[str] | None = None, sample: int = SAMPLE) -> DataFrame:
    """For each row of ``docs``: ``keep`` (doc_id by default) and ``spans``, of (start, kind, end).

    ``kind`` is a place in ``KINDS``; starts and ends count code points, ends exclusive; base spans all
    stay, spans of the method are added where they overlap none. A null or empty text has none;
    repeated rows each give a row; other columns are ignored, and ``keep`` may have any names but those
    that start with an underscore; an empty table gives no rows. A text of any length is searched whole.

    Whole texts are read once; places and candidates are written, far smaller, then judged.
    """
    keep = keep or ["doc_id"]
    found = materialise(_all_places(docs, keep), "places")
    judge = learn_judge(found, sample)
    spans = lambda places, kind: F.transform(places, lambda p: F.struct(p["start"].alias("start"), F.lit(kind).alias("kind"), p["end"].alias("end")))
    parts = [spans(F.col(f"_{k}"), i) for i, k in enumerate(KINDS[:4])]
    if judge:
        base = [F.col(f"_{k}") for k in KINDS[:4]]
        good = F.filter("_candidates", lambda c: ~_overlaps(c, base) & (judge.score(_features(c)) >= judge.least))
        parts.append(spans(good, 4))
    return found.select(*keep, F.array_sort(F.array_distinct(F.concat(*parts))).alias("spans"))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda i: F.size(F.filter("spans", lambda s: s["kind"] == i)).cast("long")
    counts = [count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:4])]
    digest = F.sha2(_listed(F.filter("spans", lambda s: s["kind"] < 4)), 256).alias("base_sha256")
    return found.select("doc_id", *counts, digest, _listed(F.col("spans")).alias("spans"))
