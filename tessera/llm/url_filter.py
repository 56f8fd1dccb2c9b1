"""URL rules looked up through a cascade of Bloom filters that is exact over a corpus."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.tables import drop_files, materialise, read_table

#: Bits that a cascade may hold, about. A longer list is dealt into shares with a cascade each.
MOST_BITS = 1 << 23
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Level:
    """One Bloom filter: its 64-bit words, its number of hashes, and its number as hash seed."""

    words: tuple[int, ...]
    hashes: int
    seed: int


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host, lower-cased A-Z, and path of a URL; both empty without ``://`` or for null."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^?#]*)", 1)
    rest = F.coalesce(rest, F.lit(""))
    host = F.substring_index(rest, "/", 1)
    return F.translate(host, UPPER, LOWER), F.substring(rest, F.length(host) + 1, F.length(rest))


def _positions(key: Column, level: Level) -> list[Column]:
    """The bits of a key in a level, by double hashing."""
    bits = 64 * len(level.words)
    low = F.lit((1 << 31) - 1).cast("long")
    one, two = F.xxhash64(key, F.lit(level.seed)).bitwiseAND(low), F.xxhash64(F.lit(level.seed), key).bitwiseAND(low)
    return [F.pmod(one + two * F.lit(i), F.lit(bits).cast("long")) for i in range(level.hashes)]


def _passes(key: Column, level: Level) -> Column:
    words = F.lit(list(level.words)).cast("array<bigint>")
    found = F.lit(True)
    for at in _positions(key, level):
        word = F.get(words, F.floor(at / 64).cast("int"))
        found = found & (F.call_function("shiftrightunsigned", word, (at % 64).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1)
    return found


def in_cascade(key: Column, levels: list[Level]) -> Column:
    """Whether a key of the universe is listed: the first level that it fails decides.

    Even levels hold listed keys, odd levels the unlisted ones that passed the level before, so a key
    that fails an even level is unlisted and one that fails an odd level is listed.
    """
    if not levels:
        return F.lit(False)
    answer = F.lit(len(levels) % 2 == 1)
    for depth in reversed(range(len(levels))):
        answer = F.when(~_passes(key, levels[depth]), F.lit(depth % 2 == 1)).otherwise(answer)
    return answer


def _filled(keys: DataFrame, n: int, rate: float, seed: int) -> Level:
    """A level that holds ``keys``: bits are set by a grouped ``bit_or``, word by word."""
    words = max(1, math.ceil(n * -math.log(rate) / math.log(2) ** 2 / 64))
    level = Level((0,) * words, max(1, round(words * 64 / n * math.log(2))), seed)
    at = keys.select(F.explode(F.array(*_positions(F.col("key"), level))).alias("at"))
    bit = F.expr("shiftleft(1L, cast(at % 64 as int))")
    held = at.select(F.floor(F.col("at") / 64).alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    full = [0] * words
    for r in held.collect():  # one row for each word of the filter, bounded by MOST_BITS
        full[r["word"]] = r["bits"]
    return Level(tuple(full), level.hashes, seed)


def build_cascade(listed: DataFrame, universe: DataFrame) -> list[Level]:
    """Levels that tell listed keys from all other keys of ``universe`` without error.

    Both tables have one column ``key``. The first level is sized by how many unlisted keys there are
    for a listed one, the others let half through. Keys that still need telling apart are written
    once and shrink with each level.
    """
    ours = materialise(listed.where("key is not null").distinct(), "listed")
    n = ours.count()
    if not n:
        return []
    others = universe.where("key is not null")
    m = others.agg(F.approx_count_distinct("key").alias("m")).first()["m"]
    rate = min(0.5, max(1e-6, n * math.sqrt(0.5) / max(m, 1)))
    levels = [_filled(ours, n, rate, 0)]
    both = others.where(_passes(F.col("key"), levels[0])).select("key", F.lit(False).alias("ours")).union(ours.select("key", F.lit(True)))
    passed = both.groupBy("key").agg(F.max("ours").alias("ours")).where("not ours").select("key")
    inside, outside = ours, materialise(passed, "passed")
    while n := outside.count():
        level = _filled(outside, n, 0.5, len(levels))
        levels.append(level)
        left = materialise(inside.where(_passes(F.col("key"), level)), "passed")
        if inside is not ours:
            drop_files(inside)
        inside, outside = outside, left
    for table in {id(t): t for t in (ours, inside, outside)}.values():
        drop_files(table)
    return levels


def _shapes(rules: list[tuple[str, str, str]]) -> list[tuple[int, int]]:
    """How many labels of the host and characters of the path the rules look at, longest first."""
    return sorted({(h.count(".") + 1, len(p)) for _, h, p in rules}, key=lambda s: (-s[0], -s[1]))


def _keys(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """For each shape, the rule that would fit a URL: its last labels and the start of its path."""
    return F.array(*[F.concat(F.substring_index(host, ".", -labels), F.substring(path, 1, chars)) for labels, chars in shapes])


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with columns host, path, rule and verdict.

    ``rules``: (verdict, host, path), verdict ``allow`` or ``block``. A rule fits its host and all
    subdomains if the path starts with the rule's; the longest that fits wins, of equally long ones that
    of the longer host; a page that none fits gets a null rule and ``default``. A null URL or one without
    ``://`` has an empty host and path; a URL of any length is read whole. Columns of ``pages`` that have
    the names of the new ones are replaced. Rules that repeat a host and path are one; with another
    verdict they are refused. Repeated pages each give a row. An empty table gives no rows.

    A page's candidate keys are as many as the rules have shapes (labels, path length). All keys of
    the corpus are the universe of a cascade over the rules, so that looking a key up in it is exact
    and takes no join: the filters, of about ``MOST_BITS``, are literals of the plan. A longer list is
    dealt into shares by a hash; pages are looked up in one share's cascade after the other.
    """
    rules = [r for r in rules if not r[2] or r[2].startswith("/")]  # no path starts otherwise
    verdicts: dict[str, str] = {}
    for verdict, host, path in rules:
        if verdicts.setdefault(host + path, verdict) != verdict:
            raise ValueError(f"two verdicts for {host}{path}")
    spark, shapes = pages.sparkSession, _shapes(rules)
    drop = [c for c in ("host", "path", "rule", "verdict") if c in pages.columns and c != url]
    address = F.col(url)
    host, path = url_parts(address)
    parts = pages.withColumn("_url", address).drop(*drop).withColumns({"host": url_parts(F.col("_url"))[0], "path": url_parts(F.col("_url"))[1]}).drop("_url")
    if not rules:
        return parts.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    table = lambda keys: spark.range(1).select(F.explode(F.lit(sorted(keys)).cast("array<string>")).alias("key"))
    universe = pages.select(F.explode(F.array_distinct(_keys(host, path, shapes))).alias("key"))
    shares = 1 + 32 * len(verdicts) // MOST_BITS  # at some 14 bits a key, all levels together
    parts = parts.withColumn("_best", F.lit(None).cast("struct<key: string, verdict: string>"))
    for s in range(shares):
        own = lambda k: F.pmod(F.xxhash64(k, F.lit("share")), F.lit(shares)) == s  # noqa: E731, B023
        listed, blocked = (t.where(own(F.col("key"))) for t in (table(verdicts), table(k for k, v in verdicts.items() if v == "block")))
        levels, which = build_cascade(listed, universe.where(own(F.col("key")))), build_cascade(blocked, listed)
        keys = F.array_distinct(_keys(F.col("host"), F.col("path"), shapes))
        fit = F.filter(keys, lambda k: own(k) & in_cascade(k, levels))
        verdict = lambda k: F.when(in_cascade(k, which), "block").otherwise("allow")  # noqa: E731, B023
        new = lambda k: F.struct(k.alias("key"), verdict(k).alias("verdict"))  # noqa: E731, B023
        longest = F.aggregate(fit, F.lit(None).cast("string"), lambda a, k: F.when(a.isNull() | (F.length(k) > F.length(a)), k).otherwise(a))
        parts = parts.withColumn("_key", longest)
        labels = lambda k: F.size(F.split(F.substring_index(k, "/", 1), "[.]"))
        old, k = F.col("_best.key"), F.col("_key")
        better = old.isNull() | (F.length(k) > F.length(old)) | ((F.length(k) == F.length(old)) & (labels(k) > labels(old)))
        parts = parts.withColumn("_best", F.when(k.isNotNull() & better, new(k)).otherwise(F.col("_best"))).drop("_key")
        if shares > 1:
            parts = materialise(parts, "judged")
    rule, verdict = F.col("_best.key"), F.coalesce(F.col("_best.verdict"), F.lit(default))
    return parts.withColumns({"rule": rule, "verdict": verdict}).drop("_best")


#: The contract's rules.
OP1_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read_table(spark, sf_dir, "pages").select("page_id", "url"), OP1_RULES).select("page_id", "host", "path", "rule", "verdict")


OP1_SQL = """
WITH u AS (
  SELECT row_number() OVER () AS nth, page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN ''
    ELSE regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') END AS rest FROM pages),
p AS (SELECT nth, page_id, translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  substr(rest, length(regexp_extract(rest, '^[^/]*')) + 1) AS path FROM u),
r(verdict, rhost, rpath) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'),
  ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
f AS (SELECT nth, max_by(rhost || rpath, length(rhost || rpath)) AS rule, max_by(verdict, length(rhost || rpath)) AS verdict
  FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY nth)
SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN f USING (nth)
"""
