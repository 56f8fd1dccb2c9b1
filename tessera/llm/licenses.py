"""License detection by ordered signature rules, with column functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.license_rules import Rule, license_rules
from tessera.plans.tables import read_table

#: Everything that is not part of a word; letters A-Z count as those of a lower-cased text.
BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
PLACES = "array<struct<rule: int, start: long, end: long>>"


def normalised(text: Column) -> Column:
    """The words of a text with one blank before and after each; a blank if none."""
    words = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), BREAKS, " "))
    return F.when(words == "", F.lit(" ")).otherwise(F.concat(F.lit(" "), words, F.lit(" ")))


def _blanks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _places(words: Column, rule: Column) -> Column:
    """Detections of one rule in order: its place in the list, first word, and word after the last."""
    pattern = F.concat(F.lit("(?i) (?:"), rule["pattern"], F.lit(")(?= )"))  # folds A-Z alone
    gaps = F.transform(F.split(words, pattern, -1), _blanks)
    found = F.transform(F.regexp_extract_all(words, pattern, F.lit(0)), _blanks)
    none = F.expr(f"cast(array() as {PLACES})")

    def add(state: Column, i: Column) -> Column:
        start = state["at"] + F.get(gaps, i)
        end = start + F.get(found, i)
        place = F.struct(rule["rule"].alias("rule"), start.cast("long").alias("start"), end.cast("long").alias("end"))
        return F.struct(end.cast("long").alias("at"), F.concat(state["all"], F.array(place)).alias("all"))

    empty = F.struct(F.lit(0).cast("long").alias("at"), none.alias("all"))
    return F.when(F.size(found) > 0, F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), empty, add)["all"]).otherwise(none)


def detect_licenses(docs: DataFrame, rules: list[Rule] | None = None, keep: list[str] | None = None) -> DataFrame:
    """``doc_id, n_words, places`` for each row of ``(doc_id, text)``; ``keep`` names more columns.

    ``places`` is an array of (label, start, end, score, base) over words counted from 0, end
    exclusive. Base rules report every place. A place of another rule is dropped if it lies in a place
    of a rule of higher priority, or in a longer one of the same, or is one of several alike and not
    the first in rule order. A null or empty text has no words and no places; repeated rows each give
    a row; ``docs`` may hold columns of any other names.

    A text is searched only for the rules whose root and keyword it has, so most texts cost one pass
    that finds their words and a few substring searches. A text of any length is searched whole.
    """
    rules = rules or license_rules()
    told = F.array(*[F.struct(F.lit(r.label).alias("label"), F.lit(r.priority).alias("priority"), F.lit(r.score).alias("score"), F.lit(r.base).alias("base")) for r in rules])
    rows = docs.select("doc_id", *(keep or []), normalised(F.col("text")).alias("_words"))
    rows = rows.withColumn("_low", F.lower("_words"))  # for the gates: it folds more than A-Z
    none = F.expr(f"cast(array() as {PLACES})")
    parts = []
    for root in dict.fromkeys(r.root for r in rules):
        own = [F.struct(F.lit(i).alias("rule"), F.lit(r.keyword).alias("keyword"), F.lit(r.pattern).alias("pattern")) for i, r in enumerate(rules) if r.root == root]
        hits = F.filter(F.array(*own), lambda r: F.contains(F.col("_low"), r["keyword"]))
        parts.append(F.when(F.contains("_low", F.lit(root)), F.flatten(F.transform(hits, lambda r: _places(F.col("_words"), r)))).otherwise(none))
    found = F.concat(*parts)
    rows = rows.select("doc_id", *(keep or []), (F.greatest(_blanks(F.col("_words")), F.lit(1)) - 1).cast("long").alias("n_words"), found.alias("_found"))

    def stays(d: Column) -> Column:
        own = F.get(told, d["rule"])

        def hides(e: Column) -> Column:
            other = F.get(told, e["rule"])
            inside = (e["start"] <= d["start"]) & (e["end"] >= d["end"]) & (e["rule"] != d["rule"])
            same = (e["start"] == d["start"]) & (e["end"] == d["end"])
            stronger = (other["priority"] > own["priority"]) | ((other["priority"] == own["priority"]) & (~same | (e["rule"] < d["rule"])))
            return inside & stronger

        return own["base"] | ~F.exists(F.col("_found"), hides)

    def shown(d: Column) -> Column:
        own = F.get(told, d["rule"])
        return F.struct(own["label"].alias("label"), d["start"].alias("start"), d["end"].alias("end"), own["score"].alias("score"), own["base"].alias("base"))

    places = F.when(F.size("_found") > 0, F.transform(F.filter("_found", stays), shown))
    empty = F.expr("cast(array() as array<struct<label: string, start: long, end: long, score: double, base: boolean>>)")
    return rows.select("doc_id", *(keep or []), "n_words", F.coalesce(places, empty).alias("places"))


def op10_license_scan(spark, sf_dir: str) -> DataFrame:
    found = detect_licenses(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("places", lambda p: p["base"])
    labels = lambda places: F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")
    starts = F.transform("base", lambda p: p["start"])
    return found.withColumn("base", base).select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(F.col("base")).alias("base_labels"), labels(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p["score"])), F.lit(0.0)).alias("score"),
    )
