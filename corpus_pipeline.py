"""A training corpus from ``documents``, stage by stage; each stage is written and read again.

Null and empty texts, texts without a letter, and those whose language is too close a call go in the first
stage. Rows that repeat a doc_id are judged each by its own text; near-dedup leaves one of them, or none.
Rows without a doc_id pass near-dedup. Texts of any length are read whole. Columns beside ``doc_id``,
``text`` and ``lang`` may have any names and are handed on by all stages but the last. An empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.decontaminate import drop_contaminated
from tessera.llm.language import keep_known_languages
from tessera.llm.packing import pack
from tessera.llm.secret_scan import redact_secrets
from tessera.llm.simhash import drop_near_copies
from tessera.llm.tokens import bounded_batches
from tessera.plans.tables import materialise, read_table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an identifiable language go: no letter, or so close a call that labelled
    documents show such calls to be more often wrong than right."""
    bounded_batches(spark)  # for this and all later stages of the session
    return keep_known_languages(docs, least=None)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity 0.8 or more."""
    return drop_near_copies(docs, words=5, similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; all documents stay."""
    return redact_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens."""
    return pack(docs, ids=False).drop("ids")


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("packing", packing),
]

#: SQL can't express learnt profiles, hashing with covering masks, latent vectors or automata.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
