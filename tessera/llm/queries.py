"""The queries of this subpackage, by key, and their oracle SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from tessera.llm.alignment import op13_token_alignment
from tessera.llm.best_fit_packing import op12_best_fit_packing
from tessera.llm.decontaminate import op9_decontamination
from tessera.llm.language import op7_language_id
from tessera.llm.licenses import op10_license_scan
from tessera.llm.merkle import OP11_SQL, op11_merkle_manifest
from tessera.llm.packing import op8_packing
from tessera.llm.personal_data import op6_personal_data
from tessera.llm.secret_scan import op4_secret_scan
from tessera.llm.simhash import op5_simhash_near_dedup
from tessera.llm.token_files import op2_token_files
from tessera.llm.tokens import bounded_batches
from tessera.llm.topk import OP3_SQL, op3_exact_top_k
from tessera.llm.url_filter import OP1_SQL, op1_url_filter


def _prepared(query: Callable) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        bounded_batches(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict:
    found = {
        "op1_url_filter": op1_url_filter,
        "op2_token_files": op2_token_files,
        "op3_exact_top_k": op3_exact_top_k,
        "op4_secret_scan": op4_secret_scan,
        "op5_simhash_near_dedup": op5_simhash_near_dedup,
        "op6_personal_data": op6_personal_data,
        "op7_language_id": op7_language_id,
        "op8_packing": op8_packing,
        "op9_decontamination": op9_decontamination,
        "op10_license_scan": op10_license_scan,
        "op11_merkle_manifest": op11_merkle_manifest,
        "op12_best_fit_packing": op12_best_fit_packing,
        "op13_token_alignment": op13_token_alignment,
        "pipeline": corpus_pipeline.run,
    }
    return {key: _prepared(query) for key, query in found.items()}


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": OP1_SQL, "op3_exact_top_k": OP3_SQL, "op11_merkle_manifest": OP11_SQL}
