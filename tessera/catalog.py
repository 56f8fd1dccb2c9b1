"""All queries of the library proper, by key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import registry
from tessera.plans import expression_queries, model_queries, prepare_queries, spatial_queries, statistics_queries  # noqa: F401  they register


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.QUERIES["flagship_flux_by_age"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.ORACLES)
