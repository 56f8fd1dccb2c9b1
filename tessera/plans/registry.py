"""Registration of queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans.fixtures import view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, *views: str, sql: str | None = None) -> Callable:
    """Register a function of fixture views as a query; ``sql`` is what it must equal."""

    def add(f: Callable) -> Callable:
        QUERIES[key] = lambda spark, sf_dir: f(*[view(spark, sf_dir, v) for v in views])
        if sql:
            ORACLES[key] = with_views(sql)
        return f

    return add
