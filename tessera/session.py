"""Session defaults. Every setting is a default only: a cluster's own configuration wins."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cpus: int | None = None, **more: str) -> SparkSession:
    """A local session for tests and benchmarks."""
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    conf = DEFAULTS | {"spark.sql.shuffle.partitions": str(n), "spark.driver.memory": "12g"} | more
    return SparkSession.builder.master(f"local[{n}]").appName("tessera").config(map=conf).getOrCreate()
