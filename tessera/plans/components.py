"""Connected components of an edge table as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.tables import drop_files, materialise


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """``(node, component)`` for every node that has an edge; component is its smallest node.

    Each round takes the smallest label around each node by a combinable ``min``, hooks the old
    label's node to it as well, and then follows labels twice. Every round is written to the shared
    folder, so lineage stays short, and no link or label reaches the driver but the number of changes.
    Null ends, loops and repeated edges have no effect; an empty table gives an empty result.
    """
    a, b = F.col(u), F.col(v)
    both = edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(a.alias("a"), b.alias("b"))
    both = materialise(both.union(both.select(F.col("b"), F.col("a"))).distinct(), "edges")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    while True:
        of = labels.select(F.col("node").alias("b"), F.col("label").alias("other"))
        near = both.join(of, "b").groupBy(F.col("a").alias("node")).agg(F.min("other").alias("low"))
        moved = labels.join(near, "node").select("node", "label", F.least("label", "low").alias("low"))
        hooked = moved.where("low < label").select(F.col("label").alias("node"), "low")
        best = moved.select("node", "low").union(hooked).groupBy("node").agg(F.min("low").alias("low"))
        best = labels.join(best, "node").select("node", "label", F.least("label", "low").alias("low"))
        up = best.select(F.col("node").alias("low"), F.col("low").alias("top"))
        new = best.join(up, "low", "left").select("node", F.coalesce("top", "low").alias("component"), "label")
        new = materialise(new, "labels")
        changed = new.where("component != label").limit(1).count()
        drop_files(labels)
        labels = new.select("node", F.col("component").alias("label"))
        if not changed:
            drop_files(both)
            return labels.select("node", F.col("label").alias("component"))
