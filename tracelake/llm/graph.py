"""Connected components over an edge table, by repeated minimum and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep


def components(edges: DataFrame) -> DataFrame:
    """``(node, label)`` for every node of ``edges(a, b)``; label is the smallest node reachable.

    Each round takes the minimum over the neighbours and then follows labels twice, so a chain
    shrinks to a fraction in every round. A round is written to the shared folder, which cuts
    the lineage; the driver only sees the number of changes. Sums over a node with very many
    edges are combined before the shuffle, and joins on it are left to adaptive splitting.
    Nodes are not null. An empty edge table gives an empty result.
    """
    both = keep(
        edges.select("a", "b").where("a <> b").union(edges.select("b", "a").where("a <> b")).toDF("a", "b").distinct()
    )
    labels = keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        around = (
            both.join(labels.select(F.col("node").alias("b"), "label"), "b")
            .groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        )
        stepped = labels.join(around, "node").select(
            "node", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        at = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        jumped = stepped.join(at, "label", "left").select(
            "node", F.least("label", F.coalesce("next", "label")).alias("label"), "was")
        jumped = keep(jumped)
        changed = jumped.where("label <> was").limit(1).count()
        labels = jumped.select("node", "label")
        if not changed:
            return labels
