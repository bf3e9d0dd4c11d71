"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlens.llm.common import hot_keys, materialize, spread_join


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for the nodes of edges(a, b): label is the smallest node of its component.

    Every round takes the smallest label among neighbours and then the label of
    that label, so a path halves each time. Rounds are written tables.
    """
    both = materialize(
        edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges"
    )
    hot = materialize(hot_keys(both.groupBy("b").agg(F.count("*").alias("n")), ["b"], both.count()), "hot")
    labels = materialize(
        both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels"
    )
    while True:
        seen = (
            spread_join(both, labels.select(F.col("node").alias("b"), "label"), ["b"], hot, ["a"])
            .groupBy("a")
            .agg(F.min("label").alias("seen"))
            .select(F.col("a").alias("node"), "seen")
        )
        step = labels.join(seen, "node").select("node", F.col("label").alias("old"), F.least("label", "seen").alias("label"))
        hop = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        step = materialize(
            step.join(hop, "label", "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label")), "labels"
        )
        labels = step.select("node", "label")
        if step.filter("old <> label").isEmpty():
            return labels
