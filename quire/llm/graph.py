"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import drop, save


def components(links: DataFrame) -> DataFrame:
    """``node, component`` of links ``a, b``: the smallest node that each node reaches.

    Each round points every node at the smallest label among its own and its neighbours', then at
    that label's own label, so paths halve; rounds go on until no label changes. Labels are
    written to the shared folder in each round, which cuts the lineage. Links of a node with
    itself are allowed; labels of a round are minima, combined before they are shuffled.
    """
    both = save(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = save(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("component")).select(
        F.col("a").alias("node"), "component"), "labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), F.col("component").alias("l")), "b")
        lower = save(seen.groupBy("a").agg(F.min("l").alias("l")), "lower")
        stepped = labels.join(lower, labels["node"] == lower["a"]).select(
            "node", F.least("component", "l").alias("next"), F.col("component").alias("old"))
        jump = labels.select(F.col("node").alias("next"), F.col("component").alias("far"))
        moved = save(stepped.join(jump, "next").select(
            "node", F.least("next", "far").alias("component"),
            (F.least("next", "far") < F.col("old")).alias("changed")), "labels")
        changed = moved.where("changed").limit(1).count()
        drop(lower)
        drop(labels)
        labels = moved
        if not changed:
            drop(both)
            return labels.select("node", "component")
