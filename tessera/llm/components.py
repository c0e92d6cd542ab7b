"""Connected components of an edge table, by iterated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import discard, keep


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of edges (a, b): the smallest node that links reach.

    Labels start as the nodes. Each round every node takes the smallest label next to it, and then its label's label;
    the end is a round without change. Each round is written, so lineage stays short; hubs meet their edges in joins
    that Spark can split, and minima are taken before the shuffle as well as after.
    """
    both = keep(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("component")))
    while True:
        heard = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("heard"))
        lower = labels.join(heard, "node").select("node", F.col("component").alias("was"), F.least("component", "heard").alias("component"))
        next_ = lower.select(F.col("node").alias("component"), F.col("component").alias("root"))
        moved = keep(lower.join(next_, "component", "left").select("node", "was", F.coalesce(F.least("root", "component"), "component").alias("component")))
        discard(labels)
        labels = moved.select("node", "component")
        labels._tessera_path = moved._tessera_path
        if moved.where(F.col("was") != F.col("component")).isEmpty():
            return labels
