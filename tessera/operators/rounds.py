"""What iterative operators share: cutting lineage, and labels of connected components."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names for driver and executors to share. Only a local session may be without; it then
    gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df as a table written to the shared folder, so that a round's plan doesn't hold all rounds before, a lost executor
    costs a read, and Catalyst knows how large it is."""
    path = f"{shared_folder(df.sparkSession)}/round-{uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def component_labels(pairs: DataFrame) -> DataFrame:
    """(node, component) of pairs (a, b): the least node that pairs lead to, both ways.

    Each round a node takes the least label next to it and then that label's own label, so a chain halves; the end is a
    round without change.
    """
    both = cut(pairs.select("a", "b").union(pairs.select("b", "a")).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("component")))
    while True:
        heard = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("heard"))
        lower = labels.join(heard, "node").select("node", F.col("component").alias("was"), F.least("component", "heard").alias("component"))
        roots = lower.select(F.col("node").alias("component"), F.col("component").alias("root"))
        moved = cut(lower.join(roots, "component", "left").select("node", "was", F.least("component", F.coalesce("root", "component")).alias("component")))
        labels = moved.select("node", "component")
        if moved.where("was <> component").isEmpty():
            return labels
