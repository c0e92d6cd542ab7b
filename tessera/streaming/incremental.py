"""Incremental variants as Structured Streaming: windows over late records, deduplication, and upserts of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def windowed_counts(records: DataFrame, every: str = "1 hour", late: str = "2 days") -> DataFrame:
    """(start, route, n, errors) of a stream of records (route, error, ts), records later than `late` left out."""
    return records.withWatermark("ts", late).groupBy(F.window("ts", every), "route").agg(F.count("*").alias("n"), F.sum(F.col("error").cast("long")).alias("errors")).select(F.col("window.start").alias("start"), "route", "n", "errors")


def first_seen(records: DataFrame, key: str, late: str = "2 days") -> DataFrame:
    """The stream with each key once; state older than the watermark is dropped."""
    return records.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def run(stream: DataFrame, folder: str, mode: str = "append") -> None:
    """All that is there now, written to folder/data; folder/state holds what a restart needs."""
    stream.writeStream.outputMode(mode).format("parquet").option("path", f"{folder}/data").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()


def run_complete(stream: DataFrame, folder: str) -> None:
    """All that is there now: each batch's whole result takes the place of folder/data, written by the executors."""
    sink = lambda df, _: df.write.mode("overwrite").parquet(f"{folder}/data")
    stream.writeStream.outputMode("complete").foreachBatch(sink).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()


def upsert(batch: DataFrame, batch_id: int, folder: str, key: str, order: str) -> None:
    """foreachBatch: a new version of the table with the batch's last row of each key in place of older ones.

    Versions are folders by batch, so a batch that is repeated after a failure overwrites its own version only.
    """
    spark = batch.sparkSession
    last = batch.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))).where("_n = 1").drop("_n")
    if batch_id:
        old = spark.read.parquet(f"{folder}/v{batch_id - 1}")
        last = old.join(last.select(key), key, "left_anti").unionByName(last)
    last.write.mode("overwrite").parquet(f"{folder}/v{batch_id}")
