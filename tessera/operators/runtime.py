"""Aggregation of runtime records: (route, symbol, duration_ms, error, ts, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(duration: Column) -> Column:
    """The duration if it is a finite number that isn't negative."""
    return F.when(duration.isNotNull() & ~F.isnan(duration) & (duration >= 0) & (duration < float("inf")), duration)


def nearest_rank(c: str, p: float) -> Column:
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {c})")


def aggregate(records: DataFrame, key: str) -> DataFrame:
    """(key, count, errors, error_rate, p50, p95, p99, first, last, symbols, confidence) of each value of key.

    Percentiles are by nearest rank, over usable durations; all records count. Three records make confidence high.
    """
    rows = records.where(F.col(key).isNotNull()).withColumn("_d", usable(F.col("duration_ms")))
    errors = F.sum(F.col("error").cast("long"))
    return rows.groupBy(F.col(key).cast("string").alias("key")).agg(F.count("*").alias("count"), errors.alias("errors"), F.round(errors / F.count("*"), 6).alias("error_rate"), nearest_rank("_d", 0.5).alias("p50"), nearest_rank("_d", 0.95).alias("p95"), nearest_rank("_d", 0.99).alias("p99"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.countDistinct("symbol").alias("symbols"), F.when(F.count("*") >= 3, "high").otherwise("medium").alias("confidence"))


def aggregate_kinds(records: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """aggregate() by several keys at once: one pass over the records, each entering a group of every kind."""
    kinds = F.array(*[F.struct(F.lit(kind).alias("kind"), c.cast("string").alias("key")) for kind, c in keys.items()])
    rows = records.withColumn("_k", F.explode(kinds)).where("_k.key IS NOT NULL").withColumn("_d", usable(F.col("duration_ms")))
    return rows.groupBy("_k.kind", "_k.key").agg(F.count("*").alias("count"), F.sum(F.col("error").cast("long")).alias("errors"), nearest_rank("_d", 0.95).alias("p95"))


def samples(records: DataFrame, key: str, message: str, order: str, n: int = 3) -> DataFrame:
    """(key, samples): the first n messages in order. Only n a task are kept before the shuffle."""
    from pyspark.sql import Window

    first = Window.partitionBy(key).orderBy(order)
    rows = records.where(F.col(message).isNotNull()).withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= n)
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", message))), lambda r: r[message].cast("string")), "|").alias("samples"))


def stale(records: DataFrame, key: str, days: int = 30) -> DataFrame:
    """(key, last, stale): whether the last record is more than `days` before the newest of all."""
    newest = records.agg(F.max("ts")).scalar()
    return records.groupBy(key).agg(F.max("ts").alias("last")).withColumn("now", newest).select(key, "last", ((F.unix_micros("now") - F.unix_micros("last")) / 86_400_000_000 > days).alias("stale"))


def facts(records: DataFrame) -> DataFrame:
    """(record_id, kind, target): up to three facts of a record: its route, its symbol, its error."""
    made = F.array(F.struct(F.lit("route").alias("kind"), F.col("route").alias("target")), F.struct(F.lit("symbol").alias("kind"), F.col("symbol").cast("string").alias("target")), F.struct(F.lit("error").alias("kind"), F.when(F.col("error"), F.concat(F.lit("error:"), F.col("k").cast("string"))).alias("target")))
    return records.select("record_id", F.explode(made).alias("f")).select("record_id", "f.kind", "f.target").where("target IS NOT NULL")

