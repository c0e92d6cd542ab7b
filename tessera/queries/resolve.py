"""Resolution queries, and streams that are run to their end."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from tessera.operators import resolve as R
from tessera.operators.rounds import shared_folder
from tessera.sources.bindings import RUNTIME_SQL, SYMBOLS_SQL, TOUCHES_SQL
from tessera.streaming import incremental as S


def _uses(t):
    names = t.raw("part").select(F.col("p_partkey").alias("path"), F.when(F.col("p_partkey") % 6 == 0, F.concat("p_name", F.lit("!"))).otherwise(F.col("p_name")).alias("name"))
    return t.touches.select((F.col("commit_id") * 10 + F.col("touch")).alias("use_id"), (F.col("commit_id") % 97).alias("file_id"), "path").join(names, "path").select("use_id", "file_id", "name")


def _imports(t):
    return t.raw("documents").select(F.col("doc_id").alias("import_id"), F.concat("source", F.lit("/deep")).alias("base"), F.concat(F.lit("../"), ((F.col("doc_id") * 7) % 1500).cast("string"), F.lit("."), F.col("lang")).alias("imported"))


def _stream(t):
    """The runtime records as a file stream, counted by hour, run until all files are read."""
    spark, folder = t.spark, f"{shared_folder(t.spark)}/stream-{uuid4().hex}"
    events = spark.readStream.schema(t.raw("events").schema).option("pathGlobFilter", "*.parquet").parquet(f"{t.folder}/events.parquet*")
    records = events.select(F.col("event_type").alias("route"), (F.col("event_type") == "error").alias("error"), F.col("ts").cast("timestamp").alias("ts"))
    S.run_complete(S.windowed_counts(records), folder)
    return spark.read.parquet(f"{folder}/data").select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "route", "n", "errors")


USES_SQL = f"WITH {SYMBOLS_SQL}, {TOUCHES_SQL}, u AS (SELECT commit_id * 10 + touch AS use_id, commit_id % 97 AS file_id, CASE WHEN p_partkey % 6 = 0 THEN p_name || '!' ELSE p_name END AS name FROM touches JOIN part ON p_partkey = path), a AS (SELECT use_id, count(DISTINCT symbol_id) AS n, min(symbol_id) AS id FROM u JOIN symbols s ON s.file_id = u.file_id AND s.name = u.name GROUP BY 1), b AS (SELECT name, count(*) AS n, min(symbol_id) AS id FROM symbols GROUP BY 1), r AS (SELECT u.use_id, coalesce(a.n, b.n, 0) AS candidates, coalesce(a.id, b.id) AS id, CASE WHEN a.n IS NOT NULL THEN 'same_file' WHEN b.n IS NOT NULL THEN 'project' END AS strategy FROM u LEFT JOIN a ON a.use_id = u.use_id LEFT JOIN b ON b.name = u.name)"

QUERIES = {
    "resolve_names": (lambda t: R.resolve_names(_uses(t), t.symbols), f"{USES_SQL} SELECT use_id, CASE candidates WHEN 0 THEN 'unresolved' WHEN 1 THEN 'resolved' ELSE 'ambiguous' END AS status, candidates, CASE WHEN candidates = 1 THEN id END AS symbol_id, strategy FROM r"),
    "resolve_status_counts": (lambda t: R.resolve_names(_uses(t), t.symbols).groupBy("status").agg(F.count("*").alias("n")), f"{USES_SQL} SELECT CASE candidates WHEN 0 THEN 'unresolved' WHEN 1 THEN 'resolved' ELSE 'ambiguous' END AS status, count(*) AS n FROM r GROUP BY 1"),
    "resolve_relative": (lambda t: R.resolve_relative(_imports(t), t.files), "WITH i AS (SELECT doc_id AS import_id, source || '/' || (doc_id * 7) % 1500 || '.' || lang AS p FROM documents), f AS (SELECT source || '/' || doc_id || '.' || lang AS path FROM documents) SELECT import_id, CASE WHEN path IS NULL THEN 'external' ELSE 'resolved' END AS status, path FROM i LEFT JOIN f ON path = p"),
    "resolve_longest_prefix": (lambda t: R.longest_prefix(t.symbols.select(F.col("qualified_name").alias("name")).distinct(), t.spark.createDataFrame([("Brand#1", "a"), ("Brand#11", "b"), ("Brand#2::E", "c")], "prefix string, target string")), f"WITH {SYMBOLS_SQL} SELECT DISTINCT qualified_name AS name, CASE WHEN qualified_name LIKE 'Brand#2::E%' THEN 'Brand#2::E' WHEN qualified_name LIKE 'Brand#11%' THEN 'Brand#11' ELSE 'Brand#1' END AS prefix, CASE WHEN qualified_name LIKE 'Brand#2::E%' THEN 'c' WHEN qualified_name LIKE 'Brand#11%' THEN 'b' ELSE 'a' END AS target FROM symbols WHERE qualified_name LIKE 'Brand#1%' OR qualified_name LIKE 'Brand#2::E%'"),
    "stream_hourly_counts": (_stream, f"WITH {RUNTIME_SQL} SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, route, count(*) AS n, count(*) FILTER (error) AS errors FROM runtime GROUP BY 1, 2"),
}
