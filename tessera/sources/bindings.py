"""The engine's record tables read from the analytic fixture tables, column by column, without copies or caches.

Commits are orders, file touches are line items (the file is the part), authors are customers, owners are suppliers,
files and chunks are documents, runtime records are events, memory facts are conversation turns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.identity import edge_id


class Tables:
    """The Parquet tables of a folder as record tables; every property is a plan, read when used."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def nodes(self) -> DataFrame:
        """(id, node_type, label, file_id): typed nodes."""
        kinds = [("region", "architecture_component", "r_regionkey", "r_name"), ("nation", "package", "n_nationkey", "n_name"), ("customer", "class", "c_custkey", "c_name"), ("supplier", "interface", "s_suppkey", "s_name"), ("part", "module", "p_partkey", "p_name"), ("orders", "function", "o_orderkey", "o_orderpriority")]

        def of(table: str, kind: str, key: str, label: str) -> DataFrame:
            return self.raw(table).select(_id(table, key).alias("id"), F.lit(kind).alias("node_type"), F.col(label).alias("label"), F.when(F.lit(table) == "part", F.col(key).cast("string")).alias("file_id"))

        return reduce(DataFrame.unionByName, [of(*k) for k in kinds])

    @property
    def edges(self) -> DataFrame:
        """(id, from_id, to_id, edge_type, confidence): typed edges, one for each (from, to, type)."""
        lines = self.raw("lineitem")

        def of(df: DataFrame, a: Column, b: Column, kind: str, confidence: str, distinct: bool = False) -> DataFrame:
            out = df.select(a.alias("from_id"), b.alias("to_id"), F.lit(kind).alias("edge_type"), F.lit(confidence).alias("confidence"))
            return out.distinct() if distinct else out

        parts = [
            of(self.raw("nation"), _id("region", "n_regionkey"), _id("nation", "n_nationkey"), "CONTAINS", "exact"),
            of(self.raw("customer"), _id("nation", "c_nationkey"), _id("customer", "c_custkey"), "CONTAINS", "exact"),
            of(self.raw("customer"), _id("customer", "c_custkey"), _id("nation", "c_nationkey"), "BELONGS_TO", "high"),
            of(self.raw("supplier"), _id("supplier", "s_suppkey"), _id("nation", "s_nationkey"), "BELONGS_TO", "high"),
            of(self.raw("orders"), _id("customer", "o_custkey"), _id("orders", "o_orderkey"), "DEFINES", "exact"),
            of(lines, _id("orders", "l_orderkey"), _id("part", "l_partkey"), "REFERENCES", "medium", True),
            of(lines, _id("supplier", "l_suppkey"), _id("part", "l_partkey"), "DEPENDS_ON", "medium", True),
            of(lines, _id("part", "l_partkey"), _id("supplier", "l_suppkey"), "OWNED_BY", "low", True),
        ]
        return reduce(DataFrame.unionByName, parts).select(edge_id("edge_type", "from_id", "to_id").alias("id"), "from_id", "to_id", "edge_type", "confidence")

    @property
    def files(self) -> DataFrame:
        """(file_id, path, language, size_bytes, content_hash, text)."""
        d = self.raw("documents")
        return d.select(F.col("doc_id").alias("file_id"), F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit("."), F.col("lang"))).alias("path"), F.col("lang").alias("language"), F.octet_length("text").cast("long").alias("size_bytes"), F.sha2("text", 256).alias("content_hash"), "text")

    @property
    def lines(self) -> DataFrame:
        """(file_id, path, line, text): the files' lines, numbered from 1."""
        return self.files.select("file_id", "path", F.posexplode(F.split("text", "\n")).alias("n", "t")).select("file_id", "path", (F.col("n") + 1).cast("long").alias("line"), F.col("t").alias("text"))

    @property
    def symbols(self) -> DataFrame:
        """(symbol_id, name, qualified_name, kind, file_id): parts as symbols, the brand as module."""
        p = self.raw("part")
        return p.select(F.col("p_partkey").alias("symbol_id"), F.col("p_name").alias("name"), F.concat_ws("::", "p_brand", "p_type", "p_name").alias("qualified_name"), F.col("p_type").alias("kind"), (F.col("p_partkey") % 97).alias("file_id"))

    @property
    def commits(self) -> DataFrame:
        """(commit_id, author, committed_at, summary)."""
        return self.raw("orders").select(F.col("o_orderkey").alias("commit_id"), F.col("o_custkey").alias("author"), F.col("o_orderdate").cast("timestamp").alias("committed_at"), F.col("o_orderpriority").alias("summary"))

    @property
    def touches(self) -> DataFrame:
        """(commit_id, touch, path, owner, additions, touched_at)."""
        return self.raw("lineitem").select(F.col("l_orderkey").alias("commit_id"), F.col("l_linenumber").alias("touch"), F.col("l_partkey").alias("path"), F.col("l_suppkey").alias("owner"), F.col("l_quantity").alias("additions"), F.col("l_shipdate").cast("timestamp").alias("touched_at"))

    @property
    def runtime(self) -> DataFrame:
        """(record_id, route, symbol, duration_ms, error, ts, k)."""
        e = self.raw("events")
        return e.select(F.col("event_id").alias("record_id"), F.col("event_type").alias("route"), F.col("user_id").alias("symbol"), F.col("value").alias("duration_ms"), (F.col("event_type") == "error").alias("error"), F.col("ts").cast("timestamp").alias("ts"), F.get_json_object("props", "$.k").cast("long").alias("k"))

    @property
    def vectors(self) -> DataFrame:
        """(target_id, target_kind, vector)."""
        return self.raw("embeddings").select(F.col("vec_id").alias("target_id"), F.col("label").alias("target_kind"), F.col("embedding").alias("vector"))

    @property
    def code(self) -> DataFrame:
        """(file_id, language, path, text): a small source file for each part, in one of five languages in turn.

        A file's number is all that is read, so a million files are a few MB and one task; they are dealt out first.
        """
        k = F.col("p_partkey")
        language = F.get(F.array(*[F.lit(name) for name, _, _ in CODE]), (k % len(CODE)).cast("int"))
        filled = [F.format_string(text.replace("{k}", "%1$d").replace("{m}", "%2$d"), k, k % 7) for _, _, text in CODE]
        paths = [F.format_string(path.replace("{k}", "%1$d"), k) for _, path, _ in CODE]
        at = (k % len(CODE)).cast("int")
        parts = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), self.spark.sparkContext.defaultParallelism)
        return self.raw("part").select("p_partkey").repartition(parts, "p_partkey").select(k.alias("file_id"), language.alias("language"), F.get(F.array(*paths), at).alias("path"), F.get(F.array(*filled), at).alias("text"))

    @property
    def facts(self) -> DataFrame:
        """(fact_id, source, text, created): conversation turns as memory facts."""
        c = self.raw("conversations")
        return c.select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("fact_id"), F.col("role").alias("source"), "text", (F.col("conv_id") * 1000 + F.col("turn")).alias("created"))


#: Templates of source files: language, path, text; {k} is the part's number, {m} that modulo 7.
CODE = [
    ("python", "pkg/mod{k}_test.py", """import os
from pkg.mod{m} import thing
@app.get("/r/{k}")
async def fetch_{k}(self, a, b):
    for x in a.b.c:
        while b {
            requests.post("/s/{m}")
    return thing
class Box{k}:
    def check_{k}(self):
        fetch_{k}(1, 2)
"""),
    ("javascript", "web/page{k}.js", """import z from "./page{m}"
import "node:fs"
router.post("/r/{k}", run)
export const run_{k} = async (x) => { producer.send("topic{m}") }
function load{k}(a) { if (a && b) { fetch("/s/{m}") } }
class Job{k} { }
consumer.subscribe("topic{m}")
"""),
    ("java", "src/main/java/a/b/Svc{k}.java", """package a.b;
import java.util.List;
@RequestMapping("/r/{k}")
public class Svc{k} extends Base{m} implements Run, Stop<A> {
  @Value("${key.{m}:none}")
  public int go{k}(int a) { kafkaTemplate.send("topic{m}"); return System.getenv("KEY_{m}"); }
}
"""),
    ("go", "svc/box{k}.go", """package svc
import "example.com/m{m}"
func (s *Box) Do{k}(a int, b int) { }
type Box{k} struct { }
type Shape{k} interface { }
"""),
    ("rust", "src/part{k}.rs", """use crate::part{m}::thing;
#[get("/r/{k}")]
pub async fn go_{k}(a: u8) { loop { for x in y { reqwest::get("/s/{m}") } } }
struct S{k};
trait T{k} { }
mod inner
"""),
]


def _id(table: str, key: str) -> Column:
    return F.concat(F.lit(f"{table}:"), F.col(key).cast("string"))


#: The same tables as common table expressions, for queries' SQL.
NODES_SQL = """nodes AS (
  SELECT 'region:' || r_regionkey AS id, 'architecture_component' AS node_type, r_name AS label, CAST(NULL AS VARCHAR) AS file_id FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, 'package', n_name, NULL FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'class', c_name, NULL FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'interface', s_name, NULL FROM supplier
  UNION ALL SELECT 'part:' || p_partkey, 'module', p_name, CAST(p_partkey AS VARCHAR) FROM part
  UNION ALL SELECT 'orders:' || o_orderkey, 'function', o_orderpriority, NULL FROM orders)"""
EDGES_SQL = """bare AS (
  SELECT 'region:' || n_regionkey AS from_id, 'nation:' || n_nationkey AS to_id, 'CONTAINS' AS edge_type, 'exact' AS confidence FROM nation
  UNION ALL SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey, 'CONTAINS', 'exact' FROM customer
  UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'BELONGS_TO', 'high' FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'BELONGS_TO', 'high' FROM supplier
  UNION ALL SELECT 'customer:' || o_custkey, 'orders:' || o_orderkey, 'DEFINES', 'exact' FROM orders
  UNION ALL SELECT DISTINCT 'orders:' || l_orderkey, 'part:' || l_partkey, 'REFERENCES', 'medium' FROM lineitem
  UNION ALL SELECT DISTINCT 'supplier:' || l_suppkey, 'part:' || l_partkey, 'DEPENDS_ON', 'medium' FROM lineitem
  UNION ALL SELECT DISTINCT 'part:' || l_partkey, 'supplier:' || l_suppkey, 'OWNED_BY', 'low' FROM lineitem),
edges AS (SELECT 'edge:' || sha256(edge_type || ':' || from_id || ':' || to_id) AS id, * FROM bare)"""
FILES_SQL = """files AS (SELECT doc_id AS file_id, source || '/' || doc_id || '.' || lang AS path, lang AS language, CAST(octet_length(encode(text)) AS BIGINT) AS size_bytes,
  sha256(text) AS content_hash, text FROM documents)"""
LINES_SQL = FILES_SQL + """,
split AS (SELECT file_id, path, string_split(text, chr(10)) AS parts FROM files),
lines AS (SELECT file_id, path, CAST(i AS BIGINT) AS line, parts[i] AS text FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM split))"""
SYMBOLS_SQL = "symbols AS (SELECT p_partkey AS symbol_id, p_name AS name, p_brand || '::' || p_type || '::' || p_name AS qualified_name, p_type AS kind, p_partkey % 97 AS file_id FROM part)"
COMMITS_SQL = "commits AS (SELECT o_orderkey AS commit_id, o_custkey AS author, o_orderdate AS committed_at, o_orderpriority AS summary FROM orders)"
TOUCHES_SQL = "touches AS (SELECT l_orderkey AS commit_id, l_linenumber AS touch, l_partkey AS path, l_suppkey AS owner, l_quantity AS additions, l_shipdate AS touched_at FROM lineitem)"
RUNTIME_SQL = "runtime AS (SELECT event_id AS record_id, event_type AS route, user_id AS symbol, value AS duration_ms, event_type = 'error' AS error, ts, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"
FACTS_SQL = "facts AS (SELECT conv_id || ':' || turn AS fact_id, role AS source, text, conv_id * 1000 + turn AS created FROM conversations)"
