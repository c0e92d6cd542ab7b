"""Rule and impact queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.paths import endpoint_path
from tessera.operators import rules as X
from tessera.sources.bindings import EDGES_SQL, FILES_SQL, NODES_SQL

GLOBS = [("low", "src[1-4]/**".replace("[1-4]", "1")), ("teens", "src1?/**"), ("english", "**/*.en"), ("german", "**/*.de")]
RULES = [("low", "teens", "forbid"), ("english", "german", "forbid"), ("teens", "*", "allow"), ("*", "english", "allow")]
MAPPED_SQL = f"{FILES_SQL}, m AS (SELECT path, 'low' AS c FROM files WHERE path LIKE 'src1/%' UNION SELECT path, 'teens' FROM files WHERE regexp_matches(path, '^src1[^/]/') UNION SELECT path, 'english' FROM files WHERE ends_with(path, '.en') UNION SELECT path, 'german' FROM files WHERE ends_with(path, '.de'))"
EDGE_SQL = "e AS (SELECT a.path AS source, b.path AS target FROM files a JOIN files b ON b.file_id = a.file_id + 1 + a.file_id % 3)"


def _edges(t):
    f = t.files.select("file_id", "path")
    return f.select(F.col("path").alias("source"), (F.col("file_id") + 1 + F.col("file_id") % 3).alias("file_id")).join(f.select("file_id", F.col("path").alias("target")), "file_id").select("source", "target")


def _verdicts(t):
    return X.verdicts(_edges(t), X.components(t.files, GLOBS), RULES)


VERDICT_SQL = f"""WITH {MAPPED_SQL}, {EDGE_SQL}, r AS (SELECT * FROM (VALUES ('low', 'teens', 'forbid'), ('english', 'german', 'forbid'), ('teens', '*', 'allow'), ('*', 'english', 'allow')) v(f, t, action)),
h AS (SELECT source, target, bool_or(action = 'forbid') AS forbid, bool_or(action = 'allow') AS allow FROM e JOIN m a ON a.path = source JOIN m b ON b.path = target JOIN r ON (r.f = '*' OR r.f = a.c) AND (r.t = '*' OR r.t = b.c) GROUP BY 1, 2),
x AS (SELECT e.source, e.target, CASE WHEN e.source = e.target THEN 'allowed' WHEN e.source NOT IN (SELECT path FROM m) OR e.target NOT IN (SELECT path FROM m) THEN 'unknown'
  WHEN EXISTS (SELECT 1 FROM m a JOIN m b ON a.c = b.c WHERE a.path = e.source AND b.path = e.target) THEN 'allowed' WHEN forbid THEN 'violation' WHEN allow THEN 'allowed' ELSE 'unknown' END AS verdict FROM e LEFT JOIN h ON h.source = e.source AND h.target = e.target)"""


def _sides(t):
    cut = F.lit("1995-06-01").cast("timestamp")
    pairs = t.raw("lineitem").select("l_partkey", "l_suppkey", F.col("l_shipdate").cast("timestamp").alias("at"))
    return pairs.where(F.col("at") < cut), pairs.where(F.col("at") >= cut)


def _signatures(t, low: int):
    return t.raw("customer").where(F.col("c_custkey") % 5 != low).select("c_custkey", F.when(F.col("c_custkey") % 7 == low, "changed").otherwise(F.col("c_mktsegment")).alias("sig"))


def _intervals(t):
    o = t.raw("orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("id"), F.unix_date(F.col("o_orderdate").cast("date")).cast("long").alias("start"))
    return o.withColumn("end", F.col("start") + 30)


def _boundaries(t):
    p = t.raw("pages").select(F.col("page_id").alias("id"), F.regexp_extract("url", r"//([^/]+)", 1).alias("project"), endpoint_path(F.col("url")).alias("path"), F.when(F.col("page_id") % 3 == 0, "GET").when(F.col("page_id") % 3 == 1, "POST").alias("method"))
    return p.where("id % 2 = 0"), p.where("id % 2 = 1")


PAGES_SQL = "b AS (SELECT page_id AS id, regexp_extract(url, '//([^/]+)', 1) AS project, CASE WHEN starts_with(p, '/') THEN p ELSE '/' || p END AS path, CASE page_id % 3 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' END AS method FROM (SELECT *, regexp_replace(regexp_replace(trim(url), '[?#].*$', ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*', '') AS p FROM pages))"
INTERVAL_SQL = "i AS (SELECT o_custkey AS key, o_orderkey AS id, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS s, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) + 30 AS e FROM orders), o AS (SELECT a.key, a.id AS l_id, a.s AS l_start, a.e AS l_end, b.id AS r_id, b.s AS r_start, b.e AS r_end FROM i a JOIN i b ON a.key = b.key AND a.s <= b.e AND b.s <= a.e WHERE a.id < b.id)"


def _overlaps(t):
    return X.overlaps(_intervals(t), _intervals(t), "key", 31).where("l_id < r_id")


QUERIES = {
    "rules_components": (lambda t: X.components(t.files, GLOBS), f"WITH {MAPPED_SQL} SELECT path, c AS component FROM m"),
    "rules_policy_verdicts": (lambda t: _verdicts(t), f"{VERDICT_SQL} SELECT * FROM x"),
    "rules_policy_counts": (lambda t: _verdicts(t).groupBy("verdict").agg(F.count("*").alias("n")), f"{VERDICT_SQL} SELECT verdict, count(*) AS n FROM x GROUP BY 1"),
    "rules_dependency_delta": (lambda t: X.difference(*_sides(t), "l_partkey", "l_suppkey"), "WITH b AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_shipdate < TIMESTAMP '1995-06-01'), a AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-06-01') SELECT *, 'added' AS change FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'removed' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)"),
    "rules_api_delta": (lambda t: X.changed(_signatures(t, 1), _signatures(t, 2), "c_custkey", "sig"), "WITH b AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 1 THEN 'changed' ELSE c_mktsegment END AS s FROM customer WHERE c_custkey % 5 <> 1), a AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 2 THEN 'changed' ELSE c_mktsegment END AS s FROM customer WHERE c_custkey % 5 <> 2) SELECT * FROM (SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey, CASE WHEN a.s IS NULL THEN 'removed' WHEN b.s IS NULL THEN 'added' WHEN a.s <> b.s THEN 'changed' END AS change FROM b FULL JOIN a ON a.c_custkey = b.c_custkey) WHERE change IS NOT NULL"),
    "rules_overlap_join": (lambda t: _overlaps(t), f"WITH {INTERVAL_SQL} SELECT * FROM o"),
    "rules_narrowest_overlap": (lambda t: X.narrowest(_overlaps(t).withColumn("r_end", F.col("r_end") + F.col("r_id") % 5)).select("l_id", "r_id", "ambiguous"), f"WITH {INTERVAL_SQL}, n AS (SELECT *, r_end + r_id % 5 - r_start AS width, rank() OVER (PARTITION BY l_id ORDER BY r_end + r_id % 5 - r_start) AS k FROM o) SELECT l_id, r_id, count(*) OVER (PARTITION BY l_id) > 1 AS ambiguous FROM n WHERE k = 1"),
    "rules_impact": (lambda t: X.impact(t.edges.where("edge_type IN ('DEPENDS_ON', 'BELONGS_TO', 'CONTAINS')"), t.nodes.where("node_type = 'package'")), f"WITH {NODES_SQL}, {EDGES_SQL}, k AS (SELECT DISTINCT from_id, to_id FROM edges WHERE edge_type IN ('DEPENDS_ON', 'BELONGS_TO', 'CONTAINS')), o AS (SELECT n.id AS start, from_id AS node FROM nodes n JOIN k ON to_id = n.id WHERE node_type = 'package'), w AS (SELECT DISTINCT start, from_id AS node FROM o JOIN k ON to_id = node) SELECT start, node, min(hops) AS hops FROM (SELECT *, 1 AS hops FROM o UNION ALL SELECT *, 2 FROM w) WHERE start <> node GROUP BY 1, 2"),
    "rules_select_tests": (lambda t: X.select_tests(t.raw("supplier").select(F.col("s_suppkey").alias("test"), F.col("s_nationkey").alias("folder"), (F.col("s_suppkey") % 50).alias("stem")), t.raw("customer").select(F.col("c_custkey").alias("changed"), F.col("c_nationkey").alias("folder"), (F.col("c_custkey") % 50).alias("stem"))), "WITH s AS (SELECT c_custkey AS changed, s_suppkey AS test, round((CASE WHEN s_suppkey % 50 = c_custkey % 50 THEN 0.35::DOUBLE ELSE 0.0::DOUBLE END) + (CASE WHEN s_nationkey = c_nationkey THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END), 6) AS score FROM customer, supplier WHERE s_suppkey % 50 = c_custkey % 50 OR s_nationkey = c_nationkey) SELECT * FROM (SELECT changed, CAST(row_number() OVER (PARTITION BY changed ORDER BY score DESC, test) AS INTEGER) AS rank, test, score FROM s) WHERE rank <= 5"),
    "rules_cross_project_links": (lambda t: X.links(*_boundaries(t)), f"WITH {PAGES_SQL} SELECT a.id AS source, c.id AS target, count(*) OVER (PARTITION BY a.id) > 1 AS ambiguous FROM b a JOIN b c ON a.path = c.path AND a.project <> c.project WHERE a.id % 2 = 0 AND c.id % 2 = 1 AND (a.method IS NULL OR c.method IS NULL OR a.method = c.method)"),
}
