"""Runtime lines, reports, context and memory. Texts are made from the tables, so the SQL states what they hold."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import facts as E
from tessera.operators import history as H
from tessera.operators import registry as G
from tessera.operators import tasks as K
from tessera.operators import telemetry as T
from tessera.queries import code
from tessera.sources.bindings import FACTS_SQL, FILES_SQL

NOW = "2024-02-05 00:00:00"


def _lines(t):
    """Runtime records in three spellings, by event number; every seventh user's file isn't known."""
    e = t.raw("events").select("event_id", F.col("user_id").cast("string").alias("u"), F.get_json_object("props", "$.k").alias("k"), F.col("value").cast("decimal(18,2)").cast("string").alias("v"), F.col("event_type").alias("y"))
    a = F.concat(F.lit('{"file":"./src/e'), "u", F.lit('.py","symbol":"f'), "u", F.lit('","http.route":"/r/'), "k", F.lit('","http.method":"get","status_code":"'), F.when(F.col("y") == "error", "503").otherwise("200"), F.lit('","duration_ms":'), "v", F.lit(',"service":"s'), "y", F.lit('","timestamp":"2024-01-01T00:00:00Z"}'))
    b = F.concat(F.lit('{"attributes":{"code":{"filepath":"src/e'), "u", F.lit('.py"},"db.statement":"select * from t'), "k", F.lit(' where x"},"duration_ns":2500000,"failed":"'), F.when(F.col("y") == "error", "yes").otherwise("no"), F.lit('"}'))
    c = F.concat(F.lit('{"source":{"path":"src/e'), "u", F.lit('.py"},"error.message":" boom token=x'), "k", F.lit(' ","elapsed_ms":"'), "v", F.lit('"}'))
    return e.select(F.col("event_id").alias("record"), F.when(F.col("event_id") % 3 == 0, a).when(F.col("event_id") % 3 == 1, b).otherwise(c).alias("value"))


def _records(t):
    files = t.raw("events").where("user_id % 7 <> 0").select(F.concat(F.lit("src/e"), F.col("user_id").cast("string"), F.lit(".py")).alias("path")).distinct()
    return T.runtime_records(_lines(t), files)


RECORDS_SQL = """r AS (SELECT event_id AS record, 'src/e' || user_id || '.py' AS path, CASE WHEN m = 0 THEN 'f' || user_id END AS symbol, CASE WHEN m = 0 THEN '/r/' || k END AS route, CASE WHEN m = 0 THEN 'GET' END AS method,
CASE WHEN m = 0 THEN CASE WHEN event_type = 'error' THEN 503 ELSE 200 END END AS status, CASE WHEN m = 1 THEN 2.5::DOUBLE ELSE round(value, 2) END AS duration_ms, m = 2 OR event_type = 'error' AS error, CASE WHEN m = 1 THEN 't' || k END AS tab, CASE WHEN m = 2 THEN 'boom token=[REDACTED]' END AS message, CASE WHEN m = 0 THEN 's' || event_type END AS service
FROM (SELECT *, event_id % 3 AS m, json_extract_string(props, '$.k') AS k FROM events) WHERE user_id % 7 <> 0)"""
GROUPS_SQL = f"""{RECORDS_SQL}, g AS (SELECT 'route' AS kind, 'GET ' || route AS target, * FROM r WHERE route IS NOT NULL UNION ALL SELECT 'table', tab, * FROM r WHERE tab IS NOT NULL UNION ALL SELECT 'error', message, * FROM r WHERE message IS NOT NULL UNION ALL SELECT 'symbol', symbol, * FROM r WHERE symbol IS NOT NULL),
a AS (SELECT kind, path, target, count(*) AS count, count(*) FILTER (error) AS errors, quantile_disc(duration_ms, 0.5) AS p50, quantile_disc(duration_ms, 0.95) AS p95, quantile_disc(duration_ms, 0.99) AS p99, coalesce(string_agg(DISTINCT service, '|' ORDER BY service), '') AS services, coalesce(string_agg(DISTINCT CAST(status AS VARCHAR), '|' ORDER BY CAST(status AS VARCHAR)), '') AS statuses, max(CASE WHEN service IS NOT NULL THEN 1 END) AS timed FROM g GROUP BY 1, 2, 3)"""


def _nation_reports(t, kind: str):
    n = F.col("n_nationkey").cast("string")
    body = {
        "json": F.concat(F.lit('{"meta":{},"files":{"src/a'), n, F.lit('.py":{"executed_lines":[1,2,2,'), F.col("n_regionkey").cast("string"), F.lit(']},"b.py":{"executed_lines":[]}}}')),
        "xml": F.concat(F.lit('<coverage><packages><package name="p"><classes><class name="A" filename="src/a'), n, F.lit('.py"><lines><line number="3" hits="2"/><line number="4" hits="0"/></lines></class></classes></package><package name="x.y"><sourcefile name="B'), n, F.lit('.java"><line nr="7" ci="1"/><line nr="8" ci="0"/></sourcefile></package></packages></coverage>')),
        "junit": F.concat(F.lit('<testsuite><testcase name="t'), n, F.lit('" classname="a.B" time="0.25" line="4"/><testcase name="u'), n, F.lit('"><failure message="bad thing"/></testcase><testcase name="v'), n, F.lit('" file="x.py"><skipped/></testcase><testcase name="w'), n, F.lit('"><error> broken </error></testcase></testsuite>')),
    }[kind]
    return t.raw("nation").select(F.col("n_nationkey").alias("report"), body.alias("text"))


def _links(t):
    covered = T.coverage_json(_nation_reports(t, "json")).select("path", "line")
    symbols = t.raw("nation").where("n_nationkey % 2 = 0").select(F.concat(F.lit("src/a"), F.col("n_nationkey").cast("string"), F.lit(".py")).alias("path"), F.col("n_nationkey").alias("symbol_id"), F.lit(2).alias("start_line"), F.lit(9).alias("end_line"))
    links = t.raw("nation").select(F.concat(F.lit("src/a"), F.col("n_nationkey").cast("string"), F.lit(".py")).alias("path"), F.lit("tests/t.py").alias("test_path"))
    return T.coverage_facts(covered, symbols, links)


def _known(t):
    reported = t.files.select(F.concat(F.lit("/build/"), "path").alias("path")).unionByName(t.files.where("file_id % 2 = 0").select(F.regexp_replace("path", "^src", "rc").alias("path")))
    return T.known_paths(reported.where("path LIKE '/build/%'"), t.files.select("path"))


def _quality(t):
    declared = E.declarations(t.code)
    imports = E.imports(t.code).select(F.concat_ws(":", F.col("file_id").cast("string"), F.col("line").cast("string")).alias("import_id"), "path", "language", "imported")
    return T.index_quality(t.code, declared, E.framework_facts(t.code), G.resolve_imports(imports, t.code.select("path"), go_modules=("example.com",)))


def _test_targets(t):
    k = F.col("p_partkey")
    name = F.when(k % 5 == 0, "AD_DOMAIN").when(k % 5 == 1, F.concat(F.lit("LoginServiceTest"), k.cast("string"))).when(k % 5 == 2, F.concat(F.lit("test_x"), k.cast("string"))).when(k % 5 == 3, "ValidationTests").otherwise("helper")
    return t.raw("part").select(k.alias("test_id"), (k % 40).alias("file_id"), name.alias("name"), F.when(k % 3 == 0, "high").otherwise("low").alias("confidence"))


def _remembered(t):
    return t.facts.withColumn("confidence", F.when(F.col("created") % 2 == 0, "high").otherwise("low")).withColumn("text", F.concat_ws(" ", "text", F.when(F.col("created") % 5 == 0, "see src/a.rs").otherwise(""), F.when(F.col("created") % 7 == 0, "AB-12").otherwise("")))


RECALL = "AB-12 in src/a.rs of heron"
RECALL_SQL = f"""WITH {FACTS_SQL}, f AS (SELECT *, text || ' ' || CASE WHEN created % 5 = 0 THEN 'see src/a.rs' ELSE '' END || ' ' || CASE WHEN created % 7 = 0 THEN 'AB-12' ELSE '' END AS x FROM facts ORDER BY created DESC, fact_id LIMIT 500),
h AS (SELECT *, (CASE WHEN contains(lower(x), 'src') THEN 1 ELSE 0 END + CASE WHEN contains(lower(x), 'heron') THEN 1 ELSE 0 END) AS hits, CASE WHEN created % 5 = 0 THEN 1 ELSE 0 END + CASE WHEN created % 7 = 0 THEN 1 ELSE 0 END AS links FROM f)
SELECT fact_id, round(CASE WHEN hits > 0 THEN 0.25::DOUBLE + 0.08::DOUBLE * hits ELSE 0.0::DOUBLE END + CASE WHEN links > 0 THEN 0.45::DOUBLE + 0.15::DOUBLE * links ELSE 0.0::DOUBLE END + CASE WHEN created % 2 = 0 THEN 0.085::DOUBLE ELSE 0.035::DOUBLE END, 6) AS score, created FROM h WHERE hits > 0 OR links > 0 ORDER BY score DESC, created DESC, fact_id LIMIT 100"""
TASK = "Rename fooBar in src2/ for AB-12 like Heron_Base"


def _boosted(t):
    r = t.files.select("path", F.lit("uses foo bar").alias("text"), (F.col("file_id") % 10 / 10.0).alias("score"), F.lit(0.5).alias("confidence"))
    return K.boosted(r, TASK)


BOOST_SQL = f"WITH {FILES_SQL} SELECT path, 'uses foo bar' AS text, round(file_id % 10 / 10.0::DOUBLE + 0.65::DOUBLE + CASE WHEN contains(path, 'src2') THEN 0.35::DOUBLE ELSE 0.0::DOUBLE END, 6) AS score, 0.85::DOUBLE AS confidence FROM files"

QUERIES = {
    "runtime_parse": (lambda t: _records(t).select("record", "path", "symbol", "route", "method", "status", F.round("duration_ms", 6).alias("duration_ms"), "error", "message"), f"WITH {RECORDS_SQL} SELECT record, path, symbol, route, method, status, round(duration_ms, 6) AS duration_ms, error, message FROM r"),
    "runtime_record_facts": (lambda t: T.record_facts(_records(t)).select("record", "edge_type", "target_kind", "target"), f"WITH {RECORDS_SQL} SELECT record, 'EXPOSES_ENDPOINT' AS edge_type, 'endpoint' AS target_kind, 'GET ' || route AS target FROM r WHERE route IS NOT NULL UNION ALL SELECT record, 'READS_TABLE', 'database_table', tab FROM r WHERE tab IS NOT NULL UNION ALL SELECT record, 'FAILED_IN', 'runtime_error', message FROM r WHERE message IS NOT NULL"),
    "runtime_groups": (lambda t: T.record_groups(_records(t)).select("kind", "path", "target", "count", "errors", *[F.round(p, 6).alias(p) for p in ("p50", "p95", "p99")], "services", "statuses", "confidence"), f"WITH {GROUPS_SQL} SELECT kind, path, target, count, errors, round(p50, 6) AS p50, round(p95, 6) AS p95, round(p99, 6) AS p99, services, statuses, CASE WHEN count >= 3 THEN 'high' ELSE 'medium' END AS confidence FROM a"),
    "runtime_group_messages": (lambda t: T.record_groups(_records(t)).where("kind = 'route'").select("path", "target", T.group_message(F.lit(NOW).cast("timestamp")).alias("message")), f"WITH {GROUPS_SQL} SELECT path, target, 'runtime aggregate observed: count ' || count || ', error_count ' || errors || ', error_rate ' || printf('%.2f', errors / count) || ', p50_ms ' || printf('%.1f', p50 + 1e-9) || ', p95_ms ' || printf('%.1f', p95 + 1e-9) || ', p99_ms ' || printf('%.1f', p99 + 1e-9) || ', first_observed 2024-01-01T00:00:00Z, last_observed 2024-01-01T00:00:00Z, freshness stale, services ' || services || ', status_codes ' || statuses AS message FROM a WHERE kind = 'route'"),
    "runtime_coverage_json": (lambda t: T.coverage_json(_nation_reports(t, "json")), "SELECT DISTINCT n_nationkey AS report, 'src/a' || n_nationkey || '.py' AS path, CAST(unnest([1, 2, n_regionkey]) AS INTEGER) AS line FROM nation"),
    "runtime_coverage_xml": (lambda t: T.coverage_xml(_nation_reports(t, "xml")), "SELECT n_nationkey AS report, 'src/a' || n_nationkey || '.py' AS path, 3 AS line FROM nation UNION ALL SELECT n_nationkey, 'x/y/B' || n_nationkey || '.java', 7 FROM nation"),
    "runtime_junit": (lambda t: T.junit_cases(_nation_reports(t, "junit")), "SELECT n_nationkey AS report, u || n_nationkey AS name, CASE u WHEN 't' THEN 'a.B' END AS classname, CASE u WHEN 'v' THEN 'x.py' END AS file, CASE u WHEN 't' THEN 'passed' WHEN 'u' THEN 'failed' WHEN 'v' THEN 'skipped' ELSE 'error' END AS status, CASE u WHEN 't' THEN 0.25::DOUBLE END AS seconds, CASE u WHEN 't' THEN 4 END AS line, CASE u WHEN 'u' THEN 'bad thing' WHEN 'w' THEN 'broken' END AS message FROM nation, (SELECT unnest(['t', 'u', 'v', 'w']) AS u)"),
    "runtime_junit_facts": (lambda t: T.junit_facts(T.junit_cases(_nation_reports(t, "junit"))).where("name LIKE 't%' OR name LIKE 'u%'"), "SELECT 't' || n_nationkey AS name, 'VALIDATES' AS edge_type, 'medium' AS confidence, 'JUnit observed test `t' || n_nationkey || '` status passed, duration_s 0.250' AS message FROM nation UNION ALL SELECT 'u' || n_nationkey, 'VALIDATES', 'high', 'JUnit observed test `u' || n_nationkey || '` status failed, message bad thing' FROM nation"),
    "runtime_coverage_facts": (_links, "SELECT 'src/a' || n_nationkey || '.py' AS path, 'tests/t.py' AS test_path, 'TEST_COVERS' AS edge_type, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey END AS symbol_id, CASE WHEN n_regionkey IN (1, 2) THEN 2 ELSE 3 END AS lines, CASE WHEN n_nationkey % 2 = 0 THEN 'high' ELSE 'medium' END AS confidence FROM nation"),
    "runtime_known_paths": (_known, f"WITH {FILES_SQL} SELECT '/build/' || path AS path, path AS file FROM files"),
    "runtime_cochange_facts": (lambda t: T.cochange_facts(H.cochange(t.commits, t.touches), 200), None),
    "meta_index_quality": (_quality, f"WITH {code.DECLARED_SQL}, {code.USED_SQL}, p AS (SELECT p_partkey FROM part) SELECT (SELECT count(*) FROM part) AS files, (SELECT count(*) FROM d) AS symbols, (SELECT count(DISTINCT file_id) FROM d) AS covered, (SELECT count(*) FROM u WHERE edge_type NOT IN ('EXTENDS', 'IMPLEMENTS')) AS facts, (SELECT count(*) FROM part WHERE p_partkey % 5 = 1 AND p_partkey % 7 IN (1, 6)) AS resolved, (SELECT count(*) FROM part WHERE p_partkey % 5 IN (0, 3, 4)) AS external, (SELECT count(*) FROM part WHERE (p_partkey % 5 = 1 AND p_partkey % 7 NOT IN (1, 6)) OR p_partkey % 5 = 4) AS unresolved, 1.0::DOUBLE AS coverage"),
    "context_plan_tests": (lambda t: K.plan_tests(_test_targets(t)), "WITH x AS (SELECT p_partkey AS test_id, p_partkey % 40 AS file_id, CASE p_partkey % 5 WHEN 1 THEN 'LoginServiceTest' || p_partkey ELSE 'test_x' || p_partkey END AS name, CASE WHEN p_partkey % 3 = 0 THEN 'high' ELSE 'low' END AS confidence FROM part WHERE p_partkey % 5 IN (1, 2)) SELECT * FROM x ORDER BY confidence, name, test_id LIMIT 8"),
    "context_recall": (lambda t: K.recall(_remembered(t), RECALL), RECALL_SQL),
    "context_anchor_boosts": (_boosted, BOOST_SQL),
    "context_titles": (lambda t: t.files.select("file_id", K.compact_title(F.concat(F.lit("a/"), "path", F.when(F.col("file_id") % 2 == 0, ":3-9").otherwise(":x"))).alias("title")), f"WITH {FILES_SQL} SELECT file_id, CASE WHEN file_id % 2 = 0 THEN split_part(path, '/', 2) || ':3-9' ELSE 'a/' || path || ':x' END AS title FROM files"),
}
