"""Extraction from source files. Files are filled from templates, so the SQL states what each template holds."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import identity as I
from tessera.functions import paths as P
from tessera.operators import facts as E
from tessera.operators import graph as G
from tessera.operators import metrics as M
from tessera.sources.bindings import CODE

# What the templates declare, import and use: (template, line, ...); {k} is the part's number, {m} that modulo 7.
DECLARED = [
    (0, 4, "function", "fetch_{k}"), (0, 9, "class", "Box{k}"), (0, 10, "function", "check_{k}"), (1, 4, "function", "run_{k}"), (1, 4, "variable", "run_{k}"),
    (1, 5, "function", "load{k}"), (1, 6, "class", "Job{k}"), (2, 4, "class", "Svc{k}"), (2, 6, "method", "go{k}"), (3, 3, "function", "Do{k}"), (3, 4, "class", "Box{k}"),
    (3, 5, "interface", "Shape{k}"), (4, 3, "function", "go_{k}"), (4, 4, "class", "S{k}"), (4, 5, "trait", "T{k}"), (4, 6, "module", "inner"),
]
IMPORTED = [(0, 1, "os"), (0, 2, "pkg.mod{m}"), (1, 1, "./page{m}"), (1, 2, "node:fs"), (2, 2, "java.util.List"), (3, 2, "example.com/m{m}"), (4, 1, "crate::part{m}::thing"), (4, 6, "inner")]
USED = [
    (0, 3, "EXPOSES_ENDPOINT", "endpoint", "GET /r/{k}"), (0, 7, "CALLS_ENDPOINT", "endpoint", "POST /s/{m}"), (1, 3, "EXPOSES_ENDPOINT", "endpoint", "POST /r/{k}"),
    (1, 4, "PUBLISHES_EVENT", "topic", "topic{m}"), (1, 5, "CALLS_ENDPOINT", "endpoint", "HTTP /s/{m}"), (1, 7, "CONSUMES_EVENT", "topic", "topic{m}"),
    (2, 3, "EXPOSES_ENDPOINT", "endpoint", "HTTP /r/{k}"), (2, 5, "READS_CONFIG", "config_key", "key.{m}"), (2, 6, "PUBLISHES_EVENT", "topic", "topic{m}"),
    (2, 6, "READS_CONFIG", "config_key", "KEY_{m}"), (4, 2, "EXPOSES_ENDPOINT", "endpoint", "GET /r/{k}"), (4, 3, "CALLS_ENDPOINT", "endpoint", "GET /s/{m}"),
]
PARENTS = [(2, 4, "EXTENDS", "class", "Base{m}"), (2, 4, "IMPLEMENTS", "interface", "Run"), (2, 4, "IMPLEMENTS", "interface", "Stop")]
PREFIX = ("'pkg::mod' || k || '_test'", "'web::page' || k", "'a::b::Svc' || k", "'svc'", "'src::part' || k")
#: Of each template's main symbol: cyclomatic, loops, loop depth, recursive, scan in loop, allocation in loop, parameters, access depth, blocking calls.
MAIN = ("fetch_", "load", "go", "Do", "go_")
METRICS = [(3, 2, 1, True, False, False, 1, 2, 0), (2, 0, 0, False, False, False, 2, 1, 1), (1, 0, 0, False, False, False, 1, 2, 0), (1, 0, 0, False, False, False, 1, 1, 0), (3, 2, 2, False, False, False, 1, 0, 1)]


def _filled(column: str) -> str:
    return f"replace(replace({column}, '{{k}}', CAST(k AS VARCHAR)), '{{m}}', CAST(k % 7 AS VARCHAR))"


def _values(rows: list[tuple], names: str) -> str:
    listed = ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {listed}) AS v(r, line, {names})) JOIN (SELECT p_partkey AS k FROM part) ON k % {len(CODE)} = r"


DECLARED_SQL = f"d AS (SELECT k AS file_id, r, CAST(line AS BIGINT) AS line, kind, {_filled('name')} AS name FROM {_values(DECLARED, 'kind, name')})"
IMPORTED_SQL = f"i AS (SELECT k AS file_id, r, CAST(line AS BIGINT) AS line, {_filled('imported')} AS imported FROM {_values(IMPORTED, 'imported')})"
USED_SQL = f"u AS (SELECT k AS file_id, r, CAST(line AS BIGINT) AS line, edge_type, target_kind, {_filled('target')} AS target FROM {_values(USED + PARENTS, 'edge_type, target_kind, target')})"
PATH = "CASE {k} % 5 " + " ".join("WHEN " + str(i) + " THEN '" + p.replace("{k}", "' || {k} || '") + "'" for i, (_, p, _) in enumerate(CODE)) + " END"
NAMED_SQL = f"{DECLARED_SQL}, q AS (SELECT *, {PATH.replace('{k}', 'file_id')} AS path, CASE r " + " ".join(f"WHEN {i} THEN {p.replace('k', 'file_id') if 'k' in p and '|| k' not in p else p.replace('|| k', '|| file_id')}" for i, p in enumerate(PREFIX)) + " END AS prefix FROM d), n AS (SELECT *, CASE WHEN split_part(prefix, '::', -1) = name THEN prefix ELSE prefix || '::' || name END AS qualified_name FROM q), s AS (SELECT DISTINCT file_id, path, line, name, qualified_name, sha256(path || ':' || line || ':' || qualified_name) AS symbol_id FROM n)"
ESCAPED = "replace(replace(replace({0}, '%', '%25'), ':', '%3A'), '/', '%2F')"
NODE = "CASE target_kind WHEN 'endpoint' THEN 'route:http:' || CASE WHEN target LIKE 'HTTP %' THEN '*' ELSE split_part(target, ' ', 1) END || ':' || " + ESCAPED.format("split_part(target, ' ', 2)") + " WHEN 'config_key' THEN 'config:' || " + ESCAPED.format("target") + " ELSE 'analysis:' || upper(left(target_kind, 1)) || substr(target_kind, 2) || ':' || sha256(lower(target)) END"
EDGES = f"""{NAMED_SQL}, {IMPORTED_SQL}, {USED_SQL}, e AS (SELECT DISTINCT file_id, 'symbol:' || symbol_id AS to_id, 'DEFINES' AS edge_type FROM s UNION SELECT file_id, 'analysis:Module:' || sha256(lower(imported)), 'IMPORTS' FROM i UNION SELECT file_id, {NODE}, edge_type FROM u),
g AS (SELECT 'file:' || {PATH.replace('{k}', 'file_id')} AS from_id, to_id, edge_type FROM e)"""


def _symbols(t):
    return E.symbol_ids(E.declarations(t.code), t.code)


def _facts(t):
    return E.framework_facts(t.code).unionByName(E.inheritance(t.code))


def _graph(t):
    return E.graph(t.code, _symbols(t), E.imports(t.code), E.fact_ids(_facts(t), t.code))


def _main(t):
    at = (F.col("file_id") % len(CODE)).cast("int")
    return t.code.select(F.col("file_id").alias("symbol_id"), F.concat(F.get(F.array(*map(F.lit, MAIN)), at), F.col("file_id").cast("string")).alias("name"), "text")


def _measured(t):
    return M.risk(M.measured(_main(t)))


def _calls(t):
    """Parts call the next three parts in a ring of their brand's number, so there are chains and cycles."""
    p = t.raw("part").select(F.col("p_partkey").alias("symbol_id"))
    return p.where("symbol_id % 10 <> 9").select("symbol_id", (F.col("symbol_id") + 1).alias("callee")).unionByName(p.where("symbol_id % 50 = 9").select("symbol_id", (F.col("symbol_id") - 9).alias("callee")))


def _depths(t):
    return t.raw("part").select(F.col("p_partkey").alias("symbol_id"), (F.col("p_size") % 4).alias("max_loop_depth"))


PATHS = ["src/a{k}.rs", "a/test/b{k}.py", "vendor/x{k}.go", "web/p{k}.spec.ts", "docs/readme{k}.md", "conf/.env.{k}", "Dockerfile.{k}", "x/secrets/k{k}.txt", "lib/k{k}_key", "node_modules/a{k}.mjs", "a/gen{k}.generated.ts", "infra/m{k}.tf"]
TRAITS = [("rust", 0, 0, 0, 0), ("python", 1, 0, 0, 0), ("go", 0, 1, 0, 1), ("typescript", 1, 0, 0, 0), ("markdown", 0, 0, 0, 1), ("unknown", 0, 0, 1, 0), ("text", 0, 0, 0, 0), ("text", 0, 0, 1, 0), ("unknown", 0, 0, 1, 0), ("javascript", 0, 1, 0, 0), ("typescript", 0, 0, 0, 1), ("text", 0, 0, 0, 0)]


def _paths(t):
    k = F.col("doc_id")
    path = F.get(F.array(*[F.concat(*[F.lit(x) if x is not None else k.cast("string") for x in (p.split("{k}")[0], None, p.split("{k}")[1])]) for p in PATHS]), (k % len(PATHS)).cast("int"))
    d = t.raw("documents").select("doc_id", path.alias("path"))
    c = F.col("path")
    return d.select("doc_id", P.detect_language(c).alias("language"), P.is_test(c).alias("test"), P.is_vendor(c).alias("vendor"), P.is_secret(c).alias("secret"), P.is_secondary(c).alias("secondary"))


def _case(i: int) -> str:
    return "CASE doc_id % 12 " + " ".join(f"WHEN {n} THEN " + (f"'{x[i]}'" if i == 0 else "true" if x[i] else "false") for n, x in enumerate(TRAITS)) + " END"


def _headed(t):
    """Documents under a header line, every third of them marked as generated."""
    mark = F.when(F.col("file_id") % 3 == 0, "// Code generated by a tool").when(F.col("file_id") % 3 == 1, "// generated by hand").otherwise("\n" * 8 + "DO NOT EDIT")
    return t.files.select("file_id", F.concat(mark, F.lit("\n"), F.col("text")).alias("text")).where(P.is_generated(F.col("text"))).select("file_id")


def _secrets(t):
    line = F.concat(F.lit("login user="), F.col("c_name"), F.lit(" password="), F.col("c_mktsegment"), F.lit(" API_KEY=x1 ok"))
    return t.raw("customer").select("c_custkey", P.compact_message(line).alias("message"), P.sql_table(F.concat(F.lit("update t"), F.col("c_nationkey").cast("string"), F.lit(" set a = 1 from s"), F.col("c_custkey").cast("string"))).alias("table_name"))


INFRA = [("dockerfile", "FROM x\nEXPOSE 8{k} 9{k}/udp\nENV KEY_{k}=1\n"), ("compose", "services:\n  web{k}:\n    ports:\n      - \"80:9{k}\"\n    environment:\n      MODE_{k}: a\n    depends_on:\n      - db{k}\n  db{k}:\n    image: x\n"), ("yaml", "kind: Service\nmetadata:\n  name: svc{k}\nport: 7{k}\n---\nname: app{k}\nkind: Job\n"), ("terraform", 'resource "aws_sqs_queue" "q{k}" {}\nresource "aws_sns_topic" "t{k}" {}\nresource "vm" "v{k}" {}\n')]
INFRA_FACTS = [
    (0, 2, "EXPOSES_ENDPOINT", "endpoint", "TCP :8{k}"), (0, 2, "EXPOSES_ENDPOINT", "endpoint", "TCP :9{k}"), (1, 2, "DEFINES", "resource", "compose:service:web{k}"),
    (1, 4, "EXPOSES_ENDPOINT", "endpoint", "TCP :9{k}"), (1, 6, "WRITES_CONFIG", "config_key", "MODE_{k}"), (1, 8, "DEPENDS_ON", "resource", "compose:service:db{k}"),
    (1, 9, "DEFINES", "resource", "compose:service:db{k}"), (2, 3, "DEFINES", "resource", "kubernetes:Service:svc{k}"), (2, 4, "EXPOSES_ENDPOINT", "endpoint", "TCP :7{k}"),
    (2, 7, "DEFINES", "resource", "kubernetes:Job:app{k}"), (3, 1, "DEFINES", "queue", "q{k}"), (3, 2, "DEFINES", "topic", "t{k}"), (3, 3, "DEFINES", "resource", "terraform:vm:v{k}"),
]


def _infra(t):
    at = (F.col("s_suppkey") % 4).cast("int")
    text = F.get(F.array(*[F.replace(F.lit(x), F.lit("{k}"), F.col("s_suppkey").cast("string")) for _, x in INFRA]), at)
    return E.infrastructure(t.raw("supplier").select(F.col("s_suppkey").alias("file_id"), F.get(F.array(*[F.lit(x) for x, _ in INFRA]), at).alias("language"), text.alias("text")))


INFRA_SQL = "SELECT k AS file_id, CAST(line AS BIGINT) AS line, edge_type, target_kind, replace(target, '{k}', CAST(k AS VARCHAR)) AS target FROM (SELECT * FROM (VALUES " + ", ".join(str(r) for r in INFRA_FACTS) + ") AS v(r, line, edge_type, target_kind, target)) JOIN (SELECT s_suppkey AS k FROM supplier) ON k % 4 = r"


def _metric(i: int) -> str:
    return "CASE p_partkey % 5 " + " ".join(f"WHEN {n} THEN {str(m[i]).lower()}" for n, m in enumerate(METRICS)) + " END"


METRIC_NAMES = ("cyclomatic", "loop_count", "max_loop_depth", "recursive", "linear_scan_in_loop", "allocation_in_loop", "parameter_count", "max_access_depth", "blocking_calls")
DEPTH_SQL = """WITH RECURSIVE c AS (SELECT p_partkey AS s, p_partkey + 1 AS t FROM part WHERE p_partkey % 10 <> 9 UNION ALL SELECT p_partkey, p_partkey - 9 FROM part WHERE p_partkey % 50 = 9),
w(s, a, n) AS (SELECT p_partkey, p_partkey, 0 FROM part UNION SELECT w.s, c.t, w.n + 1 FROM w JOIN c ON c.s = w.a WHERE w.n < 8)
SELECT w.s AS symbol_id, CAST(max(p_size % 4) AS INTEGER) AS transitive_loop_depth, w.s % 50 < 10 AND EXISTS (SELECT 1 FROM part WHERE p_partkey = w.s - w.s % 50 + 9) AS recursive FROM w JOIN part ON p_partkey = w.a GROUP BY w.s"""

QUERIES = {
    "parse_declarations": (lambda t: E.declarations(t.code).select("file_id", "line", "kind", "name"), f"WITH {DECLARED_SQL} SELECT file_id, line, kind, name FROM d"),
    "parse_imports": (lambda t: E.imports(t.code).select("file_id", "line", "imported"), f"WITH {IMPORTED_SQL} SELECT file_id, line, imported FROM i"),
    "parse_framework_facts": (lambda t: _facts(t), f"WITH {USED_SQL} SELECT file_id, line, edge_type, target_kind, target FROM u"),
    "parse_infrastructure": (_infra, INFRA_SQL),
    "parse_tests": (lambda t: E.tests(t.code, E.declarations(t.code)).select("file_id", "name", "line", "command", "confidence"), f"WITH {DECLARED_SQL} SELECT file_id, name, line, 'pytest' AS command, 'high' AS confidence FROM d WHERE r = 0"),
    "parse_symbol_ids": (lambda t: _symbols(t).select("file_id", "line", "name", "qualified_name", "symbol_id"), f"WITH {NAMED_SQL} SELECT file_id, line, name, qualified_name, symbol_id FROM s"),
    "parse_occurrences": (lambda t: E.occurrences(_symbols(t)), f"WITH {NAMED_SQL} SELECT symbol_id, file_id, line, true AS is_definition FROM s"),
    "parse_fact_properties": (lambda t: E.fact_ids(_facts(t), t.code).select("fact_id", "file_id", F.col("properties")["normalized_path"].alias("path"), F.col("properties")["method"].alias("method"), F.size("ambiguity").alias("notes")), f"WITH {USED_SQL} SELECT sha256('analysis:' || {PATH.replace('{k}', 'file_id')} || ':' || edge_type || ':' || target || ':' || line) AS fact_id, file_id, CASE target_kind WHEN 'endpoint' THEN split_part(target, ' ', 2) WHEN 'topic' THEN target WHEN 'config_key' THEN target END AS path, CASE WHEN target_kind = 'endpoint' AND target NOT LIKE 'HTTP %' THEN split_part(target, ' ', 1) END AS method, CASE WHEN target LIKE 'HTTP %' THEN 1 ELSE 0 END AS notes FROM u"),
    "parse_metrics": (lambda t: _measured(t).select("symbol_id", *METRIC_NAMES), "SELECT p_partkey AS symbol_id, " + ", ".join(f"{_metric(i)} AS {n}" for i, n in enumerate(METRIC_NAMES)) + " FROM part"),
    "parse_metric_risk": (lambda t: _measured(t).groupBy("risk").agg(F.count("*").alias("n")), "SELECT CASE p_partkey % 5 WHEN 0 THEN 'medium' WHEN 1 THEN 'medium' WHEN 4 THEN 'medium' ELSE 'low' END AS risk, count(*) AS n FROM part GROUP BY 1"),
    "parse_call_depth": (lambda t: M.transitive_depth(_depths(t), _calls(t)), DEPTH_SQL),
    "parse_path_traits": (_paths, "SELECT doc_id, " + ", ".join(f"{_case(i)} AS {n}" for i, n in enumerate(("language", "test", "vendor", "secret", "secondary"))) + " FROM documents"),
    "parse_generated": (_headed, "SELECT doc_id AS file_id FROM documents WHERE doc_id % 3 = 0"),
    "parse_messages": (_secrets, "SELECT c_custkey, 'login user=' || c_name || ' password=[REDACTED] API_KEY=[REDACTED] ok' AS message, 's' || c_custkey AS table_name FROM customer"),
    "parse_normal_forms": (lambda t: t.code.select("file_id", F.size(M.normal_tokens(F.col("text"))).alias("tokens"), F.size(M.shingles(M.normal_tokens(F.col("text")))).alias("shingles"), F.round(M.overlap(M.normal_tokens(F.col("text")), M.tokens(F.col("text"))), 6).alias("overlap")), None),
    "graph_build_edges": (lambda t: _graph(t)[1].select("from_id", "to_id", "edge_type"), f"WITH {EDGES} SELECT * FROM g"),
    "graph_build_node_stats": (lambda t: G.type_counts(_graph(t)[0].withColumn("kind", F.split("id", ":")[0]), "kind"), f"WITH {EDGES}, v AS (SELECT from_id AS id FROM g UNION SELECT to_id FROM g) SELECT split_part(id, ':', 1) AS type, count(*) AS n FROM v GROUP BY 1"),
}
