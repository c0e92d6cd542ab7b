"""Change verification, impact, test selection and benchmark scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import facts as E
from tessera.operators import history as H
from tessera.operators import scorers as K
from tessera.operators import verify as X
from tessera.queries import code
from tessera.queries.code import PATH, _values
from tessera.sources.bindings import TOUCHES_SQL

SURFACE = [(0, 9, "class", "Box{k}", "class Box{k}:"), (1, 4, "constant", "run_{k}", "const run_{k} = async (x) =>"), (2, 4, "class", "Svc{k}", "public class Svc{k} extends Base{m} implements Run, Stop<A>"), (2, 6, "method", "go{k}", "public int go{k}(int a)"), (3, 4, "type", "Box{k}", "type Box{k} struct"), (3, 5, "type", "Shape{k}", "type Shape{k} interface"), (4, 3, "function", "go_{k}", "fn go_{k}(a: u8)")]
SURFACE_SQL = f"f AS (SELECT k, {PATH.replace('{k}', 'k')} AS path, kind, {code._filled('symbol')} AS symbol, {code._filled('signature')} AS signature FROM {_values(SURFACE, 'kind, symbol, signature')})"


def _surfaces(t):
    """Before: all files; after: without every eleventh, and with another parameter in every thirteenth."""
    after = t.code.where("file_id % 11 <> 3").withColumn("text", F.when(F.col("file_id") % 13 == 4, F.replace("text", F.lit("(a"), F.lit("(b, a"))).otherwise(F.col("text")))
    return X.public_surface(t.code), X.public_surface(after)


def _diff(t):
    p = F.concat(F.lit("src/"), F.col("p_brand"), F.lit("/"), F.col("p_partkey").cast("string"))
    edit = F.concat(F.lit("diff --git a/"), p, F.lit(" b/"), p, F.lit(".new\n--- a/"), p, F.lit("\n+++ b/"), p, F.lit(".new\n@@ -1 +1 @@\n"))
    gone = F.concat(F.lit("--- a/"), p, F.lit("\t2024\n+++ /dev/null\n@@ -1 +0,0 @@\n--- /dev/null\n+++ b/x\n"))
    return t.raw("part").select("p_partkey", F.array_join(X.changed_files(F.concat(edit, gone)), " ").alias("files"))


def _changed(t):
    return t.raw("customer").select(F.concat(F.lit("./"), F.lower("c_mktsegment"), F.lit("/"), (F.col("c_nationkey") % 5).cast("string"), F.lit("/f"), F.col("c_custkey").cast("string")).alias("path"))


FORBIDDEN = [("**/3/**", "threes"), ("machinery/*f1*", "ones"), ("./building/2/**", "twos")]


def _boundary(t):
    return X.boundary_findings(_changed(t), ["household/0/f5"], ["household/1/f6"], ["furniture/4/f4"], FORBIDDEN, False).select("path", "kind", F.left("reason", F.lit(25)).alias("reason"))


BOUNDARY_SQL = """SELECT path, CASE r WHEN 5 THEN 'out_of_boundary' ELSE 'forbidden_boundary' END AS kind, left(CASE r WHEN 1 THEN 'matches forbidden contract file' WHEN 5 THEN 'outside the boundary, without evidence for more' ELSE 'matches forbidden pattern `' END, 25) AS reason FROM (SELECT './' || p AS path,
CASE WHEN p = 'furniture/4/f4' THEN 1 WHEN contains(p, '/3/') THEN 2 WHEN regexp_matches(p, 'machinery/.*f1') THEN 3 WHEN starts_with(p, 'building/2/') THEN 4 WHEN p IN ('household/0/f5', 'household/1/f6') THEN NULL ELSE 5 END AS r
FROM (SELECT lower(c_mktsegment) || '/' || c_nationkey % 5 || '/f' || c_custkey AS p FROM customer)) WHERE r IS NOT NULL"""


def _api(t):
    c = t.raw("customer").select(F.col("c_custkey").alias("k"), F.concat(F.when(F.col("c_custkey") % 3 == 0, "core/").otherwise("app/"), F.when(F.col("c_custkey") % 4 == 0, "api/").when(F.col("c_custkey") % 4 == 1, "internal/").otherwise("x/"), F.col("c_custkey").cast("string")).alias("path"))
    edges = c.select(F.col("path").alias("source"), (F.col("k") + 1).alias("k")).join(c.select("k", F.col("path").alias("target")), "k").select("source", "target")
    found = X.public_api_findings(edges, [("core-api", "core/**", "use the api", ["core/api/**"], ["core/internal/**"])])
    scope = X.exemption_scope(F.col("source"), F.col("target"), ["app/api/**"], ["tests", "vendor"], F.lit(False), F.lit(False))
    return found.withColumn("scope", scope)


API_SQL = """WITH c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 'core/' ELSE 'app/' END || CASE c_custkey % 4 WHEN 0 THEN 'api/' WHEN 1 THEN 'internal/' ELSE 'x/' END || c_custkey AS path FROM customer)
SELECT a.path AS source, b.path AS target, 'core-api' AS rule, CASE WHEN b.k % 4 = 1 THEN 'internal' ELSE 'outside_public' END AS kind, CASE WHEN a.k % 4 = 0 THEN 'configured_path' END AS scope FROM c a JOIN c b ON b.k = a.k + 1 WHERE a.k % 3 <> 0 AND b.k % 3 = 0 AND b.k % 4 <> 0"""


def _attested(t):
    o = t.raw("orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").cast("timestamp").alias("created_at"))
    required = o.where("k % 4 = 0").select(F.concat(F.lit("r"), F.col("k").cast("string")).alias("requirement"), F.lit("make test").alias("command"), F.lit(None).cast("string").alias("cwd"))
    given = o.where("k % 6 = 0").select(F.concat(F.lit("a"), F.col("k").cast("string")).alias("id"), F.concat(F.lit("r"), F.col("k").cast("string")).alias("requirement"), F.when(F.col("k") % 5 == 0, "other").otherwise("c1").alias("contract"), F.lit("d1").alias("digest"), "created_at", F.when(F.col("k") % 9 == 0, "failed").when(F.col("k") % 9 == 3, "denied").otherwise("passed").alias("outcome"), F.when(F.col("k") % 24 == 0, "make all").otherwise("make test").alias("command"), F.lit(".").alias("cwd"))
    return X.attestation_findings(required, given, "c1", "d1", F.lit("1995-01-01").cast("timestamp"))


ATTESTED_SQL = """WITH a AS (SELECT *, o_orderkey AS k FROM orders WHERE o_orderkey % 6 = 0) SELECT 'a' || k AS id, 'validation_attestation_contract_mismatch' AS kind FROM a WHERE k % 5 = 0 UNION ALL SELECT 'a' || k, 'validation_attestation_stale' FROM a WHERE o_orderdate < TIMESTAMP '1995-01-01'
UNION ALL SELECT 'a' || k, 'validation_command_' || CASE k % 9 WHEN 0 THEN 'failed' ELSE 'denied' END FROM a WHERE k % 9 IN (0, 3) UNION ALL SELECT 'r' || o_orderkey, 'validation_attestation_missing' FROM orders WHERE o_orderkey % 4 = 0 AND o_orderkey % 6 <> 0 UNION ALL SELECT 'a' || k, 'validation_command_replay_mismatch' FROM a WHERE k % 24 = 0"""


def _facts(t):
    return E.framework_facts(t.code).join(t.code.select("file_id", "path"), "file_id").select("path", "target")


def _impacts(t):
    cochange = t.code.where("file_id % 40 = 1").select("path", F.lit("high").alias("confidence"))
    references = t.code.where("file_id % 50 = 4").select("path", F.lit("medium").alias("confidence"))
    return X.impacts(references, cochange, X.shared_targets(_facts(t), "web/page1.js"), "web/page1.js", 200).select("path", "score", F.size("reasons").alias("reasons"))


IMPACT_SQL = f"""WITH {code.USED_SQL}, u2 AS (SELECT {PATH.replace('{k}', 'file_id')} AS path, target FROM u WHERE edge_type NOT IN ('EXTENDS', 'IMPLEMENTS')), p AS (SELECT p_partkey AS k, {PATH.replace('{k}', 'p_partkey')} AS path FROM part),
w AS (SELECT path, 1.85::DOUBLE AS s, 'r' AS why FROM p WHERE k % 50 = 4 UNION ALL SELECT path, 0.2225::DOUBLE, 'c' FROM p WHERE k % 40 = 1 UNION ALL SELECT DISTINCT path, 0.2::DOUBLE, 's' || target FROM u2 WHERE target IN (SELECT target FROM u2 WHERE path = 'web/page1.js'))
SELECT path, max(s) AS score, CAST(count(DISTINCT why) AS INTEGER) AS reasons FROM w WHERE path <> 'web/page1.js' GROUP BY 1 ORDER BY score DESC, path LIMIT 200"""


def _selected(t):
    """Python files are tests of the file before them, with overlaps, history, coverage and results by number."""
    c = t.code
    tests = c.where("language = 'python'").select(F.col("file_id").alias("test_id"), F.concat(F.lit("test mod"), F.col("file_id").cast("string")).alias("name"), "path", F.when(F.col("file_id") % 2 == 0, "pytest").alias("command"), F.when(F.col("file_id") % 3 == 0, "high").otherwise("low").alias("confidence"))
    changed = c.where("language = 'javascript'").select(F.col("file_id").alias("changed"), "path")
    near = lambda step, mod: changed.select("changed", (F.col("changed") + step).alias("test_id")).join(tests.select("test_id", "path"), "test_id").where(F.col("changed") % mod == 1)
    overlap = near(4, 2).select("changed", "test_id", (F.col("changed") % 7).alias("shared"))
    history, coverage = near(9, 3).select("changed", "path"), near(-1, 1 + 1).select("changed", "path", (F.col("changed") % 4 == 1).alias("by_symbol"))
    results = tests.where("test_id % 10 = 0").select("path", F.explode(F.array(*[F.lit(i) for i in range(6)])).alias("i")).select("path", (F.col("i") == 2).alias("failed"))
    return X.select_with_evidence(tests, changed, overlap, near(4, 5).select("changed", "path"), history, coverage, results, 3)


SELECTED_SQL = """WITH ts AS (SELECT p_partkey AS t, 'test mod' || p_partkey AS name, CASE WHEN p_partkey % 2 = 0 THEN 'pytest' END AS command, CASE WHEN p_partkey % 3 = 0 THEN 0.85::DOUBLE ELSE 0.35::DOUBLE END AS c FROM part WHERE p_partkey % 5 = 0), ch AS (SELECT p_partkey AS k FROM part WHERE p_partkey % 5 = 1),
nr AS (SELECT k, k + 4 AS t, k % 7 AS shared, k % 5 = 1 AS ran, NULL AS co, NULL AS sym FROM ch WHERE k % 2 = 1 UNION ALL SELECT k, k + 9, NULL, NULL, true, NULL FROM ch WHERE k % 3 = 1 UNION ALL SELECT k, k - 1, NULL, NULL, NULL, k % 4 = 1 FROM ch WHERE k % 2 = 1),
g AS (SELECT k, t, max(shared) AS shared, bool_or(co) AS co, bool_or(sym) AS sym FROM nr WHERE t IN (SELECT t FROM ts) GROUP BY 1, 2),
s AS (SELECT k AS changed, t AS test_id, name, round(c + CASE WHEN shared > 0 THEN 0.5::DOUBLE + least(shared, 5) * 0.05::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN t = k + 4 AND k % 5 = 1 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN co THEN 0.18::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN sym THEN 0.3::DOUBLE WHEN NOT sym THEN 0.18::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN t % 10 = 0 THEN 0.46::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN command IS NOT NULL THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END, 6) AS score FROM g JOIN ts USING (t)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY changed ORDER BY score DESC, name, test_id) AS INTEGER) AS rank FROM s) SELECT changed, rank, test_id, score, CASE WHEN score > 0.85 THEN 'high' WHEN score > 0.55 THEN 'medium' ELSE 'low' END AS confidence FROM r WHERE rank <= 3"""


def _cases(t):
    o = t.raw("orders")
    k = F.col("o_orderkey")
    paths = lambda n, m: F.transform(F.sequence(F.lit(1), (k % n + 1).cast("int")), lambda i: F.concat(F.lit("src/p"), ((i * m + k) % 9).cast("string")))
    none = F.array().cast("array<string>")
    return o.select(k.alias("case_id"), paths(3, 2).alias("expected_context"), paths(5, 1).alias("context"), F.when(k % 4 == 0, none).otherwise(paths(2, 3)).alias("expected_impact"), paths(4, 4).alias("impact"), paths(2, 5).alias("expected_tests"), none.alias("tests"), paths(4, 1).alias("boundary"), F.array(F.lit("P3")).alias("forbidden"), F.when(k % 2 == 0, 0.85).otherwise(0.3).alias("probability"), F.when(k % 3 == 0, "fail").when(k % 3 == 1, "pass").alias("expected_verdict"), F.lit("pass").alias("verdict"), F.col("o_orderstatus").alias("family"))


def _paths_sql(n: int, m: int) -> str:
    return f"[('src/p' || (i * {m} + k) % 9) FOR i IN range(1, k % {n} + 2)]"


WORKFLOW_SQL = f"""c AS (SELECT k, o_orderstatus AS family, {_paths_sql(3, 2)} AS ec, {_paths_sql(5, 1)} AS ac, CASE WHEN k % 4 = 0 THEN CAST([] AS VARCHAR[]) ELSE {_paths_sql(2, 3)} END AS ei, {_paths_sql(4, 4)} AS ai, {_paths_sql(4, 1)} AS bo FROM (SELECT o_orderkey AS k, o_orderstatus FROM orders)),
w AS (SELECT k AS case_id, family, round(len(list_filter(ec, lambda e: list_contains(ac, e))) / len(ec), 6) AS context_recall, round(CASE WHEN len(ei) = 0 THEN 1.0::DOUBLE ELSE len(list_filter(ei, lambda e: list_contains(ai, e))) / len(ei) END, 6) AS impact_recall, 0.0::DOUBLE AS test_recall,
round((len(bo) - CASE WHEN list_contains(bo, 'src/p3') THEN 1 ELSE 0 END) / len(bo), 6) AS boundary_precision, round(abs(CASE WHEN k % 2 = 0 THEN 0.85::DOUBLE ELSE 0.3::DOUBLE END - CASE WHEN k % 3 = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END), 6) AS calibration_error, CASE k % 3 WHEN 0 THEN false WHEN 1 THEN true END AS correct FROM c)"""


def _policy(t):
    n = t.raw("customer").select(F.col("c_custkey").alias("k"), F.concat(F.lit("s"), (F.col("c_custkey") % 60).cast("string")).alias("source"), F.concat(F.lit("t"), (F.col("c_custkey") % 45).cast("string")).alias("target"), F.concat(F.lit("f"), (F.col("c_nationkey") % 4).cast("string")).alias("family"))
    cases = n.select(F.col("k").alias("case_id"), "family", F.concat(F.lit("r"), (F.col("k") % 3).cast("string")).alias("rule"), "source", "target", F.when(F.col("k") % 5 == 0, "allowed").otherwise("violation").alias("expected"))
    return K.policy_families(cases, n.select("family", F.lit("r1").alias("rule"), "source", "target", F.lit("violation").alias("outcome")))


POLICY_SQL = """WITH n AS (SELECT c_custkey AS k, 's' || c_custkey % 60 AS source, 't' || c_custkey % 45 AS target, 'f' || c_nationkey % 4 AS family FROM customer), f AS (SELECT source, target, min(k) AS k FROM n GROUP BY 1, 2),
m AS (SELECT n.family, f.k AS case_id, n.family = c.family AND f.k % 3 = 1 AND f.k % 5 <> 0 AS hit FROM n JOIN f USING (source, target) JOIN n c ON c.k = f.k), a AS (SELECT family, count(*) AS actual, count(*) FILTER (hit) AS tp, count(*) FILTER (NOT hit) AS fp FROM m GROUP BY 1),
e AS (SELECT family, count(*) AS expected, count(*) FILTER (k NOT IN (SELECT case_id FROM m WHERE hit)) AS fn FROM n WHERE k % 5 <> 0 GROUP BY 1)
SELECT family, coalesce(expected, 0) AS expected, coalesce(actual, 0) AS actual, coalesce(tp, 0) AS true_positives, coalesce(fp, 0) AS false_positives, coalesce(fn, 0) AS false_negatives, round(CASE WHEN tp + fp = 0 THEN 1 ELSE tp / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn = 0 THEN 1 ELSE tp / (tp + fn) END, 6) AS recall FROM e FULL JOIN a USING (family)"""


def _history_cases(t):
    """Cases by path: the churn that they ask for, and the first and last commit that they expect."""
    first = t.touches.groupBy("path").agg(F.min_by("commit_id", F.struct("touched_at", "commit_id")).alias("first_commit"), F.max_by("commit_id", F.struct("touched_at", "commit_id")).alias("last_commit"), F.count("*").alias("touches"))
    cases = first.select("path", (F.col("first_commit") + (F.col("path") % 2)).alias("expected_first"), F.col("last_commit").alias("expected_last"), (F.col("path") % 60).alias("min_touches"))
    churn = K.churn_cases(H.churn(t.touches), t.raw("part").select(F.col("p_partkey").alias("path"), (F.col("p_partkey") % 50).alias("min_touches"), F.lit(0.5).alias("min_hotspot")))
    return K.provenance_cases(first, cases).withColumnRenamed("passed", "provenance").join(churn.withColumnRenamed("passed", "churn"), "path")


HISTORY_SQL = f"""WITH {TOUCHES_SQL}, h AS (SELECT path, count(*) AS n, sum(additions) AS v, sum(1 / (1 + (epoch_us((SELECT max(touched_at) FROM touches)) - epoch_us(touched_at)) / 86400000000.0::DOUBLE / 30)) AS r FROM touches GROUP BY 1)
SELECT path, path % 2 = 0 AND n >= path % 60 AS provenance, n >= path % 50 AND round(r * ln(1 + n) + ln(1 + v) / 10, 6) >= 0.5 AS churn FROM h JOIN part ON p_partkey = path"""


def _linked(t):
    tests = t.code.where("language = 'python' OR language = 'go'").select("path", F.concat(F.lit("t "), "path").alias("name"))
    return X.linked_tests(t.code.where("language = 'javascript'"), tests, 4).groupBy("links").agg(F.count("*").alias("n"))


def _quality(t):
    ranked = t.raw("customer").select((F.col("c_custkey") % 100).alias("query"), (F.floor(F.col("c_custkey") / 100) + 1).alias("rank"), F.concat(F.lit("a/"), "c_mktsegment").alias("path"))
    return K.quality(ranked, t.raw("nation").select(F.col("n_nationkey").alias("query"), F.when(F.col("n_nationkey") % 3 == 0, "building").otherwise("MACHINERY").alias("expected")))


QUALITY_SQL = "WITH h AS (SELECT n_nationkey AS q, min(c_custkey // 100 + 1) FILTER (c_mktsegment = CASE WHEN n_nationkey % 3 = 0 THEN 'BUILDING' ELSE 'MACHINERY' END) AS f FROM nation LEFT JOIN customer ON c_custkey % 100 = n_nationkey GROUP BY 1) SELECT count(*) AS cases, round(avg(CASE WHEN f = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS precision_at_1, round(avg(CASE WHEN f IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS hit_rate, round(avg(coalesce(1 / f, 0.0::DOUBLE)), 6) AS mrr FROM h"

QUERIES = {
    "rules_public_surface": (lambda t: X.public_surface(t.code), f"WITH {SURFACE_SQL} SELECT path, kind, symbol, signature FROM f"),
    "rules_surface_delta": (lambda t: X.surface_delta(*_surfaces(t)), f"WITH {SURFACE_SQL} SELECT path, kind, symbol, CASE WHEN k % 11 = 3 THEN 'removed' ELSE 'changed' END AS change FROM f WHERE k % 11 = 3 OR (k % 13 = 4 AND contains(signature, '(a'))"),
    "rules_changed_files": (_diff, "SELECT p_partkey, 'src/' || p_brand || '/' || p_partkey || ' src/' || p_brand || '/' || p_partkey || '.new x' AS files FROM part"),
    "rules_boundary_findings": (_boundary, BOUNDARY_SQL),
    "rules_public_api": (_api, API_SQL),
    "rules_attestations": (_attested, ATTESTED_SQL),
    "rules_keyword_components": (lambda t: X.keyword_components(t.raw("part").select(F.concat(F.lit("a"), F.when(F.col("p_size") % 3 == 0, "/api/").when(F.col("p_size") % 3 == 1, "/TestConfig/").otherwise("/x/"), F.col("p_partkey").cast("string")).alias("path"))), "SELECT unnest(CASE p_size % 3 WHEN 0 THEN ['api'] WHEN 1 THEN ['tests', 'configuration'] ELSE [] END) AS component, 'a' || CASE p_size % 3 WHEN 0 THEN '/api/' WHEN 1 THEN '/TestConfig/' ELSE '/x/' END || p_partkey AS path FROM part"),
    "rules_impacts": (_impacts, IMPACT_SQL),
    "rules_tests_with_evidence": (_selected, SELECTED_SQL),
    "rules_missing_tests": (lambda t: X.missing_tests(t.raw("supplier").select(F.col("s_suppkey").cast("string").alias("test_id"), F.col("s_name").alias("name")), t.raw("supplier").where("s_suppkey % 3 = 0").select(F.col("s_suppkey").cast("string").alias("test_id"), F.lit("Supplier#000000001").alias("name"))), "SELECT CAST(s_suppkey AS VARCHAR) AS test_id, s_name AS name FROM supplier WHERE s_suppkey % 3 <> 0 AND s_suppkey <> 1"),
    "rules_linked_tests": (_linked, None),
    "bench_workflow": (lambda t: K.workflow(_cases(t)), f"WITH {WORKFLOW_SQL} SELECT * EXCLUDE (family) FROM w"),
    "bench_workflow_families": (lambda t: K.summary(K.workflow(_cases(t)).join(_cases(t).select("case_id", "family"), "case_id"), "family"), f"WITH {WORKFLOW_SQL} SELECT family, count(*) AS cases, " + ", ".join(f"round(avg({n}), 6) AS {n}" for n in ("context_recall", "impact_recall", "test_recall", "boundary_precision", "calibration_error")) + ", round(coalesce(avg(CAST(correct AS INTEGER)), 1.0::DOUBLE), 6) AS verdict_accuracy FROM w GROUP BY 1"),
    "bench_policy": (_policy, POLICY_SQL),
    "bench_history_cases": (_history_cases, HISTORY_SQL),
    "bench_quality": (_quality, QUALITY_SQL),
}
