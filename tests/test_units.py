"""Operators on small hand-made inputs."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import paths as P
from tessera.functions.text import fnv1a, identifier_parts, query_variants, split_identifier
from tessera.operators import context as C
from tessera.operators import extract as E
from tessera.operators import graph as G
from tessera.operators import history as H
from tessera.operators import ranking as R
from tessera.operators import resolve
from tessera.operators import rules as X
from tessera.operators import runtime
from tessera.operators.vectors import flat_search, hash_embedding
from tessera.plans.graph_query import QueryError, execute, matches, parse
from tessera.streaming import incremental as S

NODES = [("a", "class", "Alpha"), ("b", "function", "Beta"), ("c", "function", "Gamma"), ("d", "module", "Delta"), ("e", "module", None)]
EDGES = [("1", "a", "b", "CALLS"), ("2", "b", "a", "CALLS"), ("3", "a", "c", "CALLS"), ("4", "b", "d", "CALLS"), ("5", "c", "d", "CALLS"), ("6", "d", "e", "IMPORTS"), ("7", "a", "zz", "CALLS")]


@pytest.fixture(scope="module")
def graph(spark):
    return spark.createDataFrame(NODES, "id string, node_type string, label string"), spark.createDataFrame(EDGES, "id string, from_id string, to_id string, edge_type string")


@pytest.mark.parametrize("text", ["MATCH (a) RETURN a", "MATCH (a:klass)-[:CALLS]->(b) RETURN a", "MATCH (a)-[:NOPE]->(b) RETURN a", "MATCH (a)-[:CALLS*0..2]->(b) RETURN a", "MATCH (a)-[:CALLS*1..6]->(b) RETURN a", "MATCH (a)-[:CALLS*3..2]->(b) RETURN a", "MATCH (a)<-[:CALLS*1..2]-(b) RETURN a", "MATCH (a)-[:CALLS]->(b) RETURN c", "MATCH (a)-[:CALLS]->(b) RETURN a, a", 'MATCH (a)-[:CALLS]->(b) WHERE a.size = "1" RETURN a', 'MATCH (a)-[:CALLS]->(b) WHERE a.id =~ "x" RETURN a', 'MATCH (a)-[:CALLS]->(b) WHERE a.label =~ "(" RETURN a', "MATCH (a)-[:CALLS]->(b) DELETE a", "MATCH (a)-[:CALLS]->(b) RETURN a LIMIT x", 'MATCH (a)-[:CALLS]->(b) WHERE a.label =~ "' + "x" * 101 + '" RETURN a', "MATCH (a)-[:CALLS]->(b) RETURN a %"])
def test_refused(text):
    with pytest.raises(QueryError):
        parse(text)


def test_parsed():
    p = parse('match (a:Class)-[:calls*1..3]->(b) where a.label starts_with "A\\"" and b.id = \'x\' return a, b offset 2 limit 7')
    assert (p.source.kind, p.edge, p.hops, p.limit, p.offset) == ("class", "CALLS", (1, 3), 7, 2)
    assert [f.value for f in p.filters] == ['A"', "x"]


def test_one_hop(graph):
    rows = execute("MATCH (a:class)-[:CALLS]->(b) RETURN a, b", *graph).collect()
    assert [(r.a_id, r.b_id) for r in rows] == [("a", "b"), ("a", "c")]
    assert [r.b_id for r in execute("MATCH (a:function)<-[:CALLS]-(b) RETURN b LIMIT 1 OFFSET 1", *graph).collect()] == ["a"]
    assert execute('MATCH (a)-[:CALLS]->(b) WHERE a.source = "x" RETURN a', *graph).count() == 0


def test_hops(graph):
    # a node counts once at each depth, and cycles lead back
    rows = matches(parse("MATCH (a:class)-[:CALLS*1..3]->(b) RETURN a, b"), *graph, 3).collect()
    assert sorted((r.depth, r.target_id) for r in rows) == [(1, "b"), (1, "c"), (2, "a"), (2, "d"), (3, "b"), (3, "c")]
    with pytest.raises(QueryError):
        matches(parse("MATCH (a:class)-[:CALLS*1..5]->(b) RETURN b"), *graph, 3)


def test_paths(graph):
    nodes, edges = graph
    assert [r.id for r in G.shortest_path(edges, "a", "e").orderBy("step").collect()] == ["1", "4", "6"]
    assert G.shortest_path(edges, "a", "e", 2).count() == 0
    assert G.shortest_path(edges, "e", "a").count() == 0
    assert {r.id for r in G.neighbors(nodes, edges, "d").collect()} == {"b", "c", "d", "e"}


def test_identifiers(spark):
    assert split_identifier("parseHTTPRequest_fast") == ["parse", "http", "request", "fast"]
    assert "parse_http" in query_variants("parse http")
    df = spark.createDataFrame([("parseHTTPRequest_fast x2Y",), ("",), (None,)], "s string")
    assert df.select(identifier_parts(F.col("s")).alias("p")).first().p == ["parse", "http", "request", "fast", "x2"]


def test_fnv(spark):
    def plain(s):
        h = 14695981039346656037
        for b in s.encode():
            h = (h ^ b) * 1099511628211 % 2**64
        return h

    df = spark.createDataFrame([("token",), ("éñ",), ("",)], "s string").select("s", fnv1a(F.col("s")).alias("h"))
    assert all(int(r.h) == plain(r.s) for r in df.collect())
    norm = hash_embedding(spark.createDataFrame([(1, "a b a"), (2, "")], "id int, t string"), "id", "t", 8).agg(F.sum(F.col("weight") * F.col("weight"))).first()[0]
    assert abs(norm - 1) < 1e-9


def test_flat_search(spark):
    v = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 0, [0.0, 1.0]), (3, 1, [1.0, 0.0]), (4, 0, [-1.0, 0.0]), (5, 0, [1.0])], "target_id int, target_kind int, vector array<double>")
    q = spark.createDataFrame([(9, [1.0, 0.0])], "query int, q array<double>")
    assert [(r.rank, r.target_id) for r in flat_search(v, q, 5).orderBy("rank").collect()] == [(1, 1), (2, 3)]
    assert flat_search(v, q, 5, F.col("target_kind") == 1).count() == 1


def test_fusion(spark):
    rows = spark.createDataFrame([("src/a.py", "exact symbol reference", "graph edge", 0.5), ("vendor/b.py", "text", "", 1.0), ("src/c.py", "semantic match", "", 0.4)], "path string, reason string, evidence string, score double")
    got = {r.path: r.fused for r in R.fuse(rows).collect()}
    assert got == {"src/a.py": round(0.5 + 0.35 + 0.12 * 0.35, 6), "vendor/b.py": 0.35, "src/c.py": 0.12}
    assert {r.path: r.fused for r in R.fuse(rows, "path_quality").collect()}["vendor/b.py"] == 1.0


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (1, 3, "z")], "query int, rank int, item string")
    relevant = spark.createDataFrame([(1, "y"), (1, "w"), (2, "x")], "query int, item string")
    got = {r.query: r for r in R.evaluate(ranked, relevant, 3).collect()}
    assert (got[1].recall, got[1].reciprocal_rank) == (0.5, 0.5) and got[2].ndcg == 0


def test_history(spark):
    from datetime import datetime

    commits = spark.createDataFrame([(1, "x", datetime(2024, 1, 1)), (2, "y", datetime(2024, 1, 2)), (3, "x", datetime(2024, 1, 2))], "commit_id int, author string, committed_at timestamp")
    touches = spark.createDataFrame([(1, 1, "a", 1), (1, 2, "b", 1), (2, 1, "a", 1), (2, 2, "b", 2), (3, 1, "c", 1)], "commit_id int, touch int, path string, owner int")
    w = {r.commit_id: round(r.weight, 4) for r in H.recency_weights(commits).collect()}
    assert w == {2: 1.0, 3: round(1 / 1.04, 4), 1: round(1 / 1.08, 4)}
    got = {(r.path, r.other): (r.commits, r.recency) for r in H.cochange(commits, touches).collect()}
    assert got == {("a", "b"): (2, round(1 + 1 / 1.08, 4)), ("b", "a"): (2, round(1 + 1 / 1.08, 4))}
    assert H.cochange(commits, touches, 1).count() == 0
    names = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("c", "a")], "a string, b string")
    assert {r.node: r.component for r in H.rename_closure(names).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}


def test_runtime(spark):
    rows = [(i, "r", d, False) for i, d in enumerate([1.0, 2.0, 3.0, 4.0, None, -1.0, float("nan")])]
    df = spark.createDataFrame(rows, "id int, route string, duration_ms double, error boolean").withColumn("ts", F.current_timestamp()).withColumn("symbol", F.col("id"))
    r = runtime.aggregate(df, "route").first()
    assert (r["count"], r.p50, r.p95, r.error_rate) == (7, 2.0, 4.0, 0.0)


def test_policy(spark):
    edges = spark.createDataFrame([("ui/a", "db/b"), ("db/b", "ui/a"), ("ui/a", "ui/c"), ("x", "db/b"), ("x", "x")], "source string, target string")
    paths = edges.select(F.col("source").alias("path")).union(edges.select("target"))
    mapped = X.components(paths, [("ui", "ui/**"), ("db", "db/*")])
    got = {(r.source, r.target): r.verdict for r in X.verdicts(edges, mapped, [("ui", "db", "forbid"), ("*", "*", "allow")]).collect()}
    assert got == {("ui/a", "db/b"): "violation", ("db/b", "ui/a"): "allowed", ("ui/a", "ui/c"): "allowed", ("x", "db/b"): "unknown", ("x", "x"): "allowed"}
    assert X.owners_globs("/docs/") == ["docs/**"] and X.owners_globs("*.md") == ["*.md", "**/*.md"]


def test_overlaps(spark):
    left = spark.createDataFrame([(1, 1, 0, 10), (1, 2, 11, 12)], "key int, id int, start long, end long")
    right = spark.createDataFrame([(1, 7, 10, 30), (1, 8, 13, 40), (2, 9, 0, 99)], "key int, id int, start long, end long")
    assert sorted((r.l_id, r.r_id) for r in X.overlaps(left, right, "key", 5).collect()) == [(1, 7), (2, 7)]


def test_extract(spark):
    code = spark.createDataFrame([(1, "python", "import os\nfrom a.b import c\ndef f(x):\n  pass\nclass K:\n  def g(self): pass"), (2, "rust", "pub fn go() {}\nstruct S;"), (3, "other", "def no()"), (4, None, None)], "id int, lang string, text string")
    got = sorted((r.id, r.kind, r.name) for r in E.by_patterns(code, "id", "text", F.col("lang"), E.SYMBOLS).collect())
    assert got == [(1, "class", "K"), (1, "function", "f"), (1, "function", "g"), (2, "function", "go"), (2, "struct", "S")]
    assert [r.name for r in E.by_patterns(code, "id", "text", F.col("lang"), E.IMPORTS).orderBy("at").collect()] == ["os", "a.b"]
    diff = "--- a/x\n+++ b/x\n@@ -1,2 +1,0 @@\n@@ -5 +4,3 @@\n"
    assert list(E.hunks(diff)) == [{"path": "x", "old": (1, 2), "new": None}, {"path": "x", "old": (5, 5), "new": (4, 6)}]
    assert list(E.name_status('R100\t"a\\303\\251"\tb\nM\tc')) == [{"kind": "renamed", "path": "b", "previous": "aé"}, {"kind": "modified", "path": "c", "previous": None}]
    log = "\x1e1\x1fme\x1f2024\x1fdo it\nA\tf\n\x1e2\x1fyou\x1f2025\x1fmore\n"
    assert [(c["commit_id"], len(c["touches"])) for c in E.commits(log)] == [("1", 1), ("2", 0)]
    lcov = spark.createDataFrame([(1, 1, "SF:a.py"), (1, 2, "DA:3,1"), (1, 3, "DA:4,0"), (1, 4, "end_of_record"), (1, 5, "SF:b.py"), (1, 6, "DA:1,2")], "report int, n int, text string")
    assert sorted((r.path, r.line) for r in E.covered_lines(lcov).collect()) == [("a.py", 3), ("b.py", 1)]


def test_resolve(spark):
    files = spark.createDataFrame([("src/a/x.ts",), ("src/b/index.ts",), ("src/b.ts",)], "path string")
    imports = spark.createDataFrame([(1, "src/a", "./x"), (2, "src/a", "../b"), (3, "src/a", "react")], "import_id int, base string, imported string")
    assert {r.import_id: (r.status, r.path) for r in resolve.resolve_relative(imports, files).collect()} == {1: ("resolved", "src/a/x.ts"), 2: ("ambiguous", "src/b.ts"), 3: ("external", None)}


def test_paths_of_files(spark):
    df = spark.createDataFrame([("a/tests/x.py",), ("vendor/y.go",), ("Dockerfile",), (".env",), ("z.PY",)], "p string")
    rows = df.select(P.language(F.col("p")).alias("l"), P.is_test(F.col("p")).alias("t"), P.is_vendor(F.col("p")).alias("v"), P.is_secret(F.col("p")).alias("s")).collect()
    assert [tuple(r) for r in rows] == [("python", True, False, False), ("go", False, True, False), ("dockerfile", False, False, False), ("unknown", False, False, True), ("python", False, False, False)]
    r = spark.range(1).select(P.endpoint_path(F.lit("https://h.x/a/b?q=1")).alias("e"), P.redacted(F.lit("x api_key=abc y")).alias("r"), P.sql_table(F.lit("select 1 from t join u")).alias("t")).first()
    assert tuple(r) == ("/a/b", "x api_key=[REDACTED] y", "t")


def test_render():
    assert C.render("files", [{"path": "a,b", "n": 1}]) == "files[1]{path,n}:\n  a\\,b,1"
    assert C.ticket_ids("see ABC-12 and x-1") == ["ABC-12"]


def test_stream(spark, tmp_path):
    from datetime import datetime

    rows = [("a", False, datetime(2024, 1, 1, 0, m)) for m in (1, 2, 59)] + [("a", True, datetime(2024, 1, 1, 1, 0)), ("b", True, datetime(2024, 1, 5))]
    spark.createDataFrame(rows, "route string, error boolean, ts timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("route string, error boolean, ts timestamp").parquet(str(tmp_path / "in"))
    S.run(S.windowed_counts(stream), str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out/data")).collect()
    assert sorted((r.route, r.n, r.errors) for r in got if r.route == "a") == [("a", 1, 1), ("a", 3, 0)]


def test_upsert(spark, tmp_path):
    one = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (2, "z", 1)], "id int, v string, at int")
    S.upsert(one, 0, str(tmp_path), "id", "at")
    S.upsert(spark.createDataFrame([(2, "new", 5), (3, "w", 5)], "id int, v string, at int"), 1, str(tmp_path), "id", "at")
    assert {r.id: r.v for r in spark.read.parquet(str(tmp_path / "v1")).collect()} == {1: "y", 2: "new", 3: "w"}
