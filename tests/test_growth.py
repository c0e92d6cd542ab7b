"""Plans whose rows grow with the input and not with the product of its groups."""

import glob
import os

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions.text import fnv1a, word_tokens
from tessera.operators import registry as G
from tessera.operators import resolve as R
from tessera.operators import vectors as V
from tessera.operators.graph import merge_edges, shortest_path
from tessera.operators.rules import difference
from tessera.operators.search import bm25
from tessera.plans.graph_query import matches, parse
from tessera.queries import registered
from tessera.sources.bindings import Tables


def nodes_of(plan):
    """A physical plan's nodes, also those below stages of adaptive execution."""
    yield plan
    kind = plan.getClass().getSimpleName()
    inner = [plan.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [plan.plan()] if kind.endswith("QueryStageExec") else []
    children = plan.children()
    for below in inner or [children.apply(i) for i in range(children.size())]:
        yield from nodes_of(below)


def run(df):
    """df's rows, and the most rows that a step of its plan gave out."""
    rows = df.collect()
    counts = [n.metrics().get("numOutputRows") for n in nodes_of(df._jdf.queryExecution().executedPlan())]
    return rows, max(int(c.get().value()) for c in counts if c.isDefined())


def test_names_meet_counts_of_symbols(spark):
    symbols = spark.range(300).select(F.col("id").alias("symbol_id"), F.lit(1).alias("file_id"), F.lit("a").alias("name"))
    uses = spark.range(300).select((F.col("id") + 1000).alias("use_id"), F.lit(1).alias("file_id"), F.lit("a").alias("name"))
    rows, most = run(R.resolve_names(uses, symbols))
    assert {(r.status, r.candidates, r.symbol_id, r.strategy) for r in rows} == {("ambiguous", 300, None, "same_file")} and len(rows) == 300
    assert most <= 600


def test_names_of_one_use(spark):
    """Rows of one use share their candidates; a symbol of two names or with two rows counts once."""
    symbols = spark.createDataFrame([(1, 1, "a"), (1, 1, "b"), (2, 1, "b"), (2, 1, "b"), (3, 2, "c"), (4, 1, "d")], "symbol_id int, file_id int, name string")
    uses = spark.createDataFrame([(1, 1, "a"), (1, 1, "b"), (2, 1, "d"), (2, 1, "d"), (3, 1, "c"), (4, 1, "none")], "use_id int, file_id int, name string")
    got = sorted((r.use_id, r.status, r.candidates, r.symbol_id or 0, r.strategy or "") for r in R.resolve_names(uses, symbols).collect())
    assert got == [(1, "ambiguous", 2, 0, "same_file")] * 2 + [(2, "resolved", 1, 4, "same_file")] * 2 + [(3, "resolved", 1, 3, "project"), (4, "unresolved", 0, 0, "")]


def test_tiers_meet_counts_of_symbols(spark):
    symbols = spark.range(400).select(F.col("id").alias("symbol_id"), F.lit("symbol").alias("name"), F.lit("m::symbol").alias("qualified_name"), F.lit(1).alias("file_id"))
    # each row finds its candidates by another tier: same file, same module, project, import, likeness
    kinds = [("symbol", 1, "x"), ("symbol", 2, "m"), ("symbol", 2, "x"), ("ymbol", 3, "x"), ("a symbol", 2, "x")]
    uses = spark.createDataFrame([(f, f"{m}{i}" if m == "x" else m, t) for t, f, m in kinds for i in range(80)], "file_id int, module string, token string")
    imports = spark.createDataFrame([(3, "m.symbol", None, None)], "file_id int, imported string, target_file int, target_symbol int")
    rows, most = run(G.resolve_symbols(uses, symbols, imports))
    assert {(r.strategy, r.candidates) for r in rows} == {("same-file", 400), ("same-module", 400), ("common-name-cap", 400), ("suffix-import-reachability", 400), ("fuzzy-fallback", 400)}
    assert most <= 5000


def test_tiers_count_a_symbol_of_two_names_once(spark):
    symbols = spark.createDataFrame([(1, "alpha", "m::alpha", 1), (1, "alphabet", "m::alphabet", 1), (2, "alphabet", "n::alphabet", 2)], "symbol_id int, name string, qualified_name string, file_id int")
    uses = spark.createDataFrame([(9, "z", "alph")], "file_id int, module string, token string")
    none = spark.createDataFrame([], "file_id int, imported string, target_file int, target_symbol int")
    (r,) = G.resolve_symbols(uses, symbols, none).collect()
    assert (r.strategy, r.candidates) == ("fuzzy-fallback", 2)


def test_imports_meet_counts_of_folders(spark):
    """A folder's files are counted, not listed, and no side that grows with the files is replicated."""
    files = spark.range(300).select(F.concat(F.lit("lib/f"), F.col("id").cast("string"), F.lit(".py")).alias("path"))
    imports = spark.range(300).select("id", F.lit("a.py").alias("path"), F.lit("python").alias("language"), F.lit("lib").alias("imported")).withColumnRenamed("id", "import_id")
    df = G.resolve_imports(imports, files)
    assert not [n for n in nodes_of(df._jdf.queryExecution().executedPlan()) if "Broadcast" in n.getClass().getSimpleName()]
    rows, most = run(df)
    assert {(r.status, r.candidates) for r in rows} == {("ambiguous", 300)} and len(rows) == 300
    assert most <= 6000


def test_imports_of_files_in_tried_folders(spark):
    """A file found by its path and in its folder counts once, also where another path that is tried names the folder."""
    files = spark.createDataFrame([("a/index.ts",), ("a/b.ts",), ("c.ts",), ("c/d.ts",), ("e/__init__.py",), ("e.py",)], "path string")
    imports = spark.createDataFrame([(1, "x.ts", "typescript", "./a"), (2, "x.ts", "typescript", "./c"), (3, "x.ts", "typescript", "@/b"), (4, "x.py", "python", "e"), (5, "x.ts", "typescript", "./c/d")], "import_id int, path string, language string, imported string")
    got = {r.import_id: (r.status, r.candidates, r.target) for r in G.resolve_imports(imports, files, aliases=[("@/*", ["a/*", "a"])], base_url="").collect()}
    assert got == {1: ("ambiguous", 2, None), 2: ("ambiguous", 2, None), 3: ("ambiguous", 2, None), 4: ("ambiguous", 2, None), 5: ("resolved", 1, "c/d.ts")}


def test_flat_search_passes_on_few_rows(spark):
    """Scores of all pairs stay in a block; of equal scores, the smaller ids; sums are rounded in order of components."""
    n = 3000
    at = lambda i: F.round(F.sin(F.col("id") * (i + 1)) * 2, 3)
    pool = spark.range(n).select((F.col("id") + F.when(F.col("id") % 5 == 0, 100_000).otherwise(0)).alias("target_id"), F.when(F.col("id") == 7, F.lit(None)).otherwise(F.array(*[F.when((F.col("id") == 8) & F.lit(i == 1), F.lit(None)).otherwise(at(i).cast("float")) for i in range(3)])).alias("vector"))
    pool = pool.unionByName(spark.range(40).select((F.col("id") + 500_000).alias("target_id"), F.expr("array(1.5f, 1.5f, 1.5f)").alias("vector")))
    queries = pool.where("target_id % 50 = 1 OR target_id = 500001").select(F.col("target_id").alias("query"), F.col("vector").alias("q"))
    rows, most = run(V.flat_search(pool, queries, 4))
    sides = queries.crossJoin(pool.where("target_id <> 8"))
    score = F.round(V.dot(F.col("vector"), F.col("q")), 6)
    window = Window.partitionBy("query").orderBy(F.col("score").desc(), "target_id")
    want = sides.select("query", "target_id", score.alias("score")).where("score > 0").withColumn("rank", F.row_number().over(window)).where("rank <= 4")
    assert {(r.query, r.rank, r.target_id, r.score) for r in rows} == {(r.query, r.rank, r.target_id, r.score) for r in want.collect()}
    assert most <= 20_000


def test_flat_search_rounds_as_spark(spark):
    values = [0.0000005, 0.0000015, 2.5e-6, 1.0000005, 0.1234565, 0.30000049999999995, 1e10 / 3, 123456.7890125, 5e-7 - 1e-22, 4.4e-7]
    rows = spark.createDataFrame([(x,) for x in values], "x double").select("x", F.round("x", 6).alias("y")).collect()
    assert [r.y for r in rows] == list(V._rounded(np.array([r.x for r in rows])))


def test_hops_lead_to_targets_only(spark):
    """Nodes that share a neighbour of very many others don't meet these if they are no targets."""
    n = 200
    nodes = spark.range(n).select(F.concat(F.lit("c"), "id").alias("id"), F.lit("class").alias("node_type")).union(spark.createDataFrame([("hub", "package"), ("f", "function"), ("m", "module"), ("m2", "module")], "id string, node_type string")).withColumn("label", F.col("id"))
    both = spark.range(n).select(F.concat(F.lit("c"), "id").alias("c"))
    edges = both.select(F.col("c").alias("from_id"), F.lit("hub").alias("to_id")).union(both.select(F.lit("hub"), "c")).union(spark.createDataFrame([("c1", "f"), ("f", "m"), ("f", "gone"), ("gone", "m"), ("c2", "m"), ("m", "m2"), ("hub", "hub")], "from_id string, to_id string")).withColumn("edge_type", F.lit("CALLS")).withColumn("id", F.concat_ws(">", "from_id", "to_id"))
    rows, most = run(matches(parse("MATCH (a:class)-[*1..2]->(b:module) RETURN a, b"), nodes, edges))
    assert sorted((r.source_id, r.target_id, r.depth) for r in rows) == [("c1", "m", 2), ("c2", "m", 1), ("c2", "m2", 2)]
    assert most <= 1000
    far = matches(parse('MATCH (a:class)-[*2..3]->(b) WHERE b.id = "m2" RETURN a, b'), nodes, edges).collect()
    assert sorted((r.source_id, r.target_id, r.depth) for r in far) == [("c1", "m2", 3), ("c2", "m2", 2)]


def test_shortest_path_keeps_ids_of_few_edges(spark):
    """Edges are written without ids, and levels don't pass the node of very many neighbours if the other end is smaller."""
    n = 500
    spokes = spark.range(n).select(F.lit("hub").alias("from_id"), F.concat(F.lit("n"), "id").alias("to_id"))
    more = spark.createDataFrame([("a", "b"), ("b", "hub"), ("n3", "y"), ("y", "z"), ("z", "a"), ("b", "b2"), ("b2", "hub")], "from_id string, to_id string")
    edges = spokes.union(more).withColumn("id", F.concat_ws(">", "from_id", "to_id"))
    edges = edges.union(edges.where("from_id = 'b' AND to_id = 'hub'").withColumn("id", F.lit("a twin")))
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    old = set(glob.glob(f"{folder}/round-*"))
    path = shortest_path(edges, "a", "z", 5).orderBy("step").collect()
    assert [r.id for r in path] == ["a>b", "a twin", "hub>n3", "n3>y", "y>z"]
    written = [spark.read.parquet(p) for p in set(glob.glob(f"{folder}/round-*")) - old]
    assert max(d.count() for d in written if "id" in d.columns) <= 10
    assert max(d.count() for d in written if d.columns == ["node"]) <= 10
    assert shortest_path(edges, "a", "z", 4).count() == shortest_path(edges, "a", "a").count() == shortest_path(edges, "z", "nowhere").count() == 0


def test_merged_before_ids(spark):
    rows = spark.createDataFrame([("a", "b", "CALLS", "low", 0.1), ("a", "b", "CALLS", "high", 0.8), ("a", "b", "CALLS", "exact", 0.8), ("a", "c", "CALLS", "low", None)], "from_id string, to_id string, edge_type string, confidence string, rank double")
    assert sorted((r.to_id, r.confidence) for r in merge_edges(rows, "rank").collect()) == [("b", "exact"), ("c", "low")]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
def test_files_are_dealt_out_and_not_replicated(spark):
    """Source files' texts are made in as many tasks as there are, and no table with a row for each file is replicated."""
    t = Tables(spark, "/root/testdata/sf0.001")
    assert t.code.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    for name in ("parse_symbol_ids", "parse_tests", "parse_fact_properties", "graph_build_edges", "graph_build_node_stats"):
        plan = registered()[name][0](t)._jdf.queryExecution().executedPlan()
        assert not [n for n in nodes_of(plan) if n.getClass().getSimpleName() == "BroadcastExchangeExec"], name


def test_hash_embedding_deals_out_no_tokens(spark):
    texts = ["Heron the heron THE a1", "", None, "\u212aelvin \u0130x \u00e9t\u00e9", " ".join(f"w{i}" for i in range(900))]
    docs = spark.createDataFrame([*enumerate(texts), (0, "more the")], "id int, t string")
    rows, most = run(V.hash_embedding(docs, "id", "t", 8))
    token = docs.select("id", F.explode(word_tokens(F.col("t"))).alias("token")).withColumn("h", fnv1a(F.col("token")))
    want = token.groupBy("id", (F.col("h") % 8).cast("int").alias("idx")).agg(F.sum(F.when(F.col("h") % 2 == 0, 1).otherwise(-1)).alias("w")).where("w <> 0")
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))
    assert {(r.id, r.idx, r.weight) for r in rows} == {(r.id, r.idx, r.weight) for r in want.select("id", "idx", (F.col("w") / norm).alias("weight")).collect()} and rows
    assert most <= 100


def test_bm25_deals_out_no_term(spark):
    """Neither tokens nor postings are dealt out by term, so a word of all documents isn't one task."""
    docs = spark.range(300).select("id", F.concat(F.lit("the the heron "), F.col("id").cast("string")).alias("text"))
    df = bm25(docs, "id", "text", spark.createDataFrame([(1, "the heron"), (2, "the 7")], "query int, text string"), 3)
    dealt = [str(n.outputPartitioning()) for n in nodes_of(df._jdf.queryExecution().executedPlan()) if n.getClass().getSimpleName() == "ShuffleExchangeExec"]
    # one exchange by term is left: that of the counts of documents, summed before
    assert len([d for d in dealt if "term" in d]) == 1 and len(dealt) == 3
    assert [(r.query, r.id) for r in df.orderBy("query", "rank").collect()] == [(1, 0), (1, 1), (1, 2), (2, 7), (2, 0), (2, 1)]


def test_difference_in_one_pass(spark):
    before = spark.createDataFrame([(1, 1), (1, 1), (2, 1), (None, 3), (None, 4)], "a int, b int")
    after = spark.createDataFrame([(2, 1), (3, 1), (3, 1), (None, 3)], "a int, b int")
    df = difference(before, after, "a", "b")
    assert sorted((r.a or 0, r.b, r.change) for r in df.collect()) == [(0, 4, "removed"), (1, 1, "removed"), (3, 1, "added")]
    assert not [n for n in nodes_of(df._jdf.queryExecution().executedPlan()) if "Join" in n.getClass().getSimpleName()]
