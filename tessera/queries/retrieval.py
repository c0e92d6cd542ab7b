"""Hybrid search, graph text search, embeddings of texts, and resolution by tiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import identifiers as N
from tessera.functions.text import fnv1a
from tessera.operators import facts as E
from tessera.operators import hybrid as Y
from tessera.operators import ranking as R
from tessera.operators import registry as G
from tessera.operators import search as S
from tessera.operators import vectors as V
from tessera.queries import code
from tessera.queries.ranking import ALONE, RESULTS_SQL, _results
from tessera.queries.ranking import V as VALUES
from tessera.queries.text import BM25, TOKENS
from tessera.sources.bindings import FILES_SQL, NODES_SQL

FNV = "list_reduce(list_prepend(14695981039346656037::HUGEINT, [ascii(c)::HUGEINT FOR c IN string_split({0}, '')]), lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)"
EMBED = f"""tk AS (SELECT {{key}} AS key, unnest({TOKENS.format('text')}) AS token FROM {{table}}), hs AS (SELECT token, {FNV.format('token')} AS h FROM (SELECT DISTINCT token FROM tk)),
em AS (SELECT key, CAST(h % 64 AS INTEGER) AS idx, sum(CASE WHEN h % 2 = 0 THEN 1 ELSE -1 END) AS w FROM tk JOIN hs USING (token) GROUP BY 1, 2 HAVING sum(CASE WHEN h % 2 = 0 THEN 1 ELSE -1 END) <> 0),
ev AS (SELECT key, idx, w / sqrt(sum(w * w) OVER (PARTITION BY key)) AS weight FROM em)"""
ASKED = "the that src1 heron"


def _asked_embedding() -> str:
    return "qe AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {w!r}::DOUBLE)" for i, w in sorted(Y.embed(ASKED, 64).items())) + ") AS v(idx, q))"


SEMANTIC = f"{EMBED.format(key='doc_id', table='documents')}, {_asked_embedding()}, se AS (SELECT key AS doc_id, round(sum(weight * q), 6) AS score FROM ev JOIN qe USING (idx) GROUP BY 1)"
ONE_QUERY = BM25.replace("FROM benchmark", f"FROM (SELECT 0 AS item_id, '{ASKED}' AS text)").replace("tk AS", "bt AS").replace("FROM tk", "FROM bt")


def _facts(t):
    f = t.files.where("file_id % 3 = 0").select("file_id", "path")
    ends = t.files.select(F.col("file_id").alias("to"), F.col("path").alias("target"))
    return f.select("path", F.explode(F.array(F.col("file_id") + 1, F.col("file_id") + 2)).alias("to")).join(ends, "to").select("path", "target", F.lit("high").alias("confidence"))


def _hybrid(t, mode: str = "fusion", without: str | None = None):
    files = t.files.select("file_id", "path", "text")
    semantic = Y.semantic_results(Y.semantic_search(files, "path", "text", ASKED, 100), "path")
    return Y.hybrid(Y.lexical_results(files, "path", "text", ASKED, 100), semantic, _facts(t), ASKED, 30, mode, without).select("path", "fused")


def _hybrid_sql(history: str = "0.03::DOUBLE + 0.045::DOUBLE", plain: bool = False) -> str:
    fit = "0.0::DOUBLE" if plain else "CASE WHEN path LIKE 'src1/%' THEN 4.5::DOUBLE ELSE 0.0075::DOUBLE END"
    history, times = ("0.0::DOUBLE", "1.0::DOUBLE") if plain else (history, "0.3::DOUBLE")
    return f"""WITH {FILES_SQL}, {ONE_QUERY}, {SEMANTIC}, fa AS (SELECT a.path, b.path AS target FROM files a JOIN files b ON b.file_id IN (a.file_id + 1, a.file_id + 2) WHERE a.file_id % 3 = 0),
lx AS (SELECT path, b.score FROM bm b JOIN files f ON f.file_id = b.doc_id ORDER BY b.score DESC, path LIMIT 100), sm AS (SELECT path, s.score FROM se s JOIN files f ON f.file_id = s.doc_id WHERE s.score > 0 ORDER BY s.score DESC, path LIMIT 100),
al AS (SELECT path, score + {fit} + CASE WHEN path IN (SELECT path FROM fa) THEN {history} ELSE 0.0::DOUBLE END AS f FROM lx
  UNION ALL SELECT DISTINCT target, 0.2225::DOUBLE + ({fit.replace('path', 'target')}) + {history} FROM fa WHERE path IN (SELECT path FROM lx) AND target NOT IN (SELECT path FROM lx)
  UNION ALL SELECT path, score * {times} + {fit} FROM sm)
SELECT path, round(max(f), 6) AS fused FROM al GROUP BY 1 ORDER BY fused DESC, path LIMIT 30"""


def _symbols(t):
    k = F.col("p_partkey")
    name = F.when(k % 40 == 7, "common").otherwise(F.concat(F.lit("sym"), (k % 150).cast("string")))
    return t.raw("part").select(k.alias("symbol_id"), (k % 20).alias("file_id"), name.alias("name"), F.concat(F.lit("m"), (k % 7).cast("string"), F.lit("::"), name).alias("qualified_name"))


def _uses(t):
    k = F.col("p_partkey")
    s = lambda n: (k % n).cast("string")
    token = F.when(k % 6 == 0, F.concat(F.lit("sym"), s(150))).when(k % 6 == 1, F.concat(F.lit("ym"), s(150))).when(k % 6 == 2, F.concat(F.lit("xsym"), s(150), F.lit("y"))).when(k % 6 == 3, F.concat(F.lit("none"), k.cast("string"))).when(k % 6 == 4, F.concat(F.lit("sym"), s(37))).otherwise("common")
    return t.raw("part").select((k % 23).alias("file_id"), F.concat(F.lit("m"), (F.floor(k / 3) % 9).cast("string")).alias("module"), token.alias("token"))


def _imported(t):
    f = t.spark.range(20).select(F.col("id").alias("file_id"))
    return f.select("file_id", F.concat(F.lit("m"), (F.col("file_id") % 7).cast("string"), F.lit(".sym"), F.col("file_id").cast("string")).alias("imported"), F.when(F.col("file_id") % 2 == 1, (F.col("file_id") + 1) % 20).alias("target_file"), F.when(F.col("file_id") % 2 == 0, F.col("file_id") * 3).alias("target_symbol"))


REGISTRY_SQL = """WITH sy AS (SELECT k AS symbol_id, k % 20 AS file_id, name, 'm' || k % 7 AS module, 'm' || k % 7 || '::' || name AS q FROM (SELECT p_partkey AS k, CASE WHEN p_partkey % 40 = 7 THEN 'common' ELSE 'sym' || p_partkey % 150 END AS name FROM part)),
us AS (SELECT DISTINCT p_partkey % 23 AS file_id, 'm' || (p_partkey // 3) % 9 AS module, CASE p_partkey % 6 WHEN 0 THEN 'sym' || p_partkey % 150 WHEN 1 THEN 'ym' || p_partkey % 150 WHEN 2 THEN 'xsym' || p_partkey % 150 || 'y' WHEN 3 THEN 'none' || p_partkey WHEN 4 THEN 'sym' || p_partkey % 37 ELSE 'common' END AS token FROM part),
im AS (SELECT f AS file_id, 'm' || f % 7 || '.sym' || f AS imported, CASE WHEN f % 2 = 1 THEN (f + 1) % 20 END AS tf, CASE WHEN f % 2 = 0 THEN f * 3 END AS ts FROM (SELECT unnest(range(20)) AS f)),
c AS (SELECT u.*, 0 AS tier, s.symbol_id FROM us u JOIN im USING (file_id) JOIN sy s ON s.symbol_id = im.ts WHERE s.name = u.token OR split_part(im.imported, '.', -1) = u.token
  UNION SELECT u.*, 0, s.symbol_id FROM us u JOIN im USING (file_id) JOIN sy s ON s.file_id = im.tf AND im.ts IS NULL WHERE s.name = u.token
  UNION SELECT u.*, 1, s.symbol_id FROM us u JOIN sy s ON s.file_id = u.file_id AND s.name = u.token UNION SELECT u.*, 2, s.symbol_id FROM us u JOIN sy s ON s.module = u.module AND s.name = u.token UNION SELECT u.*, 3, s.symbol_id FROM us u JOIN sy s ON s.name = u.token
  UNION SELECT u.*, 4, s.symbol_id FROM us u JOIN im USING (file_id) JOIN sy s ON ends_with(s.q, u.token) AND ends_with(replace(s.q, '::', '.'), im.imported)
  UNION SELECT u.*, 5, s.symbol_id FROM us u JOIN sy s ON length(s.name) > 3 AND length(u.token) > 3 AND (contains(s.name, u.token) OR contains(u.token, s.name))),
g AS (SELECT file_id, module, token, tier, count(DISTINCT symbol_id) AS n, min(symbol_id) AS id FROM c GROUP BY ALL), b AS (SELECT file_id, module, token, min(tier) AS tier, arg_min(n, tier) AS n, arg_min(id, tier) AS id FROM g GROUP BY ALL)
SELECT u.file_id, u.module, u.token, CASE WHEN tier = 3 AND n > 32 THEN 'common-name-cap' WHEN tier IS NULL THEN 'unresolved' ELSE ['direct-import', 'same-file', 'same-module', 'unique-project-name', 'suffix-import-reachability', 'fuzzy-fallback'][tier + 1] END AS strategy,
  CASE WHEN n IS NULL THEN 'unresolved' WHEN n = 1 THEN 'resolved' ELSE 'ambiguous' END AS status, coalesce(n, 0) AS candidates, CASE WHEN n = 1 THEN id END AS symbol_id, CASE WHEN n = 1 THEN ['high', 'high', 'medium', 'medium', 'low', 'low'][tier + 1] ELSE 'low' END AS confidence
FROM us u LEFT JOIN b ON b.file_id = u.file_id AND b.module = u.module AND b.token = u.token"""


def _code_imports(t):
    return E.imports(t.code).select(F.concat_ws(":", F.col("file_id").cast("string"), F.col("line").cast("string")).alias("import_id"), "path", "language", "imported")


IMPORTS_SQL = f"""WITH {code.IMPORTED_SQL}, p AS (SELECT p_partkey FROM part) SELECT file_id || ':' || line AS import_id,
CASE WHEN imported IN ('os', 'node:fs', 'java.util.List') THEN 'builtin' WHEN r = 1 THEN CASE WHEN file_id % 7 IN (1, 6) AND EXISTS (SELECT 1 FROM p WHERE p_partkey = file_id % 7) THEN 'resolved' ELSE 'unresolved' END WHEN contains(imported, '::') THEN 'unresolved' ELSE 'external' END AS status,
CASE WHEN r = 1 AND line = 1 AND file_id % 7 IN (1, 6) THEN 1 ELSE 0 END AS candidates, CASE WHEN r = 1 AND line = 1 AND file_id % 7 IN (1, 6) THEN 'web/page' || file_id % 7 || '.js' END AS target,
CASE WHEN imported IN ('os', 'node:fs', 'java.util.List') THEN 'builtin' WHEN r = 1 THEN CASE WHEN file_id % 7 IN (1, 6) THEN 'relative-path' ELSE 'unresolved' END WHEN contains(imported, '::') THEN 'unresolved' ELSE 'manifest-package' END AS strategy FROM i"""


def _chunk_uses(t):
    return G.token_uses(t.code.select(F.col("file_id").alias("chunk_id"), "file_id", "text")).groupBy("chunk_id").agg(F.count("*").alias("uses"), F.sum(F.col("is_call").cast("int")).alias("calls"), F.max("line").alias("last_line"))


NODE_TEXT = "concat_ws(chr(10), 'graph node', id, node_type, label, file_id)"
PARTS = TOKENS.format("regexp_replace(regexp_replace({0}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g')").replace("{{0}}", "{0}")
GRAPH_DOCS = f"gd AS (SELECT id AS doc_id, p || chr(10) || array_to_string(list_filter({PARTS.format('p')}, lambda x: length(x) >= 2), chr(10)) AS text FROM (SELECT id, {NODE_TEXT} AS p FROM nodes))"
GRAPH_QUERIES = ((1, "NATION_3 package"), (2, "Customer red"), (3, "interface"))


def _graph_search(t):
    asked = t.spark.createDataFrame(list(GRAPH_QUERIES), "query int, text string")
    return S.bm25(Y.node_text(t.nodes), "id", "text", asked, 10)


GRAPH_SQL = f"WITH {NODES_SQL}, {GRAPH_DOCS}, {BM25.replace('FROM documents', 'FROM gd').replace('FROM benchmark', 'FROM (SELECT * FROM (VALUES ' + ', '.join(str(q) for q in GRAPH_QUERIES) + ') AS v(item_id, text))')} SELECT query, rank, doc_id AS id, score FROM bm WHERE rank <= 10"


def _variants(t):
    found = Y.search_variants(t.raw("documents").select(F.col("doc_id").cast("string").alias("id"), "text"), "id", "text", "theHeron of_the", 5)
    nothing = F.lit("")
    boost = Y.variant_boost("theHeron of_the", F.col("variant"), F.concat(F.lit("a/theheron-of_the/"), "id"), F.col("id"), F.lit("x"), F.col("id"), nothing, F.lit(False))
    return found.withColumn("boost", F.round(F.when(F.col("id").cast("int") % 2 == 0, boost).otherwise(0.0), 6)).select("id", "variant", "score", "boost")


def _variants_sql() -> str:
    from tessera.functions.text import query_variants

    listed = query_variants("theHeron of_the")
    asked = "(SELECT * FROM (VALUES " + ", ".join(f"({i}, '{v}')" for i, v in enumerate(listed)) + ") AS v(item_id, text))"
    return f"WITH {BM25.replace('FROM benchmark', 'FROM ' + asked)}, f AS (SELECT doc_id, query, score, row_number() OVER (PARTITION BY doc_id ORDER BY query) AS n FROM bm WHERE rank <= 20) SELECT CAST(doc_id AS VARCHAR) AS id, {listed}[query + 1] AS variant, score, CASE WHEN doc_id % 2 = 1 THEN 0.0::DOUBLE WHEN {listed}[query + 1] <> 'theHeron of_the' THEN 0.45::DOUBLE ELSE 0.4::DOUBLE END AS boost FROM f WHERE n = 1"




def _top_sql() -> str:
    parts = [("text_relevance", f"CASE WHEN {ALONE} THEN 0 ELSE score END")] + list(VALUES.items())
    listed = ", ".join(f"{{'k': -abs({R.WEIGHTS[n]}::DOUBLE * ({v})::DOUBLE), 'signal': '{n}'}}" for n, v in parts)
    kept = f"list_filter([{listed}], lambda x: x.k < -0.00001)"
    return f"WITH {RESULTS_SQL}, s AS (SELECT list_sort({kept})[1].signal AS signal FROM r) SELECT signal, count(*) AS n FROM s GROUP BY 1"


def _fits(t):
    c = t.raw("customer").select("c_custkey", F.concat(F.when(F.col("c_custkey") % 4 == 0, F.lit("docs/")).when(F.col("c_custkey") % 4 == 1, F.lit("tests/")).otherwise(F.lit("src/")), F.lower("c_mktsegment"), F.lit("/mod"), (F.col("c_nationkey") % 5).cast("string"), F.lit(".rs")).alias("path"))
    return c.select("c_custkey", Y.boundary_fit(F.col("path"), F.lit("fix the Machinery, see fooBar"), F.when(F.col("c_custkey") % 8 == 3, "foo_bar")).alias("fit"))


NORMAL = "trim(lower(regexp_replace(regexp_replace({0}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+', ' ', 'g')))"


def _names(t):
    x = F.concat("c_name", F.lit("_"), "c_mktsegment", F.lit("Row/"), F.col("c_nationkey").cast("string"), F.lit(".rs"))
    return t.raw("customer").select("c_custkey", N.normalized_identifier(x).alias("words"), F.size(N.identifier_terms(x)).alias("terms"), F.size(N.path_tokens(x)).alias("tokens"), N.package_of(F.concat(F.lit("@"), x)).alias("package"), N.last_part(x).alias("last"))


NAMES_SQL = f"SELECT c_custkey, {NORMAL.format('x')} AS words, CAST(len(list_filter(string_split({NORMAL.format('x')}, ' '), lambda t: length(t) >= 3)) AS INTEGER) AS terms, CAST(least(len(list_filter(regexp_split_to_array(x, '[^A-Za-z0-9_]'), lambda t: length(t) >= 4)), 8) AS INTEGER) AS tokens, '@' || split_part(x, '/', 1) || '/' || split_part(x, '/', 2) AS package, 'rs' AS last FROM (SELECT c_custkey, c_name || '_' || c_mktsegment || 'Row/' || c_nationkey || '.rs' AS x FROM customer)"

QUERIES = {
    "text_fnv1a": (lambda t: t.raw("part").select("p_partkey", fnv1a(F.concat_ws("_", F.replace("p_name", F.lit(" "), F.lit("")), F.col("p_partkey").cast("string"))).cast("string").alias("hash")), f"SELECT p_partkey, CAST({FNV.format('s')} AS VARCHAR) AS hash FROM (SELECT p_partkey, replace(p_name, ' ', '') || '_' || p_partkey AS s FROM part)"),
    "text_names": (_names, NAMES_SQL),
    "text_named_anchors": (lambda t: t.lines.select("file_id", "line", F.size(N.named_identifiers(F.col("text"))).alias("n")).where("n > 0"), None),
    "text_graph_search": (_graph_search, GRAPH_SQL),
    "text_search_variants": (_variants, _variants_sql()),
    "vector_hash_embedding": (lambda t: V.hash_embedding(t.raw("documents"), "doc_id", "text").select("doc_id", "idx", F.round("weight", 9).alias("weight")), f"WITH {EMBED.format(key='doc_id', table='documents')} SELECT key AS doc_id, idx, round(weight, 9) AS weight FROM ev"),
    "vector_semantic_search": (lambda t: Y.semantic_search(t.raw("documents"), "doc_id", "text", ASKED, 50, allowed=t.raw("documents").where("lang <> 'de'").select("doc_id")), f"WITH {SEMANTIC} SELECT doc_id, s.score FROM se s JOIN documents d USING (doc_id) WHERE lang <> 'de' AND s.score > 0 ORDER BY s.score DESC, doc_id LIMIT 50"),
    "rank_hybrid": (_hybrid, _hybrid_sql()),
    "rank_hybrid_without_history": (lambda t: _hybrid(t, without="git_cochange"), _hybrid_sql("0.0::DOUBLE")),
    "rank_hybrid_baseline": (lambda t: _hybrid(t, "baseline"), _hybrid_sql(plain=True)),
    "rank_boundary_fit": (_fits, "SELECT c_custkey, CASE WHEN c_custkey % 4 IN (0, 1) THEN 0.0::DOUBLE WHEN c_mktsegment = 'MACHINERY' OR c_custkey % 8 = 3 THEN 18.0::DOUBLE ELSE 0.03::DOUBLE END AS fit FROM customer"),
    "rank_top_signals": (lambda t: R.fuse(_results(t)).select(F.get(R.top_signals(F.col("breakdown"), 1), 0).alias("signal")).groupBy("signal").agg(F.count("*").alias("n")), _top_sql()),
    "resolve_symbol_tiers": (lambda t: G.resolve_symbols(_uses(t), _symbols(t), _imported(t)), REGISTRY_SQL),
    "resolve_imports": (lambda t: G.resolve_imports(_code_imports(t), t.code.select("path"), go_modules=("example.com",)), IMPORTS_SQL),
    "resolve_token_uses": (_chunk_uses, None),
}
