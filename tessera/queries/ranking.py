"""Fusion, merging and evaluation queries. Parts stand in as results: their size picks the folder, their type the evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import ranking as R
from tessera.operators import search as S
from tessera.queries.text import BM25

EVIDENCE = {"ECONOMY": "graph dependency", "SMALL": "runtime trace", "LARGE": "co-change in git history", "MEDIUM": "semantic vector", "STANDARD": "reviewer and memory", "PROMO": "hotspot"}
RESULTS_SQL = "r AS (SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN 'vendor/' WHEN 1 THEN 'tests/' WHEN 2 THEN 'generated/' ELSE 'src/' END || p_brand || '/' || p_name AS path, CASE WHEN p_partkey % 5 = 0 THEN 'exact symbol reference' WHEN p_partkey % 5 = 1 THEN 'semantic match' ELSE 'text' END AS reason, CASE p_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EVIDENCE.items()) + " ELSE '' END AS evidence, CAST(p_retailprice AS DOUBLE) / 1000 AS score FROM part)"
V = {
    "exact_reference": "CASE WHEN reason = 'exact symbol reference' THEN 0.35 ELSE 0 END", "graph_proximity": "CASE WHEN contains(evidence, 'graph') THEN 0.12 ELSE 0 END", "runtime_corroboration": "CASE WHEN contains(evidence, 'runtime') THEN 0.18 ELSE 0 END",
    "git_cochange": "CASE WHEN contains(evidence, 'co-change') THEN 0.12 ELSE 0 END", "history_churn": "CASE WHEN contains(evidence, 'hotspot') THEN 0.08 ELSE 0 END", "similar_change_overlap": "CASE WHEN contains(evidence, 'co-change') THEN 0.12 ELSE 0 END",
    "reviewer_affinity": "CASE WHEN contains(evidence, 'reviewer') THEN 0.06 ELSE 0 END", "validation_proximity": "CASE WHEN starts_with(path, 'tests/') THEN 0.05 ELSE 0 END", "memory_signal": "CASE WHEN contains(evidence, 'memory') THEN 0.08 ELSE 0 END",
    "semantic_similarity": "CASE WHEN reason = 'semantic match' OR evidence = 'semantic vector' THEN greatest(0, least(score, 1)) ELSE 0 END", "path_quality": "CASE WHEN starts_with(path, 'vendor/') THEN score * -0.65 WHEN starts_with(path, 'generated/') THEN score * -0.45 ELSE 0 END",
}
ALONE = f"({V['semantic_similarity']}) > 0 AND ({V['exact_reference']}) = 0 AND ({V['graph_proximity']}) = 0 AND ({V['runtime_corroboration']}) = 0 AND ({V['git_cochange']}) = 0 AND ({V['validation_proximity']}) = 0"


def _fused(without: str = "") -> str:
    parts = [f"CASE WHEN {ALONE} THEN 0 ELSE score END"] + [f"({R.WEIGHTS[n]}::DOUBLE * ({v})::DOUBLE)" for n, v in V.items() if n != without]
    return "round(" + " + ".join(parts) + ", 6)"


def _results(t):
    folder = F.when(F.col("p_size") % 4 == 0, "vendor/").when(F.col("p_size") % 4 == 1, "tests/").when(F.col("p_size") % 4 == 2, "generated/").otherwise("src/")
    reason = F.when(F.col("p_partkey") % 5 == 0, "exact symbol reference").when(F.col("p_partkey") % 5 == 1, "semantic match").otherwise("text")
    said = F.create_map(*[F.lit(x) for pair in EVIDENCE.items() for x in pair])
    return t.raw("part").select(F.col("p_partkey").alias("id"), F.concat(folder, "p_brand", F.lit("/"), "p_name").alias("path"), reason.alias("reason"), F.coalesce(F.try_element_at(said, F.col("p_type")), F.lit("")).alias("evidence"), (F.col("p_retailprice") / 1000).alias("score"))


def _ranked(t):
    return S.bm25(t.raw("documents"), "doc_id", "text", t.raw("benchmark").select(F.col("item_id").alias("query"), "text")).select("query", "rank", F.col("doc_id").alias("item"))


def _relevant(t):
    passages = t.raw("benchmark").select(F.col("item_id").alias("query"), F.col("text").alias("passage"))
    return S.containing(t.raw("documents"), "doc_id", "text", passages).select("query", F.col("doc_id").alias("item"))


RELEVANT_SQL = "rel AS (SELECT item_id AS query, doc_id AS item FROM benchmark b JOIN documents d ON contains(d.text, b.text)), rn AS (SELECT query, count(*) AS n FROM rel GROUP BY 1)"
IDEAL = "list_sum([1 / log2(i + 1) FOR i IN range(1, least(n, 10) + 1)])"

QUERIES = {
    "rank_fusion": (lambda t: R.fuse(_results(t)).select("id", "path", "fused", F.size("breakdown").alias("n_signals")), f"WITH {RESULTS_SQL} SELECT id, path, {_fused()} AS fused, CAST(" + " + ".join([f"CASE WHEN NOT ({ALONE}) AND abs(score) > 0.001 THEN 1 ELSE 0 END"] + [f"CASE WHEN abs({v}) > 0.001 THEN 1 ELSE 0 END" for v in V.values()]) + " AS INTEGER) AS n_signals FROM r"),
    **{f"rank_without_{s}": (lambda t, s=s: R.fuse(_results(t), s).select("id", "fused"), f"WITH {RESULTS_SQL} SELECT id, {_fused(s)} AS fused FROM r") for s in ("path_quality", "exact_reference", "graph_proximity", "git_cochange", "semantic_similarity")},
    "rank_order": (lambda t: R.first_ranks(R.fuse(_results(t)), 100, "fused", "path", "id").select("rank", "id", "fused"), f"WITH {RESULTS_SQL} SELECT CAST(rank AS INTEGER) AS rank, id, fused FROM (SELECT *, row_number() OVER (ORDER BY fused DESC, path, id) AS rank FROM (SELECT *, {_fused()} AS fused FROM r)) WHERE rank <= 100"),
    "rank_top_signals": (lambda t: R.fuse(_results(t)).select("id", F.get(R.top_signals(F.col("breakdown"), 1), 0).alias("signal")).groupBy("signal").agg(F.count("*").alias("n")), None),
    "rank_unique_paths": (lambda t: R.best_per_path(_results(t), "score", "id").select("path", "id", F.round("score", 6).alias("score")), f"WITH {RESULTS_SQL} SELECT path, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY score DESC, id) AS n FROM r) WHERE n = 1"),
    "rank_merge_paths": (lambda t: R.merge_by_path(_results(t), "score").withColumn("score", F.round("score", 6)), f"WITH {RESULTS_SQL} SELECT path, round(max(score), 6) AS score, coalesce(string_agg(DISTINCT evidence, '; ' ORDER BY evidence), '') AS evidence FROM r GROUP BY 1"),
    "rank_merge_semantic": (lambda t: R.merge_full(R.best_per_path(_results(t).where("reason = 'text'"), "score", "id"), R.best_per_path(_results(t).where("reason = 'semantic match'"), "score", "id")), f"WITH {RESULTS_SQL}, l AS (SELECT path, max(score) AS l FROM r WHERE reason = 'text' GROUP BY 1), s AS (SELECT path, max(score) AS s FROM r WHERE reason = 'semantic match' GROUP BY 1) SELECT coalesce(l.path, s.path) AS path, round(coalesce(l, 0) + coalesce(s, 0), 6) AS score, CASE WHEN l IS NULL THEN 'semantic' WHEN s IS NULL THEN 'lexical' ELSE 'both' END AS origin FROM l FULL JOIN s ON l.path = s.path"),
    "rank_confidence": (lambda t: _results(t).select(R.confidence_of(F.col("score") % 1).alias("level")).groupBy("level").agg(F.count("*").alias("n")), f"WITH {RESULTS_SQL} SELECT CASE WHEN score % 1 >= 0.95 THEN 'exact' WHEN score % 1 >= 0.75 THEN 'high' WHEN score % 1 >= 0.55 THEN 'medium' ELSE 'low' END AS level, count(*) AS n FROM r GROUP BY 1"),
    "rank_evaluate_bm25": (lambda t: R.evaluate(_ranked(t), _relevant(t)), f"WITH {BM25}, {RELEVANT_SQL}, h AS (SELECT b.query, count(*) AS hits, min(rank) AS first, sum(1 / log2(rank + 1)) AS gain FROM bm b JOIN rel ON rel.query = b.query AND rel.item = b.doc_id WHERE rank <= 10 GROUP BY 1) SELECT rn.query, round(coalesce(hits, 0) / n, 6) AS recall, round(coalesce(1 / first, 0.0::DOUBLE), 6) AS reciprocal_rank, round(coalesce(gain, 0) / {IDEAL}, 6) AS ndcg FROM rn LEFT JOIN h ON h.query = rn.query"),
}
