"""Weighted fusion of explainable signals, ablation, merging of results and retrieval metrics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.paths import is_test
from tessera.operators.rounds import cut
from tessera.schema import CONFIDENCE, CONFIDENCE_FROM

# Weights of the signals, and each signal's phrases with the value that one of them gives.
WEIGHTS = {
    "text_relevance": 1.0, "exact_reference": 1.0, "graph_proximity": 0.35, "boundary_fit": 0.25, "runtime_corroboration": 0.30, "git_cochange": 0.25, "history_churn": 0.25, "ownership_risk": 0.25,
    "similar_change_overlap": 0.25, "reviewer_affinity": 0.25, "validation_proximity": 1.0, "memory_signal": 0.20, "semantic_similarity": 0.30, "path_quality": 1.0,
}
PHRASES = {
    "graph_proximity": (0.12, ("graph", "dependency", "direct impact")),
    "runtime_corroboration": (0.18, ("runtime", "trace", "incident")),
    "git_cochange": (0.12, ("co-change", "cochange", "git history")),
    "history_churn": (0.08, ("hotspot", "history churn")),
    "ownership_risk": (0.06, ("ownership risk", "historical author")),
    "similar_change_overlap": (0.12, ("similar change", "co-change", "cochange")),
    "reviewer_affinity": (0.06, ("reviewer",)),
    "memory_signal": (0.08, ("memory",)),
}
NEGLIGIBLE = 0.001


def _any(text: Column, phrases) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | text.contains(p)
    return out


def signals(reason: Column, evidence: Column, path: Column, score: Column) -> dict[str, Column]:
    """Each signal's raw value for a result with a reason, joined evidence, path and score."""
    reason, evidence, path = F.lower(reason), F.lower(evidence), F.lower(path)
    out = {name: F.when(_any(F.concat_ws("\n", evidence, reason) if name == "memory_signal" else evidence, phrases), value).otherwise(0.0) for name, (value, phrases) in PHRASES.items()}
    exact = F.when(reason.contains("exact symbol reference") | _any(evidence, ("exact reference", "scip")), 0.35).otherwise(0.0)
    semantic = F.when(reason.contains("semantic") | evidence.contains("semantic vector"), F.greatest(F.lit(0.0), F.least(score, F.lit(1.0)))).otherwise(0.0)
    tests = F.when(is_test(path), 0.05).otherwise(0.0)
    alone = (semantic > 0) & (exact <= 0) & (tests <= 0)
    for name in ("graph_proximity", "runtime_corroboration", "git_cochange"):
        alone = alone & (out[name] <= 0)
    quality = F.when(path.contains("vendor"), score * -0.65).otherwise(0.0) + F.when(_any(path, ("generated", "_pb.rs", ".pb.go", "schema.json")), score * -0.45).otherwise(0.0)
    return {"text_relevance": F.when(alone, 0.0).otherwise(score), "exact_reference": exact, **out, "boundary_fit": F.lit(0.0), "validation_proximity": tests, "semantic_similarity": semantic, "path_quality": quality}


def fuse(results: DataFrame, without: str | None = None) -> DataFrame:
    """results (path, reason, evidence, score) with `fused` and `breakdown`: array of (signal, raw, weight, contribution).

    A signal counts unless its value or weight is negligible or it is the one left out.
    """
    raw = signals(F.col("reason"), F.col("evidence"), F.col("path"), F.col("score"))
    parts = [F.struct(F.lit(n).alias("signal"), raw[n].cast("double").alias("raw"), F.lit(w).alias("weight"), (raw[n] * w).cast("double").alias("contribution")) for n, w in WEIGHTS.items() if n != without and abs(w) > NEGLIGIBLE]
    kept = F.filter(F.array(*parts), lambda c: F.abs(c["raw"]) > NEGLIGIBLE)
    out = results.withColumn("breakdown", kept)
    return out.withColumn("fused", F.round(F.aggregate("breakdown", F.lit(0.0), lambda s, c: s + c["contribution"]), 6))


def top_signals(breakdown: Column, n: int) -> Column:
    """Names of the n components of the largest absolute contribution, ties by name."""
    ranked = F.array_sort(F.transform(breakdown, lambda c: F.struct((-F.abs(c["contribution"])).alias("k"), c["signal"].alias("signal"))))
    return F.transform(F.slice(ranked, 1, n), lambda c: c["signal"])


def first_ranks(df: DataFrame, limit: int, score: str, *ties: str, name: str = "rank") -> DataFrame:
    """The first `limit` rows in order of score, with their rank: each task keeps its first, and those few are numbered."""
    first = df.orderBy(F.col(score).desc(), *ties).limit(limit)
    return first.withColumn(name, F.row_number().over(Window.orderBy(F.col(score).desc(), *ties)))


def rank_by(df: DataFrame, score: str, *ties: str, name: str = "rank") -> DataFrame:
    """All rows with their rank in order of score: positions in ranges of the order, and the sizes of the ranges before."""
    order = [F.col(score).desc(), *map(F.col, ties)]
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut(placed.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect()  # one row for each range
    before = df.sparkSession.createDataFrame([(r._part, sum(x.n for x in sizes if x._part < r._part)) for r in sizes], "_part int, _before long")
    return placed.join(F.broadcast(before), "_part").withColumn(name, F.col("_at") + F.col("_before") + 1).drop("_part", "_at", "_before")


def best_per_path(results: DataFrame, score: str, *ties: str) -> DataFrame:
    """The best row of each path."""
    order = Window.partitionBy("path").orderBy(F.col(score).desc(), *ties)
    return results.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def merge_by_path(results: DataFrame, score: str) -> DataFrame:
    """(path, score, evidence): the highest score and all distinct evidence of each path."""
    return results.groupBy("path").agg(F.max(score).alias("score"), F.array_join(F.array_sort(F.collect_set("evidence")), "; ").alias("evidence"))


def merge_full(lexical: DataFrame, semantic: DataFrame) -> DataFrame:
    """(path, score, origin): lexical and semantic results by path, scores added where both have it."""
    a, b = lexical.select("path", F.col("score").alias("l")), semantic.select("path", F.col("score").alias("s"))
    origin = F.when(F.col("l").isNull(), "semantic").when(F.col("s").isNull(), "lexical").otherwise("both")
    return a.join(b, "path", "full_outer").select("path", F.round(F.coalesce("l", F.lit(0.0)) + F.coalesce("s", F.lit(0.0)), 6).alias("score"), origin.alias("origin"))


def confidence_of(score: Column) -> Column:
    out = F.when(score >= CONFIDENCE_FROM[0][1], CONFIDENCE_FROM[0][0])
    for name, least in CONFIDENCE_FROM[1:]:
        out = out.when(score >= least, name)
    return out.otherwise("low")


def confidence_score(name: Column) -> Column:
    out = None
    for level, value in CONFIDENCE.items():
        out = F.when(name == level, value) if out is None else out.when(name == level, value)
    return out


def evaluate(ranked: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """(query, recall, reciprocal_rank, ndcg) of ranked (query, rank, item) against relevant (query, item), to rank k."""
    hits = ranked.where(F.col("rank") <= k).join(relevant, ["query", "item"]).groupBy("query").agg(F.count("*").alias("hits"), F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1.0)).alias("gain"))
    ideal = [sum(1 / math.log2(i + 2) for i in range(n)) for n in range(k + 1)]
    sizes = relevant.groupBy("query").agg(F.count("*").alias("n"))
    best = F.element_at(F.array(*[F.lit(x) for x in ideal]), (F.least("n", F.lit(k)) + 1).cast("int"))
    out = sizes.join(hits, "query", "left")
    return out.select("query", F.round(F.coalesce("hits", F.lit(0)) / F.col("n"), 6).alias("recall"), F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 6).alias("reciprocal_rank"), F.round(F.coalesce("gain", F.lit(0.0)) / best, 6).alias("ndcg"))
