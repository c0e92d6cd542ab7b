"""Hybrid search: lexical and semantic candidates, history beside them, fusion for a query, one result a path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import identifiers as N
from tessera.functions import scores as S
from tessera.functions.identifiers import any_of
from tessera.functions.text import fnv1a_plain, query_variants
from tessera.operators.ranking import NEGLIGIBLE, PHRASES, WEIGHTS
from tessera.operators.search import bm25
from tessera.operators.vectors import hash_embedding

# Signals that the weight of co-change drives, and what a match of the query with a path or symbol gives.
COCHANGE_GROUP = ("git_cochange", "history_churn", "ownership_risk", "similar_change_overlap", "reviewer_affinity")
FITS, PLAIN_FIT, NAME_HIT = 18.0, 0.03, 0.15
GIVEN = "array<struct<signal:string,raw:double,contribution:double>>"


def candidate_limit(limit: int) -> int:
    return min(max(4 * min(max(limit, 1), 100), 100), 200)


def _phrase(text: Column, phrases) -> Column:
    return any_of(text.contains(p) for p in phrases)


def looks_like_test(path: Column) -> Column:
    return path.contains("test") | path.contains("/spec/")


def boundary_fit(path: Column, query: Column, name: Column) -> Column:
    """Of a source path: 18 where the query matches the path's words, or names the symbol or the file, else 0.03."""
    low = F.lower(path)
    source = ~looks_like_test(low) & ~low.rlike(r"\.mdx?$|(^|/)docs/")
    stem = N.normalized_identifier(F.regexp_extract(low, r"([^/]*?)(\.[^./]*)?$", 1))
    named = name.isNotNull() & F.exists(N.query_identifiers(query), lambda q: (q == N.normalized_identifier(name)) | (q == stem))
    return F.when(~source, 0.0).when(N.query_matches_path(query, low) | named, FITS).otherwise(PLAIN_FIT)


def raw_signals(query: Column) -> dict[str, Column]:
    """Raw values for results (path, snippet, name, qualified_name, reason, evidence, score, given)."""
    path, reason, evidence = F.lower("path"), F.lower("reason"), F.lower("evidence")
    score, given = F.col("score"), F.col("given")
    text = F.lower(F.concat_ws(" ", "path", "snippet", "qualified_name", "name"))
    exact = F.when(reason.contains("exact symbol reference") | _phrase(evidence, ("exact reference", "scip")), 0.35).otherwise(0.0)
    hit = F.when(F.col("name").isNotNull() & text.contains(F.lower("name")), NAME_HIT).otherwise(0.0)
    said = {k: F.when(_phrase(evidence, words), value).otherwise(0.0) for k, (value, words) in PHRASES.items()}
    out = {k: said[k] for k in ("graph_proximity", "runtime_corroboration", "git_cochange")}
    for k in ("history_churn", "ownership_risk", "similar_change_overlap", "reviewer_affinity"):
        out[k] = F.coalesce(S.signal_value(given, k), said[k])
    out["memory_signal"] = F.when(evidence.contains("memory") | reason.contains("memory"), PHRASES["memory_signal"][0]).otherwise(0.0)
    tests = F.when(looks_like_test(path), 0.05).otherwise(0.0)
    measured = F.get(F.filter(given, lambda c: c["signal"].isin("semantic_similarity", "local_semantic_similarity")), 0)["raw"]
    told = F.when(reason.contains("semantic") | evidence.contains("semantic vector"), F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)))
    semantic = F.coalesce(measured, told, F.lit(0.0))
    only = (semantic > 0) & (exact <= 0) & (out["graph_proximity"] <= 0) & (out["runtime_corroboration"] <= 0) & (out["git_cochange"] <= 0) & (tests <= 0)
    quality = F.when(path.contains("vendor"), score * -0.65).otherwise(0.0) + F.when(_phrase(path, ("generated", "_pb.rs", ".pb.go", "schema.json")), score * -0.45).otherwise(0.0)
    return {"text_relevance": F.when(only, 0.0).otherwise(score), "exact_reference": exact + hit, **out, "boundary_fit": boundary_fit(F.col("path"), query, F.col("name")), "validation_proximity": tests, "semantic_similarity": semantic, "path_quality": quality}


def fuse_for(results: DataFrame, query: str, without: str | None = None) -> DataFrame:
    """results with `fused` and `breakdown` for a query. Leaving out co-change leaves out all signals of its weight."""
    gone = COCHANGE_GROUP if without == "git_cochange" else (without,)
    raw = raw_signals(F.lit(query))
    parts = [F.struct(F.lit(n).alias("signal"), raw[n].cast("double").alias("raw"), (raw[n] * w).cast("double").alias("contribution")) for n, w in WEIGHTS.items() if n not in gone]
    out = results.withColumn("breakdown", F.filter(F.array(*parts), lambda c: F.abs(c["raw"]) > NEGLIGIBLE))
    return out.withColumn("fused", F.round(F.aggregate("breakdown", F.lit(0.0), lambda s, c: s + c["contribution"]), 6))


def with_history(results: DataFrame, facts: DataFrame) -> DataFrame:
    """results with what changed together with them: facts (path, target, confidence). A result with such facts gets the
    overlap signal, 0.12 a fact up to 0.18; their targets that aren't results yet become candidates of their own."""
    ranked = facts.join(results.select("path").distinct(), "path", "left_semi").withColumn("_n", F.row_number().over(Window.partitionBy("path").orderBy("target"))).where("_n <= 32")
    counts = ranked.groupBy("path").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("_n") <= 3, F.col("target").cast("string")))), ", ").alias("labels"))
    one = F.array(F.struct(F.lit("similar_change_overlap").alias("signal"), F.least(0.12 * F.col("n"), F.lit(0.18)).alias("raw"), F.least(0.12 * F.col("n"), F.lit(0.18)).alias("contribution")))
    said = F.when(F.col("n").isNotNull(), F.concat(F.lit("git co-change from local history: "), "labels"))
    marked = results.join(counts, "path", "left").withColumn("given", F.when(F.col("n").isNotNull(), F.concat("given", one)).otherwise(F.col("given"))).withColumn("evidence", F.concat_ws("; ", F.nullif("evidence", F.lit("")), said)).drop("n", "labels")
    beside = ranked.groupBy(F.col("target").alias("path")).agg(F.max(S.confidence_value(F.col("confidence"))).alias("c")).join(results.select("path").distinct(), "path", "left_anti")
    given = F.array(F.struct(F.lit("similar_change_overlap").alias("signal"), F.lit(0.18).alias("raw"), F.lit(0.18).alias("contribution")))
    fresh = beside.select("path", F.lit("").alias("snippet"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("qualified_name"), F.lit("historical git co-change candidate").alias("reason"), F.lit("git co-change from local history").alias("evidence"), (0.18 + F.least(F.col("c") * 0.05, F.lit(0.05))).alias("score"), given.alias("given"))
    return marked.unionByName(fresh)


def unique_paths(fused: DataFrame, limit: int) -> DataFrame:
    """The best result of each path, the first `limit`; evidence of a path's semantic results is kept beside it."""
    order = Window.partitionBy("path").orderBy(F.col("fused").desc(), "reason")
    semantic = F.exists("breakdown", lambda c: c["signal"] == "semantic_similarity")
    best = fused.withColumn("_n", F.row_number().over(order)).withColumn("_more", F.when(semantic & (F.col("_n") > 1), F.col("evidence")))
    merged = best.groupBy("path").agg(F.max_by(F.struct("fused", "reason", "evidence"), -F.col("_n")).alias("b"), F.array_sort(F.collect_set("_more")).alias("more"))
    evidence = F.array_join(F.array_distinct(F.concat(F.array("b.evidence"), "more")), "; ")
    return merged.select("path", "b.fused", "b.reason", evidence.alias("evidence")).orderBy(F.col("fused").desc(), "path").limit(limit)


def hybrid(lexical: DataFrame, semantic: DataFrame, facts: DataFrame, query: str, limit: int, mode: str = "fusion", without: str | None = None) -> DataFrame:
    """(path, fused, reason, evidence): lexical candidates with history and semantic ones, fused for the query.

    Each side gives its best candidate_limit(limit); mode baseline keeps the given scores.
    """
    top = lambda df: df.orderBy(F.col("score").desc(), "path").limit(candidate_limit(limit))
    pool = with_history(top(lexical), facts).unionByName(top(semantic))
    scored = pool.withColumn("fused", F.round("score", 6)).withColumn("breakdown", F.array().cast(GIVEN)) if mode == "baseline" else fuse_for(pool, query, without)
    return unique_paths(scored, limit)


def embed(text: str, dims: int) -> dict[int, float]:
    """The non-zero components of a query's feature-hash embedding."""
    import re
    from math import sqrt

    parts: dict[int, float] = {}
    for token in re.findall("[a-z0-9]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)):
        h = fnv1a_plain(token)
        parts[h % dims] = parts.get(h % dims, 0.0) + (1 if h % 2 == 0 else -1)
    norm = sqrt(sum(w * w for w in parts.values())) or 1.0
    return {i: w / norm for i, w in parts.items() if w}


def semantic_search(docs: DataFrame, key: str, text: str, query: str, k: int, dims: int = 64, allowed: DataFrame | None = None) -> DataFrame:
    """(key, score): the k documents of the highest positive product with the query's embedding; of `allowed` (key) only,
    if given. The query's components, dims at most, are what is replicated."""
    pool = docs.join(allowed, key, "left_semi") if allowed is not None else docs
    asked = docs.sparkSession.createDataFrame(sorted(embed(query, dims).items()) or [(-1, 0.0)], "idx int, q double")
    found = hash_embedding(pool, key, text, dims).join(F.broadcast(asked), "idx").groupBy(key).agg(F.round(F.sum(F.col("weight") * F.col("q")), 6).alias("score"))
    return found.where("score > 0").orderBy(F.col("score").desc(), key).limit(max(k, 1))


def variant_boost(query: str, variant: Column, path: Column, symbol_id: Column, name: Column, qualified_name: Column, text: Column, graph: Column) -> Column:
    """What a match of the whole query with path, symbol or graph text adds, and a little for a variant."""
    low, under, dash = query.lower(), query.lower().replace(" ", "_"), query.lower().replace(" ", "-")
    path, name, qualified = F.lower(path), F.lower(name), F.lower(qualified_name)
    in_path = F.when(any_of(path.contains(q) for q in (low, under, dash)), 0.4).otherwise(0.0)
    whole = (F.lower(symbol_id) == low) | (qualified == low)
    by_symbol = F.when(whole, 2.0).when((name == low) | name.contains(under), 1.0).otherwise(0.0)
    return in_path + by_symbol + F.when(graph & F.lower(text).contains(low), 0.8).otherwise(0.0) + F.when(variant != query, 0.05).otherwise(0.0)


def node_text(nodes: DataFrame) -> DataFrame:
    """(id, text): what a node is found by: its id, type and label, and their words."""
    from tessera.functions.text import identifier_parts

    plain = F.concat_ws("\n", F.lit("graph node"), "id", "node_type", "label", "file_id")
    return nodes.select("id", F.concat_ws("\n", plain, F.array_join(identifier_parts(plain), "\n")).alias("text"))


def search_variants(docs: DataFrame, key: str, text: str, query: str, limit: int) -> DataFrame:
    """(key, variant, score): the best 4 * limit of each variant of the query; a document counts with the first variant, in
    order of text, that finds it."""
    variants = query_variants(query)
    asked = docs.sparkSession.createDataFrame(list(enumerate(variants)), "query int, text string")
    found = bm25(docs, key, text, asked, 4 * limit)
    first = found.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("query"))).where("_n = 1")
    return first.select(key, F.get(F.array(*map(F.lit, variants)), F.col("query")).alias("variant"), "score")


def lexical_results(docs: DataFrame, path: str, text: str, query: str, k: int) -> DataFrame:
    """Results for fusion: the k best by BM25 of the query's text."""
    asked = docs.sparkSession.createDataFrame([(0, query)], "query int, text string")
    found = bm25(docs, path, text, asked, k)
    none = F.lit(None).cast("string")
    return found.select(F.col(path).alias("path"), F.lit("").alias("snippet"), none.alias("name"), none.alias("qualified_name"), F.lit("text").alias("reason"), F.lit("bm25").alias("evidence"), "score", F.array().cast(GIVEN).alias("given"))


def semantic_results(found: DataFrame, path: str) -> DataFrame:
    none = F.lit(None).cast("string")
    given = F.array(F.struct(F.lit("semantic_similarity").alias("signal"), F.col("score").alias("raw"), F.col("score").alias("contribution")))
    return found.select(F.col(path).alias("path"), F.lit("").alias("snippet"), none.alias("name"), none.alias("qualified_name"), F.lit("local semantic match").alias("reason"), F.lit("semantic vector").alias("evidence"), "score", given.alias("given"))


