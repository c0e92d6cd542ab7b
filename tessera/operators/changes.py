"""Similar changes, touches of symbols, history across renames, and bounded history signals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import scores as S
from tessera.functions.identifiers import short_name
from tessera.operators.history import recency_weights

# Words that say nothing of a change.
STOP_WORDS = ("and", "are", "but", "for", "from", "into", "the", "this", "that", "with", "your", "you", "fix", "add", "use", "using")


def change_tokens(text: Column) -> Column:
    """Distinct words of three letters at least that aren't stop words."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*STOP_WORDS)))


def scan_limit(limit: int) -> int:
    return min(max(80 * limit, 500), 5000)


def normalized_query(task: str | None, paths, symbols) -> tuple[str | None, list, list[str]]:
    """Trimmed task, or none; distinct paths and symbols in order."""
    return (task or "").strip() or None, sorted(set(paths)), sorted({s.strip() for s in symbols} - {""})


def newest(commits: DataFrame, limit: int) -> DataFrame:
    return commits.orderBy(F.col("committed_at").desc(), "commit_id").limit(limit)


def cochange_samples(commits: DataFrame, touches: DataFrame, most_files: int = 50, samples: int = 5) -> DataFrame:
    """(path, other, commits, recency, samples): ordered pairs of files touched together, with the newest commits."""
    files = touches.select("commit_id", "path").distinct()
    sizes = files.groupBy("commit_id").agg(F.count("*").alias("n")).where(F.col("n").between(2, most_files)).select("commit_id")
    files = files.join(sizes.join(recency_weights(commits), "commit_id"), "commit_id")
    pairs = files.join(files.select("commit_id", F.col("path").alias("other")), "commit_id").where("path <> other")
    # the newest five of a pair, five at most of each part before the shuffle
    order = Window.partitionBy("path", "other").orderBy(F.col("weight").desc())
    few = pairs.withColumn("i", F.row_number().over(order)).groupBy("path", "other").agg(F.count("*").alias("commits"), F.round(F.sum("weight"), 4).alias("recency"), F.array_sort(F.collect_list(F.when(F.col("i") <= samples, F.struct("i", "commit_id")))).alias("s"))
    return few.select("path", "other", "commits", "recency", F.transform("s", lambda x: x["commit_id"]).alias("samples"))


def symbol_match(query: Column, qualified_name: Column, symbol_id: Column) -> Column:
    """0.35 for the whole or short name or the id, 0.18 for a part of the qualified name, else null."""
    low = F.lower(qualified_name)
    return F.when((query == low) | (query == F.lower(symbol_id)) | (query == short_name(low)), 0.35).when(low.contains(query), 0.18)


def similar_changes(commits: DataFrame, touches: DataFrame, symbol_touches: DataFrame, edges: DataFrame, hotspots: DataFrame, task: str | None, paths, symbols, limit: int = 10) -> DataFrame:
    """(commit_id, score, confidence, sources): past commits like a change of some paths and symbols for a task.

    commits (commit_id, committed_at, summary), touches (commit_id, path, previous), symbol_touches (commit_id,
    symbol_id, qualified_name), edges: cochange_samples(), hotspots (path, hotspot). The newest scan_limit(limit) commits
    are scored: words of the task 0.08 each up to 0.32; paths 0.42, former names 0.32, up to 0.50; symbols up to 0.45;
    files that change with the paths, and samples of such pairs, up to 0.35; the paths' and those files' hotspots up
    to 0.18. The query's paths and symbols are a stated few: they are what is replicated.
    """
    task, paths, symbols = normalized_query(task, paths, symbols)
    spark = commits.sparkSession
    pool = newest(commits, scan_limit(limit))
    ids = pool.select("commit_id")
    mine = touches.join(ids, "commit_id", "left_semi")
    asked = spark.createDataFrame([(p,) for p in paths] or [(None,)], touches.select(F.col("path").alias("asked")).schema)

    wanted = spark.createDataFrame([(task or "",)], "task string").select(change_tokens(F.col("task")).alias("words")).first().words
    words = F.size(F.array_intersect(change_tokens(F.col("summary")), F.array(*map(F.lit, wanted)).cast("array<string>")))
    parts = [pool.select("commit_id", words.alias("n")).where("n > 0").select("commit_id", F.lit("text").alias("kind"), F.least(F.col("n") * 0.08, F.lit(0.32)).alias("score"))]

    now = mine.select("commit_id", F.col("path").alias("asked"), F.lit(0.42).alias("s")).distinct()
    then = mine.where("previous IS NOT NULL").select("commit_id", F.col("previous").alias("asked"), F.lit(0.32).alias("s")).distinct()
    hit = now.unionByName(then).join(F.broadcast(asked), "asked").groupBy("commit_id", "asked").agg(F.max("s").alias("s"))
    parts.append(hit.groupBy("commit_id").agg(F.least(F.sum("s"), F.lit(0.50)).alias("score")).select("commit_id", F.lit("path").alias("kind"), "score"))

    if symbols:
        queries = F.array(*[F.lit(s.lower()) for s in symbols])
        named = symbol_touches.join(ids, "commit_id", "left_semi").select("commit_id", "qualified_name", "symbol_id", F.explode(queries).alias("q"))
        matched = named.withColumn("s", symbol_match(F.col("q"), F.col("qualified_name"), F.col("symbol_id").cast("string"))).where("s IS NOT NULL").groupBy("commit_id", "q", "qualified_name").agg(F.max("s").alias("s"))
        parts.append(matched.groupBy("commit_id").agg(F.least(F.sum("s"), F.lit(0.45)).alias("score")).select("commit_id", F.lit("symbol").alias("kind"), "score"))

    beside = edges.join(F.broadcast(asked), F.col("path") == F.col("asked")).select("asked", F.col("other").alias("near"), "recency", "samples")
    near = beside.groupBy("near").agg(F.max("recency").alias("recency"))
    touched = mine.select("commit_id", F.col("path").alias("near")).distinct()
    by_neighbor = touched.join(near, "near").select("commit_id", F.least(0.16 + F.least("recency", F.lit(2.5)) * 0.03, F.lit(0.26)).alias("s"))
    # a pair is an edge each way, and so a sample of two
    pairs = beside.select(F.least("asked", "near").alias("a"), F.greatest("asked", "near").alias("b"), F.explode("samples").alias("commit_id")).distinct()
    by_sample = pairs.join(ids, "commit_id", "left_semi").select("commit_id", F.explode(F.array(F.lit(0.10), F.lit(0.10))).alias("s"))
    together = by_neighbor.unionByName(by_sample).groupBy("commit_id").agg(F.least(F.sum("s"), F.lit(0.35)).alias("score"))
    parts.append(together.select("commit_id", F.lit("cochange").alias("kind"), "score"))

    related = near.select("near").union(asked.select("asked")).distinct()
    hot = touched.join(related, "near", "left_semi").join(hotspots.select(F.col("path").alias("near"), "hotspot"), "near").where("hotspot > 0")
    heat = hot.select("commit_id", F.least(F.log1p("hotspot") * 0.08, F.lit(0.14)).alias("s")).groupBy("commit_id").agg(F.least(F.sum("s"), F.lit(0.18)).alias("score"))
    parts.append(heat.select("commit_id", F.lit("churn").alias("kind"), "score"))

    # a task's words count as two kinds of evidence: the text, and the commit's message
    whole = reduce(DataFrame.unionByName, parts).groupBy("commit_id").agg(F.round(F.least(F.sum("score"), F.lit(1.0)), 3).alias("score"), F.sum(F.when(F.col("kind") == "text", 2).otherwise(1)).cast("int").alias("sources"))
    out = whole.where("score > 0").withColumn("confidence", S.similar_confidence(F.col("score"), F.col("sources"))).join(pool.select("commit_id", "committed_at"), "commit_id")
    return out.orderBy(F.col("score").desc(), S.confidence_rank(F.col("confidence")).desc(), F.col("committed_at").desc(), "commit_id").limit(limit).select("commit_id", "score", "confidence", "sources")


def provenance_across(touches: DataFrame, commits: DataFrame, names: DataFrame, path, limit: int = 20) -> DataFrame:
    """(commit_id, author, path, place): the newest touches and the first one of a path under all names that it had:
    names (node, component), as rename_closure() gives them."""
    mine = names.where(F.col("node") == path).select("component")
    all_names = names.join(mine, "component", "left_semi").select(F.col("node").alias("path")).union(touches.where(F.col("path") == path).select("path")).distinct()
    rows = touches.join(all_names, "path", "left_semi").groupBy("commit_id", "path").agg(F.max("touched_at").alias("touched_at")).join(commits.select("commit_id", "author"), "commit_id")
    recent = rows.orderBy(F.col("touched_at").desc(), "commit_id", "path").limit(limit).withColumn("place", F.lit("recent"))
    first = rows.orderBy("touched_at", "commit_id", "path").limit(1).withColumn("place", F.lit("first"))
    return recent.unionByName(first).select("commit_id", "author", "path", "place")


def symbol_provenance(symbol_touches: DataFrame, commits: DataFrame, symbol, limit: int = 20) -> DataFrame:
    """(commit_id, author, place) of a symbol's newest touches and its first one."""
    rows = symbol_touches.where(F.col("symbol_id") == symbol).groupBy("commit_id").agg(F.max("touched_at").alias("touched_at")).join(commits.select("commit_id", "author"), "commit_id")
    recent = rows.orderBy(F.col("touched_at").desc(), "commit_id").limit(limit).withColumn("place", F.lit("recent"))
    return recent.unionByName(rows.orderBy("touched_at", "commit_id").limit(1).withColumn("place", F.lit("first"))).select("commit_id", "author", "place")


def touch_confidence(touches: DataFrame, key: str) -> DataFrame:
    """(key, touches, confidence): the lowest confidence of a key's touches."""
    return touches.groupBy(key).agg(F.count("*").alias("touches"), S.minimum_confidence(F.col("confidence"), "low").alias("confidence"))


def newest_touch(*touches: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [t.select("touched_at") for t in touches]).agg(F.max("touched_at").alias("newest"))


def reviews_of(reviews: DataFrame, touches: DataFrame, path) -> DataFrame:
    """Reviews (review_id, path, commit_id, ...) of a path, and those without a path of commits that touch it."""
    commits = touches.where(F.col("path") == path).select("commit_id").distinct()
    return reviews.where(F.col("path") == path).unionByName(reviews.where(F.col("path").isNull()).join(commits, "commit_id", "left_semi").select(reviews.columns))


def signals(churn: DataFrame, authors: DataFrame, neighbors: DataFrame, reviewers: DataFrame) -> DataFrame:
    """(path, history_churn, ownership_risk, reviewer_affinity, similar_change_overlap, risk) of churn (path, touches,
    hotspot), authors (path, authors), neighbors (path, neighbors) and reviewers (path, reviewers)."""
    rows = churn.join(authors, "path", "left").join(neighbors, "path", "left").join(reviewers, "path", "left").fillna(0, ["authors", "neighbors", "reviewers"])
    out = rows.select(
        "path",
        S.churn_signal(F.col("touches"), F.col("hotspot")).alias("history_churn"),
        S.ownership_signal(F.col("authors"), F.col("reviewers"), F.col("touches")).alias("ownership_risk"),
        S.reviewer_signal(F.col("reviewers")).alias("reviewer_affinity"),
        S.cochange_signal(F.col("neighbors")).alias("similar_change_overlap"),
    )
    return out.withColumn("risk", F.round(S.history_risk(F.col("history_churn"), F.col("ownership_risk"), F.col("similar_change_overlap")), 6))
