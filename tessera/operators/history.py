"""Change-history analytics: co-change, churn, rename closure, provenance, similar changes, ownership, reviewers.

commits: (commit_id, author, committed_at, ...); touches: (commit_id, touch, path, owner, additions, touched_at).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.rounds import component_labels

DAY = 86_400


def recency_weights(commits: DataFrame) -> DataFrame:
    """(commit_id, weight): 1 / (1 + i / 25) for the i-th newest commit, ties to the smaller id.

    The index over all commits is a range of positions in each part plus the sizes of the parts before: newest commits
    first by days, so no task sorts the whole table.
    """
    day = F.date_trunc("day", "committed_at")
    days = commits.groupBy(day.alias("day")).agg(F.count("*").alias("n"))
    before = days.select("day", F.coalesce(F.sum("n").over(Window.orderBy(F.col("day").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("day").orderBy(F.col("committed_at").desc(), "commit_id")) - 1
    placed = commits.withColumn("day", day).withColumn("i", inside).join(before, "day")
    return placed.select("commit_id", (1 / (1 + (F.col("i") + F.col("before")) / 25.0)).alias("weight"))


def cochange(commits: DataFrame, touches: DataFrame, most_files: int = 50) -> DataFrame:
    """(path, other, commits, recency): ordered pairs of files touched together, by commits of two to most_files files.

    The pairs of a commit are bounded by most_files; recency, the sum of the commits' weights, is rounded to four places.
    """
    files = touches.select("commit_id", "path").distinct()
    fit = files.groupBy("commit_id").agg(F.count("*").alias("n")).where(F.col("n").between(2, most_files)).select("commit_id").join(recency_weights(commits), "commit_id")
    files = files.join(fit, "commit_id")
    pairs = files.join(files.select("commit_id", F.col("path").alias("other")), "commit_id").where("path <> other")
    return pairs.groupBy("path", "other").agg(F.count("*").alias("commits"), F.round(F.sum("weight"), 4).alias("recency"))


def neighbors(pairs: DataFrame, path: Column, limit: int = 10) -> DataFrame:
    return pairs.where(path).orderBy(F.col("recency").desc(), F.col("commits").desc(), "other").limit(limit)


def churn(touches: DataFrame, by: str = "path") -> DataFrame:
    """(by, touches, last_30d, last_90d, recency, volume, hotspot) against the newest touch of all.

    recency: sum of 1 / (1 + age in days / 30). hotspot: recency * ln(1 + touches) + ln(1 + volume) / 10.
    """
    newest = touches.agg(F.max("touched_at")).scalar()
    age = (F.unix_micros("now") - F.unix_micros("touched_at")) / (1e6 * DAY)
    aged = touches.withColumn("now", newest).withColumn("age", age)
    out = aged.groupBy(by).agg(F.count("*").alias("touches"), F.sum(F.when(F.col("age") <= 30, 1).otherwise(0)).alias("last_30d"), F.sum(F.when(F.col("age") <= 90, 1).otherwise(0)).alias("last_90d"), F.sum(1 / (1 + F.col("age") / 30)).alias("r"), F.sum("additions").alias("volume"))
    hotspot = F.col("r") * F.log1p("touches") + F.log1p("volume") / 10
    return out.select(by, "touches", "last_30d", "last_90d", F.round("r", 6).alias("recency"), "volume", F.round(hotspot, 6).alias("hotspot"))


def with_ancestors(touches: DataFrame, segments: Column, root: str = "__root__") -> DataFrame:
    """touches once for each module: the root and every prefix of the path's segments."""
    prefixes = F.transform(F.sequence(F.lit(1), F.size("_s")), lambda n: F.array_join(F.slice("_s", 1, n), "/"))
    return touches.withColumn("_s", segments).withColumn("module", F.explode(F.concat(F.array(F.lit(root)), F.when(F.size("_s") > 0, prefixes).otherwise(F.array().cast("array<string>"))))).drop("_s")


def rename_closure(renames: DataFrame) -> DataFrame:
    """(node, component) of rename pairs (a, b), followed both ways: the least name of each group."""
    return component_labels(renames)


def provenance(touches: DataFrame, commits: DataFrame, path: Column, limit: int = 20) -> DataFrame:
    """(commit_id, author, touched_at, place): a path's newest touches and its first one, by commit."""
    mine = touches.where(path).groupBy("commit_id").agg(F.max("touched_at").alias("touched_at")).join(commits.select("commit_id", "author"), "commit_id")
    newest = mine.orderBy(F.col("touched_at").desc(), "commit_id").limit(limit).withColumn("place", F.lit("recent"))
    first = mine.orderBy("touched_at", "commit_id").limit(1).withColumn("place", F.lit("first"))
    return newest.unionByName(first)


def shares(touches: DataFrame, who: str, stale_days: int = 365) -> DataFrame:
    """(path, who, touches, share, stale, score): each owner's share of a path's touches.

    score: (0.30 + 0.32 * share) * (0.6 + 0.4 * min(touches / 3, 1)) * (0.55 if the last is older than stale_days
    before the newest touch of all), at most 0.62.
    """
    newest = touches.agg(F.max("touched_at")).scalar()
    each = touches.groupBy("path", who).agg(F.count("*").alias("touches"), F.max("touched_at").alias("last")).withColumn("now", newest)
    share = F.col("touches") / F.sum("touches").over(Window.partitionBy("path"))
    stale = F.datediff("now", "last") > stale_days
    score = (0.30 + 0.32 * F.col("share")) * (0.6 + 0.4 * F.least(F.col("touches") / 3, F.lit(1.0))) * F.when(F.col("stale"), 0.55).otherwise(1.0)
    return each.withColumn("share", share).withColumn("stale", stale).select("path", who, "touches", F.round("share", 6).alias("share"), "stale", F.round(F.least(score, F.lit(0.62)), 6).alias("score"))


def suggestions(scored: DataFrame, who: str, keep: int = 3, gap: float = 0.08, penalty: float = 0.12) -> DataFrame:
    """(path, rank, who, score): the best owners; where several lie within `gap` of the top, all of those lose `penalty`."""
    top = F.max("score").over(Window.partitionBy("path"))
    near = scored.withColumn("near", F.col("score") >= top - gap)
    crowd = F.sum(F.col("near").cast("int")).over(Window.partitionBy("path")) > 1
    out = near.withColumn("score", F.round(F.col("score") - F.when(F.col("near") & crowd, penalty).otherwise(0.0), 6))
    order = Window.partitionBy("path").orderBy(F.col("score").desc(), who)
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep).select("path", "rank", who, "score")


def similar_commits(commits: DataFrame, touches: DataFrame, query: int, tokens: Column, limit: int = 10) -> DataFrame:
    """(commit_id, shared_paths, shared_tokens, score): commits like the query commit.

    score: 0.42 for each shared path up to 0.50, 0.08 for each shared token up to 0.32; tokens is an array column of commits.
    """
    files = touches.select("commit_id", "path").distinct()
    mine = files.where(F.col("commit_id") == query).select("path")
    paths = files.where(F.col("commit_id") != query).join(F.broadcast(mine), "path").groupBy("commit_id").agg(F.count("*").alias("shared_paths"))
    words = commits.where(F.col("commit_id") == query).select(F.array_distinct(tokens)).scalar()
    text = commits.where(F.col("commit_id") != query).withColumn("asked", words).select("commit_id", F.size(F.array_intersect(F.array_distinct(tokens), "asked")).cast("long").alias("shared_tokens"))
    both = text.join(paths, "commit_id", "left").withColumn("shared_paths", F.coalesce("shared_paths", F.lit(0)))
    score = F.least(F.col("shared_paths") * 0.42, F.lit(0.5)) + F.least(F.col("shared_tokens") * 0.08, F.lit(0.32))
    return both.withColumn("score", F.round(F.least(score, F.lit(1.0)), 3)).where("score > 0").orderBy(F.col("score").desc(), "commit_id").limit(limit).select("commit_id", "shared_paths", "shared_tokens", "score")


def dangling(touches: DataFrame, commits: DataFrame) -> DataFrame:
    """Touches whose commit isn't known."""
    return touches.join(commits.select("commit_id"), "commit_id", "left_anti")
