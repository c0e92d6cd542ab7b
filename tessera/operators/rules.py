"""Policy joins, impact, test selection, set differences, interval overlap and cross-project links."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def glob_pattern(glob: str) -> str:
    """The regular expression of a glob: ** any path, * within a segment, ? one character; a leading **/ may be empty."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = glob[i]
            out, i = out + ("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c)), i + 1
    return f"^{out}$"


def owners_globs(pattern: str) -> list[str]:
    """Globs of an owners-file pattern: a leading slash anchors it, a trailing one means all below."""
    anchored, below = pattern.startswith("/"), pattern.endswith("/")
    core = pattern.strip("/") + ("/**" if below else "")
    return [core] if anchored else [core, f"**/{core}"]


def components(paths: DataFrame, globs: list[tuple[str, str]]) -> DataFrame:
    """(path, component) for each component (name, glob) whose glob holds the path. Globs are a policy's: tens, not rows."""
    rules = paths.sparkSession.createDataFrame([(n, glob_pattern(g)) for n, g in globs], "component string, pattern string")
    return paths.select("path").distinct().join(F.broadcast(rules), F.expr("path RLIKE pattern")).select("path", "component").distinct()


def verdicts(edges: DataFrame, mapped: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(source, target, verdict) of edges (source, target) by rules (from, to, allow or forbid; * is any).

    Same path: allowed. A path without component: unknown. A component in common: allowed. Any forbidding rule:
    violation. An allowing one: allowed. None: unknown.
    """
    spark = edges.sparkSession
    rule = F.broadcast(spark.createDataFrame(rules, "r_from string, r_to string, action string"))
    sets = mapped.groupBy("path").agg(F.collect_set("component").alias("cs"))
    both = edges.join(sets.select(F.col("path").alias("source"), F.col("cs").alias("a")), "source", "left").join(sets.select(F.col("path").alias("target"), F.col("cs").alias("b")), "target", "left")
    pairs = edges.join(mapped.select(F.col("path").alias("source"), F.col("component").alias("c_from")), "source").join(mapped.select(F.col("path").alias("target"), F.col("component").alias("c_to")), "target")
    hits = pairs.join(rule, ((F.col("r_from") == "*") | (F.col("r_from") == F.col("c_from"))) & ((F.col("r_to") == "*") | (F.col("r_to") == F.col("c_to"))))
    hits = hits.groupBy("source", "target").agg(F.max((F.col("action") == "forbid").cast("int")).alias("forbid"), F.max((F.col("action") == "allow").cast("int")).alias("allow"))
    verdict = F.when(F.col("source") == F.col("target"), "allowed").when(F.col("a").isNull() | F.col("b").isNull(), "unknown").when(F.arrays_overlap("a", "b"), "allowed").when(F.col("forbid") == 1, "violation").when(F.col("allow") == 1, "allowed").otherwise("unknown")
    return both.join(hits, ["source", "target"], "left").select("source", "target", verdict.alias("verdict"))


def difference(before: DataFrame, after: DataFrame, *keys: str) -> DataFrame:
    """keys and change: rows added or removed, nulls being equal. Both sides are counted in one pass, of which a task holds
    a row a key at most, and spills what is more."""
    side = lambda df, after: df.select(*keys, F.lit(after).alias("_after"))
    both = side(before, 0).unionByName(side(after, 1)).groupBy(*keys).agg(F.min("_after").alias("_first"), F.max("_after").alias("_last"))
    return both.where("_first = _last").select(*keys, F.when(F.col("_last") == 1, "added").otherwise("removed").alias("change"))


def changed(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """(key, change): removed, added or changed, of values by key."""
    both = before.select(key, F.col(value).alias("_b")).join(after.select(key, F.col(value).alias("_a")), key, "full_outer")
    change = F.when(F.col("_a").isNull(), "removed").when(F.col("_b").isNull(), "added").when(F.col("_a") != F.col("_b"), "changed")
    return both.select(key, change.alias("change")).where("change IS NOT NULL")


def overlaps(left: DataFrame, right: DataFrame, key: str, width: int) -> DataFrame:
    """Pairs of closed integer intervals of one key that overlap: (key, l_start, l_end, r_start, r_end, ids).

    Each interval is dealt to the bins of `width` that it touches and pairs meet in the bin where the later one starts,
    so a pair is found once and a key with many intervals is spread over its bins.
    """

    def binned(df: DataFrame, p: str) -> DataFrame:
        return df.select(key, F.col("id").alias(f"{p}_id"), F.col("start").alias(f"{p}_start"), F.col("end").alias(f"{p}_end"), F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))).alias("bin"))

    pairs = binned(left, "l").join(binned(right, "r"), [key, "bin"]).where("l_start <= r_end AND r_start <= l_end")
    return pairs.where(F.col("bin") == F.floor(F.greatest("l_start", "r_start") / width)).drop("bin")


def narrowest(pairs: DataFrame, ties: str = "r_id") -> DataFrame:
    """Of each left interval's overlaps the narrowest right ones, and whether several tie."""
    by = Window.partitionBy("l_id")
    ranked = pairs.withColumn("width", F.col("r_end") - F.col("r_start")).withColumn("_r", F.rank().over(by.orderBy("width")))
    return ranked.where("_r = 1").withColumn("ambiguous", F.count("*").over(by) > 1).drop("_r")


def select_tests(tests: DataFrame, changed_paths: DataFrame, limit: int = 5) -> DataFrame:
    """(changed, rank, test, score): tests (test, folder, stem) for changed (changed, folder, stem): 0.35 for the stem, 0.2 for the folder.

    Of the tests of a stem, of a folder, and of both, the first `limit` by name are enough, so no folder meets all its tests.
    """
    pairs = []
    for keys in (["stem"], ["folder"], ["stem", "folder"]):
        first = tests.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("test"))).where(F.col("_n") <= limit)
        pairs.append(first.select(*keys, "test", F.col("stem").alias("t_stem"), F.col("folder").alias("t_folder")).join(changed_paths, keys).select("changed", "stem", "folder", "test", "t_stem", "t_folder"))
    near = pairs[0].unionByName(pairs[1]).unionByName(pairs[2]).distinct()
    score = F.when(F.col("stem") == F.col("t_stem"), 0.35).otherwise(0.0) + F.when(F.col("folder") == F.col("t_folder"), 0.2).otherwise(0.0)
    scored = near.select("changed", "test", F.round(score, 6).alias("score"))
    order = Window.partitionBy("changed").orderBy(F.col("score").desc(), "test")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("changed", "rank", "test", "score")


def impact(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, node, hops): nodes that depend on a start directly or through one other: edges (from_id, to_id) against their direction."""
    back = edges.select(F.col("to_id").alias("at"), F.col("from_id").alias("node")).distinct()
    one = starts.select(F.col("id").alias("start"), F.col("id").alias("at")).join(back, "at").select("start", "node")
    two = one.withColumnRenamed("node", "at").join(back, "at").select("start", "node").distinct()
    return one.withColumn("hops", F.lit(1)).union(two.withColumn("hops", F.lit(2))).where("start <> node").groupBy("start", "node").agg(F.min("hops").alias("hops"))


def links(sources: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target, ambiguous): boundary calls (id, project, path, method) and endpoints of other projects with the same
    path, and the same method if both have one."""
    a = sources.select(F.col("id").alias("source"), F.col("project").alias("p_a"), "path", F.col("method").alias("m_a"))
    b = targets.select(F.col("id").alias("target"), F.col("project").alias("p_b"), "path", F.col("method").alias("m_b"))
    found = a.join(b, "path").where("p_a <> p_b AND (m_a IS NULL OR m_b IS NULL OR m_a = m_b)")
    return found.select("source", "target", (F.count("*").over(Window.partitionBy("source")) > 1).alias("ambiguous"))
