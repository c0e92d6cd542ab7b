"""Owners and reviewers of paths, from owner files, authorship, memory and reviews.

Evidence is a row a (path, owner, source): score and whether it is stale. Sources: codeowners, git_history, memory.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import scores as S
from tessera.operators.rules import glob_pattern, owners_globs

# Where owner files lie, and scores and caps of the kinds of evidence.
OWNER_FILES = (".github/CODEOWNERS", "CODEOWNERS", "docs/CODEOWNERS", "OWNERS")
CODEOWNERS_SCORE, MEMORY_ONLY, STALE_DAYS = 0.70, 0.45, 365
MARKS = ",;:.()[]{}<>\"'"


def owner_of(token: str) -> str | None:
    """The handle or address that a token is, without marks around it."""
    bare = token.strip(MARKS)
    local, at, domain = bare.partition("@")
    address = bool(at and local) and "." in domain and not domain.startswith(".") and not domain.endswith(".")
    return bare if len(bare) >= 2 and (bare.startswith("@") or address) else None


def owner_rules(text: str) -> list[tuple[str, list[str]]]:
    """(pattern, owners) of an owner file's lines, in order; comments, negations and lines without owners are left out."""
    out = []
    for line in filter(None, map(str.strip, text.splitlines())):
        pattern, *rest = line.split()
        names = [t for t in rest[: next((i for i, t in enumerate(rest) if t.startswith("#")), len(rest))]]
        owners = [o for o in map(owner_of, names) if o]
        if pattern[0] not in "#!" and owners:
            out.append((pattern, owners))
    return out


def owner_tokens(text: Column) -> Column:
    """Handles and addresses in a text, each once, without regard to case and the handle's mark."""
    inner = "\\[\\](){}<>\"',;:."
    bare = F.transform(F.split(text, r"\s+"), lambda t: F.regexp_replace(t, f"^[{inner}]+|[{inner}]+$", ""))
    named = F.filter(bare, lambda t: t.rlike("^@.") | t.rlike(r"^[^@]+@(?!\.).*\..*(?<!\.)$"))
    return F.array_distinct(F.transform(named, owner_key))


def owner_key(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, "^@+", ""))


def by_owner_file(paths: DataFrame, rules: list[tuple[str, list[str]]]) -> DataFrame:
    """Evidence for paths (path): of the rules, a file's few lines, the last that holds the path names its owners."""
    owners = F.lit(None).cast("array<string>")
    for pattern, names in rules:
        holds = reduce(Column.__or__, [F.col("path").rlike(glob_pattern(g)) for g in owners_globs(pattern)])
        owners = F.when(holds, F.array(*map(F.lit, names))).otherwise(owners)
    return paths.select("path", F.explode(owners).alias("name")).select("path", owner_key(F.col("name")).alias("owner"), F.lit("codeowners").alias("source"), F.lit(CODEOWNERS_SCORE).alias("score"), F.lit(False).alias("stale"))


def by_authors(touches: DataFrame, now: Column, base: float = 0.30, by_share: float = 0.32, most: float = 0.62) -> DataFrame:
    """Evidence for touches (path, owner, touch id, touched_at), each counted once: a share of the path's touches."""
    each = touches.groupBy("path", "owner").agg(F.count("*").alias("n"), F.max("touched_at").alias("last"))
    stale = F.unix_micros(now) - F.unix_micros("last") > STALE_DAYS * 86_400_000_000
    scored = each.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("path"))).withColumn("stale", stale)
    return scored.select("path", "owner", F.lit("git_history").alias("source"), S.author_score(F.col("share"), F.col("n"), F.col("stale"), base, by_share, most).alias("score"), "stale")


def by_memory(facts: DataFrame) -> DataFrame:
    """Evidence for facts (path, text, score, confidence, stale) that name handles or addresses."""
    score = F.least((0.08 + 0.10 * F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0))) * S.confidence_value(F.col("confidence")), F.lit(0.22))
    return facts.select("path", F.explode(owner_tokens(F.col("text"))).alias("owner"), F.lit("memory").alias("source"), score.alias("score"), "stale")


def _ambiguous(df: DataFrame, sure: Column, near: float, penalty: float) -> DataFrame:
    """score of raw: where several unsure candidates lie within `near` of a path's best, those lose the penalty."""
    path = Window.partitionBy("path")
    close = ~sure & (F.round(F.max("raw").over(path) - F.col("raw"), 9) <= near)
    out = df.withColumn("close", close).withColumn("crowd", F.sum(F.col("close").cast("int")).over(path) > 1)
    score = F.col("raw") - F.when(F.col("close") & F.col("crowd"), penalty).otherwise(0.0)
    return out.withColumn("score", F.round(F.greatest(F.least(score, F.lit(1.0)), F.lit(0.0)), 6)).drop("close", "crowd")


def owners(evidence: DataFrame) -> DataFrame:
    """(path, owner, score, codeowners, git_history, memory, stale): the best of each source, memory added up to 0.22,
    0.08 more if any of it is fresh, 0.45 at most for memory alone, and less where owners without a file's word are close."""
    best = lambda source: F.coalesce(F.max(F.when(F.col("source") == source, F.col("score"))), F.lit(0.0))
    memory = F.least(F.coalesce(F.sum(F.when(F.col("source") == "memory", F.col("score"))), F.lit(0.0)), F.lit(0.22))
    each = evidence.groupBy("path", "owner").agg(best("codeowners").alias("codeowners"), best("git_history").alias("git_history"), memory.alias("memory"), F.min(F.col("stale").cast("int")).alias("old"))
    total = F.least(F.col("codeowners") + F.col("git_history") + F.col("memory") + F.when(F.col("old") == 0, 0.08).otherwise(0.0), F.lit(1.0))
    alone = (F.col("codeowners") == 0) & (F.col("git_history") == 0)
    out = _ambiguous(each.withColumn("raw", F.when(alone, F.least(total, F.lit(MEMORY_ONLY))).otherwise(total)), F.col("codeowners") > 0, 0.08, 0.12)
    return out.select("path", "owner", "score", "codeowners", "git_history", "memory", (F.col("old") == 1).alias("stale"))


def reviewers(reviews: DataFrame, owned: DataFrame, authored: DataFrame) -> DataFrame:
    """(path, reviewer, score, availability): reviews (path, reviewer, role, confidence, stale), owners() and authors'
    evidence together. Without a real review a candidate is inferred, which caps the score."""
    actual = F.col("role").isin("approver", "reviewer")
    a = reviews.select("path", F.col("reviewer").alias("who"), S.review_score(F.col("role"), F.col("confidence"), F.col("stale")).alias("review"), F.lit(0.0).alias("owner"), F.lit(0.0).alias("author"), "stale", actual.alias("actual"), (F.col("role") == "owner").alias("as_owner"), F.col("role").isin("author", "committer").alias("as_author"))
    weight = S.owner_weight(F.col("codeowners") > 0, F.col("git_history") > 0)
    no, yes = F.lit(False), F.lit(True)
    b = owned.select("path", F.col("owner").alias("who"), F.lit(0.0).alias("review"), F.least(F.col("score") * weight, F.lit(0.62)).alias("owner"), F.lit(0.0).alias("author"), "stale", no.alias("actual"), yes.alias("as_owner"), no.alias("as_author"))
    c = authored.select("path", F.col("owner").alias("who"), F.lit(0.0).alias("review"), F.lit(0.0).alias("owner"), F.col("score").alias("author"), "stale", no.alias("actual"), no.alias("as_owner"), yes.alias("as_author"))
    each = a.unionByName(b).unionByName(c).groupBy("path", "who").agg(*[F.max(x).alias(x) for x in ("review", "owner", "author")], F.min(F.col("stale").cast("int")).alias("old"), *[F.max(x).alias(x) for x in ("actual", "as_owner", "as_author")])
    total = F.least(F.col("review") + F.col("owner") + F.col("author") + F.when(F.col("old") == 0, 0.05).otherwise(0.0), F.lit(1.0))
    capped = F.when(F.col("actual"), total).otherwise(F.least(total, S.inferred_cap(F.col("as_owner"), F.col("as_author"))))
    out = _ambiguous(each.withColumn("raw", capped), F.col("actual"), 0.06, 0.08)
    return out.select("path", F.col("who").alias("reviewer"), "score", S.availability(F.col("actual"), F.col("as_owner"), F.col("as_author")).alias("availability"))


def ranked(scored: DataFrame, who: str, keep: int) -> DataFrame:
    """The best `keep` of each path, ties by name."""
    order = Window.partitionBy("path").orderBy(F.col("score").desc(), who)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def report_availability(suggested: DataFrame) -> DataFrame:
    """(path, availability): the best class among a path's suggestions."""
    return suggested.groupBy("path").agg(S.report_availability(F.col("availability")).alias("availability"))
