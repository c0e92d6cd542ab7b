"""Memory facts, compression handles, evidence of absence, risk and rendering."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import normalized, query_tokens

FILE, TICKET = r"[A-Za-z0-9_./-]+\.[a-z]{1,5}\b", r"\b[A-Z][A-Z0-9]+-[0-9]+\b"


def token_estimate(text: Column) -> Column:
    """The larger of words and a quarter of the bytes."""
    return F.greatest(F.regexp_count(text, F.lit(r"\S+")), F.floor(F.octet_length(text) / 4)).cast("long")


def summary(kind: Column, title: Column, text: Column, words: int = 8) -> Column:
    """Kind, title and the first words of the first line that isn't blank."""
    first = F.coalesce(F.get(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""), 0), F.lit(""))
    return F.concat_ws(" ", kind, F.concat(title, F.lit(":")), F.array_join(F.slice(F.regexp_extract_all(first, F.lit(r"\S+"), F.lit(0)), 1, words), " "))


def compress(items: DataFrame, key: str, kind: str, title: str, text: str) -> DataFrame:
    """(key, summary, tokens, summary_tokens): handles with what they stand for and what they save."""
    s = summary(F.col(kind), F.col(title).cast("string"), F.col(text))
    return items.select(key, s.alias("summary"), token_estimate(F.col(text)).alias("tokens"), F.greatest(F.regexp_count(s, F.lit(r"\S+")) + 3, F.lit(4)).cast("long").alias("summary_tokens"))


def entities(facts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind, value): files and tickets that a text names, each once."""

    def named(kind: str, pattern: str) -> Column:
        values = F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)))
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    found = F.concat(named("file", FILE), named("ticket", TICKET))
    return facts.select(key, F.explode(found).alias("e")).select(key, "e.kind", "e.value")


def search_facts(facts: DataFrame, query: str, limit: int = 100) -> DataFrame:
    """(fact_id, score, created): facts that hold words of the query; 0.25 and 0.08 a word, the newest first of equals."""
    words = query_tokens(query)
    held = F.lit(0)
    for w in words:
        held = held + F.when(normalized(F.col("text")).rlike(rf"(^| ){w}( |$)"), 1).otherwise(0)
    scored = facts.withColumn("hits", held).where("hits > 0")
    return scored.select("fact_id", F.round(0.25 + 0.08 * F.col("hits"), 6).alias("score"), "created").orderBy(F.col("score").desc(), F.col("created").desc(), "fact_id").limit(limit)


def recent_facts(facts: DataFrame, limit: int = 20) -> DataFrame:
    return facts.orderBy(F.col("created").desc(), "fact_id").limit(limit)


def within_budget(items: DataFrame, group: str, order: list, tokens: str, budget: int) -> DataFrame:
    """Each group's first items in order whose tokens add up to the budget at most."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return items.withColumn("used", F.sum(tokens).over(w)).where(F.col("used") <= budget)


def absent(scopes: list[str], found: DataFrame, scope: str) -> DataFrame:
    """(scope, n, note): how much was found in each scope; a note where nothing was."""
    spark = found.sparkSession
    counts = found.groupBy(F.col(scope).alias("scope")).agg(F.count("*").alias("n"))
    out = spark.createDataFrame([(s,) for s in scopes], "scope string").join(counts, "scope", "left")
    return out.select("scope", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.when(F.col("n").isNull(), F.concat(F.lit("nothing found in "), "scope")).alias("note"))


def risk_level(score: Column) -> Column:
    return F.when(score >= 0.6, "high").when(score >= 0.25, "medium").otherwise("low")


def merge_risk(a: Column, b: Column, unmatched: Column) -> Column:
    """The higher of two risks, 0.45 at least where an anchor of the task is unmatched."""
    return F.greatest(a, b, F.when(unmatched, 0.45).otherwise(0.0))


def ticket_ids(text: str) -> list[str]:
    return re.findall(TICKET, text)


def cell(value: str) -> str:
    """White space collapsed; separators of the table format escaped."""
    return re.sub(r"([|,{}])", r"\\\1", " ".join(value.split()))


def render(title: str, rows: list[dict]) -> str:
    """A compact table: title with count and columns, then a line of cells for each row."""
    columns = list(rows[0]) if rows else []
    return "\n".join([f"{title}[{len(rows)}]{{{','.join(columns)}}}:", *("  " + ",".join(cell(str(r[c])) for c in columns) for r in rows)])
