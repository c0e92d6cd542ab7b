"""Text retrieval: postings, BM25, lexical and pattern search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from tessera.functions.text import ascii_lower, lexical_score, normalized, query_tokens, snippet, tokens_held, word_tokens

from tessera.operators.rounds import cut

# Fixed value: terms of queries that are replicated.
MOST_TERMS = 100_000


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf, length): each document's distinct terms with their counts."""
    tokens = docs.select(key, word_tokens(F.col(text)).alias("tokens"))
    return tokens.select(key, F.size("tokens").alias("length"), F.explode("tokens").alias("term")).groupBy(key, "length", "term").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, key: str, text: str, asked: DataFrame, k: int = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query, rank, key, score): the k best documents of each query (query, text), ties to the smaller key.

    Score: sum over the query's distinct terms of ln(1 + (N - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) /
    (tf + k1 * (1 - b + b * length / mean length)), rounded to six places. Only the queries' terms are kept of the
    documents, by an equi-join on the term; partial sums precede the shuffle. Up to MOST_TERMS terms of queries are replicated,
    so that a term of very many documents isn't one task, and a document's scores are summed where its terms are.
    """
    terms = asked.select("query", F.explode(F.array_distinct(word_tokens(F.col("text")))).alias("term"))
    small = F.broadcast if terms.limit(MOST_TERMS + 1).count() <= MOST_TERMS else lambda df: df
    sizes = Observation()
    # each text is taken apart once: its length is observed on the way, and the terms that are asked for are written
    tokens = docs.select(key, word_tokens(F.col(text)).alias("tokens")).withColumn("length", F.size("tokens"))
    tokens = tokens.observe(sizes, F.count("*").alias("n"), F.sum("length").alias("total"))
    held = tokens.select(key, "length", F.explode("tokens").alias("term")).join(small(terms.select("term").distinct()), "term", "left_semi")
    wanted = cut(held.groupBy(key, "length", "term").agg(F.count("*").alias("tf")))
    n, total = sizes.get["n"], sizes.get["total"] or 0
    mean = total / n if n else 1.0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.sparkSession.sparkContext.defaultParallelism)
    weighed = wanted.repartition(parts, key).join(small(wanted.groupBy("term").agg(F.count("*").alias("df"))), "term")
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.lit(float(mean))))
    scored = weighed.select(key, "term", (idf * tf).alias("part")).join(small(terms), "term").groupBy("query", key).agg(F.round(F.sum("part"), 6).alias("score"))
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), key)
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query", "rank", key, "score")


def containing(docs: DataFrame, key: str, text: str, passages: DataFrame, width: int = 3) -> DataFrame:
    """(query, key): documents whose text holds a passage (query, passage) whole.

    They meet on the passage's first `width` words but its very first, which a document then has in a row; the passage is
    then looked for. Passages of too few words for that, which are compared with all documents, are a stated few.
    """
    runs = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - width + 1), lambda i: F.xxhash64(*[F.get(w, i - 1 + j) for j in range(width)]))
    words = passages.withColumn("w", F.filter(F.split("passage", r"\s+"), lambda x: x != ""))
    long = words.where(F.size("w") >= width + 2).withColumn("run", F.xxhash64(*[F.get("w", F.lit(1 + j)) for j in range(width)]))
    each = docs.select(key, text, F.filter(F.split(text, r"\s+"), lambda x: x != "").alias("w")).where(F.size("w") >= width)
    found = each.select(key, text, F.explode(F.array_distinct(runs(F.col("w")))).alias("run")).join(long.select("query", "passage", "run"), "run")
    short = words.where(F.size("w") < width + 2).select("query", "passage")
    whole = found.where(F.col(text).contains(F.col("passage"))).select("query", key)
    return whole.unionByName(docs.join(F.broadcast(short), F.col(text).contains(F.col("passage"))).select("query", key)).distinct()


def lexical(docs: DataFrame, path: str, text: str, query: str, generated=None, vendor=None) -> DataFrame:
    """(path, score, snippet) of documents that hold the phrase or all of its words, path included."""
    tokens, none = query_tokens(query), F.lit(False)
    # bound as columns, the whole text's two forms are made once for the test and once for the score
    rows = docs.withColumn("_low", ascii_lower(F.concat_ws(" ", F.col(path), F.col(text)))).withColumn("_norm", normalized(F.col("_low")))
    every = tokens_held(F.col("_norm"), tokens) == len(tokens) if tokens else none
    score = lexical_score(F.col("_low"), query, generated if generated is not None else none, vendor if vendor is not None else none, F.col("_norm"))
    return rows.where(F.col("_low").contains(query.lower()) | every).select(path, F.round(score, 6).alias("score"), snippet(F.col(text), query).alias("snippet"))


def grep(lines: DataFrame, pattern: str) -> DataFrame:
    return lines.where(F.col("text").rlike(pattern))
