"""Vector queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import vectors as V

DOT = "list_inner_product(CAST({0} AS DOUBLE[]), CAST({1} AS DOUBLE[]))"


def _asked(t):
    return t.raw("embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"))


QUERIES = {
    "vector_flat_search": (lambda t: V.flat_search(t.vectors, _asked(t)), f"SELECT query, rank, target_id, score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, target_id) AS INTEGER) AS rank FROM (SELECT q.vec_id AS query, v.vec_id AS target_id, round({DOT.format('v.embedding', 'q.embedding')}, 6) AS score FROM embeddings v, embeddings q WHERE q.vec_id % 20 = 0) WHERE score > 0) WHERE rank <= 10"),
    "vector_search_of_kind": (lambda t: V.flat_search(t.vectors, _asked(t), 5, F.col("target_kind").isin(1, 2, 3)), f"SELECT query, rank, target_id, score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, target_id) AS INTEGER) AS rank FROM (SELECT q.vec_id AS query, v.vec_id AS target_id, round({DOT.format('v.embedding', 'q.embedding')}, 6) AS score FROM embeddings v, embeddings q WHERE q.vec_id % 20 = 0 AND v.label IN (1, 2, 3)) WHERE score > 0) WHERE rank <= 5"),
    "vector_stats": (lambda t: t.vectors.groupBy("target_kind").agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dims")), "SELECT label AS target_kind, count(*) AS n, CAST(max(len(embedding)) AS INTEGER) AS dims FROM embeddings GROUP BY 1"),
    "vector_norms": (lambda t: t.vectors.select("target_id", F.round(F.sqrt(V.dot(V.unit(F.col("vector").cast("array<double>")), V.unit(F.col("vector").cast("array<double>")))), 6).alias("norm")), "SELECT vec_id AS target_id, CASE WHEN list_sum([x * x FOR x IN embedding]) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS norm FROM embeddings"),
    "vector_hash_embedding": (lambda t: V.hash_embedding(t.raw("benchmark"), "item_id", "text"), None),
}
