"""Feature-hash embeddings and exact flat vector search."""

from __future__ import annotations

import re
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Context, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from tessera.functions.text import fnv1a_plain

# Rows of a block of vectors or queries; digits enough for any double to six places.
BLOCK, CONTEXT = 16384, Context(prec=400)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """v over its length; a zero vector stays."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)


def hash_embedding(docs: DataFrame, key: str, text: str, dims: int = 64) -> DataFrame:
    """(key, idx, weight): the non-zero components of each text's signed feature-hash embedding, unit length.

    A text is one row on its way: its tokens are counted where it is read, and only `dims` sums a key are dealt out.
    """
    schema = StructType([docs.schema[key], StructField("w", ArrayType(LongType()))])
    held = docs.select(key, F.col(text).alias("_text")).mapInArrow(lambda batches: _hashed(batches, dims), schema)
    sums = held.groupBy(key).agg(*[F.sum(F.get("w", F.lit(i))).alias(f"_{i}") for i in range(dims)]).select(key, F.array(*[f"_{i}" for i in range(dims)]).alias("w"))
    norm = F.sqrt(F.aggregate("w", F.lit(0).cast("long"), lambda s, x: s + x * x))
    parts = sums.select(key, norm.alias("norm"), F.posexplode("w").alias("idx", "w")).where("w <> 0")
    return parts.select(key, "idx", (F.col("w") / F.col("norm")).alias("weight"))


class _Places(dict):
    """Of each token met, the component that it counts for, past `dims` if it counts against."""

    def __init__(self, dims: int):
        self.dims = dims

    def __missing__(self, token: bytes) -> int:
        if len(self) >= 1_000_000:
            self.clear()
        h = fnv1a_plain(token.decode())
        out = self[token] = h % self.dims + (self.dims if h % 2 else 0)
        return out


def _hashed(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[pa.RecordBatch]:
    places, find = _Places(dims), re.compile(rb"[a-z0-9]+").findall
    for batch in batches:
        keys, texts = batch.column(0), batch.column(1)
        out = np.zeros((len(batch), dims), dtype=np.int64)
        for i in range(len(batch)):
            text = texts[i].as_py()
            # bytes have only ASCII letters to lower, as the pattern has
            if text and (at := [places[t] for t in find(text.encode().lower())]):
                n = np.bincount(at, minlength=2 * dims)
                out[i] = n[:dims] - n[dims:]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, dims, dtype=np.int32)), pa.array(out.ravel()))
        yield pa.RecordBatch.from_arrays([keys, lists], names=[batch.schema.names[0], "w"])


def flat_search(vectors: DataFrame, queries: DataFrame, k: int = 10, kind: Column | None = None) -> DataFrame:
    """(query, rank, target_id, score): each query's (query, q) k highest positive dot products, ties to the smaller id.

    Vectors and queries are dealt to blocks of about BLOCK rows, and each block of the one meets each of the other in one
    task, which passes on k rows a query. Work is queries times vectors; what a task holds doesn't grow.
    """
    pool = vectors.where(kind) if kind is not None else vectors
    spark = vectors.sparkSession
    kept = pool.select("target_id", _numbers(pool, "vector")).where("vector IS NOT NULL AND size(vector) > 0")
    asked = queries.select("query", _numbers(queries, "q")).where("q IS NOT NULL AND size(q) > 0")
    n, cores = kept.count(), spark.sparkContext.defaultParallelism
    parts, blocks = max(1, -(-n // BLOCK), min(cores, n // 1024)), max(1, -(-asked.count() // BLOCK))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    deal = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
    key, spread = ["part", "block", "dim"], 2 * parts * blocks
    left = kept.select("target_id", "vector", deal("target_id", parts).alias("part"), every(blocks).alias("block"), F.size("vector").alias("dim")).repartition(spread, *key)
    right = asked.select("query", "q", every(parts).alias("part"), deal("query", blocks).alias("block"), F.size("q").alias("dim")).repartition(spread, *key)
    schema = StructType([asked.schema["query"], kept.schema["target_id"], StructField("score", DoubleType())])
    scored = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(lambda a, b: _best(a, b, k), schema)
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), "target_id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query", "rank", "target_id", "score")


def _numbers(df: DataFrame, name: str) -> Column:
    return F.col(name) if dict(df.dtypes)[name] == "array<float>" else F.col(name).cast("array<double>").alias(name)


def _best(vectors: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """(query, target_id, score) of vectors and queries of one length: for each query the k best of these vectors.

    A product of matrices tells which may be among them. These are summed again in the order of the components and
    rounded as Spark does, so that scores and ties don't hang on how a library adds up.
    """

    def matrix(t: pa.Table, name: str) -> tuple[pa.Table, np.ndarray]:
        lists = t[name].combine_chunks()
        whole = np.asarray(lists.flatten().fill_null(0), dtype=np.float64).reshape(len(t), -1) if len(t) else np.zeros((0, 1))
        if not lists.flatten().null_count:
            return t, whole
        # a vector with a null component has no score
        fit = ~np.asarray(pc.is_null(lists.flatten())).reshape(len(t), -1).any(axis=1)
        return t.filter(pa.array(fit)), whole[fit]

    vectors, v = matrix(vectors, "vector")
    queries, q = matrix(queries, "q")
    rows, hits, scores = [], [], []
    if len(v) and len(q):
        place = np.empty(len(v), dtype=np.int64)
        place[np.asarray(pc.sort_indices(vectors["target_id"], sort_keys=[("", "ascending")], null_placement="at_start"))] = np.arange(len(v))
        with np.errstate(all="ignore"):
            longest, width = np.sqrt((v * v).sum(axis=1).max()), max(1, 2**21 // len(v))
            for at in range(0, len(q), width):
                some = q[at : at + width]
                near = some @ v.T
                near[np.isnan(near)] = np.inf
                least = np.partition(near, -k, axis=1)[:, -k] if k < len(v) else np.full(len(some), -np.inf)
                slack = 2e-6 + 1e-12 * longest * np.sqrt((some * some).sum(axis=1))
                least = np.maximum(least, 0) - slack
                least[np.isnan(least)] = -np.inf
                i, j = np.nonzero(near >= least[:, None])
                exact = np.zeros(len(i))
                for d in range(v.shape[1]):
                    exact = exact + v[j, d] * some[i, d]
                exact = _rounded(exact)
                high = np.isnan(exact) | (exact > 0)
                i, j, exact = i[high], j[high], exact[high]
                order = np.lexsort((place[j], -exact, ~np.isnan(exact), i))
                i, j, exact = i[order], j[order], exact[order]
                first = np.searchsorted(i, i) if len(i) else i
                top = np.arange(len(i)) - first < k
                rows.append(at + i[top]), hits.append(j[top]), scores.append(exact[top])
    join = lambda xs, kind: np.concatenate(xs) if xs else np.zeros(0, dtype=kind)
    return pa.table({"query": queries["query"].take(pa.array(join(rows, np.int64))), "target_id": vectors["target_id"].take(pa.array(join(hits, np.int64))), "score": pa.array(join(scores, np.float64))})


def _rounded(x: np.ndarray) -> np.ndarray:
    """To six places, halves away from zero by the number's decimal digits, as Spark's round."""
    scaled = x * 1e6
    out = np.floor(scaled + 0.5) / 1e6
    near = np.abs(scaled - np.floor(scaled) - 0.5) < 1e-4
    odd = np.isfinite(x) & (near | (np.abs(scaled) > 1e9) | (x < 0))
    out[odd] = [float(Decimal(repr(float(y))).quantize(Decimal("0.000001"), ROUND_HALF_UP, CONTEXT)) for y in x[odd]]
    return np.where(np.isfinite(x), out, x)
