"""Approximate nearest neighbours by a permutation index: vectors as ordered nearest pivots, in pivot inverted files."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.vectors import search, sound


def nearest_pivots(matrix: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """Each vector's `length` nearest pivots, nearest first, ties to the earlier pivot."""
    out, length = np.empty((len(matrix), min(length, len(pivots))), np.int32), min(length, len(pivots))
    square = (pivots**2).sum(1)
    for at in range(0, len(matrix), 1024):
        d = square[None] - 2 * matrix[at : at + 1024] @ pivots.T
        last = np.partition(d, length - 1, 1)[:, length - 1 : length]
        for i, row in enumerate(d):
            near = np.flatnonzero(row <= last[i])
            out[at + i] = near[np.argsort(row[near], kind="stable")][:length]
    return out


def postings(orders: np.ndarray, n_pivots: int) -> dict[str, np.ndarray]:
    """Pivot inverted files: for each pivot the rows that have it among their nearest, and its rank there."""
    rows, length = orders.shape
    pivot, by = orders.ravel(), np.argsort(orders.ravel(), kind="stable")
    return {"starts": np.searchsorted(pivot[by], np.arange(n_pivots + 1)).astype(np.int64), "rows": (by // length).astype(np.int32), "ranks": (by % length).astype(np.int16)}


def footrule(lists: dict[str, np.ndarray], order: np.ndarray, rows: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows in the lists of a query's pivots, and their footrule distances to its order; a pivot that one of the two
    lacks counts as ranked just past the end. Rows in none of the lists are as far as rows can be."""
    starts, posted, ranks = lists["starts"], lists["rows"], lists["ranks"]
    spans = [slice(starts[p], starts[p + 1]) for p in order.tolist()]
    at = np.concatenate([posted[s] for s in spans])
    places = np.repeat(np.arange(len(order)), [s.stop - s.start for s in spans])
    rank = np.concatenate([ranks[s] for s in spans]).astype(np.int64)
    gain = 2 * length - rank - places - np.abs(rank - places)
    near = np.bincount(at, gain, minlength=rows)
    seen = np.flatnonzero(near)
    return seen, 2 * int((length - np.arange(len(order))).sum()) - near[seen]


def first_by_hash(vectors: DataFrame, n: int, seed: int) -> list:
    """The n rows of (id, v) first in a seeded hash order. Only rows below a bound on the hash are sorted, about twice as
    many as asked for, so no task sends the driver n rows of its own."""
    total, hashed = vectors.count(), vectors.withColumn("h", F.xxhash64(F.lit(seed), "id"))
    share = 2 * n / max(total, 1)
    while True:
        some = hashed.where(F.col("h") < int(share * 2**64) - 2**63) if share < 1 else hashed
        rows = some.orderBy("h", "id").limit(n).select("id", "v").collect()
        if share >= 1 or len(rows) == n:
            return rows
        share *= 2


def nearest(df: DataFrame, id_column: str, vector: str, is_query: Column, k: int = 10, n_pivots: int = 2048, length: int = 64, rerank: float = 0.12, least: int = 256, sample: int = 8192, seed: int = 7) -> DataFrame:
    """query_id, rank, vec_id, score: for each query (is_query speaks of column id) its k nearest rows found, score Euclidean.

    Pivots are the n_pivots rows first in a seeded hash order of the ids, among at most `sample` read to the driver;
    every row is indexed, by its `length` nearest pivots. In each block of the index the rows that share pivots with the
    query are ranked by footrule distance, and the nearest, a share `rerank` of the block's rows at most (but at least
    `least`, and all that tie with the last), are measured on the original vectors in double precision; where too few
    share a pivot, all rows are. Null, empty and zero vectors and those with null or non-finite components take no part,
    nor do null ids; fewer rows than k give all; ties go to the smaller vec_id; rows with the query's own id are left
    out; rows that share a vec_id are rows of their own, as queries too; other columns, of any name, are left alone; an
    empty table gives no rows.
    """
    vectors = sound(df, id_column, vector, zero=False)
    rows = first_by_hash(vectors, min(sample, 4 * n_pivots), seed)
    dims: dict[int, list] = {}
    for r in rows:
        dims.setdefault(len(r.v), []).append(r.v)
    pivots = {d: np.unique(np.array(v), axis=0) for d, v in dims.items()}
    pivots = {d: v[np.random.default_rng(seed).permutation(len(v))[:n_pivots]] for d, v in pivots.items()}

    def of(dim: int) -> np.ndarray:  # a rare length that the sample lacks has one pivot, so all its rows tie and are measured
        return pivots.get(dim, np.zeros((1, dim)))

    def build(ids, matrix):
        p = of(matrix.shape[1])
        return {"m": matrix} | postings(nearest_pivots(matrix, p, length), len(p))

    def scan(ids, payload, query_ids, queries):
        matrix, n = payload["m"], len(ids)
        take = min(n, max(least, int(np.ceil(rerank * n))))
        at, rows, score = [], [], []
        p = of(matrix.shape[1])
        for i, order in enumerate(nearest_pivots(queries, p, length)):
            seen, far = footrule(payload, order, n, len(order))
            near = seen[far <= np.partition(far, take - 1)[take - 1]] if take < len(seen) else seen
            if len(near) < min(n, least):
                near = np.arange(n)
            d = np.sqrt(((matrix[near] - queries[i]) ** 2).sum(1))
            d[ids[near] == query_ids[i]] = np.inf
            best = np.flatnonzero(d <= np.partition(d, min(k, len(d)) - 1)[min(k, len(d)) - 1])
            at.append(np.full(len(best), i))
            rows.append(ids[near[best]])
            score.append(d[best])
        return np.concatenate(at), np.concatenate(rows), np.concatenate(score)

    return search(vectors, is_query, k, build, scan, nearest_first=True)
