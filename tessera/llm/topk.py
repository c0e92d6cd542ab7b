"""Exact top-k by aggregation of sorted lists without random access."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.vectors import search, sound


def sorted_lists(values: np.ndarray) -> dict[str, np.ndarray]:
    """Per component the rows by falling value: `order` (component by depth), and each row's depth in each list."""
    order = np.argsort(-values.T, 1, kind="stable").astype(np.int32)
    depth = np.empty_like(order)
    np.put_along_axis(depth, order, np.arange(len(values), dtype=np.int32)[None, :].repeat(values.shape[1], 0), 1)
    return {"m": values, "order": order, "depth": depth.T}


#: Shares of the lists after which bounds are drawn.
DEPTHS = (1 / 8, 1 / 4, 3 / 8, 1 / 2, 9 / 16, 5 / 8, 11 / 16, 3 / 4, 13 / 16, 7 / 8, 29 / 32, 15 / 16, 1)


class Reading:
    """What was read of how many list entries, and how many rows were resolved."""

    def __init__(self):
        self.entries = self.of = self.resolved = self.queries = 0


def no_random_access(lists: dict[str, np.ndarray], queries: np.ndarray, k: int, reading: Reading | None = None, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query position, row, score) with the k best inner products of each query at least, and all that tie with the last;
    of rows that score below the query's entry in `least`, any may be missing.

    A component with positive weight is read from the top of its list, one with negative weight from the bottom, in slices;
    each entry adds to what is known of its row. After a slice a row's score lies between what is known and the least, and
    the most, that its unread components can add: the list's last value, and the value where reading stands. Rows whose
    upper bound is below the k-th lower bound, or below `least`, are out. Reading stops when so few rows are left that
    looking up their unread components is less work; their scores are then resolved. As queries need about the same depth,
    a query's first slice ends one stop before the depth that the last query needed. Products are of integers below 2**53,
    exact in double precision; beyond, bounds give way by more than their rounding.
    """
    values, depth, order = lists["m"].astype(float, copy=False), lists["depth"], lists["order"].astype(np.intp)
    (rows, width), reading, out, first = values.shape, reading or Reading(), [], 0
    few = max(4 * k, rows // 64)
    by_rank = np.take_along_axis(np.ascontiguousarray(values.T), order, 1)
    # each list from its top, and each from its bottom
    order, by_rank = np.concatenate([order, order[:, ::-1]]), np.concatenate([by_rank, by_rank[:, ::-1]])
    largest = np.abs(by_rank[:, 0]).reshape(2, width).max(0)
    stops = sorted({min(rows, max(1, round(rows * d))) for d in DEPTHS})
    for i, q in enumerate(queries.astype(float)):
        used = np.flatnonzero(q)
        weight, up = q[used], q[used] > 0
        side = used + width * ~up
        # what an unread component can add at least
        low = by_rank[side, -1] * weight
        # sums that are no longer exact may be off by this
        slack = 2.0**-40 * (np.abs(weight) @ largest[used])

        def unread_by(left, to, used=used, up=up):
            here = depth[left][:, used]
            return np.where(up, here >= to, here < rows - to).astype(float)

        bound, left, known, at = -np.inf if least is None else least[i], np.arange(rows), None, 0
        for n, to in enumerate(stops[first:], first):
            seen, found = order[side, at:to].ravel(), by_rank[side, at:to]
            found *= weight[:, None]
            reading.entries, at = reading.entries + len(seen), to
            # and at most
            most = by_rank[side, to - 1] * weight
            lower = None
            if known is None:
                # all rows: the sum over all components, and for each that was read what it differs by
                if bound == -np.inf:
                    lower = low.sum() + np.bincount(seen, (found - low[:, None]).ravel(), minlength=rows)
                found -= most[:, None]
                upper = most.sum() + np.bincount(seen, found.ravel(), minlength=rows)
            else:
                known += np.bincount(seen, found.ravel(), minlength=rows)
                unread = unread_by(left, to)
                upper, lower = known[left] + unread @ most, known[left] + unread @ low
            if lower is not None and k < len(left):
                bound = max(bound, np.partition(lower, len(lower) - k)[len(lower) - k])
            stay = upper >= bound - slack
            left, upper = left[stay], upper[stay]
            if len(left) <= few or to == rows:
                break
            if known is None:
                known = np.zeros(rows)
                known[left] = upper - unread_by(left, to) @ most
        first = max(0, n - 1)
        reading.of, reading.resolved, reading.queries = reading.of + rows * len(used), reading.resolved + len(left), reading.queries + 1
        out.append((np.full(len(left), i), left, values[left] @ q))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, int),) * 3


def top_products(df: DataFrame, id_column: str, vector: str, is_query: Column, k: int = 10, scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score (long): each query's k highest inner products of floor(scale * component).

    Every index block keeps its components as sorted lists, read by no_random_access(), 64 blocks or more one after the
    other: a query's k-th best score so far is the bound that the next block starts with. What the runs of blocks give is
    merged. One more than k is asked of a block because the query's own row is no candidate. Null and empty vectors and those
    with null or non-finite components take no part, nor do null ids; zero vectors do; ties go to the smaller vec_id;
    fewer rows than k give all; rows that share a vec_id are rows of their own, as queries too, and rows with a query's own
    id are no candidates; other columns, of any name, are left alone; an empty table gives no rows.
    """
    vectors = sound(df, id_column, vector).withColumn("v", F.transform("v", lambda x: F.floor(x * float(scale)).cast("double")))

    def scan(ids, payload, query_ids, queries, least):
        own = 1 + max(np.unique(ids, return_counts=True)[1].max(initial=1) - 1, 0)
        at, row, score = no_random_access(payload, queries, k + int(own), least=least)
        return at, ids[row], score

    found = search(vectors, is_query, k, lambda ids, m: sorted_lists(m), scan, nearest_first=False, block_rows=4096, run=64)
    return found.withColumn("score", F.col("score").cast("long"))
