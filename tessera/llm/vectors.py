"""Vectors in blocks: index blocks and query blocks that meet pair by pair, and the merge of what each pair found.

Vectors take part if id and vector are not null, the vector is not empty and no component is null or non-finite.
Only vectors of one length are compared. Blocks are dealt by a hash of the id, so any order of the table will do. They
are files in the shared folder, and what is joined are their names: no vector passes through the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import keep, open_file, scratch, trimmed

FOUND = "query_part int, dim int, place int, query_id long, vec_id long, score double"


def sound(df: DataFrame, id_column: str, vector: str, zero: bool = True) -> DataFrame:
    """(id, v) of the vectors that take part; zero: whether null vectors' kin, those of all zeros, do too."""
    v = F.col("v")
    out = df.select(F.col(id_column).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0))
    out = out.where(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    return out if zero else out.where(F.exists(v, lambda x: x != 0))


def blocks(vectors: DataFrame, n: int, build: Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]]) -> DataFrame:
    """(part, dim, path): the vectors of each of n parts, a file for each length with their ids and the arrays that build
    makes; loaded() reads it."""
    folder = scratch(vectors.sparkSession)

    def work(batches):
        ids, rows = [], []
        for b in batches:
            ids.append(b.column(0).to_numpy(zero_copy_only=False))
            lengths = np.diff(b.column(1).offsets.to_numpy())
            rows.append((lengths, b.column(1).flatten().to_numpy(zero_copy_only=False)))
        if not ids:
            return
        ids, lengths, flat = np.concatenate(ids), np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
        starts = np.cumsum(lengths) - lengths
        for dim in np.unique(lengths):
            at = np.flatnonzero(lengths == dim)
            at = at[np.argsort(ids[at], kind="stable")]
            matrix = flat[starts[at][:, None] + np.arange(dim)]
            task = TaskContext.get()
            name, mark = f"{folder}/part-{task.partitionId():06d}-{dim}.arrow", f".{task.taskAttemptId()}.tmp"
            store, path, sink = open_file(name + mark, True)
            write(sink, {"ids": ids[at].astype("<i8")} | build(ids[at], matrix))
            sink.close()
            store.move(path, path[: -len(mark)])
            yield pa.RecordBatch.from_pylist([{"part": task.partitionId(), "dim": int(dim), "path": name}], schema=schema)

    schema = pa.schema([("part", pa.int32()), ("dim", pa.int32()), ("path", pa.string())])
    return keep(vectors.repartition(n, "id").mapInArrow(trimmed(work), "part int, dim int, path string"))


def write(sink, arrays: dict[str, np.ndarray]) -> None:
    """Arrays into an open file, one after the other and without copies; loaded() reads them."""
    schema = pa.schema([("name", pa.string()), ("kind", pa.string()), ("data", pa.large_binary())])
    with pa.ipc.new_stream(sink, schema) as out:
        for name, array in arrays.items():
            array = np.ascontiguousarray(array)
            bounds, data = np.array([0, array.nbytes], np.int64), array.reshape(-1).view(np.uint8)
            column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), 1, [None, pa.py_buffer(bounds), pa.py_buffer(data)])
            out.write_batch(pa.record_batch([pa.array([name]), pa.array([" ".join([array.dtype.str, *map(str, array.shape)])]), column], schema=schema))


def loaded(path: str) -> dict[str, np.ndarray]:
    """The arrays of a file; of a local file they are views of the mapped file, which all workers share."""
    out = {}
    with pa.ipc.open_stream(open_file(path, False)[2]) as batches:
        for b in batches:
            kind, *shape = b.column(1)[0].as_py().split()
            out[b.column(0)[0].as_py()] = np.frombuffer(b.column(2)[0].as_buffer(), kind).reshape([int(x) for x in shape])
    return out


def search(vectors: DataFrame, is_query: Column, k: int, build, scan, nearest_first: bool, block_rows: int = 8192, query_rows: int = 256, run: int = 0) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best rows but its own, ties to the smaller vec_id.

    scan(ids, payload, query_ids, query_matrix) gives arrays (query position, vec_id, score) with the k best of one
    index block at least. Every query block meets every index block in the index block's task; a block holds block_rows or
    query_rows vectors, and of a pair only k rows a query go on. Query rows that share an id are queries of their own.

    With run, a task takes one query block through run index blocks or more (so that there are 10,000 tasks at most), and
    scan is also given each query's k-th best score of the blocks before (infinitely bad if they gave fewer): rows that are
    worse needn't be among what it gives. Query blocks are then smaller where there would be fewer than two a core.
    """
    vectors = keep(vectors)
    n, n_queries = vectors.count(), vectors.where(is_query).count()
    parts = max(1, math.ceil(n / block_rows))
    index = blocks(vectors, parts, build)
    if run:
        query_rows = min(query_rows, max(32, math.ceil(n_queries / (2 * vectors.sparkSession.sparkContext.defaultParallelism))))
    # names of files, one for query_rows queries
    query_parts = max(1, math.ceil(n_queries / query_rows))
    asked = blocks(vectors.where(is_query), query_parts, lambda ids, m: {"m": m})
    asked = F.broadcast(asked.select("dim", F.col("part").alias("query_part"), F.col("path").alias("query_path")))
    sign = 1 if nearest_first else -1

    def cut(query_ids, at, ids, score):
        own = ids != query_ids[at]
        at, ids, score = at[own], ids[own], score[own]
        order = np.lexsort((ids, sign * score, at))
        at, ids, score = at[order], ids[order], score[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        return tuple(x[place < k] for x in (at, ids, score, place))

    def batch(r, query_ids, at, ids, score):
        whose = [pa.array(np.full(len(at), r[x]), pa.int32()) for x in ("query_part", "dim")]
        return pa.RecordBatch.from_arrays([*whose, pa.array(at, pa.int32()), pa.array(query_ids[at], pa.int64()), pa.array(ids, pa.int64()), pa.array(score.astype(float), pa.float64())], names=[c.split()[0] for c in FOUND.split(", ")])

    def work(batches):
        path = payload = None
        for b in batches:
            for r in b.to_pylist():
                if r["path"] != path:
                    path, payload = r["path"], loaded(r["path"])
                queries = loaded(r["query_path"])
                query_ids = queries["ids"]
                at, ids, score, _ = cut(query_ids, *scan(payload["ids"], payload, query_ids, queries["m"]))
                yield batch(r, query_ids, at, ids, score)

    def in_turn(batches):
        last = None
        for b in batches:
            for r in b.to_pylist():
                if last is None or r["query_path"] != last["query_path"]:
                    if last is not None:
                        yield batch(last, query_ids, *best)
                    queries = loaded(r["query_path"])
                    query_ids = queries["ids"]
                    best, bound = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), np.full(len(query_ids), sign * np.inf)
                last, payload = r, loaded(r["path"])
                more = scan(payload["ids"], payload, query_ids, queries["m"], bound)
                *best, place = cut(query_ids, *(np.concatenate(x) for x in zip(best, more, strict=True)))
                bound[best[0][place == k - 1]] = best[2][place == k - 1]
        if last is not None:
            yield batch(last, query_ids, *best)

    pairs = index.join(asked, "dim")
    if run:
        runs = math.ceil(parts / max(run, math.ceil(parts * query_parts / 10_000)))
        # equal runs of index blocks
        task = F.col("query_part") * runs + F.floor(F.col("part") * runs / parts).cast("int")
        pairs = pairs.repartitionById(query_parts * runs, task).sortWithinPartitions("query_path", "path")
    else:
        pairs = pairs.repartitionById(parts, F.col("part")).sortWithinPartitions("path", "query_path")
    found = pairs.select("path", "query_path", "query_part", "dim").mapInArrow(trimmed(in_turn if run else work), FOUND)
    best = Window.partitionBy("query_id", "query_part", "dim", "place").orderBy(F.col("score").asc() if nearest_first else F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
