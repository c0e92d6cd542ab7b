"""Postings of documents dealt to buckets and verdicts dealt back to cells of documents, as packed columns.

A bucket is a range of a hash, a cell a hash class of doc_id; both grow in number with the data, so each fits a task.
Packed columns cost the shuffle a row a (task, bucket) instead of a row a posting. What a task can already settle among
its own postings it folds: of equal things in many documents it posts those of its smallest doc_id, and sends its
verdicts on the others along. So a thing that a third of all documents hold arrives as a few postings a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import cell, cell_of, mix64, text_bytes, trimmed

Columns = dict[str, np.ndarray]


def bucket_of(hashed: np.ndarray, n: int) -> np.ndarray:
    """Scrambled first: anchors are the lowest of many hashes, and not spread evenly as they are."""
    return ((mix64(hashed) >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int32)


def dealt(columns: Columns, to: np.ndarray, key: str, kinds: dict[str, str]) -> pa.RecordBatch:
    """One row for each value of `to`: the value, and each column's entries there as little-endian bytes."""
    order = np.argsort(to, kind="stable")
    keys, first = np.unique(to[order], return_index=True)
    bounds = [*first.tolist(), len(to)]
    arrays = [pa.array(keys, pa.int32())]
    for name, kind in kinds.items():
        values = np.ascontiguousarray(columns[name][order], kind)
        data, width = values.tobytes(), values.dtype.itemsize
        arrays.append(pa.array([data[a * width : b * width] for a, b in zip(bounds, bounds[1:])], pa.binary()))
    return pa.RecordBatch.from_arrays(arrays, names=[key, *kinds])


def gathered(batches, kinds: dict[str, str]) -> Columns:
    """All rows' packed columns, end to end."""
    parts: dict[str, list[bytes]] = {name: [] for name in kinds}
    for b in batches:
        for name in kinds:
            parts[name] += [x.as_buffer() for x in b.column(b.schema.get_field_index(name)) if x.is_valid]
    return {name: np.frombuffer(b"".join(parts[name]), kind) for name, kind in kinds.items()}


def schema_of(key: str, kinds: dict[str, str]) -> str:
    return f"{key} int, " + ", ".join(f"{k} binary" for k in kinds)


def joined(parts: list[Columns], kinds: dict[str, str]) -> Columns:
    """Columns of several parts, end to end."""
    return {k: np.concatenate([np.zeros(0, kind), *(p[k] for p in parts)]).astype(kind, copy=False) for k, kind in kinds.items()}


def _sure(kinds: dict[str, str]) -> dict[str, str]:
    return {f"sure_{k}": v for k, v in kinds.items()}


def post(docs: DataFrame, n: int, kinds: dict[str, str], hash_name: str, postings: Callable, most: int = 800_000, per_task: Callable | None = None, fold: Callable[[Columns], tuple[Columns, Columns]] | None = None, verdicts: dict[str, str] | None = None) -> DataFrame:
    """(bucket, packed columns): what postings(bytes, offsets, doc_ids) yields for the texts, dealt by column hash_name.

    With per_task, postings is what makes that function from a per_task() of each task's own. fold(postings) gives the
    postings that are left to settle and the verdicts that are sure already; those ride along to settle(), spread over
    the buckets by doc_id.
    """
    sure = _sure(verdicts) if fold else {}

    def work(batches):
        each = postings(per_task()) if per_task else postings
        held: list[Columns] = []
        size = 0

        def flush():
            columns = {k: np.concatenate([h[k] for h in held]) for k in kinds}
            if not fold:
                yield dealt(columns, bucket_of(columns[hash_name], n), "bucket", kinds)
                return
            columns, found = fold(columns)
            if len(found["doc"]):
                columns |= {f"sure_{k}": found[k] for k in verdicts}
            for names, to in ((kinds, columns[hash_name]), (sure, found["doc"])):
                if len(to):
                    part = dealt(columns, bucket_of(to.astype(np.int64).view(np.uint64) if names is sure else to, n), "bucket", names)
                    empty = pa.nulls(part.num_rows, pa.binary())
                    arrays = [part.column(part.schema.get_field_index(k)) if k in names else empty for k in (*kinds, *sure)]
                    yield pa.RecordBatch.from_arrays([part.column(0), *arrays], names=["bucket", *kinds, *sure])

        for b in batches:
            for part in slices(b):
                data, offsets = text_bytes(part.column(1))
                for columns in each(data, offsets, part.column(0).to_numpy(zero_copy_only=False)):
                    held.append(columns)
                    size += len(columns[hash_name])
                    if size >= most:
                        yield from flush()
                        held, size = [], 0
        if size:
            yield from flush()

    slim = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(trimmed(work), schema_of("bucket", kinds | sure))


def slices(batch: pa.RecordBatch, bytes_each: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about bytes_each of text each; one long text is a run of its own."""
    if batch.nbytes <= bytes_each:
        yield batch
        return
    lengths = np.array([len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(1)], np.int64)
    run = (np.cumsum(lengths) - lengths) // bytes_each
    bounds = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), batch.num_rows]
    for a, b in zip(bounds, bounds[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def settle(posted: DataFrame, n: int, kinds: dict[str, str], judge: Callable[[Columns], Columns | None], out: dict[str, str], key: str, deal: Callable[[Columns], np.ndarray]) -> DataFrame:
    """(key, packed columns): the verdicts judge(all postings of a bucket) and those that rode along, dealt by deal()."""
    sure = _sure(out)
    rode = set(sure) <= set(posted.columns)

    def work(batches):
        by: dict[int, list] = {}
        for b in batches:
            for i, k in enumerate(b.column(0).to_pylist()):
                by.setdefault(k, []).append(b.slice(i, 1))
        for parts in by.values():
            c = gathered(parts, kinds)
            found = [judge(c) if len(c[next(iter(kinds))]) else None]
            if rode:
                came = gathered(parts, sure)
                found.append({k: came[f"sure_{k}"] for k in out})
            parts.clear()
            found = joined([f for f in found if f is not None], out)
            if len(found[next(iter(out))]):
                yield dealt(found, deal(found), key, out)

    return posted.repartitionById(n, F.col("bucket")).mapInArrow(trimmed(work), schema_of(key, out))


def meet(docs: DataFrame, verdicts: DataFrame, n: int, kinds: dict[str, str], work: Callable[[pa.Table, Columns], pa.Table], schema: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """work(documents of a cell, all verdicts of that cell) for each of n cells that has documents; rows without doc_id
    have no verdicts and are left out. Columns to carry come along as one, `carried`."""
    celled = docs.where(F.col("doc_id").isNotNull()).select(cell(F.col("doc_id"), n).alias("cell"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *([F.struct(*carry).alias("carried")] if carry else []))

    def group(left: pa.Table, right: pa.Table) -> pa.Table:
        return work(left, gathered(right.to_batches(), kinds))

    return celled.groupBy("cell").cogroup(verdicts.groupBy("cell")).applyInArrow(group, schema)


def cells(doc_ids: np.ndarray, n: int) -> np.ndarray:
    return cell_of(doc_ids, n)
