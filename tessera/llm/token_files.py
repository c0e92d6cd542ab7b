"""Token ids in Arrow stream files of fixed-size-list batches: equal-length sequences and masks, read without copying."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.encoding import encoder
from tessera.llm.shared import keep, open_file, partitions, scratch

INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def ids_schema(length: int, dtype: pa.DataType) -> pa.Schema:
    return pa.schema([("ids", pa.list_(dtype, length)), ("mask", pa.list_(pa.bool_(), length))])


class TokenFileWriter:
    """Writes documents' ids, end to end, as rows of `length` ids; the last row is padded with 0 and masked out.

    Beside the ids file stands an index file of one row a document: where its ids start and how many they are.
    """

    def __init__(self, sink, index_sink, length: int, wide: bool, rows_a_batch: int = 256):
        self.length, self.rows, self.type = length, rows_a_batch, np.dtype("<u4" if wide else "<u2")
        self.arrow = pa.uint32() if wide else pa.uint16()
        self.out = pa.ipc.new_stream(sink, ids_schema(length, self.arrow))
        self.index = pa.ipc.new_stream(index_sink, INDEX)
        self.held, self.n_held, self.total, self.entries = [], 0, 0, []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n = len(ids) // 4
        self.entries.append((doc_id, self.total, n))
        self.held.append(np.frombuffer(ids, "<u4").astype(self.type))
        self.n_held += n
        self.total += n
        if self.n_held >= self.length * self.rows:
            self._flush(False)
        if len(self.entries) >= 10_000:
            self._entries()

    def _entries(self) -> None:
        columns = list(zip(*self.entries, strict=True)) or [()] * 3
        self.index.write_batch(pa.record_batch([pa.array(c, pa.int64()) for c in columns], schema=INDEX))
        self.entries = []

    def _flush(self, last: bool) -> None:
        flat = np.concatenate([*self.held, np.zeros(0, self.type)])
        n = len(flat) if last else len(flat) - len(flat) % self.length
        rest = flat[n:]
        padded = -(-n // self.length) * self.length
        values = np.zeros(padded, self.type)
        values[:n] = flat[:n]
        for at in range(0, padded, self.length * self.rows):
            part = values[at : at + self.length * self.rows]
            mask = np.arange(at, at + len(part)) < n
            self.out.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(part, self.arrow), self.length), pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length)], schema=self.out_schema))
        self.held, self.n_held = [rest], len(rest)

    @property
    def out_schema(self) -> pa.Schema:
        return ids_schema(self.length, self.arrow)

    def close(self) -> None:
        self._flush(True)
        self._entries()
        self.out.close()
        self.index.close()


class TokenFile:
    """A written file: row(i) and document(i) are views of the file's own buffers."""

    def __init__(self, source, index_source):
        table = pa.ipc.open_stream(source).read_all()
        self.length = table.schema.field("ids").type.list_size
        self.ids, self.mask = table.column("ids"), table.column("mask")
        self.starts = np.cumsum([0, *(len(c) * self.length for c in self.ids.chunks)])
        self.flat = [c.flatten().to_numpy(zero_copy_only=True) for c in self.ids.chunks]
        self.index = pa.ipc.open_stream(index_source).read_all()

    def slice(self, start: int, n: int) -> np.ndarray:
        """Ids start to start + n of the file; copied only where they cross from one batch into the next."""
        k = int(np.searchsorted(self.starts, start, "right")) - 1
        parts = []
        while n > 0:
            at = start - int(self.starts[k])
            parts.append(self.flat[k][at : at + n])
            n -= len(parts[-1])
            start += len(parts[-1])
            k += 1
        return parts[0] if len(parts) == 1 else np.concatenate([*parts, np.zeros(0, np.uint32)])

    def row(self, i: int) -> np.ndarray:
        return self.slice(i * self.length, self.length)


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int = 2, length: int = 2048, folder: str | None = None) -> DataFrame:
    """Encodes every whole text and writes the ids, documents in ascending doc_id order over all files.

    Returns one row a file: part, path, index_path, n_docs, n_tokens. Files are written under a name of the attempt
    and moved into place, so a repeated or speculative task leaves one whole file. Null texts are empty: their ids
    are end_id alone. Null doc_ids come first; equal doc_ids are ordered by text. An empty table gives no rows.
    """
    folder = folder or scratch(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = partitions(slim)

    def work(batches):
        code, tail = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        task, writer, n_docs = TaskContext.get(), None, 0
        name, mark = f"{folder}/ids-{task.partitionId():06d}", f".{task.taskAttemptId()}.tmp"
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if writer is None:
                    store, at, sink = open_file(f"{name}.arrow{mark}", True)
                    _, index_at, index_sink = open_file(f"{name}.index{mark}", True)
                    writer = TokenFileWriter(sink, index_sink, length, code.size > 1 << 16)
                writer.add(doc, code.ids(text.as_py()) + tail)
                n_docs += 1
        if writer is not None:
            writer.close()
            sink.close()
            index_sink.close()
            for x in (at, index_at):
                store.move(x, x[: -len(mark)])
            yield pa.RecordBatch.from_pylist([{"part": task.partitionId(), "path": f"{name}.arrow", "index_path": f"{name}.index", "n_docs": n_docs, "n_tokens": writer.total}])

    ordered = slim.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    return keep(ordered.mapInArrow(work, "part long, path string, index_path string, n_docs long, n_tokens long"))


def read_token_files(files: DataFrame) -> DataFrame:
    """Per document of write_token_files()'s files, from the files alone: doc_id, start (over all files), n_tokens, ids_crc32 (of 32-bit ids)."""
    based = files.withColumn("base", F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]

    def work(batches):
        for b in batches:
            for r in b.to_pylist():
                file = TokenFile(open_file(r["path"], False)[2], open_file(r["index_path"], False)[2])
                for part in file.index.to_batches(max_chunksize=20_000):
                    doc, start, n = part.column(0), part.column(1).to_numpy(), part.column(2).to_numpy()
                    sums = [zlib.crc32(file.slice(a, c).astype("<u4").tobytes()) for a, c in zip(start.tolist(), n.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([doc, pa.array(start + r["base"]), pa.array(n), pa.array(sums, pa.int64())], names=names)

    return based.repartition(max(1, partitions(files))).mapInArrow(work, "doc_id long, start long, n_tokens long, ids_crc32 long")
