"""Packing documents into windows of fixed length: sum-of-squares online packing over a level array."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.encoding import RUN, encoder
from tessera.llm.exchange import slices

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class LevelArray:
    """Open windows by fill level; place() puts an item where the sum of squared level counts ends up smallest."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, np.int64)
        self.open: list[list] = [[] for _ in range(capacity + 1)]

    def place(self, size: int):
        """The window that the item goes to, taken off its level, or None for a new one; ties to the fullest."""
        count, last = self.count, self.capacity - size
        # what the sum of squares changes by: the level left loses one, the level reached gains one; a full window has no level
        gain = 2 * (count[size : self.capacity + 1] - count[: last + 1]) + 2
        gain[0] = 2 * count[size] + 1
        gain[last] = 1 - 2 * count[last]
        gain[1:][count[1 : last + 1] == 0] = np.iinfo(np.int64).max
        if last == 0:
            gain[0] = 0
        level = last - int(np.argmin(gain[::-1]))
        if level == 0:
            return None
        self.count[level] -= 1
        return self.open[level].pop()

    def put(self, window, fill: int) -> None:
        if fill < self.capacity:
            self.count[fill] += 1
            self.open[fill].append(window)

    def drain(self) -> list:
        """The windows still open, fullest first."""
        return [w for level in reversed(self.open) for w in level]


def pack(items: Iterator[tuple[int, bytes]], capacity: int, first: int = 0) -> Iterator[tuple]:
    """Rows of SCHEMA for (doc_id, ids as little-endian 32-bit) items; sequence ids count up from first.

    A document longer than the capacity gives full windows; its rest is placed by LevelArray. What is partly filled
    at the end is joined by cutting the emptiest windows' pieces, and the one window then left is cut into lengths
    that are powers of two, which need no padding. Only partly filled windows are held in memory.
    """
    levels, sequence = LevelArray(capacity), first

    def row(piece, number: int, offset: int):
        doc, start, ids, tokens = piece
        return doc, start, len(ids) // 4, zlib.crc32(ids), tokens, number, offset

    for doc, ids in items:
        tokens = len(ids) // 4
        for start in range(0, tokens - tokens % capacity, capacity):
            yield row((doc, start, ids[4 * start : 4 * (start + capacity)], tokens), sequence, 0)
            sequence += 1
        rest = tokens % capacity
        if not rest:
            continue
        window = levels.place(rest)
        if window is None:
            window = [sequence, 0, []]
            sequence += 1
        window[2].append((doc, tokens - rest, ids[4 * (tokens - rest) :], tokens))
        window[1] += rest
        if window[1] == capacity:
            offset = 0
            for piece in window[2]:
                yield row(piece, window[0], offset)
                offset += len(piece[2]) // 4
        else:
            levels.put(window, window[1])

    left = levels.drain()
    spare = [p for w in left for p in w[2]]  # fullest windows first, so that the emptiest are the ones cut
    total = sum(len(p[2]) // 4 for p in spare)
    lengths = [capacity] * (total // capacity) + [1 << b for b in reversed(range(capacity.bit_length())) if (total % capacity) >> b & 1]
    spare.reverse()
    for length in lengths:
        offset = 0
        while offset < length:
            doc, start, ids, tokens = spare.pop()
            n = min(len(ids) // 4, length - offset)
            yield row((doc, start, ids[: 4 * n], tokens), sequence, offset)
            if 4 * n < len(ids):
                spare.append((doc, start + n, ids[4 * n :], tokens))
            offset += n
        sequence += 1


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1) -> DataFrame:
    """All docs (doc_id, text) as pieces of sequences of at most `capacity` tokens; see SCHEMA.

    Each scan partition is encoded and packed where it is read: nothing is shuffled, and a lost task is repeated with
    the same result. A document is its ids and end_id; null and empty texts are end_id alone; rows with the same
    doc_id are documents of their own; a null doc_id stays null; an empty table gives none. sequence_id is unique,
    not gapless. Other columns are left alone.
    """

    def work(batches):
        code, tail = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        first = TaskContext.get().partitionId() << 36

        def items():
            for part in (p for b in batches for p in slices(b, RUN)):
                for doc, ids in zip(part.column(0).to_pylist(), code.all_ids(part.column(1).to_pylist()), strict=True):
                    yield doc, ids + tail

        rows = []
        for r in pack(items(), capacity, first):
            rows.append(r)
            if len(rows) == 20_000:
                yield batch(rows)
                rows = []
        yield batch(rows)

    def batch(rows):
        columns = list(zip(*rows, strict=True)) or [()] * 7
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, SCHEMA)
