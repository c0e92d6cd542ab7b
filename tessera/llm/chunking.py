"""Removal of repeated text by content-defined chunks: gear hash cuts, chunks told apart by digest."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm import exchange
from tessera.llm.repeats import KEPT, cut, rows_of, with_unnamed
from tessera.llm.shared import keep, mix64, partitions

CHUNKS = {"hash": "<u8", "low": "<u8", "doc": "<i8", "pos": "<i4", "length": "<i4"}
VERDICTS = {"doc": "<i8", "pos": "<i4", "length": "<i4"}
GEAR = (mix64(np.arange(256, dtype=np.uint64) + np.uint64(0x6EA2)) >> np.uint64(32)).astype(np.uint32)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """At each position the gear hash h = 2 h + GEAR[byte] modulo 2**32, which the last 32 bytes alone decide."""
    h = GEAR[data]
    for width in (1, 2, 4, 8, 16):
        out = h.copy()
        out[width:] += h[:-width] << np.uint32(width)
        h = out
    return h


def cuts(data: np.ndarray, offsets: np.ndarray, least: int, bits: int, most: int, strip: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all texts' chunks: a cut follows a byte whose hash ends up with `bits` zero bits on top, but
    chunks have `least` (32 or more) to `most` bytes; a text's last chunk may be shorter."""
    marks = []
    for at in range(0, len(data), strip):
        lo = max(0, at - 31)
        h = gear_hashes(data[lo : at + strip])[at - lo :]
        marks.append(np.flatnonzero(h >> np.uint32(32 - bits) == 0) + at + 1)
    marks = np.concatenate([*marks, np.zeros(0, np.int64)])
    first, last = np.searchsorted(marks, offsets[:-1], "right"), np.searchsorted(marks, offsets[1:], "left")
    starts, ends = [], []
    places = marks.tolist()
    for begin, end, a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), first.tolist(), last.tolist(), strict=True):
        at = begin
        for mark in places[a:b]:
            while mark - at > most:
                starts.append(at)
                at += most
                ends.append(at)
            if mark - at >= least:
                starts.append(at)
                ends.append(mark)
                at = mark
        while end - at > most:
            starts.append(at)
            at += most
            ends.append(at)
        if end > at:
            starts.append(at)
            ends.append(end)
    return np.array(starts, np.int64), np.array(ends, np.int64)


def remove_chunks(docs: DataFrame, least: int = 32, bits: int = 5, most: int = 256, compared: int = 32) -> DataFrame:
    """KEPT per row of docs (doc_id, text): what is left without the chunks that a smaller doc_id holds too.

    A chunk of `compared` bytes or more goes if a document with a smaller doc_id has one of the same length and
    128-bit digest. Since cuts depend on the bytes before them alone, an insertion moves the cuts near it and no others.
    Chunks under `least` bytes, all of them at the ends of texts, are compared if `compared` lets them. Null texts are
    empty, and no text is too long: it is cut in strips. Rows with a null doc_id take no part and are kept whole; rows
    that share a doc_id count as one document, so their equal chunks all stay or all go; other columns, of any name,
    are left alone; an empty table gives none.
    """
    n = partitions(docs, 8 << 20)
    n_cells = 4 * n

    def postings(data, offsets, ids):
        starts, ends = cuts(data, offsets, least, bits, most)
        whole = ends - starts >= compared
        starts, ends = starts[whole], ends[whole]
        view = memoryview(data.tobytes())
        digests = b"".join([hashlib.blake2b(view[a:b], digest_size=16).digest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
        two = np.frombuffer(digests, "<u8").reshape(-1, 2)
        j = np.searchsorted(offsets, starts, "right") - 1
        yield {"hash": two[:, 0], "low": two[:, 1], "doc": ids[j], "pos": starts - offsets[j], "length": ends - starts}

    def fold(c: exchange.Columns) -> tuple[exchange.Columns, exchange.Columns]:
        order = np.lexsort((c["doc"], c["length"], c["low"], c["hash"]))
        c = {k: v[order] for k, v in c.items()}
        h, low, size, doc = c["hash"], c["low"], c["length"], c["doc"]
        fresh = np.r_[True, (h[1:] != h[:-1]) | (low[1:] != low[:-1]) | (size[1:] != size[:-1])]
        gone = doc > doc[fresh][np.cumsum(fresh) - 1]
        return {k: v[~gone] for k, v in c.items()}, {k: c[k][gone] for k in VERDICTS}

    posted = exchange.post(docs, n, CHUNKS, "hash", postings, fold=fold, verdicts=VERDICTS)
    gone = keep(exchange.settle(posted, n, CHUNKS, lambda c: fold(c)[1], VERDICTS, "cell", lambda found: exchange.cells(found["doc"], n_cells)))

    def finish(table: pa.Table, c: exchange.Columns) -> pa.Table:
        at, row = rows_of(table, c["doc"])
        start = c["pos"][at].astype(np.int64)
        return cut(table, row, start, start + c["length"][at])

    return with_unnamed(docs, exchange.meet(docs, gone, n_cells, VERDICTS, finish, KEPT))
