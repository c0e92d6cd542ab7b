"""Passages that repeat across documents, by suffix arrays over anchored contexts; removal of all but the first holder's.

A string of `least` bytes holds least - K + 1 strings of K bytes. The one whose hash is lowest (the leftmost of equals)
is its anchor, wherever it stands; so equal strings have equal anchors at equal places. Each document's anchors are
posted with a hash of their context, the least - K bytes on either side, which holds every string of that anchor.
Equal contexts need no more work: all but those of the smallest doc_id go. Contexts that share an anchor and differ
are fetched, one for each document that holds such a context first, and searched as an enhanced suffix array, whose
interval tree gives the maximal repeats with all their occurrences.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import exchange
from tessera.llm.shared import keep, mix64, partitions, text_bytes
from tessera.llm.suffixes import SuffixArray, interval_tree

K = 20
STRIP = 1 << 20
ANCHORS = {"hash": "<u8", "context": "<u8", "doc": "<i8", "pos": "<i4"}
VERDICTS = {"doc": "<i8", "pos": "<i4", "mask": "<u4", "hash": "<u8"}
KEPT = "doc_id long, kept binary, spans array<struct<start:long,end:long>>"
CARRIED = ", kept_text string, carried "


def _table(seed: int) -> np.ndarray:
    return mix64(np.arange(256, dtype=np.uint64) + np.uint64(seed << 8)) | np.uint64(1)


def k_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the K bytes at each position that has them, by doubling the length hashed."""
    h, factor, width = _table(1)[data], 0x9E3779B97F4A7C15, 1
    h1, f1 = h, factor
    while width * 2 <= K:
        h = h[:-width] * np.uint64(factor) + h[width:]
        factor, width = factor * factor % 2**64, width * 2
        if width == K % 16:
            h1, f1 = h, factor
    assert K == 20  # 16 + 4
    return mix64(h[: len(h) - 4] * np.uint64(f1) + h1[16 : 16 + len(h) - 4])


@lru_cache(1)
def _powers(n: int, base: int = 0xD6E8FEB86659FD93) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, for hashes of any range from prefix sums."""
    return tuple(np.multiply.accumulate(np.full(n, x, np.uint64)) for x in (base, pow(base, -1, 2**64)))


def window_hashes(data: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """A hash of the `width` bytes at each of the starts, which rise; strip after strip, so tables stay small."""
    out, table = np.empty(len(starts), np.uint64), _table(3)
    up, down = _powers(STRIP + 2 * 4096)
    for at in range(0, len(data), STRIP):
        a, b = np.searchsorted(starts, [at, at + STRIP])
        if b > a:
            part = data[at : at + STRIP + width]
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(table[part] * up[: len(part)])])
            here = starts[a:b] - at
            out[a:b] = mix64((sums[here + width] - sums[here]) * down[here])
    return out


def anchors(data: np.ndarray, offsets: np.ndarray, doc_ids: np.ndarray, least: int):
    """Columns of ANCHORS for the texts, strip after strip, so memory is bounded however long a text is."""
    side, span, n = least - K, least - K + 1, len(data)
    up, down = _powers(STRIP + 2 * 4096)
    table, last = _table(2), -1
    for at in range(0, n, STRIP):
        lo, hi = max(0, at - side), min(n, at + STRIP + least + side)
        part = data[lo:hi]
        if len(part) < least:
            continue
        hashed = k_hashes(part)
        low = (hashed & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashed), dtype=np.uint64)
        width = 1
        while width * 2 <= span:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if span > width:
            low = np.minimum(low[: width - span], low[span - width :])
        a, b = np.searchsorted(offsets, lo, "right") - 1, np.searchsorted(offsets, hi, "left")
        first, end = np.maximum(offsets[a:b], at) - lo, np.minimum(np.minimum(offsets[a + 1 : b + 1] - least + 1, at + STRIP) - lo, len(low))
        some = end > first
        whole = np.zeros(len(low) + 1, np.int32)
        np.add.at(whole, first[some], 1)
        np.add.at(whole, end[some], -1)
        p = (low[np.cumsum(whole[:-1]) > 0] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        p = p[np.diff(p, prepend=last - lo) != 0]
        if not len(p):
            continue
        last = int(p[-1]) + lo
        j = np.searchsorted(offsets, p + lo, "right") - 1
        left, right = np.maximum(offsets[j] - lo, p - side), np.minimum(offsets[j + 1] - lo, p + least)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(table[part] * up[: len(part)])])
        context = mix64((sums[right] - sums[left]) * down[left] + ((p - left) * 4096 + right - p).astype(np.uint64))
        yield {"hash": hashed[p], "context": context, "doc": doc_ids[j], "pos": p + lo - offsets[j]}


def _by_context(c: exchange.Columns) -> tuple[exchange.Columns, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors in order of hash, context and doc_id: where a hash begins, where a context begins, the first holder."""
    order = np.lexsort((c["doc"], c["context"], c["hash"]))
    c = {k: v[order] for k, v in c.items()}
    new_h = np.r_[True, c["hash"][1:] != c["hash"][:-1]]
    new_c = new_h | np.r_[True, c["context"][1:] != c["context"][:-1]]
    return c, new_h, new_c, c["doc"][new_c][np.cumsum(new_c) - 1]


def fold(c: exchange.Columns, full: int) -> tuple[exchange.Columns, exchange.Columns]:
    """A task's own anchors: those of each context's first holder among them, and verdicts on the other documents'."""
    c, _, _, holder = _by_context(c)
    gone = c["doc"] > holder
    sure = {k: c[k][gone] for k in ("doc", "pos", "hash")}
    return {k: v[~gone] for k, v in c.items()}, sure | {"mask": np.full(gone.sum(), full, np.uint32)}


def first_holders(c: exchange.Columns, full: int) -> exchange.Columns:
    """Verdicts on a bucket's anchors: mask full where an equal context has a smaller doc_id; mask 0 where that is to be
    looked into, because another document has the anchor in another context."""
    c, new_h, new_c, holder = _by_context(c)
    doc, at_h, group = c["doc"], np.flatnonzero(new_h), np.cumsum(new_h) - 1
    across = np.minimum.reduceat(doc, at_h) != np.maximum.reduceat(doc, at_h)
    several = np.add.reduceat(new_c.astype(np.int64), at_h) > 1
    gone, open_ = doc > holder, (doc == holder) & (across & several)[group]
    take = gone | open_
    return {"doc": doc[take], "pos": c["pos"][take], "mask": np.where(gone[take], full, 0), "hash": c["hash"][take]}


CONTEXTS = {"hash": "<u8", "doc": "<i8", "pos": "<i4", "left": "u1", "right": "u1", "bytes": "u1"}


def repeated_windows(c: exchange.Columns, least: int):
    """Per context of a bucket the strings of its anchor that a smaller doc_id holds too, as a bit mask by place."""
    side, n = least - K, len(c["hash"])
    if not n:
        return None
    lengths = c["left"].astype(np.int64) + c["right"]
    offsets = np.cumsum(lengths) - lengths
    data, per = c["bytes"], np.maximum(np.minimum(c["left"].astype(np.int64), lengths - least) + 1, 0)
    owner = np.repeat(np.arange(n), per)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
    # strings whose hash nothing shares can't repeat, and aren't sorted
    start = offsets[owner] + place
    value = window_hashes(data, start, least)
    ranked = np.sort(value)
    twice = np.unique(ranked[1:][ranked[1:] == ranked[:-1]])
    if not len(twice):
        return None
    found = np.searchsorted(twice, value)
    alive = twice[np.minimum(found, len(twice) - 1)] == value
    owner, start, place = owner[alive], start[alive], place[alive]
    array = SuffixArray(data, start, (offsets + lengths)[owner], least + side)
    order = array.order
    before = np.where(place == 0, -1, data[start - 1].astype(np.int64))[order]
    tree = list(interval_tree(array.lcp, before, least))
    if not tree:
        return None
    length, first, last = (np.array(x, np.int64) for x in zip(*tree, strict=True))
    counts = last - first + 1
    item = np.repeat(np.arange(len(tree)), counts)
    at = order[np.arange(len(item)) - np.repeat(np.cumsum(counts) - counts, counts) + first[item]]
    doc = c["doc"][owner[at]]
    smallest = np.minimum.reduceat(doc, np.cumsum(counts) - counts)
    gone = doc > smallest[item]
    at, item = at[gone], item[gone]
    shift = (place[at] - c["left"][owner[at]] + side).astype(np.uint64)
    bits = ((np.uint64(1) << (length[item] - least + 1).astype(np.uint64)) - np.uint64(1)) << shift
    masks = np.zeros(n, np.uint64)
    np.bitwise_or.at(masks, owner[at], bits)
    some = masks > 0
    return {"doc": c["doc"][some], "pos": c["pos"][some], "mask": masks[some] & np.uint64(2 ** (side + 1) - 1), "hash": c["hash"][some]}


def rows_of(table: pa.Table, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of a place in doc and a row of table with that doc_id."""
    ids = table.column("doc_id").to_numpy()
    by = np.argsort(ids, kind="stable")
    first = np.searchsorted(ids[by], doc, "left")
    n = np.searchsorted(ids[by], doc, "right") - first
    at = np.repeat(np.arange(len(doc)), n)
    return at, by[np.arange(len(at)) - np.repeat(np.cumsum(n) - n - first, n)]


def anchored_rows(table: pa.Table, c: exchange.Columns) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of a verdict and a row of table with its doc_id; where rows share that, those with its anchor there."""
    at, row = rows_of(table, c["doc"])
    several = np.bincount(at, minlength=len(c["doc"]))[at] > 1
    if several.any():
        data, offsets = text_bytes(table.column("text"))
        start = offsets[row] + c["pos"][at].astype(np.int64)
        asked = np.flatnonzero(several & (start + K <= offsets[row + 1]))
        keep_it = ~several
        if len(asked):
            hashed = k_hashes(data[start[asked, None] + np.arange(K)].ravel())[::K]
            keep_it[asked] = hashed == c["hash"][at[asked]]
        at, row = at[keep_it], row[keep_it]
    return at, row


def cut(table: pa.Table, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Table:
    """KEPT for the rows of table, without the bytes of the intervals [start, end) of their row; with a column carried,
    also that and the whole letters of what is left."""
    by = np.argsort(row, kind="stable")
    row, start, end = row[by], start[by], end[by]
    rows = np.arange(table.num_rows)
    a, b = np.searchsorted(row, rows, "left"), np.searchsorted(row, rows, "right")
    kept, spans = [], []
    for i, text in enumerate(table.column("text")):
        whole = text.as_buffer().to_pybytes() if text.is_valid else b""
        if a[i] == b[i]:
            kept.append(whole)
            spans.append([])
            continue
        level = np.zeros(len(whole) + 1, np.int32)
        np.add.at(level, np.minimum(start[a[i] : b[i]], len(whole)), 1)
        np.add.at(level, np.minimum(end[a[i] : b[i]], len(whole)), -1)
        gone = np.cumsum(level[:-1]) > 0
        kept.append(np.frombuffer(whole, np.uint8)[~gone].tobytes())
        edges = np.flatnonzero(np.diff(np.r_[False, gone, False]))
        spans.append([{"start": x, "end": y} for x, y in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    out = pa.table({"doc_id": table.column("doc_id").combine_chunks(), "kept": pa.array(kept, pa.binary()), "spans": pa.array(spans, kind)})
    if "carried" in table.column_names:
        out = out.append_column("kept_text", pa.array([k.decode(errors="ignore") for k in kept], pa.string())).append_column("carried", table.column("carried"))
    return out


def remove_repeats(docs: DataFrame, least: int = 50, carry: tuple[str, ...] = ()) -> DataFrame:
    """KEPT per row of docs (doc_id, text): the bytes left, and the maximal removed runs [start, end) of the text's bytes.

    A byte goes if it is covered by a string of `least` bytes (K + 1 to 51) that also starts in a document with a
    smaller doc_id; strings are judged on the whole input. Null texts are empty. Rows with a null doc_id take no part
    and are kept whole. Rows that share a doc_id count as one document and lose nothing to
    each other; each loses what it holds itself. Other columns, of any name, are left alone, and an empty table gives
    no rows. Text is never decoded or cut; the order of rows,
    their partitions and equal texts make no difference. With columns to carry, the result has those of each row as
    `carried`, and as `kept_text` what is left of whole letters: a letter cut by a run's edge goes with it.
    """
    assert K < least <= K + 31
    side, n = least - K, partitions(docs, 8 << 20)
    n_cells, full = 4 * n, 2 ** (side + 1) - 1
    to_cell = lambda found: exchange.cells(found["doc"], n_cells)
    posted = exchange.post(docs, n, ANCHORS, "hash", lambda data, offsets, ids: anchors(data, offsets, ids, least), fold=lambda c: fold(c, full), verdicts=VERDICTS)
    sure = keep(exchange.settle(posted, n, ANCHORS, lambda c: first_holders(c, full), VERDICTS, "cell", to_cell))

    def contexts(table: pa.Table, c: exchange.Columns) -> pa.Table:
        open_ = c["mask"] == 0
        doc, pos, hashed = c["doc"][open_], c["pos"][open_].astype(np.int64), c["hash"][open_]
        data, offsets = text_bytes(table.column("text"))
        at, row = anchored_rows(table, {"doc": doc, "pos": pos, "hash": hashed})
        doc, pos, hashed = doc[at], pos[at], hashed[at]
        left, right = np.minimum(pos, side), np.minimum(offsets[row + 1] - offsets[row] - pos, least)
        fit = right >= K
        doc, pos, hashed, row, left, right = doc[fit], pos[fit], hashed[fit], row[fit], left[fit], right[fit]
        bucket = exchange.bucket_of(hashed, n)
        order = np.argsort(bucket, kind="stable")
        doc, pos, hashed, row, left, right, bucket = (x[order] for x in (doc, pos, hashed, row, left, right, bucket))
        lengths = left + right
        where = np.repeat(offsets[row] + pos - left, lengths) + np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        columns = {"hash": hashed, "doc": doc, "pos": pos, "left": left, "right": right}
        batch = exchange.dealt(columns, bucket, "bucket", {k: v for k, v in CONTEXTS.items() if k != "bytes"})
        taken, ends = data[where].tobytes(), np.cumsum(lengths)
        firsts = np.searchsorted(bucket, batch.column(0).to_numpy())
        bounds = [*(np.r_[0, ends][firsts]).tolist(), len(taken)]
        return pa.Table.from_batches([batch]).append_column("bytes", pa.array([taken[a:b] for a, b in zip(bounds, bounds[1:])], pa.binary()))

    fetched = exchange.meet(docs, sure, n_cells, VERDICTS, contexts, exchange.schema_of("bucket", CONTEXTS))
    searched = keep(exchange.settle(fetched, n, CONTEXTS, lambda c: repeated_windows(c, least), VERDICTS, "cell", to_cell))

    def finish(table: pa.Table, c: exchange.Columns) -> pa.Table:
        at, on = anchored_rows(table, c)
        mask, pos = c["mask"][at], c["pos"][at].astype(np.int64)
        whole = mask == full
        row, start, end = [on[whole]], [np.maximum(pos[whole] - side, 0)], [pos[whole] + least]
        some = (mask > 0) & ~whole
        for place in range(side + 1):
            hit = some & (mask >> np.uint32(place) & np.uint32(1) > 0)
            row.append(on[hit])
            start.append(pos[hit] - side + place)
            end.append(start[-1] + least)
        return cut(table, *(np.concatenate(x) for x in (row, start, end)))

    return with_unnamed(docs, exchange.meet(docs, sure.unionByName(searched), n_cells, VERDICTS, finish, carried(docs, carry), carry), carry)


def carried(docs: DataFrame, carry: tuple[str, ...]) -> str:
    """KEPT, with the columns that the result carries."""
    return KEPT + (CARRIED + docs.select(F.struct(*carry)).schema[0].dataType.simpleString() if carry else "")


def with_unnamed(docs: DataFrame, out: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """out, and the rows of docs without doc_id, whole: they are read where they lie, not dealt to one place."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    nothing = [F.lit(None).cast("long").alias("doc_id"), text.cast("binary").alias("kept"), F.array().cast("array<struct<start:long,end:long>>").alias("spans")]
    more = [text.alias("kept_text"), F.struct(*carry).alias("carried")] if carry else []
    return out.unionByName(docs.where(F.col("doc_id").isNull()).select(*nothing, *more))
