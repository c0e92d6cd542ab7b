"""Enhanced suffix arrays over a bounded text, and the common-prefix interval tree by one stack scan."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def eight_bytes(data: np.ndarray) -> np.ndarray:
    """At each position the next eight bytes as a big-endian number, zeros past the end."""
    x = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    for width in (1, 2, 4):
        x = (x[:-width] << np.uint64(8 * width)) | x[width:]
    return x[: len(data)]


class SuffixArray:
    """Suffixes of `data` at `starts`, each ending before its `ends`, in lexicographic order, compared to `depth` bytes.

    order: positions in starts. lcp[i]: bytes that suffixes i - 1 and i of the order share, lcp[0] = 0. Equal suffixes
    stay in the order given.
    """

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, depth: int):
        keys, columns = eight_bytes(data), []
        for at in range(0, depth, 8):
            left = np.clip(ends - starts - at, 0, 8).astype(np.uint64)
            here = keys[np.minimum(starts + at, max(len(data) - 1, 0))]
            mask = np.where(left == 0, np.uint64(0), ~np.uint64(0) << np.minimum(np.uint64(8) * (np.uint64(8) - left), np.uint64(63)))
            columns.append(np.where(left == 0, np.uint64(0), here & mask))
        length = np.minimum(ends - starts, depth)
        self.order = np.lexsort([length, *columns[::-1]]) if len(starts) else np.zeros(0, np.int64)
        self.lcp = np.zeros(len(starts), np.int64)
        if len(starts) > 1:
            a, b = self.order[:-1], self.order[1:]
            same, open_ = np.zeros(len(a), np.int64), np.ones(len(a), bool)
            for column in columns:
                differ = column[a] ^ column[b]
                equal = np.full(len(a), 8, np.int64)
                for byte in range(8):
                    equal = np.where((equal == 8) & ((differ >> np.uint64(56 - 8 * byte)) & np.uint64(255) != 0), byte, equal)
                same += np.where(open_, equal, 0)
                open_ &= equal == 8
            self.lcp[1:] = np.minimum(same, np.minimum(length[a], length[b]))


def interval_tree(lcp: np.ndarray, left: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(length, first, last) of the maximal repeats: intervals of the order that share `length` >= least bytes, each as
    long as its suffixes agree, and whose suffixes are preceded by different bytes (left: that byte, or any negative
    number where nothing that could be equal stands before). Parents come after their children.
    """
    inside = lcp >= least
    heads = np.flatnonzero(inside & ~np.r_[False, inside[:-1]]) - 1
    tails = np.flatnonzero(inside & ~np.r_[inside[1:], False])
    for head, tail in zip(heads.tolist(), tails.tolist(), strict=True):
        here = left[head : tail + 1]
        if here[0] >= 0 and (here == here[0]).all():
            continue  # the repeat one byte further left holds all of this
        # stack entries: length, first, the one byte before all of it or None if there are several
        stack: list[list] = []
        lengths = [*lcp[head + 1 : tail + 1].tolist(), 0]
        byte = here.tolist()
        for i, length in enumerate(lengths):
            first, before = i, byte[i] if byte[i] >= 0 else None
            while stack and stack[-1][0] > length:
                depth, first, seen = stack.pop()
                before = seen if seen == before else None
                if before is None:
                    yield depth, head + first, head + i
            if length >= least:
                if stack and stack[-1][0] == length:
                    stack[-1][2] = before if stack[-1][2] == before else None
                else:
                    stack.append([length, first, before])


def maximal_repeats(texts: list[bytes], least: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """All maximal repeats of at least `least` bytes within and across the texts: (length, [(text, position), ...])."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    lengths = np.array([len(t) for t in texts], np.int64)
    offsets = np.cumsum(lengths) - lengths
    text = np.repeat(np.arange(len(texts)), lengths)
    starts = np.arange(len(data))
    ends = (offsets + lengths)[text]
    array = SuffixArray(data, starts, ends, int(lengths.max(initial=0)))
    before = np.where(starts == offsets[text], -1 - starts, data[starts - 1].astype(np.int64) if len(data) else 0)
    at = starts[array.order]
    return [(n, sorted((int(text[p]), int(p - offsets[text[p]])) for p in at[a : b + 1])) for n, a, b in interval_tree(array.lcp, before[array.order], least)]
