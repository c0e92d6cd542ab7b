"""Sets of word shingles as sorted 64-bit hashes, for whole batches of texts at a time."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

from tessera.llm.shared import mix64

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUE = mix64(_LOWER.astype(np.uint64) + np.uint64(0x51ED)) | np.uint64(1)
_BASE = 0xD6E8FEB86659FD93
_STEP = np.uint64(0x9E3779B97F4A7C15)
STRIP = 1 << 18


@lru_cache(1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, for one strip."""
    return tuple(np.multiply.accumulate(np.full(STRIP + 1, b, np.uint64)) for b in (_BASE, pow(_BASE, -1, 2**64)))


def _long_word(data: np.ndarray) -> int:
    """The sum of a word's weighed bytes, strip after strip, if it is longer than one."""
    up, _ = _powers()
    total = 0
    for at in range(0, len(data), STRIP):
        part = data[at : at + STRIP]
        total += int((_VALUE[part] * up[: len(part)]).sum(dtype=np.uint64)) * pow(_BASE, at, 2**64)
    return total * pow(_BASE, -1, 2**64) % 2**64


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of all texts, A-Z taken as lower case, and each text's number of words."""
    solid = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(solid & (edge[:-1] | ~np.r_[False, solid[:-1]]))
    ends = np.flatnonzero(solid & (edge[1:] | ~np.r_[solid[1:], False])) + 1
    out, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        lo = int(starts[at])
        to = int(np.searchsorted(ends, lo + STRIP, "right"))
        if to <= at:
            n = int(ends[at]) - lo
            out[at] = mix64(np.array([_long_word(data[lo : lo + n])], np.uint64) + np.uint64(n))[0]
            at += 1
            continue
        part = data[lo : int(ends[to - 1])]
        up, down = _powers()
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUE[part] * up[: len(part)])])
        a, b = starts[at:to] - lo, ends[at:to] - lo
        out[at:to] = mix64((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))
        at = to
    counts = np.searchsorted(starts, offsets[1:]) - np.searchsorted(starts, offsets[:-1])
    return out, counts


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Each text's distinct shingles of `width` words, sorted; a text of fewer words is one shingle, one of none empty."""
    hashed, counts = words(data, offsets)
    ends = np.cumsum(counts)
    if len(hashed) >= width:
        n = len(hashed) - width + 1
        rolled = hashed[:n].copy()
        for i in range(1, width):
            rolled = rolled * _STEP + hashed[i : i + n]
        rolled = mix64(rolled)
    for end, count in zip(ends.tolist(), counts.tolist(), strict=True):
        a = end - count
        if count >= width:
            yield np.unique(rolled[a : end - width + 1])
        elif count:
            h = hashed[a : a + 1].copy()
            for i in range(a + 1, end):
                h = h * _STEP + hashed[i : i + 1]
            yield mix64(h + np.uint64(count))
        else:
            yield np.zeros(0, np.uint64)


def set_digest(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits of a set that don't depend on its order, as two signed 64-bit numbers."""
    two = np.array([mix64(shingles).sum(dtype=np.uint64), mix64(shingles ^ _STEP).sum(dtype=np.uint64)])
    return tuple(mix64(two).view(np.int64).tolist())
