"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, votes by distance.

Vectors have all terms of a text: words, and the first letters of longer words, since abuse is inflected. Document
frequencies are those of the whole table; terms that labelled toxic texts surely hold more often than labelled clean ones
weigh more. Examples with one vector are one entry with a tally of labels. The k nearest entries vote by distance; what
the votes of left-out examples were worth, by pooled adjacent violators, makes a score of them.
"""

from __future__ import annotations

import hashlib
import math
import re
import sys
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import exchange
from tessera.llm.shared import cell, cell_of, keep, mix64, open_file, partitions, scratch, trimmed
from tessera.llm.vectors import loaded, write as write_arrays

_WORDS = re.compile(r"[^\W\d_]+").findall
OTHERS = {"hash": "<i8", "key": "<i8", "count": "<i4"}
HELD = {"term": "<i4", "n": "<i8"}
ADDS = {"key": "<i8", "add": "<i8"}
#: What other terms add to a squared norm is summed in this unit, as integers, so the order of the sum is nothing.
UNIT = 2.0**-30
#: Postings that are added up at a time.
PIECE = 1 << 17


def features(text: str | None, stem: int) -> Counter:
    """How often a text has its words in lower case, and the first `stem` letters of the longer ones, marked with *."""
    found = Counter(_WORDS((text or "").lower()))
    for w, n in list(found.items()):
        if len(w) > stem:
            found[w[:stem] + "*"] += n
    return found


@lru_cache(1)
def _letters() -> np.ndarray:
    """By code point, whether it is a letter of a word."""
    out = np.zeros(sys.maxunicode + 1, bool)
    for m in re.finditer(r"[^\W\d_]+", "".join(map(chr, range(len(out))))):
        out[m.start() : m.end()] = True
    return out


@lru_cache(1)
def _powers(n: int, base: int = 0xD6E8FEB86659FD93) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.multiply.accumulate(np.full(n, x, np.uint64)) for x in (base, pow(base, -1, 2**64)))


STRIP = 1 << 18


def term_hashes(letters: np.ndarray, stem: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a run of code points: where its words begin and their hashes, where words with a stem begin and the stems' hashes."""
    solid = np.concatenate([[False], _letters()[letters], [False]])
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    a, b = edges[::2], edges[1::2]
    words, stems, at = np.empty(len(a), np.uint64), [np.zeros(0, np.uint64)], 0
    (up, down), mark = _powers(STRIP + 1), np.uint64(1 << 63)
    while at < len(a):
        lo = int(a[at])
        to = int(np.searchsorted(b, lo + STRIP, "right"))
        if to <= at:  # a word longer than a strip
            total = 0
            for x in range(lo, int(b[at]), STRIP):
                part = letters[x : min(x + STRIP, int(b[at]))].astype(np.uint64)
                total += int((part * up[: len(part)]).sum(dtype=np.uint64)) * pow(int(up[0]), x - lo, 2**64)
            words[at] = mix64(np.array([total * int(down[0]) % 2**64], np.uint64) + np.uint64(b[at] - lo))[0]
            stems.append(mix64((letters[lo : lo + stem] * np.r_[np.uint64(1), up[: stem - 1]]).sum(dtype=np.uint64, keepdims=True) ^ mark))
            at += 1
            continue
        sums = np.empty(int(b[to - 1]) - lo + 1, np.uint64)
        sums[0] = 0
        np.cumsum(letters[lo : b[to - 1]] * up[: len(sums) - 1], out=sums[1:])
        x, y = a[at:to] - lo, b[at:to] - lo
        before, scale = sums[x], down[x]
        words[at:to] = mix64((sums[y] - before) * scale + (y - x).astype(np.uint64))
        long = np.flatnonzero(y - x > stem)
        stems.append(mix64((sums[x[long] + stem] - before[long]) * scale[long] ^ mark))
        at = to
    return a, words.view(np.int64), a[b - a > stem], np.concatenate(stems).view(np.int64)


def hashed(texts: list[str | None], stem: int, letters_each: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each text features() as sorted 64-bit hashes of the terms, and how often each occurs."""
    at = 0
    while at < len(texts):
        lows, size = [], 0
        while at < len(texts) and (not lows or size + len(texts[at] or "") <= letters_each):
            lows.append((texts[at] or "").lower())
            size += len(lows[-1]) + 1
            at += 1
        letters = np.frombuffer("\n".join(lows).encode("utf-32-le", "surrogatepass"), "<u4")
        ends = np.cumsum([len(t) + 1 for t in lows])
        a, words, c, stems = term_hashes(letters, stem)
        i, j, x, y = 0, 0, np.searchsorted(a, ends).tolist(), np.searchsorted(c, ends).tolist()
        for u, v in zip(x, y, strict=True):
            found = np.concatenate([words[i:u], stems[j:v]])
            found.sort()
            edges = np.flatnonzero(np.concatenate([[len(found) > 0], found[1:] != found[:-1], [True]]))
            i, j = u, v
            yield found[edges[:-1]], (edges[1:] - edges[:-1]).astype(np.int32)


def places(vocabulary: np.ndarray, found: list[np.ndarray]) -> list[np.ndarray]:
    """Of each array of terms their places in the vocabulary, -1 for those that it lacks; equal terms are looked up once."""
    if not found:
        return []
    terms, inverse = np.unique(np.concatenate(found), return_inverse=True)
    at = np.searchsorted(vocabulary, terms)
    here = at < len(vocabulary)
    here[here] = vocabulary[at[here]] == terms[here]
    return np.split(np.where(here, at, -1)[inverse], np.cumsum([len(x) for x in found])[:-1])


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def clusters(rows: np.ndarray, n: int, rounds: int = 4) -> np.ndarray:
    """By row the nearest of n centres, moved some rounds to the means of their rows; they begin at rows evenly apart."""
    if not len(rows) or not rows.shape[1]:
        return np.zeros(len(rows), np.int64)
    centres = rows[np.arange(n) * len(rows) // n].copy()
    for _ in range(rounds):
        near = np.argmax(rows @ (centres / np.maximum(np.sqrt((centres**2).sum(1)), 1e-9)[:, None]).T, 1)
        for c in range(n):
            if (near == c).any():
                centres[c] = rows[near == c].mean(0)
    return near


class BlockMaxIndex:
    """Inverted lists of weights over entries, in blocks of entries with each block's largest weight.

    Entries that are alike in their frequent terms, such as those of one language, form a part, in which the shorter lie
    first, so that a block's maxima are near what its entries have. Lists of terms that more than the share `frequent` of a
    part's entries have are stored there at full length, as columns of the part's matrix, so that a block of them is one
    product; the others as postings.
    """

    ARRAYS = ("entry", "first", "owner", "weight", "heavy", "means", "bounds", "columns", "column_bounds", "dense", "tops", "rows", "terms", "weights")

    def __init__(self, vectors: Iterable, block: int = 128, n_terms: int | None = None, frequent: float = 0.08, n_parts: int = 8):
        """vectors: for each entry a mapping of terms (numbers) to weights, or a pair of arrays; of those that an iterator
        gives nothing is kept beside the lists."""
        pairs = [(np.fromiter(v, np.int64, len(v)), np.fromiter(v.values(), float, len(v))) if isinstance(v, dict) else v for v in vectors]
        self.block, n = block, len(pairs)
        sizes = np.array([len(t) for t, _ in pairs], np.int64)
        term = np.concatenate([*(t for t, _ in pairs), np.zeros(0, np.int32)]).astype(np.int32, copy=False)
        weight = np.concatenate([*(w for _, w in pairs), np.zeros(0)]).astype(float, copy=False)
        del pairs
        owner = np.repeat(np.arange(n, dtype=np.int32), sizes)
        self.n_terms = int(n_terms or (term.max(initial=-1) + 1))
        count = np.bincount(term, minlength=self.n_terms)
        common = np.flatnonzero(count > max(frequent * n, 16))
        place = np.full(self.n_terms, -1, np.int32)
        place[common] = np.arange(len(common))
        often = place[term] >= 0
        alike = np.zeros((n, len(common)), np.float32)
        alike[owner[often], place[term[often]]] = weight[often]
        part = clusters(alike, min(n, n_parts)).astype(np.int32)
        del alike, often
        # every part begins a block; places that no entry takes are -1
        n_parts = int(part.max(initial=-1)) + 1
        ends = np.cumsum(np.bincount(part, minlength=n_parts))
        self.bounds = np.concatenate([[0], np.cumsum(-(-np.bincount(part, minlength=n_parts) // block))]).astype(np.int64)
        order = np.lexsort((np.arange(n), sizes, part)).astype(np.int32)
        whose = part[order]
        at = np.empty(n, np.int32)
        at[order] = self.bounds[whose] * block + np.arange(n) - np.r_[0, ends][whose]
        self.entry = np.full(self.bounds[-1] * block, -1, np.int32)
        self.entry[at] = np.arange(n)
        often = np.zeros(len(term), bool)
        columns = []
        for p in range(n_parts):
            mine = np.flatnonzero(part[owner] == p)
            held = np.bincount(term[mine], minlength=self.n_terms) > max(frequent * (part == p).sum(), 16)
            often[mine] = held[term[mine]]
            columns.append(np.flatnonzero(held))
        # from here on by place, so that a stable sort by term leaves each list in order
        owner = at[owner]
        rare = np.flatnonzero(~often).astype(np.int32)
        rare = rare[np.argsort(owner[rare], kind="stable")]
        rare = rare[np.argsort(term[rare], kind="stable")]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(term[rare], minlength=self.n_terms))])
        self.owner, self.weight = owner[rare], weight[rare]
        del rare
        # the frequent terms' weights as they are, for the sums in double precision
        often = np.flatnonzero(often).astype(np.int32)
        often = often[np.argsort(owner[often], kind="stable")]
        self.rows = np.searchsorted(owner[often], np.arange(len(self.entry) + 1))
        self.heavy = np.unique(np.concatenate([*columns, np.zeros(0, np.int64)])).astype(np.int32)
        place[:] = -1
        place[self.heavy] = np.arange(len(self.heavy))
        self.terms, self.weights = place[term[often]], weight[often]
        del often, term, weight, owner
        self.columns = np.concatenate([*(place[c] for c in columns), np.zeros(0, np.int32)])
        self.column_bounds = np.cumsum([0, *map(len, columns)])
        self.means = np.zeros((n_parts, len(self.heavy)), np.float32)
        widths, heights = np.diff(self.column_bounds), np.diff(self.bounds) * block
        self.dense, self.tops = np.zeros(int(widths @ heights), np.float32), np.zeros(int(widths @ heights) // block, np.float32)
        self._views()
        column = np.empty(len(self.heavy), np.int32)
        for p, (lo, hi, cols, dense, tops) in enumerate(self.parts):
            column[cols] = np.arange(len(cols))
            x, y = self.rows[lo * block], self.rows[hi * block]
            dense[np.repeat(np.arange(len(dense)), np.diff(self.rows[lo * block : hi * block + 1])), column[self.terms[x:y]]] = self.weights[x:y]
            tops[:] = dense.reshape(hi - lo, block, len(cols)).max(1)
            self.means[p, cols] = dense.sum(0) / (part == p).sum().clip(1)

    def _views(self) -> None:
        """The parts: first block, block behind the last, columns as places in heavy, the matrix and its blocks' maxima."""
        self.place = np.full(self.n_terms, -1, np.int32)
        self.place[self.heavy] = np.arange(len(self.heavy))
        self.parts, x = [], 0
        for (lo, hi), (c, d) in zip(*([*zip(b.tolist(), b[1:].tolist())] for b in (self.bounds, self.column_bounds)), strict=True):
            y = x + (hi - lo) * (d - c)
            self.parts.append((lo, hi, self.columns[c:d], self.dense[x * self.block : y * self.block].reshape((hi - lo) * self.block, d - c), self.tops[x:y].reshape(hi - lo, d - c)))
            x = y
        #: Blocks multiplied, and those that there were: what the maxima spared can be read off.
        self.read = self.asked = 0

    def arrays(self) -> dict[str, np.ndarray]:
        return {k: getattr(self, k) for k in self.ARRAYS} | {"shape": np.array([self.block, self.n_terms])}

    @classmethod
    def of(cls, arrays: dict[str, np.ndarray]) -> "BlockMaxIndex":
        out = cls.__new__(cls)
        out.__dict__ |= {k: arrays[k] for k in cls.ARRAYS}
        out.block, out.n_terms = arrays["shape"].tolist()
        out._views()
        return out

    def nearest(self, query: dict[int, float], k: int) -> list[tuple[float, int]]:
        """The k entries of the highest positive scores (score, entry), ties to the earlier entry."""
        q = {t: w for t, w in query.items() if 0 <= t < self.n_terms}
        return self.search([(np.fromiter(q, np.int64, len(q)), np.fromiter(q.values(), float, len(q)))], k)[0]

    def search(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[list[tuple[float, int]]]:
        """nearest() of several queries (terms, weights).

        Postings are added up first. The k-th best of the blocks' best sums so far is below the k-th score, so a block's
        frequent terms matter only if its best sum and its maxima reach that. Queries that are likest one part go together
        and meet it first, so that the other parts' blocks are held against whole sums. What is near the k-th in the end is
        summed anew in double precision.
        """
        out: list[list[tuple[float, int]]] = [[] for _ in queries]
        blocks, size = len(self.entry) // self.block, self.block
        if not blocks:
            return out
        likest, common = np.zeros(len(queries), np.int64), []
        for i, (t, w) in enumerate(queries):
            p = self.place[t]
            here = np.flatnonzero(p >= 0)
            common.append((p[here], w[here]))
            likest[i] = np.argmax(self.means.take(p[here], 1) @ w[here])
        order = np.argsort(likest, kind="stable")
        for a in range(0, len(order), 128):
            some = order[a : a + 128]
            asked, sums, listed = np.zeros((len(some), len(self.heavy))), np.empty((len(some), blocks * size), np.float32), []
            floor = np.zeros(len(some), np.float32)
            for i, x in enumerate(some.tolist()):
                p, w = common[x]
                asked[i, p] = w
                listed.append(self._listed(*queries[x]))
                sums[i] = listed[i]
            single, best = asked.astype(np.float32), sums.reshape(len(some), blocks, size).max(2)
            for p in np.argsort(-np.bincount(likest[some], minlength=len(self.parts)), kind="stable").tolist():
                if k < blocks:
                    floor = np.partition(best, -k, axis=1)[:, -k]
                lo, hi, columns, dense, tops = self.parts[p]
                mine = single[:, columns]
                most = best[:, lo:hi] + mine @ tops.T
                wanted = (most >= floor[:, None] * (1 - 1e-4) - 1e-6) & (most > 0)
                self.asked += wanted.size
                for b in np.flatnonzero(wanted.any(0)).tolist():
                    rows = np.flatnonzero(wanted[:, b])
                    # copies of the rows cost more than the products that they spare, unless they are few
                    rows = rows if 4 * len(rows) < len(some) else slice(None)
                    block = sums[rows, (lo + b) * size : (lo + b + 1) * size] + mine[rows] @ dense[b * size : (b + 1) * size].T
                    sums[rows, (lo + b) * size : (lo + b + 1) * size], best[rows, lo + b] = block, block.max(1)
                    self.read += len(block)
            if k < blocks:
                floor = np.partition(best, -k, axis=1)[:, -k]
            for i, x in enumerate(some.tolist()):
                s = sums[i]
                at = np.flatnonzero(s >= max(floor[i] * (1 - 1e-4), 1e-30))
                if k < len(at):
                    at = at[s[at] >= np.partition(s[at], -k)[-k] * (1 - 1e-4)]
                n = self.rows[at + 1] - self.rows[at]
                own = np.repeat(self.rows[at] - np.cumsum(n) + n, n)
                own += np.arange(len(own))
                scores = listed[i][at] + np.bincount(np.repeat(np.arange(len(at)), n), asked[i][self.terms[own]] * self.weights[own], len(at))
                entry = self.entry[at]
                first = np.lexsort((entry, -scores))[:k]
                out[x] = [(v, e) for v, e in zip(scores[first].tolist(), entry[first].tolist(), strict=True) if v > 0]
        return out

    def _listed(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """What the postings of these terms add to each entry."""
        begin, size = self.first[terms], self.first[terms + 1] - self.first[terms]
        out, ends = np.zeros(len(self.entry)), np.cumsum(size)
        # the places of many postings at once, since most lists are short, in pieces that fit a cache
        for a, b in pairwise([*np.unique(np.searchsorted(ends, np.arange(0, size.sum(), PIECE))).tolist(), len(size)]):
            n = size[a:b]
            at = np.repeat(begin[a:b] - np.cumsum(n) + n, n)
            at += np.arange(len(at))
            values = self.weight.take(at, mode="clip")
            values *= np.repeat(weights[a:b], n)
            out += np.bincount(self.owner.take(at, mode="clip"), values, len(out))
        return out


def pooled(raw: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[list[float], list[float]]:
    """Steps (raw value from which, score) of the best rising fit of label to raw: pooled adjacent violators."""
    order = np.argsort(raw, kind="stable")
    groups: list[list[float]] = []  # start, weight, weighted labels
    for r, y, w in zip(raw[order].tolist(), label[order].tolist(), weight[order].tolist(), strict=True):
        if groups and groups[-1][0] == r:
            groups[-1][1] += w
            groups[-1][2] += w * y
        else:
            groups.append([r, w, w * y])
    out: list[list[float]] = []
    for g in groups:
        out.append(g)
        while len(out) > 1 and out[-2][2] * out[-1][1] >= out[-1][2] * out[-2][1]:
            last = out.pop()
            out[-1][1] += last[1]
            out[-1][2] += last[2]
    return [g[0] for g in out], [g[2] / g[1] for g in out]


class Votes:
    """The entries' tallies of labels, and what the nearest of them say."""

    def __init__(self, n: np.ndarray, toxic: np.ndarray, doc: np.ndarray, n_none: int, toxic_none: int):
        """By entry: examples, toxic ones, an example's doc_id; and how many examples have no terms at all."""
        self.n, self.toxic, self.doc, self.n_none, self.toxic_none = n, toxic, doc, n_none, toxic_none
        self.base = float((toxic.sum() + toxic_none + 1) / (n.sum() + n_none + 2))

    def none(self) -> float:
        """A text without any term is like the examples with none."""
        return (self.toxic_none + self.base) / (self.n_none + 1)

    def share(self, near: list[tuple[float, int]], left_out: tuple[int, int] | None = None) -> float:
        """The distance-weighted share of toxic examples; the prior votes as one example at the distance of no likeness."""
        total, toxic = 1.0, self.base
        for s, i in near:
            n, y = int(self.n[i]), int(self.toxic[i])
            if left_out and i == left_out[0]:
                n, y = n - 1, y - left_out[1]
            w = 1 / max(1.02 - s, 0.02)
            total += w * n
            toxic += w * y
        return toxic / total

    def left_out(self, index: BlockMaxIndex, entries: list[int], vectors: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[tuple[float, int, int]]:
        """(raw share, label, examples): what the others' votes make of the entries' examples, one at a time."""
        out = []
        for i, near in zip(entries, index.search(vectors, k + 1), strict=True):
            n, y = int(self.n[i]), int(self.toxic[i])
            near = [p for p in near if p[1] != i or n > 1][:k]
            out += [(self.share(near, (i, own)), own, count) for own, count in ((1, y), (0, n - y)) if count]
        return out

    def score(self, near: list[tuple[float, int]], some: bool, starts: list[float], scores: list[float]) -> float:
        """A score between 0 and 1 by the steps of pooled(); some: whether the text has any term."""
        raw = self.share(near) if some else self.none()
        # the step's score, with the raw share as the finer order within it
        low = scores[max(bisect_right(starts, raw) - 1, 0)]
        return min(1.0, max(0.0, 0.999 * low + 0.001 * raw))


def write(path: str, arrays: dict[str, np.ndarray]) -> None:
    with open_file(path, True)[2] as f:
        write_arrays(f, arrays)


def times_of(counts: pa.Scalar, n: int) -> np.ndarray:
    """A vector's counts, in two bytes each or, where one is too large, in four."""
    data = counts.as_buffer()
    return np.frombuffer(data, "<u2" if len(data) == 2 * n else "<i4")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def telling(clean: np.ndarray, toxic: np.ndarray, n_clean: int, n_toxic: int, n_terms: int) -> np.ndarray:
    """By term: 1, and for at most n_terms terms more, by how sure it is that toxic examples hold them more often."""
    odds = np.log((toxic + 0.5) / (n_toxic + 1.0)) - np.log((clean + 0.5) / (n_clean + 1.0))
    # the log ratio over its standard error
    sure = odds / np.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))
    best = np.flatnonzero((toxic >= 3) & (odds > math.log(3)) & (sure > 3))
    best = best[np.argsort(-sure[best], kind="stable")][:n_terms]
    out = np.ones(len(clean))
    out[best] += sure[best]
    return out


def score_documents(docs: DataFrame, labels: DataFrame, k: int = 12, stem: int = 4, sample: int = 20_000, n_terms: int = 4096, threshold: float = 0.3, seed: int = 11) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence) per row of docs (doc_id, text); labels: (doc_id, toxic 0 or 1).

    Labels are learnt from rows that are not held out: of `sample` labelled doc_ids at most, the first in a seeded hash
    order, one text each (the first by hash, if rows share the doc_id) is an example, with all its terms; a doc_id that is
    labelled both ways is toxic, and labels other than 0 and 1 are no labels. n_terms terms at most, those surest of
    toxic texts, get an extra weight by how sure they are. Terms' document frequencies, norms and scores are over all
    rows of docs and whole texts, terms that no example has included. evidence: doc_ids of the nearest examples, nearest
    first, ties to the smaller doc_id; examples with one vector stand together under the smallest doc_id and vote each.
    Null and empty texts have no terms and score like examples without any; a null doc_id is scored and not held out;
    rows with one doc_id are scored each; long texts are read in runs; without labels all scores are one; an empty table
    gives no rows. Columns of other names are left alone. source, lang and doc_id are no inputs.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    slim = slim.withColumn("key", F.xxhash64("text", "doc_id"))
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id").cast("long")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = keep(known.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(sample))
    # the first of a doc_id's texts by hash is its example
    firsts = slim.select("doc_id", "key").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("key").alias("key"))
    picked = slim.join(F.broadcast(keep(firsts)), ["doc_id", "key"])
    more = slim.where(F.pmod(F.xxhash64(F.lit(seed), "key"), F.lit(max(1, docs.count() // sample))) == 0)

    def vectors(batches):
        for b in batches:
            rows = list(hashed(b.column(2).to_pylist(), stem))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r[0].tobytes() for r in rows], pa.binary()), pa.array([r[1].astype("<u2").tobytes() if r[1].max(initial=0) < 65536 else r[1].astype("<i4").tobytes() for r in rows], pa.binary())], names=["doc_id", "toxic", "terms", "counts"])

    drawn = picked.select("doc_id", "toxic", "text").mapInArrow(trimmed(vectors), "doc_id long, toxic int, terms binary, counts binary")
    # rows that are equal, doc_id and all, are one example
    alike = drawn.groupBy("terms", "counts").agg(F.collect_set(F.struct("doc_id", "toxic")).alias("docs"))
    entries = keep(alike.select("terms", "counts", F.size("docs").cast("long").alias("n"), F.aggregate("docs", F.lit(0).cast("long"), lambda x, d: x + d["toxic"]).alias("toxic"), F.array_min(F.transform("docs", lambda d: d["doc_id"])).alias("doc_id")))
    folder = scratch(spark)

    def once(rows: DataFrame, work, schema: str):
        """The one row that work(all rows, a name of the task's own) gives in a single task: rows are bounded by `sample`."""

        def run(batches):
            table = pa.Table.from_batches(list(batches)).combine_chunks()
            yield pa.RecordBatch.from_pylist([work(table.filter(table.column("_row")), f"{folder}/{TaskContext.get().taskAttemptId()}")])

        # a row that isn't one, for tables that have none
        nothing = spark.range(1).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema), F.lit(False).alias("_row"))
        return rows.withColumn("_row", F.lit(True)).unionByName(nothing).repartition(1).mapInArrow(trimmed(run), schema).first()

    def vocabulary(rows, name):
        """The terms of the examples and of about `sample` rows of all. So a term beyond them is in few rows."""
        terms = np.unique(np.concatenate([*(np.frombuffer(x.as_buffer(), "<i8") for x in rows.column("terms")), np.zeros(0, np.int64)]))
        write(name + "-terms", {"terms": terms})
        return {"path": name + "-terms", "n": len(terms)}

    def distinct_terms(batches):
        held = np.zeros(0, np.int64)
        for b in batches:
            for part in exchange.slices(pa.RecordBatch.from_arrays([b.column(0), b.column(0)], names=["text", "again"])):
                held = np.unique(np.concatenate([held, *(found for found, _ in hashed(part.column(0).to_pylist(), stem))]))
        yield pa.RecordBatch.from_arrays([pa.array([held.tobytes()], pa.binary())], names=["terms"])

    drawn_terms = more.select("text").mapInArrow(trimmed(distinct_terms), "terms binary")
    made = once(entries.select("terms").unionByName(drawn_terms), vocabulary, "path string, n long")
    terms_path, n_terms_known, n_parts, n_ranges = made.path, made.n, partitions(docs), 32

    def count(batches):
        """Postings of the terms beyond the vocabulary, by bucket; and for the task the number of its rows, and of those
        that have each term of the vocabulary, by ranges of terms."""
        known_terms = loaded(terms_path)["terms"]
        held, n_rows, other, size = np.zeros(len(known_terms), np.int64), 0, [], 0

        def row(batch, names, rows=0):
            empty = pa.nulls(batch.num_rows, pa.binary())
            n, arrays = len(batch.column(0)), {k: batch.column(i + 1) for i, k in enumerate(names)}
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([rows] * n, pa.int64()), *(arrays.get(k, empty) for k in (*OTHERS, *HELD))], names=["bucket", "rows", *OTHERS, *HELD])

        def placed(batch, terms):
            for part in exchange.slices(batch):
                rows = list(hashed(part.column(1).to_pylist(), stem))
                yield from zip(part.column(0).to_pylist(), rows, places(terms, [r[0] for r in rows]), strict=True)

        def flush():
            c = exchange.joined(other, OTHERS)
            other.clear()
            return row(exchange.dealt(c, exchange.bucket_of(c["hash"].view(np.uint64), n_parts), "bucket", OTHERS), OTHERS)

        for b in batches:
            for key, (found, times), at in placed(b, known_terms):
                n_rows += 1
                here = at >= 0
                held[at[here]] += 1
                if not here.all():
                    beyond = ~here
                    other.append({"hash": found[beyond], "key": np.full(beyond.sum(), key), "count": times[beyond]})
                    size += len(other[-1]["hash"])
            if size > 500_000:
                yield flush()
                size = 0
        if size:
            yield flush()
        seen = np.flatnonzero(held)
        if len(seen):
            yield row(exchange.dealt({"term": seen, "n": held[seen]}, (seen * n_ranges // n_terms_known).astype(np.int32), "bucket", HELD), HELD)
        yield row(pa.RecordBatch.from_arrays([pa.array([-1], pa.int32())], names=["bucket"]), (), n_rows)

    kinds = exchange.schema_of("bucket", OTHERS | HELD).replace("bucket int", "bucket int, rows long")
    counted = keep(slim.select("key", "text").mapInArrow(trimmed(count), kinds))
    total = counted.agg(F.sum("rows")).first()[0] or 0

    def frequencies(batches):
        c = exchange.gathered(batches, HELD)
        seen, at = np.unique(c["term"], return_inverse=True)
        sums = np.zeros(len(seen), np.int64)
        np.add.at(sums, at, c["n"])
        yield pa.RecordBatch.from_arrays([pa.array([seen.astype("<i4").tobytes()], pa.binary()), pa.array([sums.tobytes()], pa.binary())], names=list(HELD))

    held_by = counted.where("term IS NOT NULL").select("bucket", *HELD).repartitionById(n_ranges, F.col("bucket")).select(*HELD)
    held_by = held_by.mapInArrow(trimmed(frequencies), "term binary, n binary")

    def other_norms(batches):
        """What the other terms of a bucket add to the squared norms of their texts."""
        by: dict[int, list] = {}
        for b in batches:
            for i, bucket in enumerate(b.column(0).to_pylist()):
                by.setdefault(bucket, []).append(b.slice(i, 1))
        for parts in by.values():
            c = exchange.gathered(parts, OTHERS)
            parts.clear()
            order = np.lexsort((c["key"], c["hash"]))
            h, key, times = (c[x][order] for x in OTHERS)
            new = np.r_[True, h[1:] != h[:-1]][: len(h)]
            df = np.diff(np.r_[np.flatnonzero(new), len(h)])[np.cumsum(new) - 1]
            once_each = new | np.r_[True, key[1:] != key[:-1]][: len(h)]
            adds = np.rint(((1 + np.log(times)) * (np.log((1 + total) / (1 + df)) + 1)) ** 2 / UNIT).astype(np.int64)
            columns = {"key": key[once_each], "add": adds[once_each]}
            if len(columns["key"]):
                yield exchange.dealt(columns, cell_of(columns["key"], n_parts), "cell", ADDS)

    norms = counted.where("hash IS NOT NULL").select("bucket", *OTHERS).repartitionById(n_parts, F.col("bucket")).mapInArrow(trimmed(other_norms), exchange.schema_of("cell", ADDS))

    def weigh(rows, name):
        """Writes the weights of terms, the index over the entries, the entries themselves and their tallies."""
        terms = loaded(terms_path)["terms"]
        df, vectors_, tallies = np.zeros(len(terms)), [], []
        order = np.argsort(rows.column("doc_id").fill_null(-1).to_numpy(), kind="stable")
        for t, c, *x in (tuple(rows.column(k)[i] for k in ("terms", "counts", "n", "toxic", "doc_id", "term", "held")) for i in order.tolist()):
            if t.is_valid:
                tallies.append([v.as_py() for v in x[:3]])
                ids = np.searchsorted(terms, np.frombuffer(t.as_buffer(), "<i8"))
                vectors_.append((ids.astype(np.int32), times_of(c, len(ids))))
            else:
                df[np.frombuffer(x[3].as_buffer(), "<i4")] += np.frombuffer(x[4].as_buffer(), "<i8")
        n, toxic, doc = np.array(tallies, np.int64).reshape(-1, 3).T
        by_term, sizes = np.concatenate([*(i for i, _ in vectors_), np.zeros(0, np.int32)]), [len(i) for i, _ in vectors_]
        with_toxic, with_any = (np.bincount(by_term, np.repeat(x, sizes), minlength=len(terms)) for x in (toxic, n))
        idf = (np.log((1 + total) / (1 + df)) + 1) * telling(with_any - with_toxic, with_toxic, int((n - toxic).sum()), int(toxic.sum()), n_terms)
        some = np.array(sizes, np.int64) > 0
        del by_term, with_toxic, with_any, df
        vectors_.reverse()

        def unit():
            while vectors_:
                ids, counts = vectors_.pop()
                if len(ids):
                    w = (1 + np.log(counts)) * idf[ids]
                    yield ids, w / math.sqrt(w @ w)

        write(name + "-index", BlockMaxIndex(unit(), n_terms=len(terms)).arrays() | {"idf": idf, "vocabulary": terms})
        write(name + "-votes", {"n": n[some], "toxic": toxic[some], "doc": doc[some], "none": np.array([n[~some].sum(), toxic[~some].sum()])})
        return {"name": name, "entries": int(some.sum())}

    no = F.lit(None)
    frequency_rows = held_by.select(no.cast("binary").alias("terms"), no.cast("binary").alias("counts"), no.cast("long").alias("n"), no.cast("long").alias("toxic"), no.cast("long").alias("doc_id"), "term", F.col("n").alias("held"))
    built = once(entries.withColumn("term", no.cast("binary")).withColumn("held", no.cast("binary")).unionByName(frequency_rows), weigh, "name string, entries long")
    name = built.name

    def votes() -> Votes:
        a = loaded(name + "-votes")
        return Votes(a["n"], a["toxic"], a["doc"], *a["none"].tolist())

    def left_out(batches):
        a, v = loaded(name + "-index"), votes()
        index, vocabulary, idf = BlockMaxIndex.of(a), a["vocabulary"], a["idf"]
        for b in batches:
            at, vectors = np.searchsorted(v.doc, b.column(2).to_numpy()).tolist(), []
            for t, c in zip(b.column(0), b.column(1), strict=True):
                ids = np.searchsorted(vocabulary, np.frombuffer(t.as_buffer(), "<i8"))
                w = (1 + np.log(times_of(c, len(ids)))) * idf[ids]
                vectors.append((ids, w / math.sqrt(w @ w)))
            seen = v.left_out(index, at, vectors, k)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in seen], kind) for i, kind in ((0, pa.float64()), (1, pa.int64()), (2, pa.int64()))], names=["raw", "label", "n"])

    # at most two rows for each of the examples
    asked = entries.where("length(terms) > 0").select("terms", "counts", "doc_id").repartition(32, "doc_id")
    tried = asked.mapInArrow(trimmed(left_out), "raw double, label long, n long").collect() if built.entries else []
    v = votes()
    tried = sorted([*map(tuple, tried), *([(v.none(), 1, v.toxic_none), (v.none(), 0, v.n_none - v.toxic_none)] if v.n_none else [])])
    starts, scores = pooled(*(np.array(x, float) for x in zip(*tried, strict=True))) if tried else ([0.0], [0.5])

    def search(batches):
        a, memo = loaded(name + "-index"), {}
        index, vocabulary, idf = BlockMaxIndex.of(a), a["vocabulary"], a["idf"]
        for part in (p for b in batches for p in exchange.slices(b)):
            texts = [t or "" for t in part.column(1).to_pylist()]
            digests = list(map(_digest, texts))
            if len(memo) > 10_000:
                memo.clear()
            new = {d: t for d, t in zip(digests, texts, strict=True) if d not in memo}
            queries, norm, some = [], [], []
            rows = list(hashed(list(new.values()), stem))
            for (found, times), at in zip(rows, places(vocabulary, [r[0] for r in rows]), strict=True):
                here = at >= 0
                t = at[here]
                w = (1 + np.log(times[here])) * idf[t]
                queries.append((t, w))
                norm.append(float(w @ w))
                some.append(len(found) > 0)
            for d, near, x, has in zip(new, index.search(queries, k), norm, some, strict=True):
                memo[d] = x, has, [s for s, _ in near], [i for _, i in near]
            out = [memo[d] for d in digests]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *(pa.array([o[i] for o in out], kind) for i, kind in enumerate((pa.float64(), pa.bool_(), pa.list_(pa.float64()), pa.list_(pa.int32()))))], names=["doc_id", "key", "norm", "some", "products", "entries"])

    found = slim.select("doc_id", "text", "key").mapInArrow(trimmed(search), "doc_id long, key long, norm double, some boolean, products array<double>, entries array<int>")

    def judge(left: pa.Table, right: pa.Table) -> pa.Table:
        """Scores of a cell's texts, with what their other terms add to the norms."""
        v, more = votes(), exchange.gathered(right.to_batches(), ADDS)
        keys, at = np.unique(more["key"], return_inverse=True)
        sums = np.zeros(len(keys) + 1, np.int64)
        np.add.at(sums, at, more["add"])
        here = np.searchsorted(keys, own := left.column("key").to_numpy())
        here = np.where((here < len(keys)) & (np.append(keys, 0)[here] == own), here, len(keys))
        found, evidence = [], []
        for extra, norm, some, products, near in zip(sums[here].tolist(), *(left.column(c).to_pylist() for c in ("norm", "some", "products", "entries")), strict=True):
            norm = math.sqrt(norm + extra * UNIT)
            found.append(v.score([(p / norm, i) for p, i in zip(products, near, strict=True)], some, starts, scores))
            evidence.append(v.doc[near].tolist())
        return pa.table({"doc_id": left.column("doc_id"), "score": pa.array(found, pa.float64()), "evidence": pa.array(evidence, pa.list_(pa.int64()))})

    celled = found.withColumn("cell", cell(F.col("key"), n_parts)).groupBy("cell").cogroup(norms.groupBy("cell"))
    scored = celled.applyInArrow(judge, "doc_id long, score double, evidence array<long>")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")
