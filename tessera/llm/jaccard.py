"""Exact Jaccard join of shingle sets by PartEnum signatures, and the groups that its links form.

Sets are put into bands of sizes within the similarity of each other; a pair that is similar enough lies in one band
or in two that follow, so each set is signed for its own band and the next. In a band whose largest size is r, similar
sets differ in at most k shingles, k known from r. The shingle domain is partitioned into n > k parts by hash; similar
sets agree on all but k of the parts, so of the subsets of n - k parts that can be enumerated at least one is common.
With subsets of t parts each, parts ordered by how much they hold, the k + t fullest of each set must share t with the
other's: n - k parts agree, and only n - k - t of them can be left out. Parts that say little are thus never posted.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import exchange
from tessera.llm.components import components
from tessera.llm.shared import discard, keep, mix64, open_file, partitions, scratch, text_bytes, trimmed
from tessera.llm.shingles import set_digest, shingle_sets

KINDS = {"sig": "<u8", "set": "<i8"}


class Bands:
    """Bands of set sizes for similarity num / den."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.last = num, den, [0]

    def of(self, size: int) -> int:
        while self.last[-1] < size:
            self.last.append((self.last[-1] + 1) * self.den // self.num)
        return int(np.searchsorted(self.last, size))

    def differ(self, band: int) -> int:
        """Most shingles in which similar sets of a band differ."""
        self.of(self.last[-1] + 1 if band >= len(self.last) else 0)
        return 2 * self.last[band] * (self.den - self.num) // (self.den + self.num)


def subset_size(k: int) -> int:
    """Parts to a signature. Small sets have few parts, one of which may hold no more than a passage that many share, so
    theirs are signed by two or three together; sets that differ in many shingles have enough in a part."""
    return 3 if k <= 2 else 2 if k <= 12 else 1


def signatures(shingles: np.ndarray, bands: Bands, spare: float = 0.2) -> np.ndarray:
    """The set's signatures; none for a band in which similar sets are equal sets.

    With t parts to a signature the k + t fullest parts are taken: of similar sets' at least t are common, and so is
    one of the subsets of t.
    """
    out, size = [], len(shingles)
    own = bands.of(size)
    scrambled = mix64(shingles)
    for band in (own, own + 1):
        k = bands.differ(band)
        if not k:
            continue
        t = subset_size(k)
        parts = k + t + max(1, int(spare * (k + t)))
        part = ((shingles >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        # shingles are sorted, so each part is a run of them
        edges = np.searchsorted(part, np.arange(parts + 1))
        held = np.diff(edges)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(scrambled)])
        value = mix64((sums[edges[1:]] - sums[edges[:-1]]) ^ mix64(np.arange(parts, dtype=np.uint64) + (np.uint64(band) << np.uint64(32))))
        value = value[np.lexsort((value, -held))[: k + t]]
        if t > 1:
            value = mix64(np.sort(value)[_subsets(k + t, t)]).sum(1, dtype=np.uint64)
        out.append(value)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


@lru_cache(None)
def _subsets(n: int, t: int) -> np.ndarray:
    return np.array(list(combinations(range(n), t)))


def _slim(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def profiles(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n, d1, d2): size and digest of each document's shingle set."""

    def work(batches):
        for b in batches:
            for part in exchange.slices(b, 2 << 20):
                rows = [(len(s), *set_digest(s)) for s in shingle_sets(*text_bytes(part.column(1)), width)]
                n, d1, d2 = zip(*rows, strict=True) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64())], names=["doc_id", "n", "d1", "d2"])

    return _slim(docs).mapInArrow(trimmed(work), "doc_id long, n long, d1 long, d2 long")


def _sets(texts: DataFrame, width: int) -> DataFrame:
    """(node, set) of texts (node, text, d1, d2) whose set has that digest, as sorted 64-bit numbers."""

    def work(batches):
        for b in batches:
            for part in exchange.slices(b, 2 << 20):
                digests = zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)
                rows = [(s.tobytes() if set_digest(s) == d else None) for s, d in zip(shingle_sets(*text_bytes(part.column(1)), width), digests, strict=True)]
                sets = pa.array(rows, pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), sets], names=["node", "set"]).filter(sets.is_valid())

    return texts.mapInArrow(trimmed(work), "node long, set binary")


def similar_groups(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) per row of docs (doc_id, text).

    Documents link when the Jaccard similarity of their sets of `width`-word shingles is num / den at least; words are
    runs of anything but ASCII white space, A-Z lower-cased. component_id is the smallest doc_id that links reach, the
    document's own included. A document of fewer words is one shingle; one without words or text has none and links
    with nothing. Rows that share a doc_id are documents of their own that share a name. A null doc_id gets its size and
    no component. n_links counts
    the other distinct sets that a document's set links with; copies are folded, so each has the links of their set.
    Texts of any length are read whole, in strips; similarities that tie with num / den link; equal rows give equal
    rows. Extra columns, of any name, are left alone, an empty table gives no rows.

    Copies, however many, are collapsed by digest before anything else. The sets that share a signature with others go to
    blocks of like size, and a task counts what sets of two blocks share, each against those that share a signature with
    it; it passes on each set's number of links, and of the links those that join components. So every link is counted,
    and pairs are never rows.
    """
    n_parts = partitions(docs, 8 << 20)
    info = keep(profiles(docs, width))
    firsts = info.where("n > 0").groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))
    firsts = keep(firsts.withColumn("node", F.monotonically_increasing_id()))

    def postings(seen):
        def each(data, offsets, ids):
            bands, sig, sets = Bands(num, den), [], []
            for s in shingle_sets(data, offsets, width):
                digest = set_digest(s)
                if len(s) and digest not in seen:
                    seen.add(digest)
                    sig.append(signatures(s, bands))
                    sets.append(np.full(len(sig[-1]), digest[0], np.int64))
            if sig:
                yield {"sig": np.concatenate(sig), "set": np.concatenate(sets)}

        return each

    posted = exchange.post(docs, n_parts, KINDS, "sig", postings, per_task=set)
    members = _shared(posted, n_parts)
    grouped = keep(members.join(firsts.select(F.col("d1").alias("set"), "node"), "set").select("gid", "node"))
    wanted = firsts.join(grouped.select("node").distinct(), "node", "left_semi").select(F.col("first").alias("doc_id"), "node", "d1", "d2")
    # a document's other texts, if rows share its doc_id, have other digests
    texts = _slim(docs).join(wanted, "doc_id").withColumn("key", F.xxhash64("text")).dropDuplicates(["doc_id", "node", "key"])
    sets = keep(_sets(texts.select("node", "text", "d1", "d2"), width))
    met = keep(_met(grouped, firsts.select("node", "n"), sets, num, den))
    discard(sets)
    found = components(met.where("n IS NULL").select("a", "b").distinct())
    ends = met.where("n IS NOT NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n_links"))
    least = found.join(firsts.select("node", "first"), "node").groupBy("component").agg(F.min("first").alias("component_id"))
    each = firsts.join(found.join(least, "component").select("node", "component_id"), "node", "left").join(ends, "node", "left")
    each = each.select("d1", "d2", "n", "copies", F.coalesce("component_id", "first").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    out = _spread(info, each)
    nulls = docs.where(F.col("doc_id").isNull()).select(F.lit(-1).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sized = profiles(nulls, width).select(F.lit(None).cast("long").alias("doc_id"), F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return out.unionByName(sized)


def _spread(info: DataFrame, each: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links): what holds for each set, for each of its documents.

    Sets of more than a 4096th of all documents, of which there are fewer than 4096, go to every task, so their copies
    stay where they are; documents without shingles are groups of their own.
    """
    keys, total = ["d1", "d2", "n"], info.count()
    each = keep(each)
    large = F.broadcast(each.where(F.col("copies") * 4096 > total))
    some = info.where("n > 0")
    few = some.join(large, keys, "left_anti").join(each, keys)
    none = info.where("n = 0").withColumn("component_id", F.col("doc_id")).withColumn("n_links", F.lit(0).cast("long"))
    out = [d.select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links") for d in (some.join(large, keys), few, none)]
    return out[0].unionByName(out[1]).unionByName(out[2])


def _met(grouped: DataFrame, nodes: DataFrame, sets: DataFrame, num: int, den: int, block_shingles: int = 1_000_000) -> DataFrame:
    """(a, b, n): n null, links a - b that join what links join; b null, n links that node a has in a pair of blocks.

    grouped: (gid, node). The sets are written in blocks by size, each with its groups; the blocks that hold nodes of one
    group, in sizes near enough, meet in a task that reads both and compares what shares a group. A node is in one block,
    so a pair of nodes is counted once.
    """
    spark, folder = grouped.sparkSession, scratch(grouped.sparkSession)
    sized = grouped.groupBy("node").agg(F.collect_set("gid").alias("gids")).join(nodes, "node").withColumn("step", F.floor(F.log("n") * 100).cast("int"))
    # steps of one in a hundred in size; a set counts for some shingles more than it has, so the nodes of a block are bounded
    totals = sized.groupBy("step").agg(F.sum(F.col("n") + 50).alias("n")).orderBy("step").collect()
    steps, n_blocks = _dealt([(r.step, r.n) for r in totals], block_shingles)
    steps = F.broadcast(spark.createDataFrame(steps, "step int, first int, wide int"))
    block = (F.col("first") + F.pmod(F.hash("node"), F.col("wide"))).alias("block")

    def write(batches):
        held: dict[int, dict[int, tuple[bytes, bytes]]] = {}
        for b in batches:
            columns = b.column(0).to_pylist(), b.column(1).to_pylist(), (x.as_buffer().to_pybytes() for x in b.column(2)), (x.values.to_numpy().tobytes() for x in b.column(3))
            for to, node, *data in zip(*columns, strict=True):
                held.setdefault(to, {})[node] = tuple(data)
        for to, rows in held.items():
            name, mark = f"{folder}/block-{to:06d}.arrow", f".{TaskContext.get().taskAttemptId()}.tmp"
            store, path, sink = open_file(name + mark, True)
            ids, (data, gids) = list(rows), zip(*rows.values(), strict=True)
            batch = pa.record_batch({"node": pa.array(ids, pa.int64()), "set": pa.array(data, pa.large_binary()), "gids": pa.array(gids, pa.large_binary())})
            with pa.ipc.new_stream(sink, batch.schema) as out:
                out.write_batch(batch)
            sink.close()
            store.move(path, path[: -len(mark)])
            k = len(ids)
            yield pa.RecordBatch.from_arrays([pa.array([to] * k, pa.int64()), pa.array([name] * k), pa.array(ids, pa.int64()), pa.array([len(x) // 8 for x in data], pa.int64())], names=["block", "path", "node", "n"])

    rows = sized.join(steps, "step").join(sets, "node").select(block, "node", "set", "gids")
    placed = keep(rows.repartitionById(n_blocks, F.col("block")).mapInArrow(trimmed(write), "block long, path string, node long, n long"))
    held = grouped.join(placed, "node").groupBy("gid", "block", "path").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    i, j = (held.select("gid", *(F.col(c).alias(f"{c}_{x}") for c in ("block", "path", "low", "high"))) for x in "ij")
    meet = i.join(j, "gid").where(f"block_i <= block_j AND {num} * low_j <= {den} * high_i AND {num} * low_i <= {den} * high_j").select("path_i", "path_j").distinct()

    def read(path):
        b = pa.ipc.open_stream(open_file(path, False)[2]).read_next_batch()
        return b.column(0).to_numpy(), *([np.frombuffer(x.as_buffer(), kind) for x in b.column(c)] for c, kind in ((1, "<u8"), (2, "<i8")))

    def work(batches):
        for b in batches:
            for path_i, path_j in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                same = path_i == path_j
                node_i, *left = read(path_i)
                node_j, *right = (node_i, *left) if same else read(path_j)
                label = np.arange(len(node_j) + (0 if same else len(node_i)))
                off = 0 if same else len(node_j)
                links_i, links_j = np.zeros(len(node_i), np.int64), np.zeros(len(node_j), np.int64)
                a_out, b_out = [], []
                for x, others in linked(left, right, same, num, den):
                    links_i[x] += len(others)
                    links_j[others] += 1
                    own = label[off + x]
                    roots, first = np.unique(label[others], return_index=True)
                    first = first[roots != own]
                    if len(first):
                        label[np.isin(label, roots)] = own
                        a_out += [int(node_i[x])] * len(first)
                        b_out += node_j[others[first]].tolist()
                ends = [(node_i, links_i), (node_j, links_j)]
                counted, links = (np.concatenate([e[i][e[1] > 0] for e in ends]) for i in (0, 1))
                k, m = len(a_out), len(counted)
                yield pa.RecordBatch.from_arrays([pa.array(np.r_[np.array(a_out, np.int64), counted], pa.int64()), pa.array(b_out + [None] * m, pa.int64()), pa.array([None] * k + links.tolist(), pa.int64())], names=["a", "b", "n"])

    return meet.repartition(4 * n_blocks, "path_i", "path_j").mapInArrow(trimmed(work), "a long, b long, n long")


def _dealt(totals: list[tuple[int, int]], most: int) -> tuple[list[tuple[int, int, int]], int]:
    """(step, first block, blocks) of steps and their totals in rising order, and the number of blocks: a step of more than
    `most` has blocks of its own, small ones that follow each other share one."""
    out, n, filled = [], 0, most
    for step, total in totals:
        k = -(-total // most)
        if filled + total <= most:
            out.append((step, n - 1, 1))
            filled += total
        else:
            out.append((step, n, k))
            n, filled = n + k, total if k == 1 else most
    return out, max(n, 1)


def linked(left: tuple[list, list], right: tuple[list, list], same: bool, num: int, den: int):
    """(x, others) for each set on the left that links with some on the right: positions of x and of those.

    Each side: its sets and the groups of each; what shares no group isn't compared. If both are the same, others come
    after x.
    """
    (sets_i, groups_i), (sets_j, groups_j) = left, right
    n_j, wide = np.array([len(s) for s in sets_j], np.int64), [len(g) for g in groups_i]
    gid, owner = np.concatenate([*groups_j, np.zeros(0, np.int64)]), np.repeat(np.arange(len(sets_j)), [len(g) for g in groups_j])
    order = np.argsort(gid, kind="stable")
    gid, owner, asked = gid[order], owner[order], np.concatenate([*groups_i, np.zeros(0, np.int64)])
    low, high, ends = np.searchsorted(gid, asked), np.searchsorted(gid, asked, "right"), np.cumsum(wide)
    # by set the runs of its groups' owners, those that have any
    some = np.flatnonzero(high > low)
    of, low, high, met = np.searchsorted(ends, some, "right"), low[some].tolist(), high[some].tolist(), np.zeros(len(sets_j), bool)
    xs, first = np.unique(of, return_index=True)
    for x, a, b in zip(xs.tolist(), first.tolist(), [*first[1:].tolist(), len(of)], strict=True):
        for u, v in zip(low[a:b], high[a:b], strict=True):
            met[owner[u:v]] = True
        if same:
            met[: x + 1] = False
        others, n = np.flatnonzero(met), len(sets_i[x])
        met[others] = False
        others = others[(num * n_j[others] <= den * n) & (num * n <= den * n_j[others])]
        if len(others):
            shared = shared_counts(sets_i[x], [sets_j[y] for y in others.tolist()])
            others = others[den * shared >= num * (n + n_j[others] - shared)]
            if len(others):
                yield x, others


def shared_counts(one: np.ndarray, others: list[np.ndarray], most: int = 1 << 20) -> np.ndarray:
    """How many elements a set shares with each of others; sets are sorted, without repeats, and not empty.

    The set's elements are in a table by their last bits. The few that lost their place to another one are searched for.
    """
    size = 1 << (16 * len(one)).bit_length()
    mask, number, known = np.uint64(size - 1), np.arange(1, len(one) + 1, dtype=np.int32), np.concatenate([one[:1], one])
    table, place = np.zeros(size, np.int32), (one & mask).view(np.int64)
    table[place] = number
    lost = one[table[place] != number]
    sizes = np.array([len(s) for s in others], np.int64)
    ends, out, at = np.cumsum(sizes), [], 0
    while at < len(others):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] - sizes[at] + most, "right")))
        flat = np.concatenate(others[at:to])
        held = table[(flat & mask).view(np.int64)]
        # an empty place stands for the first element, whose own place isn't empty
        hit = known[held] == flat
        if len(lost):
            rest = np.flatnonzero((held > 0) & ~hit)
            hit[rest] = lost[np.minimum(np.searchsorted(lost, flat[rest]), len(lost) - 1)] == flat[rest]
        out.append(np.add.reduceat(hit, ends[at:to] - sizes[at:to] - (ends[at] - sizes[at]), dtype=np.int64))
        at = to
    return np.concatenate(out)


def common_counts(left: list[np.ndarray], right: list[np.ndarray], heavy: int = 2048) -> np.ndarray:
    """How many elements each set on the left shares with each on the right; sets are sorted and without repeats.

    The plain form of shared_counts(), for all pairs. An element held by few is counted pair by pair, those held by many as products of 0-1 matrices, some columns at a time.
    """
    out = np.zeros((len(left), len(right)), np.int64)
    owner = [np.repeat(np.arange(len(s)), [len(x) for x in s]) for s in (left, right)]
    value = [np.concatenate([*s, np.zeros(0, np.uint64)]) for s in (left, right)]
    order = [np.argsort(v, kind="stable") for v in value]
    value, owner = [v[o] for v, o in zip(value, order, strict=True)], [w[o] for w, o in zip(owner, order, strict=True)]
    both = np.intersect1d(value[0], value[1])
    first = [np.searchsorted(v, both, "left") for v in value]
    count = [np.searchsorted(v, both, "right") - f for v, f in zip(value, first, strict=True)]
    product = count[0] * count[1]
    light = np.flatnonzero(product <= heavy)
    for at in range(0, len(light), 20_000):
        some = light[at : at + 20_000]
        sizes = product[some]
        inner = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        wide = np.repeat(count[1][some], sizes)
        x = owner[0][np.repeat(first[0][some], sizes) + inner // wide]
        y = owner[1][np.repeat(first[1][some], sizes) + inner % wide]
        out += np.bincount(x * len(right) + y, minlength=out.size).reshape(out.shape)
    dense = np.flatnonzero(product > heavy)
    for at in range(0, len(dense), 1024):
        some = dense[at : at + 1024]
        m = []
        for side, rows in ((0, len(left)), (1, len(right))):
            n = count[side][some]
            column = np.repeat(np.arange(len(some)), n)
            row = owner[side][np.repeat(first[side][some], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            matrix = np.zeros((rows, len(some)), np.float32)
            matrix[row, column] = 1
            m.append(matrix)
        out += np.rint(m[0] @ m[1].T).astype(np.int64)
    return out


def _shared(posted: DataFrame, n_parts: int) -> DataFrame:
    """(gid, set): the distinct lists of sets, by the first half of their digests, that share a signature."""

    def work(batches):
        by: dict[int, list] = {}
        for b in batches:
            for i, k in enumerate(b.column(0).to_pylist()):
                by.setdefault(k, []).append(b.slice(i, 1))
        for parts in by.values():
            c = exchange.gathered(parts, KINDS)
            parts.clear()
            order = np.lexsort((c["set"], c["sig"]))
            sig, doc = c["sig"][order], c["set"][order]
            fresh = np.r_[True, (sig[1:] != sig[:-1]) | (doc[1:] != doc[:-1])]
            sig, doc = sig[fresh], doc[fresh]
            heads = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]]) if len(sig) else np.zeros(0, np.int64)
            sizes = np.diff(np.r_[heads, len(sig)])
            heads, sizes = heads[sizes > 1], sizes[sizes > 1]
            if not len(heads):
                continue
            spot = mix64(doc.view(np.uint64))
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(spot)])
            gid = mix64((sums[heads + sizes] - sums[heads]) ^ mix64(sizes.astype(np.uint64)))
            _, one = np.unique(gid, return_index=True)
            heads, sizes, gid = heads[one], sizes[one], gid[one]
            group = np.repeat(np.arange(len(heads)), sizes)
            at = heads[group] + np.arange(len(group)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            for a in range(0, len(at), 500_000):
                g, x = group[a : a + 500_000], at[a : a + 500_000]
                yield pa.RecordBatch.from_arrays([pa.array(gid.view(np.int64)[g]), pa.array(doc[x])], names=["gid", "set"])

    return posted.repartitionById(n_parts, F.col("bucket")).mapInArrow(trimmed(work), "gid long, set long")
