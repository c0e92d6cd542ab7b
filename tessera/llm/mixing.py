"""Mixing sources to target weights: Sainte-Laguë quotas of equal-token blocks, then seeded selection of blocks."""

from __future__ import annotations

import heapq
import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import WORD, discard, keep

#: Sums that decide something are exact, so that no order of adding matters.
EXACT = "decimal(38,6)"


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def sainte_lague(votes, limits, seats: int) -> list[int]:
    """Seats by highest quotients votes / (2 n + 1), ties to the earlier party; none gets more than its limit.

    A party has floor(votes / d + 1/2) quotients of d / 2 at least. With the least d at which these are not too many, what
    is left to give are quotients that tie, and those go one by one.
    """
    votes, limits = np.asarray(votes, float), np.asarray(limits, np.int64)
    seats = int(min(seats, limits[votes > 0].sum()))
    if seats <= 0:
        return [0] * len(votes)

    def at(d):
        return np.minimum(np.floor(votes / d + 0.5), limits).astype(np.int64)

    high = 4 * votes.max()
    low = votes[votes > 0].min() / (4.0 * max(limits.max(), 1))
    while high > low * (1 + 1e-12):
        middle = math.sqrt(high * low)
        low, high = (middle, high) if at(middle).sum() > seats else (low, middle)
    got = at(high * (1 + 1e-12))
    heap = [(-v / (2 * n + 1), i) for i, (v, n) in enumerate(zip(votes.tolist(), got.tolist(), strict=True)) if v > 0 and n < limits[i]]
    heapq.heapify(heap)
    for _ in range(seats - int(got.sum())):
        _, i = heapq.heappop(heap)
        got[i] += 1
        if got[i] < limits[i]:
            heapq.heappush(heap, (-votes[i] / (2 * got[i] + 1), i))
    return got.tolist()


def seats_of(parties: DataFrame, seats: int) -> DataFrame:
    """parties (name, votes, most, ...) with `seats` by the same rule, ties to the earlier name, however many parties.

    Each round sums up what 64 divisors would give, and goes on between the two that enclose the seats.
    """
    voting = parties.where("votes > 0 AND most > 0")
    top, low, all_ = voting.agg(F.max("votes"), F.min("votes") / (4.0 * F.greatest(F.max("most"), F.lit(1))), F.sum("most")).first()
    if top is None or seats <= 0:
        return parties.withColumn("seats", F.lit(0).cast("long"))
    if all_ <= seats:
        return parties.withColumn("seats", F.when(F.col("votes") > 0, F.col("most")).otherwise(0).cast("long"))

    def given(d):
        return F.when(F.col("votes") > 0, F.least(F.col("most"), F.floor(F.col("votes") / F.lit(d) + 0.5))).otherwise(0).cast("long")

    high, enough = 4.0 * top, 0
    while high > low * (1 + 1e-12) and enough < seats:
        tried = [low * (high / low) ** (i / 65) for i in range(1, 65)]
        sums = voting.agg(*(F.sum(given(d)).alias(f"n{i}") for i, d in enumerate(tried))).first()
        below = [i for i, n in enumerate(sums) if n <= seats]
        if below:
            high, enough = tried[below[0]], sums[below[0]]
        low = tried[below[0] - 1] if below and below[0] else low if below else tried[-1]
    out = parties.withColumn("seats", given(high * (1 + 1e-12)))
    rest = seats - (out.agg(F.sum("seats")).first()[0] or 0)
    if rest:
        # quotients that tie: at most one more for each
        next_ = out.where("votes > 0 AND seats < most").select("name", (F.col("votes") / (2 * F.col("seats") + 1)).alias("quotient"))
        more = next_.orderBy(F.col("quotient").desc(), "name").limit(rest).select("name", F.lit(1).alias("one"))
        out = out.join(more, "name", "left").withColumn("seats", F.col("seats") + F.coalesce("one", F.lit(0))).drop("one")
    return out


def source_targets(sizes: DataFrame, weights=(5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(name, source_size) to (name, source_size, target): weights by rank of name, repeating.

    The sources share `share` times all words by weight; a target stops at `most` times its source's size and the
    rest is shared again: the fixed point is min(most * size, level * weight). Each round shares what the stopped sources
    leave among the others, until no other stops. Ranks are positions in ranges of names and the sizes of the ranges
    before, so no task sorts all names.
    """
    spark = sizes.sparkSession
    placed = sizes.repartitionByRange("name").sortWithinPartitions("name")
    placed = keep(placed.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("place")))
    counts = placed.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect()  # one row for each partition
    before = spark.createDataFrame([(r.part, sum(x.n for x in counts if x.part < r.part)) for r in counts], "part int, before long")
    rank = F.col("place") + F.col("before")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    ranked = keep(placed.join(F.broadcast(before), "part").select("name", "source_size", weight.alias("weight"), (most * F.col("source_size")).alias("cap")))
    discard(placed)
    total, all_weights = ranked.agg(F.sum("source_size"), F.sum(F.col("weight").cast(EXACT))).first()
    whole = share * float(total or 0)
    level, stopped = whole / float(all_weights or 1), -1
    while True:
        stops = F.col("cap") <= level * F.col("weight")
        n, caps, rest = ranked.agg(F.count(F.when(stops, 1)), F.sum(F.when(stops, F.col("cap").cast(EXACT)).otherwise(0)), F.sum(F.when(~stops, F.col("weight").cast(EXACT)).otherwise(0))).first()
        if n == stopped or not rest:
            break
        level, stopped = (whole - float(caps)) / float(rest), n
    return ranked.select("name", "source_size", F.least("cap", F.lit(level) * F.col("weight")).alias("target"))


def mix(docs: DataFrame, weights=(5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0, block: int = 16, shard_words: int = 250_000, seed: int = 20) -> DataFrame:
    """Per row of docs (doc_id, source, text): doc_id, source, size, source_size, target, taken, ranges, text_key.

    size: words of the whole text, null or empty 0. taken: words that the mix takes of the document, repeats
    counted, at most `most` times size: so many whole copies, and the words [first, after) of each of ranges, which are
    the parts of chosen blocks that lie in the document, in order and apart from each other. text_key is xxhash64 of text.

    A source's words, in the seeded order of its documents, are cut into equal blocks of about `block` words. The blocks
    are allocated to the sources by Sainte-Laguë over all their words, with the targets as votes; a source takes whole
    passes over its blocks and then evenly spaced ones from a seeded start. Documents are dealt to shards by a seeded
    hash of doc_id, or of the text where that is null, so that no source, however large, is in one place; a shard's quota
    is what of its source's blocks lies in it, so the shards' quotas add up to the source's.

    The same rows, parameters and seed give the same result. Rows with the same doc_id are documents of their own, and
    rows that are wholly equal take what two documents take; columns beyond these three, of any name, are left alone; an
    empty table gives an empty one; null sources form one source, the last; long texts are documents like others, whose
    blocks are theirs alone; `most` need not be whole: of the last pass so many blocks are the limit.
    """
    key = F.xxhash64(F.col("text").cast("string"))
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source"), word_count(F.col("text")).alias("size"), key.alias("text_key"))
    sized = keep(sized.withColumn("name", F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("text"))))
    targets = source_targets(sized.groupBy("name").agg(F.sum("size").alias("source_size")), weights, share, most)
    # a source's blocks are about `block` words; its votes are in blocks of its own, so a source at its limit votes for just that
    parties = targets.withColumn("blocks", F.when(F.col("source_size") > 0, F.greatest(F.lit(1), F.round(F.col("source_size") / block))).otherwise(0).cast("long"))
    votes = F.when(F.col("source_size") > 0, F.col("target") * F.col("blocks") / F.col("source_size")).otherwise(0.0)
    parties = keep(parties.withColumn("votes", votes).withColumn("most", F.floor(most * F.col("blocks")).cast("long")))
    asked = parties.agg(F.sum(F.col("votes").cast(EXACT))).first()[0] or 0
    quotas = seats_of(parties, int(round(float(asked)))).select("name", "source_size", "target", "blocks", "seats")

    total = sized.agg(F.sum("size")).first()[0] or 0
    shards = max(1, math.ceil(total / shard_words))
    shard = F.pmod(F.xxhash64(F.lit(seed), "doc_id", F.when(F.col("doc_id").isNull(), F.col("text_key"))), F.lit(shards)).cast("int")
    sized = sized.withColumn("shard", shard)
    # where a shard's words of a source begin among all of the source's: sums over groups of shards, then within a group
    parts = sized.groupBy("name", "shard").agg(F.sum("size").alias("words")).withColumn("group", F.expr("shard div 1024"))
    inner = Window.partitionBy("name", "group").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy("name").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = parts.groupBy("name", "group").agg(F.sum("words").alias("w")).select("name", "group", F.coalesce(F.sum("w").over(outer), F.lit(0)).alias("before"))
    parts = parts.withColumn("inside", F.coalesce(F.sum("words").over(inner), F.lit(0))).join(groups, ["name", "group"])
    parts = parts.join(quotas, "name").select("name", "shard", (F.col("before") + F.col("inside")).alias("offset"), "source_size", "target", "blocks", "seats")

    order = Window.partitionBy("name", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id", "size", "text_key")
    placed = sized.withColumn("until", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    j = placed.join(parts, ["name", "shard"]).withColumn("end", F.col("offset") + F.col("until")).withColumn("begin", F.col("end") - F.col("size"))
    j = j.withColumn("passes", F.expr("CASE WHEN blocks > 0 THEN seats div blocks ELSE 0 END")).withColumn("extra", F.expr("CASE WHEN blocks > 0 THEN seats % blocks ELSE 0 END"))
    j = j.withColumn("start", F.pmod(F.xxhash64(F.lit(seed + 2), "name"), F.greatest("blocks", F.lit(1)))).withColumn("width", F.col("source_size") / F.greatest("blocks", F.lit(1)))
    # block i holds a source's words from `at(i)` to `at(i + 1)`; turned by `start`, it is taken if the steps of `extra` / `blocks` reach a new integer in it
    at = "IF({0} >= blocks, source_size, CAST(floor({0} * width) AS BIGINT))"
    turned = "(i + start) % blocks"
    step = "floor(0.5D + ({0}) * (CAST(extra AS DOUBLE) / blocks))"
    near = "sequence(greatest(0L, CAST(floor(begin / width) AS BIGINT) - 1), least(blocks - 1, CAST(floor((end - 1) / width) AS BIGINT) + 1))"
    chosen = f"filter({near}, i -> {step.format(turned + ' + 1')} > {step.format(turned)})"
    spans = f"transform({chosen}, i -> named_struct('first', greatest({at.format('i')}, begin) - begin, 'after', least({at.format('(i + 1)')}, end) - begin))"
    spans = f"filter({spans}, r -> r.first < r.after)"
    j = j.withColumn("ranges", F.expr(f"CASE WHEN size > 0 AND extra > 0 THEN {spans} ELSE CAST(array() AS array<struct<first: bigint, after: bigint>>) END"))
    taken = F.col("passes") * F.col("size") + F.aggregate("ranges", F.lit(0).cast("long"), lambda n, r: n + r["after"] - r["first"])
    return j.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), "ranges", "text_key")
