"""Hot groups, repeated ids, odd labels and exact rules: what must hold however the rows are shared out."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import chunking, exchange, jaccard, mixing, packing, permutation, repeats, shingles, topk, toxicity, unigram
from tessera.llm.queries import tokenizer
from tessera.llm.shared import Memo

LINE = "This licence line stands in a third of all documents, whatever else they say. "


def test_fold():
    """Of a task's equal anchors only the first holder's are posted; the verdicts come out the same as without folding."""
    rng = np.random.default_rng(3)
    n = 4000
    c = {"hash": rng.integers(0, 9, n).astype(np.uint64), "context": rng.integers(0, 3, n).astype(np.uint64), "doc": rng.integers(0, 500, n), "pos": rng.integers(0, 50, n).astype(np.int32)}
    left, sure = repeats.fold(c, 7)
    assert len(left["hash"]) < n // 20 and len(left["hash"]) + len(sure["doc"]) == n

    def gone(v):
        return Counter((int(d), int(p), int(h)) for d, p, h, m in zip(v["doc"], v["pos"], v["hash"], v["mask"]) if m == 7)

    assert gone(repeats.first_holders(c, 7)) == gone(repeats.first_holders(left, 7)) + gone(sure)


def test_hot_line(spark):
    """10^5 copies of a line and 10^4 rows without doc_id: no task gets more than a few postings of the line."""
    n = 100_000
    docs = spark.range(n).select(F.when(F.col("id") % 10 == 9, None).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit(LINE), F.lit("doc "), F.col("id").cast("string")).alias("text")).repartition(8)
    counted = exchange.post(docs, 16, repeats.ANCHORS, "hash", lambda d, o, i: repeats.anchors(d, o, i, 50), fold=lambda c: repeats.fold(c, 2**31 - 1), verdicts=repeats.VERDICTS)
    rows = counted.where("hash IS NOT NULL").select((F.octet_length("hash") / 8).alias("n"), "bucket").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    assert max(r.n for r in rows) < n  # the line alone has several anchors a document
    got = repeats.remove_repeats(docs).select("doc_id", F.octet_length("kept").alias("n"), F.size("spans").alias("spans"))
    kept = got.groupBy((F.col("doc_id").isNull()).alias("none"), (F.col("n") > 50).alias("whole")).agg(F.count("*").alias("n")).collect()
    assert {(r.none, r.whole): r.n for r in kept} == {(True, True): 10_000, (False, True): 1, (False, False): 89_999}


def test_chunk_copies(spark):
    rows = [(i, LINE * 6 + (f"end {i}" if i % 2 else "")) for i in range(400)] + [(None, LINE * 6)] * 50
    got = chunking.remove_chunks(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), compared=1).collect()
    assert all(bytes(r.kept) == (LINE * 6).encode() for r in got if r.doc_id is None)
    assert {r.doc_id: len(r.kept) for r in got}[2] == 0 and len(got) == 450


def test_copies_join(spark):
    """A set of a third of all documents, a near copy of it, and documents without words."""
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(i, text) for i in range(1000)] + [(5000, text + " more"), (5001, ""), (5002, None), (5003, "other words entirely here now")] + [(7, "a second text of one id that is quite different from others")]
    got = jaccard.similar_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    by = defaultdict(set)
    for r in got:
        by[r.doc_id].add((r.component_id, r.n_links))
    assert len(got) == len(rows) and by[999] == {(0, 1)} and by[5000] == {(0, 1)} and by[5001] == {(5001, 0)} and by[7] == {(0, 1), (7, 0)}


def test_only_groups_are_compared(monkeypatch):
    """Of 2000 sets of like size, in groups of two or three, none meets a set of another group; counts are exact."""
    rng = np.random.default_rng(8)
    shared, asked = jaccard.shared_counts, []
    monkeypatch.setattr(jaccard, "shared_counts", lambda one, others: asked.append(len(others)) or shared(one, others))
    base = [np.unique(rng.integers(0, 2**63, 40).astype(np.uint64)) for _ in range(900)]
    sets = [b[cut:] for cut in (0, 1) for b in base] + [b[6:] for b in base[:200]]
    groups = [np.array([i % 900 if i < 1800 else i - 1800]) for i in range(2000)]
    pairs = {(x, y) for x, others in jaccard.linked((sets, groups), (sets, groups), True, 17, 20) for y in others.tolist()}
    assert pairs == {(i, i + 900) for i in range(900)} | {(i + 900 * c, i + 1800) for i in range(200) for c in (0, 1)}
    assert sum(asked) == 900 + 2 * 200
    crossed = {(x, y) for x, others in jaccard.linked((sets[:900], groups[:900]), (sets[900:], groups[900:]), False, 17, 20) for y in others.tolist()}
    assert crossed == {(x, y - 900) for x, y in pairs if x < 900}


@pytest.mark.parametrize("scale", [1, 2**20, 2**40])
def test_shared_counts(scale):
    """Also where all elements have the same last bits."""
    rng = np.random.default_rng(9)
    one, *others = (np.unique(rng.integers(0, 300, k).astype(np.uint64) * np.uint64(scale)) for k in (100, *rng.integers(1, 90, 60)))
    for most in (1, 200, 1 << 20):
        assert jaccard.shared_counts(one, others, most).tolist() == [len(np.intersect1d(one, o)) for o in others]


def test_size_steps():
    """A step too large for a block has blocks of its own, small neighbours share one, and none is lost."""
    steps, n = jaccard._dealt([(1, 30), (2, 50), (3, 30), (4, 250), (5, 10), (6, 10)], 100)
    assert steps == [(1, 0, 1), (2, 0, 1), (3, 1, 1), (4, 2, 3), (5, 5, 1), (6, 5, 1)] and n == 6
    assert jaccard._dealt([], 100) == ([], 1)


def test_long_word(monkeypatch):
    """Words longer than a strip hash as they would in one piece."""
    data = np.frombuffer(b"ab cdefghijklmnop qr", np.uint8)
    whole, _ = shingles.words(data, np.array([0, len(data)]))
    monkeypatch.setattr(shingles, "STRIP", 5)
    shingles._powers.cache_clear()
    parts, counts = shingles.words(data, np.array([0, len(data)]))
    shingles._powers.cache_clear()
    assert (whole == parts).all() and counts.tolist() == [3]


def test_hashed_features(monkeypatch):
    rng = random.Random(1)
    texts = ["".join(rng.choice("aB é'\n.1 ,ñ\t<|Σxyz_²ⅷ中文") for _ in range(rng.randint(0, 60))) for _ in range(200)] + ["abcdefghijklmnopqrstuvwxyz abcd", None, ""]
    first = list(toxicity.hashed(texts, 4))
    monkeypatch.setattr(toxicity, "STRIP", 7)
    toxicity._powers.cache_clear()
    second = list(toxicity.hashed(texts, 4, 50))
    toxicity._powers.cache_clear()
    for t, a, b in zip(texts, first, second):
        assert sorted(toxicity.features(t, 4).values()) == sorted(a[1].tolist()) and (a[0] == b[0]).all() and (a[1] == b[1]).all()


def test_pooled():
    """The steps are the best rising fit: no split of the raw values into rising steps is nearer to the labels."""
    rng = random.Random(2)
    for _ in range(40):
        rows = [(rng.randint(0, 6) / 6, rng.randint(0, 1), rng.randint(1, 3)) for _ in range(rng.randint(1, 9))]
        starts, scores = toxicity.pooled(*(np.array(x, float) for x in zip(*rows)))
        assert starts == sorted(starts) and all(a < b for a, b in zip(scores, scores[1:]))
        values = sorted({r for r, _, _ in rows})

        def loss(fit):
            return sum(w * (y - fit[r]) ** 2 for r, y, w in rows)

        mine = {r: scores[max(i for i, s in enumerate(starts) if s <= r)] for r in values}
        grid = [i / 12 for i in range(13)]
        reach = {g: 0.0 for g in grid}
        for r in values:  # the best fit on a grid, by the last value taken
            cost = lambda g, r=r: sum(w * (y - g) ** 2 for x, y, w in rows if x == r)
            reach = {g: min(c for h, c in reach.items() if h <= g) + cost(g) for g in grid}
        assert loss(mine) <= min(reach.values()) + 1e-9


def test_arrays_are_written_as_they_are(tmp_path):
    """A file of arrays costs no copy of them: what Python allocates meanwhile is less than a tenth."""
    import tracemalloc

    arrays = {"a": np.arange(1_000_000), "b": np.zeros((3, 0), np.float32), "c": np.arange(12, dtype="<u2").reshape(3, 4)}
    tracemalloc.start()
    toxicity.write((tmp_path / "x").as_uri(), arrays)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < arrays["a"].nbytes / 10
    got = toxicity.loaded((tmp_path / "x").as_uri())
    assert all((got[k] == v).all() and got[k].dtype == v.dtype and got[k].shape == v.shape for k, v in arrays.items()) and len(got) == 3


def test_index_of_many_blocks():
    """Frequent and rare terms, more queries than go together, and more runs than a piece holds, against plain sums."""
    rng = np.random.default_rng(12)
    share = 1 / np.arange(1, 701) ** 0.6
    vectors = [{int(t): float(rng.random()) for t in np.flatnonzero(rng.random(700) < share)} for _ in range(900)]
    index = toxicity.BlockMaxIndex(vectors)
    queries = [(np.fromiter(v, np.int64), np.fromiter(v.values(), float)) for v in vectors[:300]] + [(np.arange(700), rng.random(700))]
    assert index.owner.itemsize == 4
    full = np.zeros((900, 700))
    for i, v in enumerate(vectors):
        full[i, list(v)] = list(v.values())
    for (t, w), near in zip(queries, index.search(queries, 12), strict=True):
        scores = full[:, t] @ w
        assert [e for _, e in near] == np.lexsort((np.arange(900), -scores))[:12].tolist()
        assert np.allclose([s for s, _ in near], np.sort(scores)[::-1][:12], rtol=1e-12)
    assert index.read <= index.asked


def test_index_of_several_languages(monkeypatch):
    """Entries of each language are a part with frequent terms of its own: a query is multiplied with little else, its
    results are those of brute force whatever it is asked with, and lists are the same in pieces."""
    rng = np.random.default_rng(4)
    share = 1 / np.arange(1, 201) ** 0.5

    def vector(language):
        terms = np.flatnonzero(rng.random(200) < share) * 4 + language
        return {int(t): 0.1 + float(rng.random()) for t in [*terms, *(800 + np.flatnonzero(rng.random(3) < 0.3))]}

    vectors = [vector(i % 4) for i in range(2000)]
    index = toxicity.BlockMaxIndex(vectors, block=16)
    queries = [(np.fromiter(v, np.int64), np.fromiter(v.values(), float)) for v in [vector(i % 4) for i in range(300)] + vectors[:20] + [{800: 1.0}, {}]]
    full = np.zeros((2000, 803))
    for i, v in enumerate(vectors):
        full[i, list(v)] = list(v.values())
    found = index.search(queries, 12)
    for (t, w), near in zip(queries, found, strict=True):
        scores = full[:, t] @ w
        want = [e for e in np.lexsort((np.arange(2000), -scores))[:12].tolist() if scores[e] > 0]
        assert np.allclose([s for s, _ in near], scores[want], rtol=1e-12) and len(near) == len(want)
    assert index.read < 0.5 * index.asked
    assert [index.search([q], 12)[0] for q in queries[::7]] == found[::7]
    again = toxicity.BlockMaxIndex.of(index.arrays())
    assert again.search(queries, 12) == found
    monkeypatch.setattr(toxicity, "PIECE", 50)
    for near, other in zip(found, again.search(queries, 12), strict=True):
        assert np.allclose([s for s, _ in near], [s for s, _ in other], rtol=1e-12)


def test_odd_labels(spark):
    """Labels beyond 0 and 1 are none; equal examples vote each; a doc_id that is labelled both ways is toxic; scores are the
    same whatever the order of rows."""
    texts = [(i, "kalo mipor grobian" if i % 2 else "kalo mipor tusti") for i in range(60)] + [(60, "kalo mipor grobian"), (61, "kalo mipor tusti")]
    labels = [(i, i % 2) for i in range(50)] + [(50, 7), (51, -1), (52, None), (3, 0)]
    df, known = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    a = {r.doc_id: (r.score, tuple(r.evidence)) for r in toxicity.score_documents(df.repartition(3), known).collect()}
    b = {r.doc_id: (r.score, tuple(r.evidence)) for r in toxicity.score_documents(df.repartition(7), known.orderBy(F.desc("doc_id"))).collect()}
    assert a == b and a[60][0] > 0.9 and a[61][0] < 0.1
    assert a[60][1][0] == min(i for i in range(1, 50, 2) if zlib.crc32(str(i).encode()) % 4 != 2)


def test_votes_by_hand():
    v = toxicity.Votes(np.array([2, 1]), np.array([1, 0]), np.array([5, 9]), 1, 0)
    base = (1 + 0 + 1) / (3 + 1 + 2)
    near = [(0.8, 0), (0.5, 1)]
    w = [1 / (1.02 - 0.8), 1 / (1.02 - 0.5)]
    assert abs(v.share(near) - (base + w[0]) / (1 + 2 * w[0] + w[1])) < 1e-12
    assert abs(v.share(near, (0, 1)) - base / (1 + w[0] + w[1])) < 1e-12 and v.none() == base / 2


def plain_seats(votes, limits, seats):
    got = [0] * len(votes)
    for _ in range(seats):
        open_ = [i for i in range(len(votes)) if votes[i] > 0 and got[i] < limits[i]]
        if not open_:
            break
        got[max(open_, key=lambda i: (votes[i] / (2 * got[i] + 1), -i))] += 1
    return got


def test_sainte_lague_rule():
    """The rule itself, whatever the parties: many small ones beside a large one too."""
    rng = random.Random(3)
    for _ in range(300):
        votes = [rng.choice([0, 1, 5, 8.5, 100, 0.6, rng.random() * 50]) for _ in range(rng.randint(1, 8))]
        limits, seats = [rng.randint(0, 20) for _ in votes], rng.randint(0, 60)
        assert mixing.sainte_lague(votes, limits, seats) == plain_seats(votes, limits, seats)
    many = [400.0] + [0.6] * 1000
    assert mixing.sainte_lague(many, [10**6] * 1001, 1000)[0] == 333
    assert mixing.sainte_lague([100.0] + [0.6] * 100, [10**6] * 101, 160)[0] == 83


@pytest.mark.parametrize("seats", [0, 7, 40, 10**6])
def test_seats_of(spark, seats):
    """The distributed form of the rule gives the same seats, ties by name."""
    rng = random.Random(seats)
    rows = [(f"n{i:03d}", rng.choice([1.0, 0.6, 2.0, 30.0, 0.0]), rng.randint(0, 9)) for i in range(60)]
    got = {r["name"]: r.seats for r in mixing.seats_of(spark.createDataFrame(rows, "name string, votes double, most long"), seats).collect()}
    assert [got[n] for n, _, _ in rows] == plain_seats([v for _, v, _ in rows], [m for _, _, m in rows], min(seats, 600))


def test_many_sources(spark):
    """Hundreds of tiny sources: each gets what its target says, whatever the number of shards."""
    rows = [(i, " ".join(["w"] * 5), f"s{i % 300:03d}") for i in range(600)] + [(1000 + i, " ".join(["big"] * 400), "a") for i in range(40)] + [(None, "null id words", "a"), (2000, None, "a"), (2001, "x y", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for shard_words in (200, 10**6):
        got = mixing.mix(df.repartition(4), shard_words=shard_words).collect()
        taken, target, size = Counter(), {}, {}
        for r in got:
            taken[r.source] += r.taken
            target[r.source], size[r.source] = r.target, r.source_size
            assert r.taken <= 2 * r.size
        assert len(got) == len(rows) and all(abs(taken[s] - t) <= max(8, 0.5 * size[s] + 1) for s, t in target.items())
        assert all(taken[s] == t for s, t in target.items() if t == 2 * size[s])


def test_memo():
    made = []
    memo = Memo(lambda p: made.append(p) or p.upper().encode(), 3)
    for piece in "abcdabcdabcd":
        assert memo[piece] == piece.upper().encode()
    assert memo.joined(["a", "zz", "a"]) == b"AZZA" and len(memo.young) <= 3 and len(memo.old) <= 3
    memo["x" * 100]
    assert "x" * 100 not in memo.young


def test_unigram_lengths():
    """Words of any length go through the trie, walked by levels or one after the other, with the plain rule's counts."""
    rng = random.Random(1)
    model = unigram.Unigram({b"a": -1.0, b"b": -2.0, b"ab": -2.5, b"abc": -3.0, b"bc": -2.9, b"c": -4.0}, width=4)
    words = sorted({bytes(rng.choice(b"abcd") for _ in range(rng.randint(1, 70))) for _ in range(400)} | {b"abc" * 300, b"abc" * 300 + b"d", b""})
    assert model.count(words) == [model.one(w) if w else 0 for w in words]


def test_reading_stops():
    """Reading stops before the lists' end, rows drop out, and the scores are those of all rows."""
    rng = np.random.default_rng(0)
    for skew in (1.0, 0.7):
        values = np.floor(1024 * rng.normal(size=(1500, 32)) * skew ** np.arange(32))
        queries, reading = values[:8], topk.Reading()
        at, row, score = topk.no_random_access(topk.sorted_lists(values), queries, 5, reading)
        for i, q in enumerate(queries):
            whole = values @ q
            best = set(np.flatnonzero(whole >= np.sort(whole)[-5]).tolist())
            mine = dict(zip(row[at == i].tolist(), score[at == i].tolist()))
            assert best <= set(mine) and all(mine[r] == whole[r] for r in mine)
        assert reading.entries < reading.of and reading.resolved / reading.queries < 1500 / 8
        assert skew == 1.0 or reading.entries < 0.8 * reading.of


def test_bound_of_blocks_before():
    """A query's k-th best score so far ends the reading of the next block at far less depth, and no better row is lost."""
    rng = np.random.default_rng(4)
    values = np.floor(1024 * rng.normal(size=(8000, 32)))
    queries, k = values[:16], 5
    values[5000], values[6000] = values[100], values[100]
    bound, best, shares = np.full(16, -np.inf), [[] for _ in queries], []
    for a in range(0, 8000, 2000):
        reading = topk.Reading()
        at, row, score = topk.no_random_access(topk.sorted_lists(values[a : a + 2000]), queries, k, reading, bound)
        shares.append(reading.entries / reading.of)
        for i in range(16):
            best[i] = sorted(best[i] + [(-s, a + r) for s, r in zip(score[at == i].tolist(), row[at == i].tolist())])[:k]
            bound[i] = -best[i][-1][0]
    for i, q in enumerate(queries):
        whole = values @ q
        assert best[i] == sorted(zip((-whole).tolist(), range(8000)))[:k]
    assert max(shares[1:]) < 0.7 < 0.8 < shares[0] and shares[-1] < 0.6


def test_bound_beyond_exact_sums():
    """Copies that tie with the bound stay, even where sums are so large that they are rounded."""
    rng = np.random.default_rng(6)
    values = np.floor(1e9 * rng.normal(size=(3000, 33)))
    for q in values[:20]:
        values[1000:1100] = q
        lists, bound = topk.sorted_lists(values), np.array([np.float64(q @ q)])
        for least in (None, bound, np.nextafter(bound, np.inf)):
            _, row, _ = topk.no_random_access(lists, q[None], 3, least=least)
            assert set(range(1000, 1100)) <= set(row.tolist())


def test_products_over_blocks(spark):
    """Several index blocks read in turn give what brute force gives: ties to the smaller id, copies, fewer rows than k, weights of zero."""
    rng = np.random.default_rng(8)
    values = np.round(rng.normal(size=(9000, 6)), 1)
    values[rng.integers(0, 9000, 2500)] = values[300]
    values[600] = 0
    rows = [(i, v) for i, v in enumerate(values.tolist())] + [(900, [1.0, -2.0]), (10900, [0.5, 0.5]), (1200, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in topk.top_products(df, "vec_id", "embedding", F.col("id") % 300 == 0, 10).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    ints, ids = np.floor(1024 * values), np.arange(9000)
    for q in range(0, 9000, 300):
        score = ints @ ints[q]
        order = [j for j in np.lexsort((ids, -score)).tolist() if j != q][:10]
        want = [(n + 1, j, int(score[j])) for n, j in enumerate(order)]
        assert q in (900, 1200) or got[q] == want
    assert len(got[900]) == 12 and {(r, i) for r, i, _ in got[900]} >= {(1, 10900), (2, 1200)} and len(got[1200]) == 12


@pytest.mark.parametrize("search", [topk.top_products, permutation.nearest])
def test_repeated_vectors(spark, search):
    """Rows that share an id are candidates and queries of their own, and none is its own id's candidate."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(50)] + [(100, [1.0] * 6), (100, [-1.0] * 6), (7, [1.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = search(df, "vec_id", "embedding", F.col("id") == 100, 4).collect()
    assert len(got) == 8 and Counter(r["rank"] for r in got) == Counter({1: 2, 2: 2, 3: 2, 4: 2}) and all(r.vec_id != 100 for r in got)


@pytest.mark.parametrize("search", [topk.top_products, permutation.nearest])
def test_vectors_stay_out_of_the_driver(spark, search):
    """Blocks are joined by the names of their files: sides that Spark may broadcast hold no vectors."""
    df = spark.range(300).select("id", F.array(*(F.rand(i) for i in range(4))).alias("v"))
    found = search(df, "id", "v", F.col("id") % 10 == 0)
    nodes, sides = [found._jdf.queryExecution().optimizedPlan()], []
    while nodes:
        node = nodes.pop()
        children = [node.children().apply(i) for i in range(node.children().size())]
        nodes += children
        if node.getClass().getSimpleName() == "Join":
            sides += [c.output().apply(i).dataType().typeName() for c in children for i in range(c.output().size())]
    assert sides and not {"binary", "array"} & set(sides)
    assert found.count() == 300


@pytest.mark.parametrize("n", [1, 40, 1500, 4000])
def test_first_by_hash(spark, n):
    vectors = spark.range(0, 3000, numPartitions=7).select("id", F.array(F.col("id").cast("double")).alias("v"))
    plain = vectors.orderBy(F.xxhash64(F.lit(7), "id"), "id").limit(n).collect()
    assert permutation.first_by_hash(vectors, n, 7) == plain


def test_recall(spark):
    """The query's own parameters find nine of ten nearest vectors."""
    rng = np.random.default_rng(9)
    m = rng.normal(size=(3000, 64))
    m /= np.linalg.norm(m, axis=1)[:, None]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "vec_id long, embedding array<double>")
    found = defaultdict(set)
    for r in permutation.nearest(df, "vec_id", "embedding", F.col("id") % 100 == 0).collect():
        found[r.query_id].add(r.vec_id)
    hits = [len(found[q] & set(np.argsort(((m - m[q]) ** 2).sum(1), kind="stable")[1:11].tolist())) / 10 for q in range(0, 3000, 100)]
    assert np.mean(hits) >= 0.9


def test_packed_pieces(spark):
    """Each document's ids, put together from its pieces, are its ids."""
    from tokenizers import Tokenizer

    rng = random.Random(7)
    whole = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma9", "x,y"]) for _ in range(rng.randint(0, 400)))) for i in range(60)] + [(None, "null id"), (3, "another text of an id"), (99, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    pieces = packing.pack_documents(df, tokenizer("byte_bpe_50k.json"), capacity=128).collect()
    by = defaultdict(list)
    for r in pieces:
        by[r.doc_id, r.doc_tokens].append(r)
    for i, t in rows:
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        mine, at = sorted(by[i, len(ids)], key=lambda r: r.start), 0
        for r in mine:
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)


def test_stages(spark, tmp_path):
    """What each stage keeps, on its own input: toxic documents go and clean ones stay, letters that were there stay, and rows
    that share an id keep their own texts."""
    import corpus_pipeline as pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, cell string"
    bad = [(i, f"grobian blödmann grobian kalo {i}" if i % 3 == 0 else f"tusti mipor renkan kalo {i}", "en", "s", 9, "x") for i in range(90)]
    spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = {r.doc_id for r in pipeline.clean(spark, spark.createDataFrame(bad, schema), str(tmp_path)).collect()}
    assert {i for i in range(60, 90)} & kept == {i for i in range(60, 90) if i % 3}
    passage = "a passage that is repeated, with a letter � that was there before all"
    rows = [(1, passage + " one", "en", "s", 3, "c"), (2, "begin " + passage + " end �", "en", "t", 3, "c"), (2, "the same id, another text", "en", "t", 3, "c"), (3, passage, "en", "s", 3, "c"), (4, None, "en", "s", 0, "c"), (None, passage, "en", "s", 3, "c")]
    docs = spark.createDataFrame(rows, schema)
    got = sorted(((r.doc_id or 0, r.text or "") for r in pipeline.trim(spark, docs, "").collect()))
    assert got == [(0, passage), (1, passage + " one"), (2, "begin end �"), (2, "the same id, another text"), (4, "")]
    mixed = pipeline.mix(spark, docs, "").collect()
    assert all(set(r.text.split()) <= set(" ".join(x[1] or "" for x in rows).split()) for r in mixed) and {r.doc_id for r in mixed} >= {1, 2}
    packed = pipeline.pack(spark, docs, "").groupBy("doc_id").agg(F.countDistinct("doc_tokens").alias("n")).collect()
    assert {r.doc_id: r.n for r in packed}[2] == 2


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_of_a_run(name, monkeypatch):
    """Packing's ids of texts taken together are the tokenizer's; what is frequent in a run is looked up once in it."""
    from tokenizers import Tokenizer

    from tessera.llm import encoding

    rng, path = random.Random(5), tokenizer(name)
    texts = [None, "", " ", "a  b", "one\ntwo three.", "ends,*** (here) x", "don't we've. it's'", "a<|endoftext|>. b", "a\x01b", "日本. über, éa", "... !", "a.b,c", "x_y._", "½. Ⅷ, 7."]
    texts += ["".join(rng.choice("aB é'\n.1 ,ñ*<|Σ_") for _ in range(rng.randint(1, 30))) for _ in range(400)] + ["the end, of it\nall. " * 50 + "x"] * 40
    whole, asked = Tokenizer.from_file(path), []
    code = encoding.Encoder(path, 50)
    each = code.words.each
    monkeypatch.setattr(code.words, "each", lambda pieces: asked.append(len(pieces)) or each(pieces))
    want = [whole.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in code.all_ids(texts)] == want
    if code.kind == "spaced":
        assert sum(asked) < sum(len((t or "").split()) for t in texts) / 5
    monkeypatch.setattr(encoding, "RUN", 12)  # longer texts are taken alone
    assert [np.frombuffer(x, "<u4").tolist() for x in code.all_ids(texts)] == want
    assert list(code.all_ids([])) == [] and list(code.all_ids([None, " "])) == [b"", code.ids(" ")]


def test_index_is_built_in_little_memory():
    """Entries that an iterator gives are not kept beside the lists, and lists are put in order by narrow numbers."""
    import tracemalloc

    rng = np.random.default_rng(6)

    def vectors():
        for _ in range(2000):
            yield np.unique(rng.integers(0, 40_000, 400)).astype(np.int32), rng.random(400)

    pairs = ((t, w[: len(t)]) for t, w in vectors())
    tracemalloc.start()
    index = toxicity.BlockMaxIndex(pairs, n_terms=40_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4.2 * (index.owner.nbytes + index.weight.nbytes)
