"""Ownership, reviewers, similar changes and history signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import scores as S
from tessera.operators import changes as C
from tessera.operators import history as H
from tessera.operators import ownership as O
from tessera.sources.bindings import COMMITS_SQL, TOUCHES_SQL

B = f"WITH {COMMITS_SQL}, {TOUCHES_SQL}"
OWNERS = """# owners of parts
/b1/ @One
economy/ @eco x@y.z # the kind
!b3/ @no
b2/small/* @Two
* nobody
"""
RULES = O.owner_rules(OWNERS)
NAMED = "parts AS (SELECT p_partkey AS k, 'b' || p_size % 10 || '/' || lower(p_type) || '/' || p_partkey AS path FROM part)"
FILE_SQL = "fo AS (SELECT path, unnest(CASE WHEN regexp_matches(path, '(^|/)b2/small/[^/]*$') THEN ['two'] WHEN regexp_matches(path, '(^|/)economy/') THEN ['eco', 'x@y.z'] WHEN path LIKE 'b1/%' THEN ['one'] END) AS owner, 0.7::DOUBLE AS score, false AS stale FROM parts)"
AUTHOR_SQL = """an AS (SELECT p.path, 's' || owner AS owner, count(*) AS n, max(touched_at) AS last FROM touches t JOIN parts p ON p.k = t.path GROUP BY 1, 2),
au AS (SELECT path, owner, least(({base}::DOUBLE + {by}::DOUBLE * n / sum(n) OVER (PARTITION BY path)) * (0.6::DOUBLE + 0.4::DOUBLE * least(n / 3.0::DOUBLE, 1.0::DOUBLE)) * CASE WHEN stale THEN 0.55::DOUBLE ELSE 1.0::DOUBLE END, {most}::DOUBLE) AS score, stale
  FROM (SELECT *, epoch_us((SELECT max(touched_at) FROM touches)) - epoch_us(last) > 365 * 86400000000 AS stale FROM an))"""
OWN_SQL = AUTHOR_SQL.format(base="0.30", by="0.32", most="0.62")
CONF = "CASE {0} WHEN 'low' THEN 0.35::DOUBLE WHEN 'medium' THEN 0.6::DOUBLE WHEN 'high' THEN 0.85::DOUBLE ELSE 1.0::DOUBLE END"
MEMORY_SQL = f"me AS (SELECT path, unnest(['one', 'x@y.z', 'bob']) AS owner, least((0.08::DOUBLE + 0.10::DOUBLE * (k % 10) / 10.0::DOUBLE) * {CONF.format('c')}, 0.22::DOUBLE) AS score, k % 2 = 0 AS stale FROM (SELECT *, CASE k % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS c FROM parts WHERE k % 4 = 0))"
OWNERS_SQL = f"""{NAMED}, {FILE_SQL}, {OWN_SQL}, {MEMORY_SQL}, ev AS (SELECT path, owner, 'c' AS source, score, stale FROM fo UNION ALL SELECT path, owner, 'g', score, stale FROM au UNION ALL SELECT path, owner, 'm', score, stale FROM me),
ow AS (SELECT path, owner, coalesce(max(score) FILTER (source = 'c'), 0.0::DOUBLE) AS codeowners, coalesce(max(score) FILTER (source = 'g'), 0.0::DOUBLE) AS git_history, least(coalesce(sum(score) FILTER (source = 'm'), 0.0::DOUBLE), 0.22::DOUBLE) AS memory, bool_and(stale) AS stale FROM ev GROUP BY 1, 2),
ra AS (SELECT *, CASE WHEN codeowners = 0 AND git_history = 0 THEN least(raw, 0.45::DOUBLE) ELSE raw END AS r FROM (SELECT *, least(codeowners + git_history + memory + CASE WHEN stale THEN 0.0::DOUBLE ELSE 0.08::DOUBLE END, 1.0::DOUBLE) AS raw FROM ow)),
cl AS (SELECT *, codeowners = 0 AND round(max(r) OVER (PARTITION BY path) - r, 9) <= 0.08::DOUBLE AS near FROM ra),
owners AS (SELECT path, owner, round(greatest(r - CASE WHEN near AND sum(CAST(near AS INTEGER)) OVER (PARTITION BY path) > 1 THEN 0.12::DOUBLE ELSE 0.0::DOUBLE END, 0.0::DOUBLE), 6) AS score, codeowners, git_history, memory, stale FROM cl)"""
ROLE = "CASE k % 5 WHEN 0 THEN 'approver' WHEN 1 THEN 'reviewer' WHEN 2 THEN 'owner' WHEN 3 THEN 'committer' ELSE 'author' END"
REVIEWERS_SQL = f"""{OWNERS_SQL}, {AUTHOR_SQL.format(base='0.20', by='0.30', most='0.52').replace('an AS', 'bn AS').replace('FROM an', 'FROM bn').replace('au AS', 'bu AS')},
rv AS (SELECT path, 's' || k % 10 AS reviewer, {ROLE} AS role, CASE k % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'high' ELSE 'exact' END AS c, k % 2 = 0 AS stale FROM parts WHERE k % 3 = 0),
sg AS (SELECT path, reviewer AS who, least((CASE role WHEN 'approver' THEN 0.78::DOUBLE WHEN 'reviewer' THEN 0.72::DOUBLE WHEN 'owner' THEN 0.50::DOUBLE WHEN 'committer' THEN 0.40::DOUBLE ELSE 0.35::DOUBLE END + 0.10::DOUBLE * {CONF.format('c')}) * CASE WHEN stale THEN 0.65::DOUBLE ELSE 1.0::DOUBLE END, 0.92::DOUBLE) AS review, 0.0::DOUBLE AS own, 0.0::DOUBLE AS author, stale, role IN ('approver', 'reviewer') AS actual, role = 'owner' AS o, role IN ('author', 'committer') AS a FROM rv
  UNION ALL SELECT path, owner, 0.0, least(score * CASE WHEN codeowners > 0 THEN 0.58::DOUBLE WHEN git_history > 0 THEN 0.46::DOUBLE ELSE 0.30::DOUBLE END, 0.62::DOUBLE), 0.0, stale, false, true, false FROM owners
  UNION ALL SELECT path, owner, 0.0, 0.0, score, stale, false, false, true FROM bu),
wh AS (SELECT path, who, max(review) + max(own) + max(author) AS total, bool_and(stale) AS stale, bool_or(actual) AS actual, bool_or(o) AS o, bool_or(a) AS a FROM sg GROUP BY 1, 2),
cp AS (SELECT *, CASE WHEN actual THEN t ELSE least(t, CASE WHEN o AND a THEN 0.78::DOUBLE WHEN o THEN 0.68::DOUBLE WHEN a THEN 0.62::DOUBLE ELSE 0.0::DOUBLE END) END AS r FROM (SELECT *, least(total + CASE WHEN stale THEN 0.0::DOUBLE ELSE 0.05::DOUBLE END, 1.0::DOUBLE) AS t FROM wh)),
nr AS (SELECT *, NOT actual AND round(max(r) OVER (PARTITION BY path) - r, 9) <= 0.06::DOUBLE AS near FROM cp),
reviewers AS (SELECT path, who AS reviewer, round(greatest(r - CASE WHEN near AND sum(CAST(near AS INTEGER)) OVER (PARTITION BY path) > 1 THEN 0.08::DOUBLE ELSE 0.0::DOUBLE END, 0.0::DOUBLE), 6) AS score, CASE WHEN actual THEN 4 WHEN o AND a THEN 3 WHEN o THEN 2 WHEN a THEN 1 ELSE 0 END AS av FROM nr)"""
AVAILABLE = "(" + str(list(S.AVAILABILITY)) + ")[{0} + 1]"


def _parts(t):
    p = t.raw("part")
    return p.select(F.col("p_partkey").alias("k"), F.concat(F.lit("b"), (F.col("p_size") % 10).cast("string"), F.lit("/"), F.lower("p_type"), F.lit("/"), F.col("p_partkey").cast("string")).alias("path"))


def _authored(t):
    return t.touches.join(_parts(t).select(F.col("k").alias("path"), F.col("path").alias("name")), "path").select(F.col("name").alias("path"), F.concat(F.lit("s"), F.col("owner").cast("string")).alias("owner"), "touched_at")


def _now(t):
    return t.touches.agg(F.max("touched_at")).scalar()


def _owners(t):
    facts = _parts(t).where("k % 4 = 0").select("path", F.lit("ask @One, (mail x@y.z) or @bob. not a@b").alias("text"), (F.col("k") % 10 / 10.0).alias("score"), F.when(F.col("k") % 3 == 0, "low").when(F.col("k") % 3 == 1, "medium").otherwise("high").alias("confidence"), (F.col("k") % 2 == 0).alias("stale"))
    return O.owners(O.by_owner_file(_parts(t), RULES).unionByName(O.by_authors(_authored(t), _now(t))).unionByName(O.by_memory(facts)))


def _reviewers(t):
    role = F.when(F.col("k") % 5 == 0, "approver").when(F.col("k") % 5 == 1, "reviewer").when(F.col("k") % 5 == 2, "owner").when(F.col("k") % 5 == 3, "committer").otherwise("author")
    reviews = _parts(t).where("k % 3 = 0").select("path", F.concat(F.lit("s"), (F.col("k") % 10).cast("string")).alias("reviewer"), role.alias("role"), F.when(F.col("k") % 3 == 0, "low").when(F.col("k") % 3 == 1, "high").otherwise("exact").alias("confidence"), (F.col("k") % 2 == 0).alias("stale"))
    return O.reviewers(reviews, _owners(t), O.by_authors(_authored(t), _now(t), 0.20, 0.30, 0.52))


def _renamed(t):
    return t.touches.withColumn("previous", F.when(F.col("touch") % 4 == 0, (F.col("path") * 7 + 3) % 200))


def _symbol_touches(t):
    s = t.touches.withColumn("symbol_id", F.col("path") * 10 + F.col("touch") % 3)
    return s.withColumn("qualified_name", F.concat(F.lit("m"), (F.col("path") % 50).cast("string"), F.lit("::Sym"), F.col("symbol_id").cast("string"))).withColumn("confidence", F.when(F.col("touch") % 3 == 0, "low").when(F.col("touch") % 3 == 1, "medium").otherwise("high"))


SYMBOLS = "st AS (SELECT *, path * 10 + touch % 3 AS symbol_id, 'm' || path % 50 || '::Sym' || (path * 10 + touch % 3) AS qualified_name, CASE touch % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS confidence FROM touches)"
SAMPLES_SQL = """f AS (SELECT DISTINCT commit_id, path FROM touches), ok AS (SELECT commit_id FROM f GROUP BY 1 HAVING count(*) BETWEEN 2 AND 50),
w AS (SELECT commit_id, 1 / (1 + (row_number() OVER (ORDER BY date_trunc('day', committed_at) DESC, committed_at DESC, commit_id) - 1) / 25.0::DOUBLE) AS weight FROM commits),
g AS (SELECT f.commit_id, path, weight FROM f JOIN ok USING (commit_id) JOIN w USING (commit_id)),
pr AS (SELECT a.path, b.path AS other, a.commit_id, a.weight, row_number() OVER (PARTITION BY a.path, b.path ORDER BY a.weight DESC) AS i FROM g a JOIN g b ON a.commit_id = b.commit_id AND a.path <> b.path),
pairs AS (SELECT path, other, count(*) AS commits, round(sum(weight), 4) AS recency, list(commit_id ORDER BY weight DESC) FILTER (i <= 5) AS samples FROM pr GROUP BY 1, 2)"""
CHURN = "hs AS (SELECT path, round(r * ln(1 + n) + ln(1 + v) / 10, 6) AS hotspot, n AS touches FROM (SELECT path, count(*) AS n, sum(additions) AS v, sum(1 / (1 + (epoch_us((SELECT max(touched_at) FROM touches)) - epoch_us(touched_at)) / 86400000000.0::DOUBLE / 30)) AS r FROM touches GROUP BY 1))"
SIMILAR_SQL = f"""{B}, {SYMBOLS}, {SAMPLES_SQL}, {CHURN}, pool AS (SELECT * FROM commits ORDER BY committed_at DESC, commit_id LIMIT 1600), tm AS (SELECT *, CASE WHEN touch % 4 = 0 THEN (path * 7 + 3) % 200 END AS previous FROM touches WHERE commit_id IN (SELECT commit_id FROM pool)),
p1 AS (SELECT commit_id, least(n * 0.08::DOUBLE, 0.32::DOUBLE) AS s FROM (SELECT commit_id, len(list_intersect(list_distinct(regexp_extract_all(lower(summary), '[a-z0-9]+')), ['high', 'urgent', 'low'])) AS n FROM pool) WHERE n > 0),
p2 AS (SELECT commit_id, least(sum(s), 0.5::DOUBLE) AS s FROM (SELECT commit_id, a, max(s) AS s FROM (SELECT commit_id, path AS a, 0.42::DOUBLE AS s FROM tm WHERE path IN (11, 12) UNION ALL SELECT commit_id, previous, 0.32::DOUBLE FROM tm WHERE previous IN (11, 12)) GROUP BY 1, 2) GROUP BY 1),
p3 AS (SELECT commit_id, least(sum(s), 0.45::DOUBLE) AS s FROM (SELECT commit_id, q, qualified_name, max(CASE WHEN q = lower(qualified_name) OR q = split_part(lower(qualified_name), '::', 2) THEN 0.35::DOUBLE ELSE 0.18::DOUBLE END) AS s FROM (SELECT *, unnest(['m3::sym31', 'sym4']) AS q FROM st WHERE commit_id IN (SELECT commit_id FROM pool)) WHERE contains(lower(qualified_name), q) GROUP BY 1, 2, 3) GROUP BY 1),
be AS (SELECT * FROM pairs WHERE path IN (11, 12)), ne AS (SELECT other AS near, max(recency) AS recency FROM be GROUP BY 1),
p4 AS (SELECT commit_id, least(sum(s), 0.35::DOUBLE) AS s FROM (SELECT DISTINCT commit_id, near, least(0.16::DOUBLE + least(recency, 2.5::DOUBLE) * 0.03::DOUBLE, 0.26::DOUBLE) AS s FROM tm JOIN ne ON near = path UNION ALL SELECT commit_id, a, 0.2::DOUBLE FROM (SELECT DISTINCT unnest(samples) AS commit_id, least(path, other) AS a, greatest(path, other) AS b FROM be) WHERE commit_id IN (SELECT commit_id FROM pool)) GROUP BY 1),
p5 AS (SELECT commit_id, least(sum(s), 0.18::DOUBLE) AS s FROM (SELECT DISTINCT commit_id, path, least(ln(1 + hotspot) * 0.08::DOUBLE, 0.14::DOUBLE) AS s FROM tm JOIN hs USING (path) WHERE hotspot > 0 AND (path IN (11, 12) OR path IN (SELECT near FROM ne))) GROUP BY 1),
al AS (SELECT commit_id, round(least(sum(s), 1.0::DOUBLE), 3) AS score, CAST(sum(n) AS INTEGER) AS sources FROM (SELECT *, 2 AS n FROM p1 UNION ALL SELECT *, 1 FROM p2 UNION ALL SELECT *, 1 FROM p3 UNION ALL SELECT *, 1 FROM p4 UNION ALL SELECT *, 1 FROM p5) GROUP BY 1),
cf AS (SELECT *, CASE WHEN (sources >= 4 AND score >= 0.75) OR (sources >= 3 AND score >= 0.55) THEN 2 WHEN sources >= 2 AND score >= 0.35 THEN 1 ELSE 0 END AS c FROM al WHERE score > 0)
SELECT commit_id, score, ['low', 'medium', 'high'][c + 1] AS confidence, sources FROM cf JOIN commits USING (commit_id) ORDER BY score DESC, c DESC, committed_at DESC, commit_id LIMIT 20"""


def _similar(t):
    edges = C.cochange_samples(t.commits, t.touches)
    return C.similar_changes(t.commits, _renamed(t), _symbol_touches(t), edges, H.churn(t.touches), " 2-HIGH urgent, fix the low ", [12, 11], ["M3::Sym31", "sym4 "], 20)


def _signals(t):
    authors = t.touches.join(t.commits.select("commit_id", "author"), "commit_id").groupBy("path").agg(F.countDistinct("author").alias("authors"))
    neighbors = H.cochange(t.commits, t.touches).groupBy("path").agg(F.count("*").alias("neighbors"))
    return C.signals(H.churn(t.touches), authors, neighbors, t.touches.where("touch = 1").groupBy("path").agg(F.countDistinct("owner").alias("reviewers")))


SIGNALS_SQL = f"""{B}, {SAMPLES_SQL}, {CHURN}, au AS (SELECT path, count(DISTINCT author) AS authors FROM touches JOIN commits USING (commit_id) GROUP BY 1), nb AS (SELECT path, count(*) AS neighbors FROM pairs GROUP BY 1), rw AS (SELECT path, count(DISTINCT owner) AS reviewers FROM touches WHERE touch = 1 GROUP BY 1),
x AS (SELECT path, CASE WHEN hotspot >= 3 THEN 0.12::DOUBLE WHEN hotspot >= 1.5 THEN 0.07::DOUBLE ELSE 0.03::DOUBLE END AS history_churn, CASE WHEN a >= 4 THEN 0.12::DOUBLE WHEN a >= 2 THEN 0.07::DOUBLE WHEN a = 1 AND r = 0 THEN 0.04::DOUBLE ELSE 0.0::DOUBLE END AS ownership_risk, CASE WHEN r > 0 THEN least(0.04::DOUBLE + least(r, 3) * 0.02::DOUBLE, 0.1::DOUBLE) ELSE 0.0::DOUBLE END AS reviewer_affinity, least(least(n, 3) * 0.04::DOUBLE, 0.12::DOUBLE) AS similar_change_overlap
  FROM (SELECT path, hotspot, coalesce(authors, 0) AS a, coalesce(neighbors, 0) AS n, coalesce(reviewers, 0) AS r FROM hs LEFT JOIN au USING (path) LEFT JOIN nb USING (path) LEFT JOIN rw USING (path)))
SELECT *, round(least(history_churn + ownership_risk + similar_change_overlap, 0.25::DOUBLE), 6) AS risk FROM x"""


def _reviews(t):
    r = t.raw("orders").select(F.col("o_orderkey").alias("review_id"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey")).alias("path"), F.col("o_orderkey").alias("commit_id"), F.col("o_orderstatus").alias("role"))
    return C.reviews_of(r, t.touches, 11)


def _provenance(t):
    from tessera.queries.history import _renames

    names = H.rename_closure(_renames(t))
    return C.provenance_across(t.touches, t.commits, names, 11, 30)


def _closure_sql() -> str:
    from tessera.queries.history import CLOSURE

    return CLOSURE.replace("SELECT * FROM c", "") + """, nm AS (SELECT node AS path FROM c WHERE component = (SELECT component FROM c WHERE node = 11)),
rw AS (SELECT commit_id, path, max(touched_at) AS touched_at, any_value(author) AS author FROM touches JOIN commits USING (commit_id) WHERE path IN (SELECT path FROM nm) GROUP BY 1, 2)
(SELECT commit_id, author, path, 'recent' AS place FROM rw ORDER BY touched_at DESC, commit_id, path LIMIT 30) UNION ALL (SELECT commit_id, author, path, 'first' FROM rw ORDER BY touched_at, commit_id, path LIMIT 1)"""


RANKED = "(SELECT *, CAST(row_number() OVER (PARTITION BY path ORDER BY score DESC, {who}) AS INTEGER) AS rank FROM {t})"
R6 = "round({0}, 6) AS {0}"
QUERIES = {
    "history_owner_file": (lambda t: O.by_owner_file(_parts(t), RULES).select("path", "owner"), f"WITH {NAMED}, {FILE_SQL} SELECT path, owner FROM fo"),
    "history_owners_fused": (lambda t: O.ranked(_owners(t), "owner", 3).select("path", "rank", "owner", "score", *[F.round(c, 6).alias(c) for c in ("codeowners", "git_history", "memory")], "stale"), f"{B}, {OWNERS_SQL} SELECT path, rank, owner, score, {R6.format('codeowners')}, {R6.format('git_history')}, {R6.format('memory')}, stale FROM {RANKED.format(who='owner', t='owners')} WHERE rank <= 3"),
    "history_reviewers_fused": (lambda t: O.ranked(_reviewers(t), "reviewer", 3).select("path", "rank", "reviewer", "score", "availability"), f"{B}, {REVIEWERS_SQL} SELECT path, rank, reviewer, score, {AVAILABLE.format('av')} AS availability FROM {RANKED.format(who='reviewer', t='reviewers')} WHERE rank <= 3"),
    "history_review_availability": (lambda t: O.report_availability(_reviewers(t)), f"{B}, {REVIEWERS_SQL} SELECT path, {AVAILABLE.format('max(av)')} AS availability FROM reviewers GROUP BY 1"),
    "history_similar_changes": (_similar, SIMILAR_SQL),
    "history_cochange_samples": (lambda t: C.cochange_samples(t.commits, t.touches).select("path", "other", "commits", "recency", F.array_join("samples", ",").alias("samples")), f"{B}, {SAMPLES_SQL} SELECT path, other, commits, recency, array_to_string(samples, ',') AS samples FROM pairs"),
    "history_signals": (_signals, SIGNALS_SQL),
    "history_reviews_of_path": (_reviews, f"{B}, r AS (SELECT o_orderkey AS review_id, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END AS path, o_orderkey AS commit_id, o_orderstatus AS role FROM orders) SELECT * FROM r WHERE path = 11 OR (path IS NULL AND commit_id IN (SELECT commit_id FROM touches WHERE path = 11))"),
    "history_symbol_churn": (lambda t: H.churn(_symbol_touches(t), "symbol_id").join(C.touch_confidence(_symbol_touches(t), "symbol_id").select("symbol_id", "confidence"), "symbol_id").select("symbol_id", "touches", "last_90d", "hotspot", "confidence"), f"{B}, {SYMBOLS}, a AS (SELECT *, (epoch_us((SELECT max(touched_at) FROM touches)) - epoch_us(touched_at)) / 86400000000.0::DOUBLE AS age FROM st), c AS (SELECT symbol_id, count(*) AS touches, CAST(sum(CASE WHEN age <= 90 THEN 1 ELSE 0 END) AS BIGINT) AS last_90d, sum(1 / (1 + age / 30)) AS r, sum(additions) AS v, min(confidence) AS confidence FROM a GROUP BY 1) SELECT symbol_id, touches, last_90d, round(r * ln(1 + touches) + ln(1 + v) / 10, 6) AS hotspot, confidence FROM c"),
    "history_symbol_provenance": (lambda t: C.symbol_provenance(_symbol_touches(t), t.commits, 111, 20), f"{B}, {SYMBOLS}, r AS (SELECT commit_id, max(touched_at) AS seen, any_value(author) AS author FROM st JOIN commits USING (commit_id) WHERE symbol_id = 111 GROUP BY 1) (SELECT commit_id, author, 'recent' AS place FROM r ORDER BY seen DESC, commit_id LIMIT 20) UNION ALL (SELECT commit_id, author, 'first' FROM r ORDER BY seen, commit_id LIMIT 1)"),
    "history_provenance_across": (_provenance, None),
    "history_newest_touch": (lambda t: C.newest_touch(t.touches, _symbol_touches(t)).select(F.date_format("newest", "yyyy-MM-dd").alias("newest")), f"{B} SELECT strftime(max(touched_at), '%Y-%m-%d') AS newest FROM touches"),
}
