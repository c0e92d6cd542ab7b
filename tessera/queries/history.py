"""Change-history queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.text import word_tokens
from tessera.operators import history as H
from tessera.sources.bindings import COMMITS_SQL, TOUCHES_SQL

B = f"WITH {COMMITS_SQL}, {TOUCHES_SQL}"
PAIRS = """f AS (SELECT DISTINCT commit_id, path FROM touches), ok AS (SELECT commit_id FROM f GROUP BY 1 HAVING count(*) BETWEEN 2 AND 50),
w AS (SELECT commit_id, 1 / (1 + (row_number() OVER (ORDER BY date_trunc('day', committed_at) DESC, committed_at DESC, commit_id) - 1) / 25.0::DOUBLE) AS weight FROM commits),
g AS (SELECT f.commit_id, path, weight FROM f JOIN ok USING (commit_id) JOIN w USING (commit_id)),
pairs AS (SELECT a.path, b.path AS other, count(*) AS commits, round(sum(a.weight), 4) AS recency FROM g a JOIN g b ON a.commit_id = b.commit_id AND a.path <> b.path GROUP BY 1, 2)"""


def _churn(key: str, source: str) -> str:
    return f"""c AS (SELECT {key}, count(*) AS touches, CAST(sum(CASE WHEN age <= 30 THEN 1 ELSE 0 END) AS BIGINT) AS last_30d, CAST(sum(CASE WHEN age <= 90 THEN 1 ELSE 0 END) AS BIGINT) AS last_90d, sum(1 / (1 + age / 30)) AS r, sum(additions) AS volume
FROM (SELECT *, (epoch_us((SELECT max(touched_at) FROM touches)) - epoch_us(touched_at)) / 86400000000.0::DOUBLE AS age FROM {source}) GROUP BY 1)
SELECT {key}, touches, last_30d, last_90d, round(r, 6) AS recency, volume, round(r * ln(1 + touches) + ln(1 + volume) / 10, 6) AS hotspot FROM c"""


def _share(who: str) -> str:
    return f"""e AS (SELECT path, {who}, count(*) AS touches, max(touched_at) AS last FROM touches GROUP BY 1, 2),
s AS (SELECT *, touches / sum(touches) OVER (PARTITION BY path) AS share, date_diff('day', CAST(last AS DATE), CAST((SELECT max(touched_at) FROM touches) AS DATE)) > 365 AS stale FROM e),
sh AS (SELECT path, {who}, touches, round(share, 6) AS share, stale, round(least((0.30::DOUBLE + 0.32::DOUBLE * share) * (0.6::DOUBLE + 0.4::DOUBLE * least(touches / 3, 1.0::DOUBLE)) * CASE WHEN stale THEN 0.55::DOUBLE ELSE 1.0::DOUBLE END, 0.62::DOUBLE), 6) AS score FROM s)"""


BEST = """t AS (SELECT *, score >= max(score) OVER (PARTITION BY path) - 0.08::DOUBLE AS near FROM sh), u AS (SELECT *, sum(CAST(near AS INTEGER)) OVER (PARTITION BY path) > 1 AS crowd FROM t),
v AS (SELECT path, {who}, round(score - CASE WHEN near AND crowd THEN 0.12::DOUBLE ELSE 0.0::DOUBLE END, 6) AS score FROM u),
x AS (SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY score DESC, {who}) AS INTEGER) AS rank, {who}, score FROM v) SELECT * FROM x WHERE rank <= 3"""


def _renames(t):
    """Line items of one order in a row stand in as renames."""
    a = t.touches.select("commit_id", "touch", F.col("path").alias("a"))
    b = t.touches.select("commit_id", (F.col("touch") - 1).alias("touch"), F.col("path").alias("b"))
    return a.join(b, ["commit_id", "touch"]).select("a", "b").where("a <> b")


#: The least name that a chain of renames leads to: labels move a step a round, and rounds are as many as any chain needs.
CLOSURE = f"""{B}, n AS (SELECT a.path AS a, b.path AS b FROM touches a JOIN touches b ON b.commit_id = a.commit_id AND b.touch = a.touch + 1 WHERE a.path <> b.path),
e AS (SELECT a, b FROM n UNION SELECT b, a FROM n), c AS (WITH RECURSIVE r(node, component, round) USING KEY (node) AS (SELECT a, least(a, min(b)), 0 FROM e GROUP BY a
  UNION SELECT e.a, min(r.component), any_value(r.round) + 1 FROM r JOIN e ON e.b = r.node JOIN recurring.r AS own ON own.node = e.a GROUP BY e.a, own.component HAVING min(r.component) < own.component) SELECT node, component FROM r) SELECT * FROM c"""


def _authored(t):
    return t.touches.join(t.commits.select("commit_id", "author"), "commit_id")


QUERIES = {
    "history_cochange": (lambda t: H.cochange(t.commits, t.touches), f"{B}, {PAIRS} SELECT * FROM pairs"),
    "history_cochange_neighbors": (lambda t: H.neighbors(H.cochange(t.commits, t.touches), F.col("path") == 11), f"{B}, {PAIRS} SELECT * FROM pairs WHERE path = 11 ORDER BY recency DESC, commits DESC, other LIMIT 10"),
    "history_recency_weights": (lambda t: H.recency_weights(t.commits).select("commit_id", F.round("weight", 9).alias("weight")), f"{B} SELECT commit_id, round(1 / (1 + (row_number() OVER (ORDER BY committed_at DESC, commit_id) - 1) / 25.0::DOUBLE), 9) AS weight FROM commits"),
    "history_churn_file": (lambda t: H.churn(t.touches), f"{B}, {_churn('path', 'touches')}"),
    "history_churn_owner": (lambda t: H.churn(t.touches, "owner"), f"{B}, {_churn('owner', 'touches')}"),
    "history_churn_module": (lambda t: H.churn(H.with_ancestors(t.touches.join(t.raw("part").select(F.col("p_partkey").alias("path"), "p_brand", "p_type"), "path"), F.array("p_brand", "p_type")), "module"), f"{B}, m AS (SELECT t.*, unnest(['__root__', p_brand, p_brand || '/' || p_type]) AS module FROM touches t JOIN part ON p_partkey = path), {_churn('module', 'm')}"),
    "history_hotspots": (lambda t: H.churn(t.touches).orderBy(F.col("hotspot").desc(), "path").limit(100).select("path", "hotspot"), f"{B}, {_churn('path', 'touches').replace('SELECT path, touches, last_30d, last_90d, round(r, 6) AS recency, volume, round', 'SELECT path, round')} ORDER BY hotspot DESC, path LIMIT 100"),
    "history_rename_closure": (lambda t: H.rename_closure(_renames(t)), CLOSURE),
    "history_provenance": (lambda t: H.provenance(t.touches, t.commits, F.col("path") == 11).select("commit_id", "author", "place"), f"{B}, m AS (SELECT commit_id, max(touched_at) AS touched_at, any_value(author) AS author FROM touches JOIN commits USING (commit_id) WHERE path = 11 GROUP BY 1) (SELECT commit_id, author, 'recent' AS place FROM m ORDER BY touched_at DESC, commit_id LIMIT 20) UNION ALL (SELECT commit_id, author, 'first' FROM m ORDER BY touched_at, commit_id LIMIT 1)"),
    "history_first_touch": (lambda t: t.touches.groupBy("path").agg(F.min_by("commit_id", F.struct("touched_at", "commit_id")).alias("first_commit"), F.max_by("commit_id", F.struct("touched_at", "commit_id")).alias("last_commit"), F.count("*").alias("touches")), f"{B} SELECT path, arg_min(commit_id, (touched_at, commit_id)) AS first_commit, arg_max(commit_id, (touched_at, commit_id)) AS last_commit, count(*) AS touches FROM touches GROUP BY 1"),
    "history_ownership": (lambda t: H.shares(t.touches, "owner"), f"{B}, {_share('owner')} SELECT * FROM sh"),
    "history_owner_suggestions": (lambda t: H.suggestions(H.shares(t.touches, "owner"), "owner"), f"{B}, {_share('owner')}, {BEST.format(who='owner')}"),
    "history_reviewers": (lambda t: H.suggestions(H.shares(_authored(t), "author"), "author", 2, 0.06, 0.08), f"{B.replace('FROM lineitem', 'FROM lineitem').replace('touches AS (', 'plain AS (')}, touches AS (SELECT p.*, author FROM plain p JOIN commits USING (commit_id)), {_share('author')}, {BEST.format(who='author').replace('0.08', '0.06').replace('0.12', '0.08').replace('<= 3', '<= 2')}"),
    "history_similar_commits": (lambda t: H.similar_commits(t.commits, t.touches, 33, word_tokens(F.col("summary")), 25), f"{B}, k AS (SELECT *, regexp_extract_all(lower(summary), '[a-z0-9]+') AS tokens FROM commits), q AS (SELECT tokens AS asked FROM k WHERE commit_id = 33), p AS (SELECT commit_id, count(DISTINCT path) AS n FROM touches WHERE commit_id <> 33 AND path IN (SELECT path FROM touches WHERE commit_id = 33) GROUP BY 1), s AS (SELECT k.commit_id, coalesce(n, 0) AS shared_paths, CAST(len(list_intersect(list_distinct(tokens), asked)) AS BIGINT) AS shared_tokens FROM k CROSS JOIN q LEFT JOIN p ON p.commit_id = k.commit_id WHERE k.commit_id <> 33), z AS (SELECT *, round(least(shared_paths * 0.42::DOUBLE, 0.5::DOUBLE) + least(shared_tokens * 0.08::DOUBLE, 0.32::DOUBLE), 3) AS score FROM s) SELECT * FROM z WHERE score > 0 ORDER BY score DESC, commit_id LIMIT 25"),
    "history_commit_sizes": (lambda t: t.touches.groupBy("commit_id").agg(F.countDistinct("path").alias("files"), F.sum("additions").alias("additions")), f"{B} SELECT commit_id, count(DISTINCT path) AS files, sum(additions) AS additions FROM touches GROUP BY 1"),
    "history_author_activity": (lambda t: _authored(t).groupBy("author").agg(F.countDistinct("commit_id").alias("commits"), F.countDistinct("path").alias("paths")), f"{B} SELECT author, count(DISTINCT commit_id) AS commits, count(DISTINCT path) AS paths FROM touches JOIN commits USING (commit_id) GROUP BY 1"),
    "history_dangling_touches": (lambda t: H.dangling(t.touches, t.commits.where("commit_id % 10 <> 3")).groupBy("commit_id").agg(F.count("*").alias("n")), f"{B} SELECT commit_id, count(*) AS n FROM touches WHERE commit_id NOT IN (SELECT commit_id FROM commits WHERE commit_id % 10 <> 3) GROUP BY 1"),
}

# these build on the ones above
from tessera.queries import signals  # noqa: E402

QUERIES |= signals.QUERIES
QUERIES["history_provenance_across"] = (QUERIES["history_provenance_across"][0], signals._closure_sql())
