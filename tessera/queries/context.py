"""Memory, compression and risk queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import context as C
from tessera.sources.bindings import FACTS_SQL

B = f"WITH {FACTS_SQL}"
TOK = "greatest(len(regexp_extract_all({0}, '\\S+')), octet_length(encode({0})) // 4)"
FIRST = "coalesce(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')[1], '')"
SUM = f"source || ' ' || fact_id || ': ' || array_to_string(regexp_extract_all({FIRST}, '\\S+')[1:8], ' ')"
NORM = "translate(regexp_replace(text, '[^A-Za-z0-9]', ' ', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

QUERIES = {
    "context_token_estimates": (lambda t: t.facts.select("fact_id", C.token_estimate(F.col("text")).alias("tokens")), f"{B} SELECT fact_id, CAST({TOK.format('text')} AS BIGINT) AS tokens FROM facts"),
    "context_compress": (lambda t: C.compress(t.facts, "fact_id", "source", "fact_id", "text"), f"{B} SELECT fact_id, {SUM} AS summary, CAST({TOK.format('text')} AS BIGINT) AS tokens, CAST(greatest(len(regexp_extract_all({SUM}, '\\S+')) + 3, 4) AS BIGINT) AS summary_tokens FROM facts"),
    "context_compression_ratio": (lambda t: C.compress(t.facts, "fact_id", "source", "fact_id", "text").agg(F.sum("tokens").alias("tokens"), F.sum("summary_tokens").alias("summary_tokens"), F.round(F.sum("summary_tokens") / F.sum("tokens"), 6).alias("ratio")), f"{B}, c AS (SELECT {TOK.format('text')} AS t, greatest(len(regexp_extract_all({SUM}, '\\S+')) + 3, 4) AS s FROM facts) SELECT CAST(sum(t) AS BIGINT) AS tokens, CAST(sum(s) AS BIGINT) AS summary_tokens, round(sum(s) / sum(t), 6) AS ratio FROM c"),
    "context_memory_search": (lambda t: C.search_facts(t.facts, "the of and"), f"{B}, h AS (SELECT *, " + " + ".join(f"CASE WHEN regexp_matches({NORM}, '(^| ){w}( |$)') THEN 1 ELSE 0 END" for w in ("the", "of", "and")) + " AS hits FROM facts) SELECT fact_id, round(0.25::DOUBLE + 0.08::DOUBLE * hits, 6) AS score, created FROM h WHERE hits > 0 ORDER BY score DESC, created DESC, fact_id LIMIT 100"),
    "context_recent_facts": (lambda t: C.recent_facts(t.facts, 50).select("fact_id", "source", "created"), f"{B} SELECT fact_id, source, created FROM facts ORDER BY created DESC, fact_id LIMIT 50"),
    "context_entities": (lambda t: C.entities(t.raw("documents"), "doc_id", "text"), "SELECT doc_id, 'file' AS kind, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z0-9_./-]+\\.[a-z]{1,5}\\b'))) AS value FROM documents UNION ALL SELECT doc_id, 'ticket', unnest(list_distinct(regexp_extract_all(text, '\\b[A-Z][A-Z0-9]+-[0-9]+\\b'))) FROM documents"),
    "context_within_budget": (lambda t: C.within_budget(t.raw("conversations").select("conv_id", "turn", C.token_estimate(F.col("text")).alias("tokens")), "conv_id", ["turn"], "tokens", 300), f"SELECT * FROM (SELECT conv_id, turn, tokens, CAST(sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM (SELECT conv_id, turn, CAST({TOK.format('text')} AS BIGINT) AS tokens FROM conversations)) WHERE used <= 300"),
    "context_absent_scopes": (lambda t: C.absent(["user", "assistant", "system", "tool"], t.facts, "source"), f"{B} SELECT scope, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'nothing found in ' || scope END AS note FROM (SELECT unnest(['user', 'assistant', 'system', 'tool']) AS scope) LEFT JOIN (SELECT source AS scope, count(*) AS n FROM facts GROUP BY 1) USING (scope)"),
    "context_risk": (lambda t: t.raw("part").select("p_partkey", C.risk_level(C.merge_risk(F.col("p_size") / 100.0, F.col("p_retailprice") / 4000.0, F.col("p_partkey") % 9 == 0)).alias("level")), "SELECT p_partkey, CASE WHEN r >= 0.6 THEN 'high' WHEN r >= 0.25 THEN 'medium' ELSE 'low' END AS level FROM (SELECT *, greatest(p_size / 100.0::DOUBLE, p_retailprice / 4000.0::DOUBLE, CASE WHEN p_partkey % 9 = 0 THEN 0.45::DOUBLE ELSE 0.0::DOUBLE END) AS r FROM part)"),
}
