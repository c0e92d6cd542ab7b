"""Runtime queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import runtime as R
from tessera.sources.bindings import RUNTIME_SQL

B = f"WITH {RUNTIME_SQL}"
D = "CASE WHEN duration_ms >= 0 AND isfinite(duration_ms) THEN duration_ms END"


def _agg(key: str) -> str:
    return f"{B} SELECT CAST({key} AS VARCHAR) AS key, count(*) AS count, count(*) FILTER (error) AS errors, round(count(*) FILTER (error) / count(*), 6) AS error_rate, quantile_disc({D}, 0.5) AS p50, quantile_disc({D}, 0.95) AS p95, quantile_disc({D}, 0.99) AS p99, min(ts) AS first, max(ts) AS last, count(DISTINCT symbol) AS symbols, CASE WHEN count(*) >= 3 THEN 'high' ELSE 'medium' END AS confidence FROM runtime GROUP BY 1"


QUERIES = {
    "runtime_by_route": (lambda t: R.aggregate(t.runtime, "route"), _agg("route")),
    "runtime_by_symbol": (lambda t: R.aggregate(t.runtime, "symbol"), _agg("symbol")),
    "runtime_by_kinds": (lambda t: R.aggregate_kinds(t.runtime, {"route": F.col("route"), "symbol": F.col("symbol"), "attribute": F.col("k")}), f"{B}, u AS (SELECT 'route' AS kind, route AS key, * EXCLUDE (route) FROM runtime UNION ALL SELECT 'symbol', CAST(symbol AS VARCHAR), * EXCLUDE (route) FROM runtime UNION ALL SELECT 'attribute', CAST(k AS VARCHAR), * EXCLUDE (route) FROM runtime) SELECT kind, key, count(*) AS count, count(*) FILTER (error) AS errors, quantile_disc({D}, 0.95) AS p95 FROM u WHERE key IS NOT NULL GROUP BY 1, 2"),
    "runtime_samples": (lambda t: R.samples(t.runtime, "symbol", "k", "record_id"), f"{B} SELECT symbol, string_agg(CAST(k AS VARCHAR), '|' ORDER BY record_id) AS samples FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY record_id) AS n FROM runtime WHERE k IS NOT NULL) WHERE n <= 3 GROUP BY 1"),
    "runtime_stale": (lambda t: R.stale(t.runtime, "symbol", 1).select("symbol", "stale"), f"{B} SELECT symbol, (epoch_us((SELECT max(ts) FROM runtime)) - epoch_us(max(ts))) / 86400000000 > 1 AS stale FROM runtime GROUP BY 1"),
    "runtime_facts": (lambda t: R.facts(t.runtime), f"{B} SELECT record_id, 'route' AS kind, route AS target FROM runtime UNION ALL SELECT record_id, 'symbol', CAST(symbol AS VARCHAR) FROM runtime WHERE symbol IS NOT NULL UNION ALL SELECT record_id, 'error', 'error:' || k FROM runtime WHERE error AND k IS NOT NULL"),
    "runtime_fact_counts": (lambda t: R.facts(t.runtime).groupBy("kind", "target").agg(F.count("*").alias("n")), f"{B}, f AS (SELECT 'route' AS kind, route AS target FROM runtime UNION ALL SELECT 'symbol', CAST(symbol AS VARCHAR) FROM runtime WHERE symbol IS NOT NULL UNION ALL SELECT 'error', 'error:' || k FROM runtime WHERE error AND k IS NOT NULL) SELECT kind, target, count(*) AS n FROM f GROUP BY 1, 2"),
    "runtime_hourly": (lambda t: t.runtime.groupBy(F.date_format(F.window("ts", "1 hour")["start"], "yyyy-MM-dd HH").alias("hour"), "route").agg(F.count("*").alias("n")), f"{B} SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, route, count(*) AS n FROM runtime GROUP BY 1, 2"),
}
