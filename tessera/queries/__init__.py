"""Registered queries by family: name to (plan, SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.sources.bindings import Tables

Query = Callable[[Tables], DataFrame]
FAMILIES = ("graph", "metadata", "text", "vectors", "ranking", "history", "runtime", "rules", "context", "parse", "resolve")


def registered() -> dict[str, tuple[Query, str | None]]:
    import importlib

    out: dict[str, tuple[Query, str | None]] = {}
    for family in FAMILIES:
        out |= importlib.import_module(f"tessera.queries.{family}").QUERIES
    # families that stand on others
    for name in ("retrieval", "checks", "sources"):
        out |= importlib.import_module(f"tessera.queries.{name}").QUERIES
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, folder, f=f: f(Tables(spark, folder))) for name, (f, _) in registered().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in registered().items() if sql}
