"""One object with the engine's families over a set of record tables, and calls by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import changes, context, graph, history, hybrid, metadata, runtime, search, tasks, verify
from tessera.plans.graph_query import execute
from tessera.sources.bindings import Tables


class Engine:
    """Methods give DataFrames; dispatch() calls those that TOOLS names, with limits held to what pages allow."""

    def __init__(self, tables: Tables):
        self.t = tables

    def match(self, query: str, limit: int = 50, offset: int = 0) -> DataFrame:
        """A graph pattern: MATCH (a:type)-[:EDGE]->(b) WHERE ... RETURN a, b."""
        return execute(query, self.t.nodes, self.t.edges, limit, offset)

    def neighbors(self, node: str, limit: int = 20) -> DataFrame:
        return graph.neighbors(self.t.nodes, self.t.edges, node).orderBy("id").limit(limit)

    def path(self, source: str, target: str, depth: int = 12) -> DataFrame:
        return graph.shortest_path(self.t.edges, source, target, depth)

    def files(self, limit: int = 20, offset: int = 0) -> DataFrame:
        return metadata.list_files(self.t.files.drop("text"), limit, offset)

    def symbols(self, query: str | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
        return metadata.list_symbols(self.t.symbols, query, limit, offset)

    def definition(self, name: str) -> DataFrame:
        return metadata.definition(self.t.symbols, name)

    def references(self, word: str, limit: int = 20) -> DataFrame:
        return metadata.word_references(self.t.lines, word).orderBy("path", "line").limit(limit)

    def search(self, query: str, limit: int = 20) -> DataFrame:
        return search.lexical(self.t.files, "path", "text", query).orderBy(F.col("score").desc(), "path").limit(limit)

    def grep(self, pattern: str, limit: int = 20) -> DataFrame:
        return search.grep(self.t.lines, pattern).orderBy("path", "line").limit(limit)

    def semantic(self, query: str, limit: int = 20) -> DataFrame:
        return hybrid.semantic_search(self.t.files, "path", "text", query, limit)

    def hybrid(self, query: str, limit: int = 20) -> DataFrame:
        """Lexical and semantic candidates, without history, fused for the query."""
        most = hybrid.candidate_limit(limit)
        facts = self.t.spark.createDataFrame([], "path string, target string, confidence string")
        return hybrid.hybrid(hybrid.lexical_results(self.t.files, "path", "text", query, most), hybrid.semantic_results(self.semantic(query, most), "path"), facts, query, limit)

    def node_for(self, text: str) -> DataFrame:
        """The node that a text names: by id, else by label, the least id."""
        n = self.t.nodes.where((F.col("id") == text) | (F.col("label") == text))
        return n.orderBy((F.col("id") != text).cast("int"), "id").limit(1)

    def churn(self, path, limit: int = 20) -> DataFrame:
        return history.churn(self.t.touches).where(F.col("path") == path).limit(limit)

    def cochange(self, path, limit: int = 20) -> DataFrame:
        return history.neighbors(history.cochange(self.t.commits, self.t.touches), F.col("path") == path, limit)

    def provenance(self, path, limit: int = 20) -> DataFrame:
        return history.provenance(self.t.touches, self.t.commits, F.col("path") == path, limit)

    def runtime(self, key: str = "route") -> DataFrame:
        return runtime.aggregate(self.t.runtime, key)

    def memory(self, query: str, limit: int = 20) -> DataFrame:
        return context.search_facts(self.t.facts, query, limit)

    def changed_files(self, diff: str) -> DataFrame:
        one = self.t.spark.createDataFrame([(diff,)], "d string")
        return one.select(F.explode(verify.changed_files(F.col("d"))).alias("path"))

    def terms(self, task: str) -> list[str]:
        return tasks.search_terms(task)

    def newest_touch(self) -> DataFrame:
        return changes.newest_touch(self.t.touches)

    #: Names that clients call, and what answers them. Several names are one search, as they always were.
    TOOLS = {
        "query_evidence_graph": "match", "get_callers": "neighbors", "get_callees": "neighbors", "module_dependencies": "neighbors", "dependency_path": "path", "list_files": "files", "list_symbols": "symbols",
        "search_symbols": "symbols", "get_definition": "definition", "get_references": "references", "search_code": "search", "search_files": "search", "structural_search": "search", "get_implementations": "search",
        "regex_search": "search", "semantic_search": "semantic", "hybrid_search": "hybrid", "churn_analysis": "churn", "history_provenance_lookup": "provenance", "search_memory": "memory",
    }

    def dispatch(self, method: str, params: dict):
        """The answer to a call by name; limit and offset are held to a page's bounds. Unknown names are errors."""
        if method not in self.TOOLS:
            raise ValueError(f"unknown method: {method}")
        call: Callable = getattr(self, self.TOOLS[method])
        held = dict(params)
        limit, offset = metadata.clamp(held.get("limit"), held.get("offset"))
        held |= {k: v for k, v in (("limit", limit), ("offset", offset)) if k in held}
        return call(**held)
