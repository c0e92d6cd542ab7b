"""A read-only graph pattern language: text to a checked pattern, and a pattern to a DataFrame plan.

    MATCH (a:class)-[:DEFINES]->(b:function) WHERE a.label STARTS_WITH "Customer" AND b.id = "orders:7" RETURN a, b LIMIT 20 OFFSET 5
    MATCH (a:class)-[:DEFINES*1..3]->(b) RETURN a, b
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.rounds import cut
from tessera.schema import EDGE_TYPES, NODE_TYPES

# Fixed values of the language.
MAX_HOPS, MAX_ROWS, DEFAULT_ROWS, DEFAULT_HOPS, MAX_PATTERN = 5, 500, 50, 3, 100
REFUSED = "CREATE MERGE DELETE DETACH SET REMOVE DROP CALL LOAD UNION WITH FOREACH".split()
FIELDS = "label file_path qualified_name id source source_type confidence".split()
PATTERN_FIELDS = "label file_path qualified_name".split()


class QueryError(ValueError):
    """A query that is malformed, or asks for what the language doesn't allow."""


@dataclass(frozen=True)
class Node:
    variable: str | None
    kind: str | None


@dataclass(frozen=True)
class Filter:
    variable: str
    field: str
    operator: str
    value: str


@dataclass(frozen=True)
class Pattern:
    source: Node
    target: Node
    edge: str | None
    backwards: bool
    hops: tuple[int, int] | None
    filters: tuple[Filter, ...]
    returned: tuple[str, ...]
    limit: int | None
    offset: int | None


_TOKEN = re.compile(r"""\s*(?:(?P<string>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<sign>=~|<-|->|\.\.|[-()\[\]:,.*=]))""", re.ASCII)


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while text[at:].strip():
        m = _TOKEN.match(text, at)
        if not m:
            raise QueryError(f"unexpected character: {text[at:].strip()[0]}")
        kind, value, at = m.lastgroup, m[m.lastgroup], m.end()
        if kind == "name" and value.upper() in REFUSED:
            raise QueryError(f"keyword not allowed: {value}")
        out.append((kind, re.sub(r"\\(.)", r"\1", value[1:-1]) if kind == "string" else value))
    return out


class _Reader:
    def __init__(self, text: str):
        self.rest = tokens(text)[::-1]

    def next_is(self, value: str) -> bool:
        return bool(self.rest) and self.rest[-1][0] in ("name", "sign") and self.rest[-1][1].upper() == value

    def skip(self, value: str) -> bool:
        if self.next_is(value):
            self.rest.pop()
            return True
        return False

    def need(self, *values: str) -> str:
        for v in values:
            if self.skip(v):
                return v
        raise QueryError(f"expected {' or '.join(values)}, found {self.rest[-1][1] if self.rest else 'the end'}")

    def take(self, kind: str) -> str:
        if not self.rest or self.rest[-1][0] != kind:
            raise QueryError(f"expected a {kind}, found {self.rest[-1][1] if self.rest else 'the end'}")
        return self.rest.pop()[1]

    def maybe(self, kind: str) -> str | None:
        return self.rest.pop()[1] if self.rest and self.rest[-1][0] == kind else None

    def node(self) -> Node:
        self.need("(")
        variable, kind = self.maybe("name"), None
        if self.skip(":"):
            kind = self.take("name").lower()
            if kind not in NODE_TYPES:
                raise QueryError(f"unknown node type: {kind}")
        self.need(")")
        return Node(variable, kind)

    def filter(self) -> Filter:
        variable = self.take("name")
        self.need(".")
        field = self.take("name")
        if field not in FIELDS:
            raise QueryError(f"unsupported field: {field}")
        operator, value = self.need("=", "=~", "STARTS_WITH"), self.take("string")
        if operator == "=~":
            if field not in PATTERN_FIELDS:
                raise QueryError(f"no pattern on field: {field}")
            if len(value.encode()) > MAX_PATTERN:
                raise QueryError("pattern too long")
            try:
                re.compile(value)
            except re.error as e:
                raise QueryError(f"bad pattern: {e}") from None
        return Filter(variable, field, operator, value)


def parse(text: str) -> Pattern:
    """The query's pattern; QueryError if the text isn't one."""
    r = _Reader(text)
    r.need("MATCH")
    source = r.node()
    if not r.rest:
        raise QueryError("a node alone is no pattern")
    backwards = r.need("-", "<-") == "<-"
    r.need("[")
    edge, hops = None, None
    if r.skip(":"):
        edge = r.maybe("name")
        if edge is not None and edge.upper() not in EDGE_TYPES:
            raise QueryError(f"unknown edge type: {edge}")
        edge = edge and edge.upper()
    if r.skip("*"):
        low = int(r.take("number"))
        r.need("..")
        hops = low, int(r.take("number"))
    r.need("]")
    r.need("-" if backwards else "->")
    if hops and backwards:
        raise QueryError("several hops go forward only")
    target = r.node()
    filters: list[Filter] = []
    if r.skip("WHERE"):
        filters.append(r.filter())
        while r.skip("AND"):
            filters.append(r.filter())
    r.need("RETURN")
    returned = [r.take("name")]
    while r.skip(","):
        returned.append(r.take("name"))
    limit = offset = None
    while r.rest:
        if r.need("LIMIT", "OFFSET") == "LIMIT":
            limit = int(r.take("number"))
        else:
            offset = int(r.take("number"))
    if hops and not 1 <= hops[0] <= hops[1] <= MAX_HOPS:
        raise QueryError(f"hops must be 1 to {MAX_HOPS}, the lower number first")
    bound = {source.variable, target.variable} - {None}
    for name in [*(f.variable for f in filters), *returned]:
        if name not in bound:
            raise QueryError(f"unbound variable: {name}")
    if len({*returned}) < len(returned):
        raise QueryError("a variable is returned twice")
    return Pattern(source, target, edge, backwards, hops, tuple(filters), tuple(returned), limit, offset)


def _holds(f: Filter, side: str) -> Column:
    # of a node only its id and label can be compared; it has no source, source type or confidence, and null fails
    value = F.col(f"{side}_id") if f.field == "id" else F.col(f"{side}_label") if f.field in PATTERN_FIELDS else F.lit(None).cast("string")
    return value.startswith(f.value) if f.operator == "STARTS_WITH" else value.rlike(f.value) if f.operator == "=~" else value == f.value


def matches(pattern: Pattern, nodes: DataFrame, edges: DataFrame, max_hops: int = DEFAULT_HOPS) -> DataFrame:
    """All matches: source_id, source_type, source_label, target_id, ..., edge_id or depth. Filters are ordinary
    predicates, which Catalyst moves below the joins; each hop is one equi-join and a distinct of (start, node)."""

    def side(name: str, node: Node) -> DataFrame:
        out = nodes.select(F.col("id").alias(f"{name}_id"), F.col("node_type").alias(f"{name}_type"), F.col("label").alias(f"{name}_label"))
        return out.where(F.col(f"{name}_type") == node.kind) if node.kind else out

    source, target = side("source", pattern.source), side("target", pattern.target)
    chosen = edges.where(F.col("edge_type") == pattern.edge) if pattern.edge else edges
    if pattern.hops is None:
        if not pattern.edge:
            raise QueryError("one hop needs an edge type")
        a, b = ("to_id", "from_id") if pattern.backwards else ("from_id", "to_id")
        out = chosen.select(F.col(a).alias("source_id"), F.col(b).alias("target_id"), F.col("id").alias("edge_id")).join(source, "source_id").join(target, "target_id")
    else:
        if pattern.hops[1] > max_hops:
            raise QueryError(f"more than {max_hops} hops")
        if not pattern.source.kind:
            raise QueryError("several hops need a type of the first node")
        for f in pattern.filters:
            if f.variable == pattern.source.variable:
                source = source.where(_holds(f, "source"))
        for f in pattern.filters:
            if f.variable == pattern.target.variable:
                target = target.where(_holds(f, "target"))
        low, high = pattern.hops
        real, ends = nodes.select(F.col("id").alias("next")), target.select(F.col("target_id").alias("next"))
        # edges and levels are written once: a level's plan doesn't hold the levels before
        step = chosen.select(F.col("from_id").alias("at"), F.col("to_id").alias("next"))
        if pattern.target.kind or any(f.variable == pattern.target.variable for f in pattern.filters):
            # from the last hop back, only edges to a target or to a node from which the hops that are left reach one: a node
            # with very many neighbours of another kind doesn't lead to all of them
            step = cut(step) if high > 1 else step
            steps, useful = {}, ends
            for depth in range(high, 0, -1):
                steps[depth] = step.join(useful, "next", "left_semi")
                if depth > 1:
                    steps[depth] = cut(steps[depth])
                    useful = ends.union(steps[depth].select(F.col("at").alias("next")).distinct().join(real, "next", "left_semi"))
        else:
            steps = dict.fromkeys(range(1, high + 1), cut(step.distinct().join(real, "next", "left_semi")))
        level, levels = source.select("source_id", F.col("source_id").alias("at")), []
        for depth in range(1, high + 1):
            level = level.join(steps[depth], "at").select("source_id", F.col("next").alias("at")).distinct()
            level = cut(level) if depth < high else level
            if depth >= low:
                levels.append(level.withColumn("depth", F.lit(depth)))
        out = reduce(DataFrame.unionByName, levels).withColumnRenamed("at", "target_id").join(source, "source_id").join(target, "target_id")
    for f in pattern.filters:
        both = f.variable == pattern.source.variable == pattern.target.variable
        out = out.where(_holds(f, "target" if both or f.variable == pattern.target.variable else "source"))
    return out


def execute(text: str, nodes: DataFrame, edges: DataFrame, limit: int = DEFAULT_ROWS, offset: int = 0, max_hops: int = DEFAULT_HOPS) -> DataFrame:
    """The query's page of rows: id, type and label of each returned variable; at most MAX_ROWS.

    Rows are in order of edge id, or of start, depth and end, so that pages of a query fit together.
    """
    p = parse(text)
    order = ["edge_id"] if p.hops is None else ["source_id", "depth", "target_id"]
    rows = matches(p, nodes, edges, max_hops).orderBy(*order).offset(p.offset if p.offset is not None else offset).limit(min(p.limit if p.limit is not None else limit, MAX_ROWS))
    # of one variable at both ends the later binding counts
    ends = {v: "target" if v == p.target.variable else "source" for v in p.returned}
    return rows.select(*[F.col(f"{side}_{c}").alias(f"{v}_{c}") for v, side in ends.items() for c in ("id", "type", "label")])
