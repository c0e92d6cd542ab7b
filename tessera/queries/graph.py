"""Evidence-graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.identity import edge_id
from tessera.operators import graph as G
from tessera.plans.graph_query import execute, matches, parse
from tessera.schema import CONFIDENCE, EDGE_TYPES, NODE_TYPES
from tessera.sources.bindings import EDGES_SQL, NODES_SQL, Tables

BOTH = f"WITH {NODES_SQL}, {EDGES_SQL} "
ENDS = "a.id AS source_id, a.node_type AS source_type, a.label AS source_label, b.id AS target_id, b.node_type AS target_type, b.label AS target_label"
COLUMNS = ("source_id", "source_type", "source_label", "target_id", "target_type", "target_label")


def _match(text: str, *extra: str):
    return lambda t: matches(parse(text), t.nodes, t.edges, 5).select(*COLUMNS, *extra)


def _hops(depth: int, kinds: str = "") -> str:
    """SQL of (start, node, depth) levels."""
    levels = ["l0 AS (SELECT id AS start, id AS at FROM nodes WHERE node_type = 'class')"]
    for d in range(1, depth + 1):
        levels.append(f"l{d} AS (SELECT DISTINCT l.start, e.to_id AS at FROM l{d - 1} l JOIN edges e ON e.from_id = l.at {kinds})")
    return ", ".join(levels)


def _confidence(t: Tables):
    rank = F.create_map(*[F.lit(x) for pair in CONFIDENCE.items() for x in pair])
    return t.edges.withColumn("rank", rank[F.col("confidence")])


def _twice(t: Tables):
    """Each edge as it is and with the least confidence, side by side, so that a task drops one before it deals them out."""
    low = F.struct(F.lit("low").alias("confidence"), F.lit(0.1).alias("rank"))
    return _confidence(t).select("from_id", "to_id", "edge_type", F.inline(F.array(F.struct("confidence", "rank"), low)))


_RANK = "CASE confidence WHEN 'low' THEN 0.35::DOUBLE WHEN 'medium' THEN 0.6::DOUBLE WHEN 'high' THEN 0.85::DOUBLE ELSE 1.0::DOUBLE END"

QUERIES = {
    "graph_one_hop": (_match('MATCH (a:class)-[:DEFINES]->(b:function) WHERE b.label STARTS_WITH "1" RETURN a, b', "edge_id"), BOTH + f"SELECT {ENDS}, e.id AS edge_id FROM edges e JOIN nodes a ON a.id = e.from_id JOIN nodes b ON b.id = e.to_id WHERE e.edge_type = 'DEFINES' AND a.node_type = 'class' AND b.node_type = 'function' AND b.label LIKE '1%'"),
    "graph_one_hop_reverse": (_match('MATCH (a:package)<-[:BELONGS_TO]-(b:interface) WHERE a.label =~ "^N.*1" RETURN a, b', "edge_id"), BOTH + f"SELECT {ENDS}, e.id AS edge_id FROM edges e JOIN nodes a ON a.id = e.to_id JOIN nodes b ON b.id = e.from_id WHERE e.edge_type = 'BELONGS_TO' AND a.node_type = 'package' AND b.node_type = 'interface' AND regexp_matches(a.label, '^N.*1')"),
    "graph_multi_hop": (_match("MATCH (a:class)-[*1..2]->(b:module) RETURN a, b", "depth"), BOTH + f", {_hops(2)} SELECT {ENDS}, l.depth FROM (SELECT *, 1 AS depth FROM l1 UNION ALL SELECT *, 2 FROM l2) l JOIN nodes a ON a.id = l.start JOIN nodes b ON b.id = l.at WHERE b.node_type = 'module'"),
    "graph_multi_hop_typed": (_match("MATCH (a:architecture_component)-[:CONTAINS*1..2]->(b) RETURN a, b", "depth"), BOTH + f", {_hops(2, '').replace(chr(39) + 'class' + chr(39), chr(39) + 'architecture_component' + chr(39)).replace('e.from_id = l.at ', 'e.from_id = l.at AND e.edge_type = ' + chr(39) + 'CONTAINS' + chr(39))} SELECT {ENDS}, l.depth FROM (SELECT *, 1 AS depth FROM l1 UNION ALL SELECT *, 2 FROM l2) l JOIN nodes a ON a.id = l.start JOIN nodes b ON b.id = l.at"),
    "graph_query_page": (lambda t: execute('MATCH (c:class)-[:DEFINES]->(o:function) RETURN c, o LIMIT 40 OFFSET 10', t.nodes, t.edges), BOTH + "SELECT a.id AS c_id, a.node_type AS c_type, a.label AS c_label, b.id AS o_id, b.node_type AS o_type, b.label AS o_label FROM edges e JOIN nodes a ON a.id = e.from_id JOIN nodes b ON b.id = e.to_id WHERE e.edge_type = 'DEFINES' AND a.node_type = 'class' AND b.node_type = 'function' ORDER BY e.id LIMIT 40 OFFSET 10"),
    "graph_node_by_id": (lambda t: t.nodes.where("id = 'nation:7'"), f"WITH {NODES_SQL} SELECT * FROM nodes WHERE id = 'nation:7'"),
    "graph_neighbors": (lambda t: G.neighbors(t.nodes, t.edges, "nation:7"), BOTH + "SELECT * FROM nodes WHERE id IN (SELECT from_id FROM edges WHERE from_id = 'nation:7' OR to_id = 'nation:7' UNION SELECT to_id FROM edges WHERE from_id = 'nation:7' OR to_id = 'nation:7')"),
    "graph_incident_edges": (lambda t: G.incident(t.edges, "part:11"), BOTH + "SELECT * FROM edges WHERE from_id = 'part:11' OR to_id = 'part:11'"),
    "graph_shortest_path": (lambda t: G.shortest_path(t.edges, "region:1", "part:11", 5).select("step", "from_id", "to_id").groupBy().agg(F.count("*").alias("n_steps"), F.max(F.when(F.col("step") == 1, F.col("from_id"))).alias("first"), F.max_by("to_id", "step").alias("last")), BOTH + ", d AS (WITH RECURSIVE p AS (SELECT 'region:1' AS v, 0 AS n UNION SELECT e.to_id, p.n + 1 FROM p JOIN edges e ON e.from_id = p.v WHERE p.n < 5) SELECT min(n) AS n FROM p WHERE v = 'part:11') SELECT CAST(n AS BIGINT) AS n_steps, 'region:1' AS first, 'part:11' AS last FROM d"),
    "graph_nodes_by_type": (lambda t: G.nodes_by_type(t.nodes, "module", 100, 20), f"WITH {NODES_SQL} SELECT * FROM nodes WHERE node_type = 'module' ORDER BY id LIMIT 100 OFFSET 20"),
    "graph_edges_by_type": (lambda t: G.edges_by_type(t.edges, "DEPENDS_ON", 100, 20), BOTH + "SELECT * FROM edges WHERE edge_type = 'DEPENDS_ON' ORDER BY id LIMIT 100 OFFSET 20"),
    "graph_edges_between": (lambda t: G.edges_between(t.edges, "nation:7", "region:1").unionByName(G.edges_between(t.edges, "region:1", "nation:1")), BOTH + "SELECT * FROM edges WHERE (from_id = 'nation:7' AND to_id = 'region:1') OR (from_id = 'region:1' AND to_id = 'nation:1')"),
    "graph_all_nodes": (lambda t: t.nodes, f"WITH {NODES_SQL} SELECT * FROM nodes"),
    "graph_node_type_stats": (lambda t: G.type_stats(t.nodes, "node_type", "label"), f"WITH {NODES_SQL} SELECT node_type AS type, count(*) AS n, max(label) AS best FROM nodes GROUP BY 1"),
    "graph_edge_type_stats": (lambda t: G.type_stats(_confidence(t), "edge_type", "rank"), BOTH + f"SELECT edge_type AS type, count(*) AS n, max({_RANK}) AS best FROM edges GROUP BY 1"),
    "graph_counts": (lambda t: t.nodes.agg(F.count("*").alias("nodes")).withColumn("edges", t.edges.agg(F.count("*")).scalar()), BOTH + "SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges"),
    "graph_schema_counts": (lambda t: G.schema_catalogue(EDGE_TYPES, G.type_counts(t.edges, "edge_type")).unionByName(G.schema_catalogue(NODE_TYPES, G.type_counts(t.nodes, "node_type"))), BOTH + "SELECT type, coalesce(n, 0) AS n FROM (SELECT unnest(" + str(EDGE_TYPES + NODE_TYPES) + ") AS type) LEFT JOIN (SELECT edge_type AS type, count(*) AS n FROM edges GROUP BY 1 UNION ALL SELECT node_type, count(*) FROM nodes GROUP BY 1) USING (type)"),
    "graph_degrees": (lambda t: G.degrees(t.edges), BOTH + "SELECT id, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree FROM (SELECT from_id AS id, 0 AS i, 1 AS o FROM edges UNION ALL SELECT to_id, 1, 0 FROM edges) GROUP BY 1"),
    "graph_reachable": (lambda t: G.reachable(t.edges.where("edge_type IN ('CONTAINS', 'DEFINES')"), t.nodes.where("node_type = 'architecture_component'"), 3), BOTH + ", l0 AS (SELECT id AS start, id FROM nodes WHERE node_type = 'architecture_component'), k AS (SELECT * FROM edges WHERE edge_type IN ('CONTAINS', 'DEFINES')), l1 AS (SELECT DISTINCT start, to_id AS id FROM l0 JOIN k ON from_id = l0.id), l2 AS (SELECT DISTINCT start, to_id AS id FROM l1 JOIN k ON from_id = l1.id), l3 AS (SELECT DISTINCT start, to_id AS id FROM l2 JOIN k ON from_id = l2.id) SELECT start, id, min(depth) AS depth FROM (SELECT *, 1 AS depth FROM l1 UNION ALL SELECT *, 2 FROM l2 UNION ALL SELECT *, 3 FROM l3) WHERE start <> id GROUP BY 1, 2"),
    "graph_merge_edges": (lambda t: G.merge_edges(_twice(t), "rank").select(edge_id("edge_type", "from_id", "to_id").alias("id"), "from_id", "to_id", "edge_type", "confidence"), BOTH + "SELECT * FROM edges"),
    "graph_merge_nodes": (lambda t: G.merge_nodes(t.nodes.unionByName(t.nodes.where("node_type = 'class'").withColumn("node_type", F.lit("file")))).select("id", "label", F.array_join("types", ",").alias("types")), f"WITH {NODES_SQL} SELECT id, label, CASE WHEN node_type = 'class' THEN 'class,file' ELSE node_type END AS types FROM nodes"),
}
