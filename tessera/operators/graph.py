"""Lookups, neighbours, paths and statistics of a node table and an edge table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.rounds import cut


def page(df: DataFrame, limit: int, offset: int = 0, *order: str, most: int = 1000) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(min(limit, most))


def nodes_by_type(nodes: DataFrame, kind: str, limit: int = 1000, offset: int = 0) -> DataFrame:
    return page(nodes.where(F.col("node_type") == kind), limit, offset, "id")


def edges_by_type(edges: DataFrame, kind: str, limit: int = 1000, offset: int = 0) -> DataFrame:
    return page(edges.where(F.col("edge_type") == kind), limit, offset, "id")


def edges_between(edges: DataFrame, source: str, target: str) -> DataFrame:
    return edges.where((F.col("from_id") == source) & (F.col("to_id") == target))


def incident(edges: DataFrame, node: str) -> DataFrame:
    """Edges that start or end at a node: two filters, each of which can prune its scan, instead of a disjunction."""
    return edges.where(F.col("from_id") == node).unionByName(edges.where((F.col("to_id") == node) & (F.col("from_id") != node)))


def neighbors(nodes: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """The nodes at the other end, and the node itself, of all incident edges."""
    near = incident(edges, node)
    ids = near.select(F.col("from_id").alias("id")).union(near.select("to_id")).distinct()
    return nodes.join(ids, "id", "left_semi")


def degrees(edges: DataFrame) -> DataFrame:
    """(id, in_degree, out_degree) of all nodes with edges."""
    ends = edges.select(F.col("from_id").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select("to_id", F.lit(0), F.lit(1)))
    return ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def type_counts(df: DataFrame, column: str) -> DataFrame:
    """(type, n), empty types left out."""
    return df.where(F.coalesce(F.col(column), F.lit("")) != "").groupBy(F.col(column).alias("type")).agg(F.count("*").alias("n"))


def type_stats(df: DataFrame, column: str, rank: str) -> DataFrame:
    """(type, n, best): with the highest value of `rank`."""
    return df.groupBy(F.col(column).alias("type")).agg(F.count("*").alias("n"), F.max(rank).alias("best"))


def schema_catalogue(kinds: list[str], counts: DataFrame) -> DataFrame:
    """(type, n) for all known types, those not observed with 0."""
    spark = counts.sparkSession
    return spark.createDataFrame([(k,) for k in kinds], "type string").join(F.broadcast(counts), "type", "left").select("type", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def shortest_path(edges: DataFrame, source: str, target: str, max_depth: int = 5) -> DataFrame:
    """(step, id, from_id, to_id): a directed path of fewest edges, the one with the least chain of edge ids; none if
    it is longer than max_depth.

    Levels of nodes grow from both ends, each time the smaller, until they meet, so neither grows to most of the graph on
    the way. Only edges between nodes of levels next to each other are read with their ids.
    """
    spark = edges.sparkSession
    slim = cut(edges.select("from_id", "to_id"))
    ends = {"from_id": [spark.createDataFrame([(source,)], "node string")], "to_id": [spark.createDataFrame([(target,)], "node string")]}
    size, met = dict.fromkeys(ends, 1), None
    for _ in range(max_depth if source != target else 0):
        near, far = sorted(ends, key=size.get) if size["from_id"] != size["to_id"] else ("from_id", "to_id")
        seen = reduce(DataFrame.union, ends[near])
        level = cut(slim.join(ends[near][-1].withColumnRenamed("node", near), near, "left_semi").select(F.col(far).alias("node")).distinct().join(seen, "node", "left_anti"))
        ends[near].append(level)
        size[near] = level.count()
        both = level.join(ends[far][-1], "node", "left_semi")
        if not size[near]:
            break
        if not both.isEmpty():
            met = cut(both)
            break
    if met is None:
        return edges.select(F.lit(0).alias("step"), "id", "from_id", "to_id").where(F.lit(False))

    # from where they meet back to the source and on to the target
    pairs, on = {}, met
    for i in range(len(ends["from_id"]) - 2, -1, -1):
        pairs[i] = cut(_between(slim, ends["from_id"][i], on))
        on = pairs[i].select(F.col("from_id").alias("node")).distinct()
    on = met
    for i, level in enumerate(reversed(ends["to_id"][:-1]), len(ends["from_id"]) - 1):
        pairs[i] = cut(_between(slim, on, level))
        on = pairs[i].select(F.col("to_id").alias("node")).distinct()
    whole = cut(edges.join(reduce(DataFrame.union, pairs.values()).distinct(), ["from_id", "to_id"], "left_semi").select("id", "from_id", "to_id"))
    chains = spark.createDataFrame([(source, [])], "node string, chain array<string>")
    for i in range(len(pairs)):
        step = chains.join(pairs[i], F.col("node") == F.col("from_id")).select("from_id", "to_id", "chain").join(whole, ["from_id", "to_id"])
        chains = cut(step.groupBy(F.col("to_id").alias("node")).agg(F.min(F.array_append("chain", F.col("id"))).alias("chain")))
    found = chains.where(F.col("node") == target).select(F.posexplode("chain").alias("i", "id"))
    return found.join(whole, "id").select((F.col("i") + 1).alias("step"), "id", "from_id", "to_id")


def _between(slim: DataFrame, starts: DataFrame, ends: DataFrame) -> DataFrame:
    return slim.join(starts.withColumnRenamed("node", "from_id"), "from_id", "left_semi").join(ends.withColumnRenamed("node", "to_id"), "to_id", "left_semi").select("from_id", "to_id").distinct()


def reachable(edges: DataFrame, starts: DataFrame, max_depth: int) -> DataFrame:
    """(start, id, depth): least number of forward edges to every node reached, the start itself left out."""
    step = cut(edges.select("from_id", "to_id").distinct())
    level = starts.select(F.col("id").alias("start"), "id")
    seen = [level.withColumn("depth", F.lit(0))]
    for depth in range(1, max_depth + 1):
        near = level.join(step, level.id == step.from_id).select("start", F.col("to_id").alias("id")).distinct()
        # only what is new goes on; it and what was seen are written, not computed again
        level = cut(near.join(reduce(DataFrame.unionByName, seen), ["start", "id"], "left_anti"))
        seen.append(level.withColumn("depth", F.lit(depth)))
    return reduce(DataFrame.unionByName, seen[1:])


def merge_nodes(nodes: DataFrame) -> DataFrame:
    """One row for each id: the first label and file (least, nulls last), every distinct type."""
    return nodes.groupBy("id").agg(F.min("label").alias("label"), F.min("file_id").alias("file_id"), F.array_sort(F.collect_set("node_type")).alias("types"))


def merge_edges(edges: DataFrame, rank: str) -> DataFrame:
    """One row for each (from, to, type): that of the highest rank, ties to the least id, or of edges that have none yet, to
    the least of the other columns. Ids that follow from these three are best made afterwards, since they are long."""
    key = ["from_id", "to_id", "edge_type"]
    ties = ["id"] if "id" in edges.columns else sorted(set(edges.columns) - {*key, rank})
    best = Window.partitionBy(*key).orderBy(F.col(rank).desc(), *ties)
    return edges.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")
