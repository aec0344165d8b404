"""Property graphs as two DataFrames: nodes (id, type, label, properties) and edges (id, src, relation, dst, properties)."""

from __future__ import annotations

import json
import logging
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import edge_id
from ..sources.tables import cut_lineage

logger = logging.getLogger(__name__)

DIRECTIONS = ("out", "in", "both")
#: Hops after which the lineage of the traversal is cut by a written table.
CUT_EVERY = 3


@dataclass
class Subgraph:
    """nodes: id, hop; edges: all columns of the edge table; seeds: id, score; ``truncated`` tells whether ``max_nodes`` cut it short."""

    nodes: DataFrame
    edges: DataFrame
    seeds: DataFrame
    truncated: bool = False


def upsert(table: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``rows`` replace those with the same key; of a key repeated in ``rows`` the last by ``seq`` (if there) counts."""
    if "seq" in rows.columns:
        last = Window.partitionBy(key).orderBy(F.desc("seq"))
        rows = rows.withColumn("__rn", F.row_number().over(last)).filter("__rn = 1").drop("__rn", "seq")
    return table.join(rows.select(key), key, "left_anti").unionByName(rows)


def with_edge_ids(edges: DataFrame) -> DataFrame:
    """Fills in missing edge ids from the triple."""
    return edges.withColumn("id", F.coalesce("id", edge_id(F.col("src"), F.col("relation"), F.col("dst"))))


def remove_nodes(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Removes nodes (``ids``: id) and every edge at one of them."""
    gone = ids.select("id").distinct()
    kept = edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return nodes.join(gone, "id", "left_anti"), kept.select(*edges.columns)


def _check(direction: str) -> None:
    if direction not in DIRECTIONS:
        raise ValueError(f"direction is one of {DIRECTIONS}")


def incident(edges: DataFrame, ids: DataFrame, direction: str = "both") -> DataFrame:
    """Edges with an end in ``ids`` (id); an edge found from both ends comes once per row of the edge table.

    Two equi-joins instead of one with OR; the second takes only what the first did not.
    """
    _check(direction)
    out = edges.join(ids.select(F.col("id").alias("src")).distinct(), "src", "left_semi").select(*edges.columns)
    if direction == "out":
        return out
    into = edges.join(ids.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi").select(*edges.columns)
    if direction == "in":
        return into
    rest = into.join(ids.select(F.col("id").alias("src")).distinct(), "src", "left_anti").select(*edges.columns)
    return out.unionByName(rest)


def neighbors(edges: DataFrame, node: str, direction: str = "both", relation: str | None = None) -> DataFrame:
    """Edges at one node: a filter that reaches the scan."""
    _check(direction)
    at = {"out": F.col("src") == node, "in": F.col("dst") == node, "both": (F.col("src") == node) | (F.col("dst") == node)}[direction]
    return edges.filter(at if relation is None else at & (F.col("relation") == relation))


def k_hop(
    edges: DataFrame,
    seeds: DataFrame,
    k: int,
    direction: str = "both",
    relation: str | None = None,
    max_nodes: int | None = None,
    node_gate: DataFrame | None = None,
) -> Subgraph:
    """Nodes within ``k`` hops of the seeds (id) and every edge followed on the way.

    Each hop follows the edges of the nodes found in the hop before and keeps
    all of them, also those that lead back; the nodes of the last hop are
    returned, their edges are not. Seeds are kept even if no edge knows them.
    ``max_nodes`` stops at that many nodes, nearer hops and smaller ids first,
    and the result and a warning say so if any were left out.
    ``node_gate`` (id): only edges between two such nodes are followed, and only
    such seeds. Null ends lead nowhere. k = 0 gives the seeds alone.
    """
    _check(direction)
    if relation is not None:
        edges = edges.filter(F.col("relation") == relation)
    edges = edges.filter(F.col("src").isNotNull() & F.col("dst").isNotNull())
    start = seeds.select("id").filter(F.col("id").isNotNull()).distinct()
    if node_gate is not None:
        gate = node_gate.select("id").distinct()
        edges = edges.join(gate.withColumnRenamed("id", "src"), "src", "left_semi").join(gate.withColumnRenamed("id", "dst"), "dst", "left_semi")
        start = start.join(gate, "id", "left_semi")
    visited = start.withColumn("hop", F.lit(0))
    frontier, followed, truncated = start, None, False
    for hop in range(1, k + 1):
        found = incident(edges, frontier, direction)
        followed = found if followed is None else followed.unionByName(found)
        ends = {"out": ["dst"], "in": ["src"], "both": ["src", "dst"]}[direction]
        reached = found.select(F.explode(F.array(*ends)).alias("id")).distinct().join(visited, "id", "left_anti")
        if max_nodes is not None:
            room = max(0, max_nodes - visited.count())
            if reached.limit(room + 1).count() > room:
                truncated = True
                logger.warning("the traversal stopped at %s nodes in hop %s; the subgraph is partial", max_nodes, hop)
            reached = reached.orderBy("id").limit(room)
        if hop % CUT_EVERY == 0 and hop < k:
            reached, visited, followed = (cut_lineage(x, "hop") for x in (reached, visited, followed))
        visited = visited.unionByName(reached.withColumn("hop", F.lit(hop)))
        frontier = reached
    none = edges.limit(0)
    links = followed.dropDuplicates(["id"]) if followed is not None else none
    return Subgraph(visited, links, start.withColumn("score", F.lit(None).cast("double")), truncated)


def search_subgraph(edges: DataFrame, scored_seeds: DataFrame, k: int, **options) -> Subgraph:
    """Expands ranked seeds (id, score); all of them stay in the result."""
    grown = k_hop(edges, scored_seeds, k, **options)
    return Subgraph(grown.nodes, grown.edges, scored_seeds.select("id", "score"), grown.truncated)


def _has_property(properties: Column, wanted: dict) -> Column:
    """Whether any top-level property has its wanted value; other values than texts are compared as JSON writes them."""
    held = F.coalesce(F.from_json(properties, "map<string,string>"), F.create_map().cast("map<string,string>"))
    text = lambda v: v if isinstance(v, str) else json.dumps(v)
    tests = [F.coalesce(F.try_element_at(held, F.lit(k)) == F.lit(text(v)), F.lit(False)) for k, v in wanted.items()]
    found = tests[0]
    for t in tests[1:]:
        found = found | t
    return found


def nodes_with(nodes: DataFrame, properties: dict | None = None, ids: list[str] | None = None) -> DataFrame:
    """Nodes with any of the properties, and among the ids if given."""
    if properties:
        nodes = nodes.filter(_has_property(F.col("properties"), properties))
    return nodes.filter(F.col("id").isin(ids)) if ids else nodes


def triplets(
    nodes: DataFrame, edges: DataFrame, entity_names: list[str] | None = None, relation_names: list[str] | None = None, properties: dict | None = None, ids: list[str] | None = None
) -> DataFrame:
    """source, relation, target (ids) and edge_id of the edges between existing nodes that pass all filters given.

    Names and ids match either end, a property match on any of the three
    elements suffices. Without any filter there are no triplets.
    """
    if not (entity_names or relation_names or properties or ids):
        edges = edges.limit(0)
    for names in (entity_names, ids):
        if names:
            edges = edges.filter(F.col("src").isin(names) | F.col("dst").isin(names))
    if relation_names:
        edges = edges.filter(F.col("relation").isin(relation_names))
    node = nodes.select("id", "properties").dropDuplicates(["id"])
    joined = (
        edges.dropDuplicates(["id"]).select(F.col("id").alias("edge_id"), "src", "relation", "dst", F.col("properties").alias("ep"))
        .join(node.select(F.col("id").alias("src"), F.col("properties").alias("sp")), "src")
        .join(node.select(F.col("id").alias("dst"), F.col("properties").alias("dp")), "dst")
    )
    if properties:
        joined = joined.filter(_has_property(F.col("sp"), properties) | _has_property(F.col("ep"), properties) | _has_property(F.col("dp"), properties))
    return joined.select("edge_id", F.col("src").alias("source"), "relation", F.col("dst").alias("target"))


def relation_map(nodes: DataFrame, edges: DataFrame, seeds: list[str], depth: int = 2, limit: int = 30, ignore: list[str] | None = None) -> DataFrame:
    """Triplets around the seeds, following targets for ``depth`` rounds; at most ``limit``, nearer and smaller edge ids first."""
    known = nodes.select("id").distinct()
    whole = edges.dropDuplicates(["id"]).join(known.withColumnRenamed("id", "src"), "src", "left_semi").join(known.withColumnRenamed("id", "dst"), "dst", "left_semi")
    at = nodes.sparkSession.createDataFrame([(s,) for s in seeds], "id string")
    found = None
    for level in range(depth):
        hop = incident(whole, at, "both").withColumn("depth", F.lit(level))
        found = hop if found is None else found.unionByName(hop)
        at = hop.select(F.col("dst").alias("id")).distinct()
    first = found.groupBy("id", "src", "relation", "dst").agg(F.min("depth").alias("depth"))
    kept = first.filter(~F.col("relation").isin(ignore)) if ignore else first
    return kept.orderBy("depth", "id").limit(limit).select(F.col("id").alias("edge_id"), F.col("src").alias("source"), "relation", F.col("dst").alias("target"), "depth")


def remove_triplets(nodes: DataFrame, edges: DataFrame, properties: dict | None = None, ids: list[str] | None = None, **filters) -> tuple[DataFrame, DataFrame]:
    """Removes the edges of the matching triplets, and matching nodes only if ids or properties are given."""
    gone = triplets(nodes, edges, properties=properties, ids=ids, **filters)
    edges = edges.join(gone.select(F.col("edge_id").alias("id")), "id", "left_anti")
    if properties or ids:
        return remove_nodes(nodes, edges, nodes_with(nodes, properties, ids))
    return nodes, edges


def ingest(nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables after one batch of nodes and edges; edges without id get one from their triple, blank ends are refused."""
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    bad = new_edges.filter(blank("src") | blank("dst") | blank("relation")).select("src", "relation", "dst").limit(3).collect()
    bad += new_nodes.filter(blank("id")).limit(3).collect()
    if bad:
        raise ValueError(f"blank ids or relations: {[tuple(b) for b in bad]}")
    return upsert(nodes, new_nodes), upsert(edges, with_edge_ids(new_edges))


def dangling_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with an end that no node has."""
    known = nodes.select("id").distinct()
    bad_src = edges.join(known.withColumnRenamed("id", "src"), "src", "left_anti").select(*edges.columns)
    bad_dst = edges.join(known.withColumnRenamed("id", "dst"), "dst", "left_anti").select(*edges.columns)
    return bad_src.unionByName(bad_dst).dropDuplicates(["id"])


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes, edges: numbers of distinct ids."""
    return nodes.agg(F.countDistinct("id").alias("nodes")).crossJoin(edges.agg(F.countDistinct("id").alias("edges")))
