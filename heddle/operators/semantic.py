"""Semantic retrieval over graphs: a derived index of labels and facts, searched and joined back to the topology.

The index has one unit per element: id, kind, label (type or relation), text,
tokens, vector. It is a by-product that may lag behind or be rebuilt at any
time, so every hit is joined with the current rows, which decide by the temporal
frame and the caller's predicate whether it counts. Both are applied before the
ranking too, by restricting the candidates, so that k hits come out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.embedding import Embedder
from ..functions.frames import AsOf
from ..functions.predicate import metadata_filter
from ..functions.text import tokenize
from ..functions.vectors import l2_normalize
from ..plans.search import search, with_vectors
from . import graph, temporal_graph as tg

INDEX = "id string, kind string, label string, text string, tokens array<string>, vector array<float>"
SEED_KINDS = ("entity", "fact", "both")


def build_index(elements: DataFrame, kind: str, embedder: Embedder, vectors: DataFrame | None = None) -> DataFrame:
    """Index units of ``elements`` (id, label, text); an element may occur several times with one text.

    ``vectors`` (id, vector) are retained vectors, which come before the
    embedder. Elements with neither a vector nor a text have no unit, see
    ``unrebuildable``.
    """
    one = elements.filter(F.col("id").isNotNull()).groupBy("id").agg(F.min_by("label", F.struct("text", "label")).alias("label"), F.min("text").alias("text"))
    kept = vectors.groupBy("id").agg(F.max("vector").alias("kept")) if vectors is not None else None
    joined = one.join(kept, "id", "left") if kept is not None else one.withColumn("kept", F.lit(None).cast("array<float>"))
    worded = F.coalesce(F.trim("text") != "", F.lit(False))
    joined = joined.filter(F.col("kept").isNotNull() | worded)
    has = joined.filter(F.col("kept").isNotNull()).withColumn("vector", l2_normalize(F.col("kept")).cast("array<float>"))
    # two branches, so that the embedder sees only the texts it is needed for
    made = joined.filter(F.col("kept").isNull()).withColumn("vector", embedder.documents(F.col("text")).cast("array<float>"))
    return has.unionByName(made).select("id", F.lit(kind).alias("kind"), "label", "text", tokenize(F.col("text")).alias("tokens"), "vector")


def unrebuildable(elements: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """Distinct ids of elements (id, text) that can have no index unit: without text and without retained vector."""
    bare = elements.groupBy("id").agg(F.max(F.coalesce(F.trim("text") != "", F.lit(False))).alias("worded")).filter("not worded").select("id")
    return bare.join(vectors.select("id").distinct(), "id", "left_anti") if vectors is not None else bare


def orphans(index: DataFrame, elements: DataFrame) -> DataFrame:
    """Index units whose element is gone."""
    return index.join(elements.select("id").distinct(), "id", "left_anti")


def reindex(index: DataFrame, elements: DataFrame, kind: str, embedder: Embedder, vectors: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The index of one kind rebuilt from the topology, and one row of counts: reindexed, unrebuildable, removed_orphans."""
    own = index.filter(F.col("kind") == kind)
    fresh = build_index(elements, kind, embedder, vectors)
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    counts = count(fresh, "reindexed").crossJoin(count(unrebuildable(elements, vectors), "unrebuildable")).crossJoin(count(orphans(own, elements), "removed_orphans"))
    return index.filter(F.col("kind") != kind).unionByName(fresh), counts


def _property_map(properties: Column) -> Column:
    return F.coalesce(F.from_json(properties, "map<string,string>"), F.create_map().cast("map<string,string>"))


def property_gate(predicate: dict | None, properties: str = "properties") -> Column | None:
    """A predicate over JSON properties as a Column; the fields of the index itself cannot be reached."""
    return None if predicate is None else metadata_filter(_property_map(F.col(properties)), predicate)


def hits(index: DataFrame, kind: str, queries: DataFrame, k: int, embedder: Embedder, allowed: DataFrame | None = None, label: str | None = None, mode: str | None = None, digits: int = 6) -> DataFrame:
    """query_id, rank, score, id: the ``k`` best units of a kind, of a label (type or relation) and of ``allowed`` ids if given.

    ``queries``: query_id and text, or vector. Text queries are hybrid unless a
    mode is given; queries that bring vectors are vector queries, and no other
    mode may be asked for then.
    """
    if "vector" in queries.columns and mode not in (None, "vector"):
        raise ValueError("a vector query cannot be lexical")
    mode = mode or ("vector" if "vector" in queries.columns else "hybrid")
    queries = with_vectors(queries, mode, embedder.queries, embedder.dim)
    # one index for all kinds: its statistics are those of all units, the kind only restricts what is ranked
    name = F.concat_ws(":", "kind", "id")
    documents = index.select(name.alias("document_id"), F.create_map(F.lit("kind"), F.col("kind"), F.lit("label"), F.coalesce("label", F.lit(""))).alias("metadata"))
    chunks = index.select(name.alias("document_id"), name.alias("chunk_id"), "tokens", "vector")
    scope = {"metadata": {"kind": kind} | ({"label": label} if label is not None else {})}
    if allowed is not None:
        scope["document_ids"] = allowed.select(F.concat(F.lit(f"{kind}:"), "id").alias("document_id"))
    found = search(documents, chunks, queries, k, scope, mode, digits=digits).hits
    return found.select("query_id", "rank", "score", F.substring("document_id", len(kind) + 2, 1 << 30).alias("id"))


def semantic_nodes(nodes: DataFrame, index: DataFrame, queries: DataFrame, k: int, embedder: Embedder, type: str | None = None, predicate: dict | None = None, mode: str | None = None) -> DataFrame:
    """The ``k`` nodes most relevant to each query: query_id, rank, score, id. ``predicate`` is a filter on their properties."""
    gate = property_gate(predicate)
    live = nodes.select("id", "type", "properties") if gate is None else nodes.select("id", "type", "properties").filter(gate)
    live = live if type is None else live.filter(F.col("type") == type)
    return hits(index, "node", queries, k, embedder, live.select("id").distinct(), type, mode)


def semantic_edges(edges: DataFrame, index: DataFrame, queries: DataFrame, k: int, embedder: Embedder, relation: str | None = None, mode: str | None = None) -> DataFrame:
    """The ``k`` edges with the most relevant fact texts; edges without an index unit have no part."""
    return hits(index, "edge", queries, k, embedder, edges.select("id").distinct(), relation, mode)


def _live(rows: DataFrame, frame: AsOf, predicate: dict | None) -> DataFrame:
    gate = property_gate(predicate)
    kept = rows.filter(frame.predicate())
    return kept if gate is None else kept.filter(gate)


def semantic_entities(entities: DataFrame, index: DataFrame, queries: DataFrame, k: int, embedder: Embedder, frame: AsOf | None = None, type: str | None = None, predicate: dict | None = None, mode: str | None = None) -> DataFrame:
    """The ``k`` entities most relevant to each query under a frame (default: now): query_id, rank, score, id."""
    live = _live(entities, frame or AsOf.now(), predicate)
    live = live if type is None else live.filter(F.col("type") == type)
    return hits(index, "entity", queries, k, embedder, live.select("id").distinct(), type, mode)


def semantic_facts(facts: DataFrame, index: DataFrame, queries: DataFrame, k: int, embedder: Embedder, frame: AsOf | None = None, relation: str | None = None, predicate: dict | None = None, mode: str | None = None) -> DataFrame:
    """The ``k`` facts most relevant to each query under a frame: query_id, rank, score, id."""
    live = _live(facts, frame or AsOf.now(), predicate)
    live = live if relation is None else live.filter(F.col("relation") == relation)
    return hits(index, "fact", queries, k, embedder, live.select("id").distinct(), relation, mode)


def resolve_entity(entities: DataFrame, index: DataFrame, names: DataFrame, k: int, embedder: Embedder, predicate: dict | None = None) -> DataFrame:
    """Candidates for names (query_id, text), whatever their time: the caller decides on a merge."""
    return semantic_entities(entities, index, names, k, embedder, AsOf.all(), predicate=predicate)


def search_graph(nodes: DataFrame, edges: DataFrame, index: DataFrame, query: DataFrame, k: int, hops: int, embedder: Embedder, type: str | None = None, predicate: dict | None = None, mode: str | None = None, **options) -> graph.Subgraph:
    """Semantic seeds of one query and what lies within ``hops`` of them; all seeds stay in the result."""
    seeds = semantic_nodes(nodes, index, query, k, embedder, type, predicate, mode).select("id", "score")
    return graph.search_subgraph(edges, seeds, hops, **options)


def search_temporal(
    entities: DataFrame, facts: DataFrame, index: DataFrame, query: DataFrame, k: int, hops: int, embedder: Embedder, frame: AsOf | None = None, seed_kind: str = "entity",
    type: str | None = None, relation: str | None = None, predicate: dict | None = None, mode: str | None = None, direction: str = "both",
) -> graph.Subgraph:
    """Seeds of one query, entities or facts or both, and the traversal from them, all under one frame and predicate.

    Fact seeds count if both ends are allowed; they are reported as ``fact:<id>``.
    """
    if seed_kind not in SEED_KINDS:
        raise ValueError(f"seed_kind is one of {SEED_KINDS}")
    frame = frame or AsOf.now()
    own = semantic_entities(entities, index, query, k, embedder, frame, type, predicate, mode).select("id", "score") if seed_kind != "fact" else None
    told = semantic_facts(facts, index, query, k, embedder, frame, relation, predicate, mode).select("id", "score") if seed_kind != "entity" else None
    return tg.search_subgraph(entities, facts, hops, frame, own, told, property_gate(predicate), direction=direction)
