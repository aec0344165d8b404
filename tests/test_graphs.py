import pytest
from pyspark.sql import functions as F

from heddle.functions.frames import AsOf
from heddle.operators import graph
from heddle.operators import temporal_graph as tg
from heddle.plans.graphs import QUERIES
from heddle.sources import sync

from .conftest import rows, settle


def settled(tables):
    return tg.TemporalTables(*[settle(getattr(tables, n)) for n in ("episodes", "entities", "facts", "mentions", "versions")])

NODE, EDGE = "id string, type string, label string, properties string", "id string, src string, relation string, dst string, properties string"


@pytest.fixture(scope="module")
def nodes(spark):
    return spark.createDataFrame([(i, "t", i.upper(), '{"p": "%s"}' % i) for i in "abcde"], NODE)


@pytest.fixture(scope="module")
def edges(spark):
    data = [("1", "a", "r", "b"), ("2", "b", "r", "c"), ("3", "c", "s", "a"), ("4", "c", "r", "d"), ("5", "d", "r", "ghost"), ("6", "e", "r", None)]
    return spark.createDataFrame([(*d, '{"w": "%s"}' % d[0]) for d in data + data[:1]], EDGE)


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def test_k_hop(spark, nodes, edges):
    hop = lambda k, **o: graph.k_hop(edges, ids(spark, "a", "unknown"), k, **o)
    assert rows(hop(0).nodes) == [("a", 0), ("unknown", 0)] and hop(0).edges.count() == 0
    assert rows(hop(2, direction="out").nodes) == [("a", 0), ("b", 1), ("c", 2), ("unknown", 0)]
    assert rows(hop(2, direction="out").edges, "id") == [("1",), ("2",)]
    assert rows(hop(1).nodes, "id") == [("a",), ("b",), ("c",), ("unknown",)]
    assert rows(hop(3, direction="in").nodes, "id") == [("a",), ("b",), ("c",), ("unknown",)]
    assert rows(hop(4, direction="out").nodes, "id", "hop")[-2:] == [("ghost", 4), ("unknown", 0)]
    assert rows(hop(4, direction="out", relation="r").edges, "id") == [("1",), ("2",), ("4",), ("5",)]
    assert rows(hop(3, direction="out", max_nodes=3).nodes, "id") == [("a",), ("b",), ("unknown",)]
    assert rows(graph.k_hop(edges, ids(spark, "a"), 2, "out", node_gate=ids(spark, "a", "b", "d")).nodes, "id") == [("a",), ("b",)]
    with pytest.raises(ValueError):
        hop(1, direction="up")


def test_triplets_and_relation_map(spark, nodes, edges):
    t = lambda **o: rows(graph.triplets(nodes, edges, **o), "edge_id")
    assert t() == []
    assert t(entity_names=["c"]) == [("2",), ("3",), ("4",)]
    assert t(relation_names=["s"]) == [("3",)]
    assert t(properties={"p": "a", "w": "4"}) == [("1",), ("3",), ("4",)]
    assert t(ids=["d"]) == [("4",)]  # the edge to the ghost dangles
    got = rows(graph.relation_map(nodes, edges, ["a"], 2, ignore=["s"]), "edge_id", "depth")
    assert got == [("1", 0), ("2", 1)]  # 3 has relation s
    assert rows(graph.dangling_edges(nodes, edges), "id") == [("5",), ("6",)]


def test_changes(spark, nodes, edges):
    n, e = graph.remove_nodes(nodes, edges, ids(spark, "c"))
    assert rows(n, "id") == [("a",), ("b",), ("d",), ("e",)] and rows(e.distinct(), "id") == [("1",), ("5",), ("6",)]
    fresh = spark.createDataFrame([("a", "t", "old", "{}", 1), ("a", "t", "new", "{}", 2)], NODE + ", seq int")
    assert rows(graph.upsert(nodes, fresh).filter("id = 'a'"), "label") == [("new",)]
    n, e = graph.remove_triplets(nodes, edges, relation_names=["s"])
    assert n.count() == 5 and rows(e.distinct(), "id") == [("1",), ("2",), ("4",), ("5",), ("6",)]
    named = graph.with_edge_ids(spark.createDataFrame([(None, "x", "r", "y", "{}")], EDGE))
    assert rows(named, "id") == [("x:r:y",)]
    assert rows(graph.graph_stats(nodes, edges)) == [(5, 6)]


ENTITY = "id string, type string, label string, properties string, valid_at bigint, invalid_at bigint"
FACT = "id string, src string, relation string, dst string, fact string, properties string, episodes array<string>, valid_at bigint, invalidates array<string>"


@pytest.fixture(scope="module")
def world(spark):
    t = tg.TemporalTables.empty(spark)
    t = tg.add_episodes(t, spark.createDataFrame([("e1", "s", "b", 5, 6, "{}"), ("e2", "s", "b", 3, 6, "{}")], tg.EPISODE))
    t = tg.upsert_entities(t, spark.createDataFrame([(i, "p", i, '{"k":"1","z":"%s"}' % i, 0, None) for i in "xyz"], ENTITY), 10)
    return settled(tg.add_facts(t, spark.createDataFrame([("f1", "x", "r", "y", "x r y", "{}", ["e1", "e2"], None, []), ("f2", "y", "r", "z", "y r z", "{}", ["e2"], 4, None)], FACT), 20))


def test_facts_supersede(spark, world):
    assert rows(world.facts, "id", "valid_at", "reference_time", "created_at") == [("f1", None, 3, 20), ("f2", 4, 3, 20)]
    new = spark.createDataFrame([("f3", "x", "r", "z", "x r z", "{}", ["e1"], None, ["f1"])], FACT)
    after = settled(tg.add_facts(world, new, 30))
    assert rows(after.facts, "id", "valid_at", "invalid_at", "expired_at") == [("f1", None, 5, 30), ("f2", 4, None, None), ("f3", 5, None, None)]
    assert rows(tg.add_facts(after, new, 40).facts) == rows(after.facts)  # the same again
    for bad in (
        ("f3", "x", "r", "y", "other", "{}", ["e1"], None, None), ("f9", "x", "r", "nobody", "", "{}", [], None, None), ("f9", "x", "r", "y", "", "{}", ["e9"], None, None),
        ("f9", "x", "r", "y", "", "{}", [], None, ["f1"]), ("f9", "x", "r", "y", "", "{}", [], None, ["f77"]), (" ", "x", "r", "y", "", "{}", [], None, None),
    ):
        with pytest.raises(tg.GraphError):
            tg.add_facts(after, spark.createDataFrame([bad], FACT), 50)
    assert rows(tg.facts_as_of(after.facts, AsOf.now(), "x"), "id") == [("f3",)]
    assert [r["id"] for r in tg.history(after.facts, "x").collect()] == ["f1", "f3"]
    closed = tg.invalidate_facts(after, spark.createDataFrame([("f1", 1), ("f2", None)], "id string, invalid_at bigint"), 60)
    assert rows(closed.facts, "id", "invalid_at", "expired_at") == [("f1", 5, 30), ("f2", None, 60), ("f3", None, None)]


def test_property_lineage(spark, world):
    batch = spark.createDataFrame([("x", "p", "X", '{"k":"2","n":"new"}', 7, None)], ENTITY)
    sources = spark.createDataFrame([("x", "n", "e1")], "entity_id string, property_key string, episode_id string")
    after = settled(tg.upsert_entities(world, batch, 50, sources))
    got = rows(after.versions.filter("entity_id = 'x'"), "property_key", "value", "valid_at", "invalid_at", "created_at", "expired_at", "episode_id")
    assert got == [("k", "1", 0, 7, 10, 50, None), ("k", "2", 7, None, 50, None, None), ("n", "new", 7, None, 50, None, "e1"), ("z", "x", 0, 7, 10, 50, None)]
    assert rows(after.entities.filter("id = 'x'"), "label", "created_at") == [("X", 10)]
    assert rows(tg.upsert_entities(after, batch, 60).versions) == rows(after.versions)
    assert rows(tg.current_versions(after.versions).filter("entity_id = 'x'"), "property_key", "value") == [("k", "2"), ("n", "new")]
    assert tg.property_history(after.versions, "x", "k").count() == 2
    with pytest.raises(tg.GraphError):
        tg.upsert_entities(world, batch, 50, spark.createDataFrame([("x", "absent", "e1")], sources.schema))


def test_lineage_of_all_versions(spark, tmp_path):
    entity = "id string, type string, label string, properties string, valid_at bigint, invalid_at bigint"
    texts = ['{"k":"1","z":"a"}', '{"k":"2"}', '{"k":"2","z":"b"}', None, '{"k":"3","z":"b"}']
    history = [("x", "t", "x", p, v, None, 10 * n) for n, (p, v) in enumerate(zip(texts, (5, None, 7, None, 9)))] + [("y", "t", "y", '{"k":"1"}', None, None, 3)]
    tables = tg.TemporalTables.empty(spark)
    for n in range(len(texts)):
        batch = [r[:6] for r in history if r[0] == "x"][n : n + 1] + [r[:6] for r in history if r[0] == "y" and n == 0]
        tables = settled(tg.upsert_entities(tables, spark.createDataFrame(batch, entity), 1000 * (n + 1)))
    spark.createDataFrame(history, f"{entity}, created_at bigint").write.parquet(f"{tmp_path}/entities.parquet")
    got = QUERIES["property_lineage"](spark, str(tmp_path))
    assert rows(got) == rows(tables.versions, *got.columns)
    assert rows(got.filter("created_at > 2000"), "property_key", "value") == [("k", "3"), ("z", "b"), ("z", "b")]


def test_episodes(spark, world):
    again = spark.createDataFrame([("e1", "s", "b", 5, 99, "{}")], tg.EPISODE)
    assert rows(tg.add_episodes(world, again).episodes) == rows(world.episodes)
    with pytest.raises(tg.GraphError):
        tg.add_episodes(world, again.withColumn("body", F.lit("else")))
    with pytest.raises(tg.GraphError):
        tg.add_episodes(world, again, spark.createDataFrame([("e1", "nobody")], tg.MENTION))
    seen = tg.add_episodes(world, again, spark.createDataFrame([("e1", "x"), ("e1", "x")], tg.MENTION))
    assert rows(tg.mention_counts(seen.mentions)) == [("x", 1)]
    left = tg.remove_episode(world, "e2")
    assert rows(left.facts, "id", "episodes") == [("f1", ["e1"])] and rows(left.episodes, "id") == [("e1",)]
    assert rows(tg.remove_entity(world, "y").facts) == [] and tg.remove_fact(world, "f1").facts.count() == 1
    assert rows(tg.dangling(world)) == []


def test_temporal_traversal(spark, world):
    seeds = ids(spark, "x")
    assert rows(tg.k_hop(world.entities, world.facts, seeds, 2, AsOf.now(), "out").nodes) == [("x", 0), ("y", 1), ("z", 2)]
    assert rows(tg.k_hop(world.entities, world.facts, seeds, 2, AsOf.at(3), "out").nodes) == [("x", 0), ("y", 1)]
    gate = F.col("id") != "y"
    assert rows(tg.k_hop(world.entities, world.facts, seeds, 2, AsOf.now(), gate=gate).nodes) == [("x", 0)]
    assert rows(tg.k_hop(world.entities, world.facts, seeds, 2, AsOf.now(), gate=F.col("id") != "x").nodes) == []
    scored = spark.createDataFrame([("f2", 0.5), ("f1", 0.4)], "id string, score double")
    sub = tg.search_subgraph(world.entities, world.facts, 0, AsOf.at(3), entity_seeds=spark.createDataFrame([("z", 1.0)], "id string, score double"), fact_seeds=scored)
    assert rows(sub.seeds, "id") == [("fact:f1",), ("z",)] and rows(sub.nodes, "id") == [("x",), ("y",), ("z",)]


SNAP = "struct<generation:int,snapshot_id:string,logical_id:string,text_id:string,lexical_id:string>"


@pytest.mark.parametrize(
    "local,base,remote,want",
    [
        (None, None, None, "in_sync"), ((1, "s", "l", None, None), None, None, "local_ahead"), (None, None, (1, "s", "l", None, None), "remote_ahead"),
        ((1, "s", "l", None, None), None, (1, "s", "l", None, None), "in_sync"), ((1, "s2", "l", "t", None), None, (1, "s", "l", None, None), "republish"),
        ((1, "s2", "l", None, None), None, (1, "s", "l", "t", None), "in_sync"), ((1, "s2", "l", "t", None), None, (1, "s", "l", None, "x"), "unknown"),
        ((1, "s2", "l", "t1", None), None, (1, "s", "l", "t2", None), "unknown"), ((2, "s2", "m", None, None), None, (1, "s", "l", None, None), "unknown"),
        ((2, "s2", "m", None, None), (1, "s", "l", None, None), (1, "s", "l", None, None), "local_ahead"), ((1, "s", "l", None, None), (1, "s", "l", None, None), (2, "r", "n", None, None), "remote_ahead"),
        ((2, "s2", "m", None, None), (1, "s", "l", None, None), (2, "r", "n", None, None), "diverged"), ((0, "s2", "m", None, None), (1, "s", "l", None, None), (2, "r", "n", None, None), "unknown"),
        ((1, "s3", "l", "t", None), (1, "s", "l", None, None), (2, "r", "n", None, None), "diverged"), (None, (1, "s", "l", None, None), None, "in_sync"),
    ],
)
def test_sync_states(spark, local, base, remote, want):
    df = spark.createDataFrame([(local, base, remote)], f"local {SNAP}, base {SNAP}, remote {SNAP}")
    assert sync.classify(df).first()["state"] == want


def test_inventories(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "2"), ("z", None)], "artifact string, sha256 string")
    b = spark.createDataFrame([("y", "3"), ("z", None), ("w", "1")], "artifact string, sha256 string")
    assert rows(sync.inventory_diff(a, b)) == [("w", "added"), ("x", "removed"), ("y", "changed")]
