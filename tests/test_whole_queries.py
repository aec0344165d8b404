"""Queries over small tables whose decisive rows lie where a shortened job would not look."""

import pytest

from heddle.plans import registry

from .conftest import rows

HEAD, TAIL = (" ".join(f"{word}{i}" for i in range(20)) for word in ("filler", "quasar"))


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    """Document 50 shares only its second half with documents 1 and 3, one of its first words with each of many others."""
    path = str(tmp_path_factory.mktemp("texts"))
    data = [(50, f"{HEAD} {TAIL}", "en"), (1, TAIL, "en"), (2, "nothing shared", "en"), (3, TAIL, "de")]
    data += [(200 + i, f"filler{i % 8}", "fr") for i in range(1, 50)]
    schema = "doc_id bigint, text string, lang string, source string, store_id string, n_chars bigint"
    spark.createDataFrame([(i, t, lang, None, None, len(t)) for i, t, lang in data], schema).write.parquet(f"{path}/documents.parquet")
    vectors = [(i, [1.0 if j == i % 64 else 0.0 for j in range(64)], 0) for i in (50, *range(100, 160))]
    spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return path


@pytest.mark.parametrize("name, hits", [("bm25_topk", {1, 3}), ("bm25_filtered", {1}), ("bm25_local_stats", {1}), ("hybrid_topk", {1, 3})])
def test_text_queries_use_every_token(spark, texts, name, hits):
    got = registry.QUERIES[name](spark, texts)
    ids = {r[0] for r in got.filter("query_id = 50").select("id" if name == "hybrid_topk" else "doc_id").collect()}
    assert hits == ids & {1, 2, 3}


@pytest.mark.parametrize("name, hits", [("store_search_lexical", {"1", "50"}), ("store_search_hybrid", {"50"})])
def test_stored_text_queries_use_every_token(spark, texts, name, hits):
    got = rows(registry.QUERIES[name](spark, texts).filter("query_id = 50"), "document_id")
    assert hits <= {r[0] for r in got}


def test_distance_rerank_ranks_every_node(spark, tmp_path):
    names = [f"a{i:04d}" for i in range(600)] + ["nod-hub-atlasroot", "z-near"]
    spark.createDataFrame([(n, "t", n, None) for n in names], "id string, type string, label string, properties string").write.parquet(f"{tmp_path}/nodes.parquet")
    edges = [("1", "nod-hub-atlasroot", "r", "z-near", None), ("2", "z-near", "r", "a0599", None)]
    spark.createDataFrame(edges, "id string, src string, relation string, dst string, properties string").write.parquet(f"{tmp_path}/edges.parquet")
    got = registry.QUERIES["distance_rerank"](spark, str(tmp_path)).orderBy("rank").collect()
    near = [("nod-hub-atlasroot", 0), ("z-near", 1), ("a0599", 2)]
    assert [(r["id"], r["hops"]) for r in got] == near + [(n, None) for n in names[:599]]
    assert [r["rank"] for r in got] == list(range(1, 603))


def test_dangling_looks_at_facts_without_a_target(spark, tmp_path):
    facts = [("whole", "a", "b", ["e"]), ("lost", "ghost", None, ["e"]), ("open", "a", None, ["e"]), ("told", "a", None, ["gone", None]), ("none", None, None, None)]
    spark.createDataFrame(facts, "id string, src string, dst string, episodes array<string>").write.parquet(f"{tmp_path}/facts.parquet")
    spark.createDataFrame([("a",), ("b",)], "id string").write.parquet(f"{tmp_path}/entities.parquet")
    spark.createDataFrame([("e",)], "id string").write.parquet(f"{tmp_path}/episodes.parquet")
    assert rows(registry.QUERIES["temporal_dangling"](spark, str(tmp_path))) == [("lost", "entity"), ("told", "episode")]


def test_temporal_subgraph_returns_the_expansion(spark, tmp_path):
    times = "valid_at bigint, invalid_at bigint, created_at bigint, expired_at bigint"
    spark.createDataFrame([(i, "t", None, None, 1, None) for i in "abcde"], f"id string, type string, {times}").write.parquet(f"{tmp_path}/entities.parquet")
    facts = [("s", "a", "located_in", "b", 1, None), ("t", "b", "knows", "c", 1, None), ("u", "c", "knows", "d", 1, None), ("v", "a", "knows", "e", 1, 2), ("w", "a", "located_in", "ghost", 1, None)]
    spark.createDataFrame([(*f, 1, None) for f in facts], f"id string, src string, relation string, dst string, {times}").write.parquet(f"{tmp_path}/facts.parquet")
    got = rows(registry.QUERIES["temporal_subgraph"](spark, str(tmp_path)), "id", "hop", "score")
    assert got == [("a", 0, None), ("b", 0, None), ("c", 1, None), ("fact:s", None, 1.0)]


def test_maxsim_uses_every_patch(spark, tmp_path):
    axis = lambda i: [1.0 if j == i else 0.0 for j in range(64)]
    data = [(i, axis(i)) for i in range(8)] + [(8 + i, axis(4 + i % 4)) for i in range(8)] + [(16 + i, axis(i % 3)) for i in range(8)]
    spark.createDataFrame([(*d, 0) for d in data], "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = registry.QUERIES["maxsim_topk"](spark, str(tmp_path)).filter("query_id = 0").orderBy("rank").collect()
    assert [(r["document_id"], r["score"]) for r in got] == [(0, 8.0), (1, 4.0), (2, 3.0)]
