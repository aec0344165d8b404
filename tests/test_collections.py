"""Collections beyond single writes: deltas, races, reuse, search, patches, indexes, logs, and the verbs of other callers."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from heddle.functions.embedding import BatchEmbedder, EmbeddingError, HashEmbedder, pool, preset, unpadded
from heddle.sources.files import Folder
from heddle.sources.store import Collection, Config, Spaces, StoreError
from heddle.sources.tables import cut_lineage, scratch_dir, sweep
from heddle.sources.verbs import Memories, Nodes, Passages, Points, Texts

from .conftest import rows

DOC = "document_id string, text string, metadata map<string,string>"


def docs(spark, *data):
    return spark.createDataFrame([(i, t, m) for i, t, m in data], DOC)


def vectors(spark, n, dim=8, seed=0, **metadata):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(f"v{i:03d}", rng.normal(size=dim).tolist(), {"n": str(i % 3), "ref_doc_id": f"src{i % 4}"}, f"caption {i}") for i in range(n)], "document_id string, vector array<float>, metadata map<string,string>, text string")


@pytest.fixture
def store(spark, tmp_path):
    return Collection.create(spark, f"{tmp_path}/c", Config(dim=8, chunk_limit=20))


def test_small_writes_stay_small(spark, store):
    store.add(docs(spark, *[(f"d{i:02d}", f"text number {i}", {"k": "a"}) for i in range(40)]))
    base = store.generation
    store.add(docs(spark, *[(f"d{i:02d}", f"text number {i}", {"k": "a"}) for i in range(40)]))
    assert store.generation == base  # nothing changed, no version
    store.update_payload("d07", metadata={"k": "b"})
    store.remove(["d03", "d04"])
    assert store.storage() == {"segments": 3, "written": 1, "removed": 2, "indexed": False} and store.generation == base + 2
    assert store.count() == 38 and store.count({"k": "b"}) == 1 and store.chunks.filter("document_id = 'd03'").count() == 0
    store.add(docs(spark, ("d03", "back again", {"k": "c"})))
    assert rows(store.get_texts(["d03"])) == [("d03", "back again")] and store.count() == 39
    for i in range(8):
        store.update_payload(f"d{i + 10}", metadata={"k": str(i)})
    assert store.storage()["segments"] < 10  # a quarter of the rows had changed: folded
    assert store.count() == 39 and rows(store.audit(["secret"])) == []
    store.compact()
    assert store.storage()["segments"] == 1 and store.count() == 39 and rows(store.audit()) == []
    pinned = Collection(spark, store.path, generation=base)
    assert pinned.count() == 40 and pinned.count({"k": "b"}) == 0


def test_known_chunks_are_not_embedded_again(spark, store):
    counted = spark.sparkContext.accumulator(0)

    def load():
        def run(texts):
            counted.add(len(texts))
            return np.ones((len(texts), 8))

        return run

    store.embed = BatchEmbedder(load, 8).documents
    many = [(f"d{i}", f"first part of {i:04d} / second part {i:04d}", None) for i in range(100)]
    store.add(docs(spark, *many))
    assert counted.value == 200
    store.add(docs(spark, *many))
    assert counted.value == 200
    changed = [(i, t + " and more", None) for i, t, _ in many[:5]]
    plan = store.plan(docs(spark, *changed, *many[5:]))
    assert plan["documents"].count() == 5 and plan["fresh"].count() == plan["chunks"].count() - 5
    store.add(docs(spark, *changed, *many[5:]))
    assert counted.value == 200 + 10


def test_one_of_two_writers_wins(spark, store, monkeypatch):
    other = Collection(spark, store.path)
    publish = Collection._publish

    def slow(self, *args, **kwargs):  # between the check and the commit another writer commits
        monkeypatch.setattr(Collection, "_publish", publish)
        other.add(docs(spark, ("o", "other", None)))
        return publish(self, *args, **kwargs)

    monkeypatch.setattr(Collection, "_publish", slow)
    with pytest.raises(StoreError):
        store.add(docs(spark, ("s", "self", None)))
    store.refresh()
    assert rows(store.documents, "document_id") == [("o",)]
    store.vacuum(keep=0)
    assert len(store.folder.names("segments")) == 1 and store.count() == 1


def test_commit_files_are_created_once(spark, tmp_path):
    folder = Folder(spark, f"{tmp_path}/f")
    assert folder.create_once("a/x", "one") and not folder.create_once("a/x", "two") and folder.read("a/x") == "one"
    assert folder.names("a") == ["x"] and folder.names("none") == [] and folder.delete("a") and not folder.exists("a/x")


def test_search_on_a_collection(spark, store):
    store.add(docs(spark, ("a", "alpha beta gamma", {"k": "1"}), ("b", "beta beta", {"k": "2"}), ("c", "delta", {"k": "1"}), ("e", "", None)))
    asked = spark.createDataFrame([("q1", "beta"), ("q2", "delta"), ("q3", "nothing")], "query_id string, text string")
    assert rows(store.search(asked, 2, mode="lexical"), "query_id", "rank", "document_id") == [("q1", 1, "b"), ("q1", 2, "a"), ("q2", 1, "c")]
    assert rows(store.search(asked, 2, {"k": "1"}, "lexical"), "query_id", "document_id") == [("q1", "a"), ("q2", "c")]
    exact = store.search(asked, 1, mode="vector").filter("query_id = 'q2'").collect()
    assert [(r["document_id"], round(r["score"], 5)) for r in exact] == [("c", 1.0)]
    assert {r["document_id"] for r in store.search(asked, 1).filter("rank = 1 and query_id <> 'q3'").collect()} == {"b", "c"}
    subs = spark.createDataFrame([("q", 0, "beta"), ("q", 1, "delta")], "query_id string, sub_query int, text string")
    got = store.recall(subs, 3, mode="lexical")
    assert rows(got, "chunk_id", "matched")[0][1] in ([0], [1]) and got.count() == 3
    with pytest.raises(ValueError):
        store.search(spark.createDataFrame([("q", [1.0] * 8)], "query_id string, vector array<double>"), 1, mode="lexical")
    with pytest.raises(EmbeddingError):
        Collection(spark, store.path, embedder=HashEmbedder(16))


def test_cluster_index(spark, store):
    store.add_vectors(vectors(spark, 300))
    asked = vectors(spark, 12, seed=9).select(F.col("document_id").alias("query_id"), "vector")
    exact = {(r["query_id"], r["document_id"]) for r in store.search(asked, 5, mode="vector").collect()}
    store.build_index(12)
    assert store.storage()["indexed"]
    near = store.search(asked, 5, mode="vector", nprobe=3)
    assert len({(r["query_id"], r["document_id"]) for r in near.collect()} & exact) > 0.6 * len(exact)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cluster_id" in plan.replace("isnotnull(cluster_id", "cluster_id") or "cluster_id" in plan
    assert {(r["query_id"], r["document_id"]) for r in store.search(asked, 5, mode="vector", nprobe=0).collect()} == exact
    assert {(r["query_id"], r["document_id"]) for r in store.search(asked, 5, {"n": {"$exists": True}}, "vector").collect()} == exact
    store.remove(["v000"])
    assert not store.storage()["indexed"]  # the index was that of another version


def test_patches_and_images(spark, store):
    axis = lambda i: [float(i == j) for j in range(8)]
    batch = spark.createDataFrame([("p", [axis(0), axis(1)], {"k": "1"}), ("q", [axis(2)], None)], "document_id string, patches array<array<float>>, metadata map<string,string>")
    store.add_patches(batch)
    asked = spark.createDataFrame([("x", [axis(1), axis(2)])], "query_id string, patches array<array<float>>")
    assert rows(store.search_patches(asked, 5), "document_id", "score") == [("p", 1.0), ("q", 1.0)]
    assert rows(store.search_patches(asked, 5, {"k": "1"}), "document_id") == [("p",)]
    store.add_vectors(batch.select("document_id", F.element_at("patches", 1).alias("vector"), "metadata").filter("document_id = 'p'"))
    assert store.stats()["patches"] == 1  # written again without patches
    store.add_images(spark.createDataFrame([("i", bytearray(b"ab"), None)], "document_id string, image binary, metadata map<string,string>"), lambda image: F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.length(image) * i))
    assert store.count() == 3


def test_log_records_become_a_version(spark, store):
    record = lambda n, op, **p: (n, op, json.dumps(p))
    set_ = lambda n, i, x: record(n, "upsert_vectors", documents=[{"document_id": i, "text": "t", "metadata": {}, "vector": [x] * 8}])
    log = lambda *r: spark.createDataFrame(list(r), "lsn bigint, op string, payload string")
    store.apply_log(log(set_(1, "a", 1.0), set_(2, "b", 2.0), record(4, "update_document_payload", document_id="a", text="new")))
    assert store.applied_lsn == 4 and rows(store.get_texts(["a", "b"])) == [("a", "new"), ("b", "t")]
    store.apply_log(log(set_(1, "a", 9.0), record(6, "delete_documents", document_ids=["b", "x"]), record(5, "update_document_payload", document_id="a", metadata={"k": "v"})))
    assert store.applied_lsn == 6 and rows(store.documents, "document_id", "text", "metadata") == [("a", "new", {"k": "v"})]
    generation = store.generation
    store.apply_log(log(set_(1, "a", 9.0)))
    assert store.generation == generation and store.wait_for(6, 0) and not store.wait_for(7, 0)
    ordered = log(set_(9, "c", 1.0), set_(8, "d", 1.0)).withColumn("place", F.monotonically_increasing_id())
    with pytest.raises(ValueError):
        store.apply_log(ordered, "place")
    assert store.generation == generation


def test_audit_finds_what_must_not_be_there(spark, tmp_path):
    store = Collection.create(spark, f"{tmp_path}/c", Config(dim=8, store_text=False, index_text=True))
    store.add(docs(spark, ("a", "one two", {"secret": "x"})))
    assert rows(store.audit(["secret"]), "finding") == [("forbidden key secret",)]
    assert store.documents.first()["text"] is None and store.chunks.first()["tokens"] == ["one", "two"]
    path = f"{store.path}/segments/{store.commit.segments[0].path}/documents"
    spoiled = spark.read.parquet(path).withColumn("text", F.lit("raw")).withColumn("chunk_count", F.lit(7)).collect()
    spark.createDataFrame(spoiled, store.documents.schema).write.mode("overwrite").parquet(path)
    assert {r["finding"] for r in store.audit().collect()} == {"raw text", "wrong chunk count"}


def test_embedders(spark):
    texts = spark.createDataFrame([(1, "x"), (2, None)], "i int, t string")
    seen = lambda: (lambda ts: np.array([[len(t), 0] for t in ts]))
    e = BatchEmbedder(seen, 2, "query: ", "passage: ", normalize=False)
    got = texts.select("i", e.queries(F.col("t")).alias("q"), e.documents(F.col("t")).alias("d")).collect()
    assert [(r["q"], r["d"]) for r in got] == [([8.0, 0.0], [10.0, 0.0]), (None, None)]
    with pytest.raises(Exception, match="wanted"):
        texts.select(BatchEmbedder(seen, 3).documents(F.col("t"))).collect()
    assert BatchEmbedder.of_preset("E5-small", seen).document_prefix == "passage: " and preset("bge").pooling == "cls"
    with pytest.raises(EmbeddingError):
        preset("none")
    hidden, mask = np.arange(12.0).reshape(1, 3, 4), np.array([[1, 1, 0]])
    assert pool(hidden, mask).tolist() == [[2, 3, 4, 5]] and pool(hidden, how="cls").tolist() == [[0, 1, 2, 3]]
    assert pool(hidden, np.zeros((1, 3))).tolist() == [[0] * 4] and pool(hidden[0]).shape == (3, 4)
    with pytest.raises(EmbeddingError):
        pool(hidden)
    assert [len(p) for p in unpadded(hidden, mask)] == [2]


def test_verbs(spark, tmp_path):
    made = Texts.from_texts(spark, f"{tmp_path}/t", docs(spark, ("a", "red apple", None), ("b", "green pear", None)), Config(dim=8))
    more = made.add(spark.createDataFrame([("blue plum", None), ("blue plum", None)], "text string, metadata map<string,string>"))
    assert more.count() == 1 and made.store.count() == 3
    asked = spark.createDataFrame([("q", "green pear")], "query_id string, text string")
    assert made.similar(asked, 1).first()["text"] == "green pear"

    store = Collection.create(spark, f"{tmp_path}/v", Config(dim=8, vector_only=True))
    store.add_vectors(vectors(spark, 24))
    one = vectors(spark, 1).select(F.lit("q").alias("query_id"), "vector")
    nodes = Nodes(store)
    assert [r["document_id"] for r in nodes.get(["v005", "none", "v001", "v005"]).collect()] == ["v005", "v001"]
    assert {r["metadata"]["ref_doc_id"] for r in nodes.query(one, 20, doc_ids=["src1", "src2"]).collect()} == {"src1", "src2"}
    assert rows(nodes.query(one, 5, node_ids=["v000", "v004"], conditions=[{"key": "ref_doc_id", "operator": "==", "value": "src0"}]), "document_id") == [("v000",), ("v004",)]
    assert nodes.query(one, 5, node_ids=[]).count() == 0
    with pytest.raises(ValueError):
        nodes.query(one, 5, mode="mmr")
    assert nodes.delete("src3") == 6 and nodes.delete_nodes(["v000", "v001"], [{"key": "n", "operator": "==", "value": "1"}]) == 1

    memories = Memories(store)
    assert memories.info() == {"rows": 17, "dim": 8} and [r["document_id"] for r in memories.list({"n": "0"}, 2).collect()] == ["v000", "v006"]
    memories.update("v000", vector=[1.0] * 8, metadata={"n": "x"})
    assert rows(memories.get("v000"), "text", "metadata") == [("caption 0", {"n": "x"})]
    words = spark.createDataFrame([("q", "caption 6")], "query_id string, text string")
    assert memories.keyword_search(words, 1, {"n": "0"}).first()["document_id"] == "v006"
    assert {r["metadata"]["n"] for r in memories.search(one, 9, {"NOT": [{"n": ["0", "x"]}]}).collect()} == {"1", "2"}
    assert memories.delete_all({"n": "2"}) > 0 and memories.list({"n": "2"}).count() == 0

    passages = Passages(store)
    assert rows(passages.query(one, 9, ids=["v000", "v004", "v006"], doc_ids=["v006", "v004"], filters={"n": ["0", "1"]}, where={"n": {"$ne": "1"}}), "document_id") == [("v006",)]
    assert passages.query(one, 9, ids=["v000"], doc_ids=["v006"]).count() == 0 and passages.query(one, 9, ids=[]).count() == 0

    points = Points(Spaces(spark, f"{tmp_path}/spaces"))
    assert points.search("no", one).count() == 0 and points.retrieve("no", ["a"]).count() == 0 and points.delete("no", ["a"]) == 0
    points.upsert("p", vectors(spark, 30), Config(dim=8, vector_only=True))
    every = points.search("p", one, limit=None).orderBy("rank").collect()
    assert len(every) == 30 and every[0]["score"] == pytest.approx(0, abs=1e-5) and every[0]["score"] <= every[-1]["score"]
    assert points.prune() == ["p"] and points.search("p", one).count() == 0


def test_scratch_folders(spark, monkeypatch):
    table = cut_lineage(spark.range(3), "kept")
    path = scratch_dir(spark, "x")
    assert table.count() == 3 and "/x-" in path
    from heddle.sources import tables

    class Cluster:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("S", (), {"master": "spark://somewhere", "_jsc": type("J", (), {"sc": staticmethod(lambda: type("X", (), {"getCheckpointDir": staticmethod(lambda: type("O", (), {"isDefined": staticmethod(lambda: False)}))}))})})

    with pytest.raises(ValueError):
        tables.scratch_dir(Cluster, "x")
    kept, tables._made[:] = list(tables._made), [p for p in tables._made if "/kept-" in p and p == [q for q in tables._made if "/kept-" in q][-1]]
    assert sweep() == 1
    tables._made[:] = kept
