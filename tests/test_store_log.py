import json

import pytest
from pyspark.sql import functions as F

from heddle.sources import importers
from heddle.sources.store import Collection, Config, Spaces, StoreError, needs_compaction
from heddle.streaming.log import LOG, STATE, Appender, LogError, LogFolder, check_ascending, check_log, checkpoint_due, fold, read_segment, write_segment

from .conftest import rows, settle

DOC = "document_id string, text string, metadata map<string,string>, n int"


@pytest.fixture
def store(spark, tmp_path):
    return Collection.create(spark, f"{tmp_path}/c", Config(dim=16, chunk_limit=5))


def docs(spark, *data):
    return spark.createDataFrame([(i, t, m, n) for n, (i, t, m) in enumerate(data)], DOC)


def test_text_documents(spark, store):
    store.add(docs(spark, ("a", "hello world", {"k": "1"}), ("b", "  ", None), ("c", None, {})))
    assert store.stats() | {"generation": 0} == {"documents": 3, "chunks": 3, "patches": 0, "generation": 0, "dim": 16, "bit_width": 4, "applied_lsn": 0}
    assert rows(store.get_texts(["a", "c", "x"])) == [("a", "hello world")]
    before = {r["chunk_id"]: r["vector"] for r in store.chunks.collect()}
    store.embed = lambda text: F.array(*[F.lit(9.0)] * 16).cast("array<float>")  # a new embedder shows which chunks are embedded again
    store.add(docs(spark, ("a", "hello there", {"k": "2"})))
    after = {r["chunk_id"]: r["vector"] for r in store.chunks.collect()}
    kept = set(before) & set(after)
    assert kept and all(before[c] == after[c] for c in kept) and all(after[c] == [9.0] * 16 for c in set(after) - kept)
    assert store.count({"k": "2"}) == 1 and store.count() == 3
    with pytest.raises(StoreError):
        store.add(docs(spark, ("a", "x", None), ("a", "y", None)))
    store.add(docs(spark, ("a", "x", None), ("a", "last", None)), seq="n")
    assert rows(store.get_texts(["a"])) == [("a", "last")]
    with pytest.raises(StoreError):
        store.add(docs(spark, (" ", "x", None)))


def test_vectors_payloads_and_removal(spark, store):
    v = lambda i: [float(i == j) * 2 for j in range(16)]
    batch = spark.createDataFrame([(f"v{i}", v(i), {"n": str(i)}, f"cap {i}") for i in range(4)], "document_id string, vector array<float>, metadata map<string,string>, text string")
    store.add_vectors(batch)
    got = store.get_vectors(["v2", "none", "v0", "v2"]).collect()
    assert [(r["document_id"], max(r["vector"])) for r in got] == [("v2", 1.0), ("v0", 1.0)]
    bad = spark.createDataFrame([("z", [0.0] * 16, None)], "document_id string, vector array<float>, metadata map<string,string>")
    with pytest.raises(StoreError):
        store.add_vectors(bad)
    store.update_payload("v1", metadata={"x": "y"})
    store.update_payload("v1", text="new words")
    assert rows(store.documents.filter("document_id = 'v1'"), "metadata", "text") == [({"x": "y"}, "new words")]
    assert rows(store.token_lists(["v1"]), "tokens") == [(["new", "words"],)]
    store.update_payload("v1", clear_text=True)
    assert rows(store.get_texts(["v1"])) == []
    with pytest.raises(StoreError):
        store.update_payload("unknown", metadata={})
    assert store.remove(["v0", "v0", "unknown"]) == 1 and store.remove(["unknown"]) == 0
    assert [r["document_id"] for r in store.list_documents(after="v1").collect()] == ["v2", "v3"]
    assert store.list_documents(limit=0).count() == 0
    assert rows(store.audit()) == []


def test_versions(spark, store):
    other = Collection(spark, store.path)
    pinned = Collection(spark, store.path, read_only=True)
    for i in range(4):
        store.add(docs(spark, (f"d{i}", "text", {"tag:a": "1"} if i < 2 else {"tag:a": "1", "tag:b": "1"})))
    assert pinned.count() == 0 and store.generation == 4
    with pytest.raises(StoreError):
        other.add(docs(spark, ("x", "y", None)))  # opened on an older version
    with pytest.raises(StoreError):
        pinned.add(docs(spark, ("x", "y", None)))
    pinned.refresh()
    assert pinned.count() == 4
    store.remove_tags(["a"])
    assert rows(store.documents, "document_id", "metadata") == [("d2", {"tag:b": "1"}), ("d3", {"tag:b": "1"})]
    store.compact()
    assert store.vacuum(keep=1) == [0, 1, 2, 3, 4] and store.versions() == [5, 6]
    store.rollback(5)
    assert store.count() == 2
    with pytest.raises(StoreError):
        store.rollback(1)
    assert needs_compaction(64, 0, 10**6) and needs_compaction(1, 25, 100) and not needs_compaction(1, 24, 100)


def test_spaces_and_config(spark, tmp_path):
    spaces = Spaces(spark, f"{tmp_path}/root")
    assert spaces.names() == []
    spaces.create("b", Config(dim=8))
    spaces.create("a", Config(dim=16, store_text=False))
    assert spaces.names() == ["a", "b"] and spaces.open("a").config.dim == 16
    with pytest.raises(StoreError):
        spaces.create("a", Config(dim=8))
    with pytest.raises(StoreError):
        spaces.open("a").get_texts(["x"])
    for bad in ({"dim": 7}, {"dim": 0}, {"dim": 8, "bit_width": 3}, {"dim": 8, "chunk_limit": 0}):
        with pytest.raises(StoreError):
            Config(**bad)
    only = spaces.create("v", Config(dim=8, vector_only=True))
    with pytest.raises(StoreError):
        only.add(docs(spark, ("a", "b", None)))


def test_importers(spark, tmp_path, store):
    (tmp_path / "points.jsonl").write_text(
        json.dumps({"id": "p1", "vector": [0.5, 1], "payload": {"data": "one", "user": "u"}}) + "\n" + json.dumps({"id": "p2", "vector": None, "payload": {"memory": "two"}}) + "\n"
    )
    got = rows(importers.from_points(spark, f"{tmp_path}/points.jsonl"), "id", "text", "metadata", "vector")
    assert got == [("p1", "one", {"user": "u"}, [0.5, 1.0]), ("p2", "two", {}, None)]
    (tmp_path / "dump.json").write_text(json.dumps({"k1": {"id": "m1", "text": "t", "metadata": {"a": "b"}, "vector": [1.0] * 16}, "k2": {"text": "u", "vector": [2.0] * 16}}, indent=1))
    dump = importers.from_memory_dump(spark, f"{tmp_path}/dump.json")
    assert rows(dump, "id", "text") == [("k2", "u"), ("m1", "t")]
    (tmp_path / "store.json").write_text(json.dumps({"docstore/data": {"n1": {"__data__": json.dumps({"text": "node", "metadata": {"x": "1"}, "relationships": {"1": {"node_id": "d1"}}})}}}))
    assert rows(importers.from_docstore(spark, f"{tmp_path}/store.json"), "id", "text", "metadata", "ref_doc_id") == [("n1", "node", {"x": "1"}, "d1")]
    table = spark.createDataFrame([(1, "t", "[1,2]", '{"a":"b"}')], "pk int, body string, emb string, meta string")
    assert rows(importers.from_vector_table(table, "pk", "body", "emb", "meta"), "id", "vector", "metadata") == [("1", [1.0, 2.0], {"a": "b"})]
    more = spark.createDataFrame([(i, "t", "[1,2]", '{"a":"b","lang":"x"}', "de" if i else None) for i in range(3)], "pk int, body string, emb string, meta string, lang string")
    assert rows(importers.from_vector_table(more, "pk", "body", "emb", "meta", ["lang"], after=0), "id", "metadata") == [("1", {"a": "b", "lang": "de"}), ("2", {"a": "b", "lang": "de"})]
    assert rows(importers.from_vector_table(more, "pk", "body", "emb", None, ["lang"]), "id", "metadata")[0] == ("0", {})
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "x.txt").write_text("line\nline")
    assert rows(importers.from_files(spark, f"{tmp_path}/files"), "text") == [("line\nline",)]
    assert importers.load(dump, store, dry_run=True)["ok"] and store.count() == 0
    assert importers.load(dump, store)["ok"] and store.count() == 2
    assert not importers.load(dump.unionByName(dump), store)["ok"]
    assert importers.sample_report(dump, 1).count() == 2


def record(lsn, op, **payload):
    return lsn, op, json.dumps(payload)


def set_(lsn, i, text="t", **metadata):
    return record(lsn, "upsert_vectors", documents=[{"document_id": i, "text": text, "metadata": metadata, "vector": [1.0]}])


RECORDS = [
    set_(1, "a", k="1"),
    record(2, "update_document_payload", document_id="a", metadata={"k": "2"}),
    record(3, "update_document_payload", document_id="a", text="new"),
    set_(4, "b"),
    record(5, "update_document_payload", document_id="b", text=None),
    record(6, "update_document_payload", document_id="ghost", text="x"),
    set_(7, "c"),
    record(8, "delete_documents", document_ids=["c", "unknown"]),
    record(9, "update_document_payload", document_id="c", text="too late"),
    set_(10, "d", "first"),
    record(11, "delete_documents", document_ids=["d"]),
    set_(12, "d", "again"),
]
WANT = [("a", {"k": "2"}, "new", 3), ("b", {}, None, 5), ("d", {}, "again", 12)]


def test_fold(spark):
    log = spark.createDataFrame(RECORDS, LOG)
    empty = spark.createDataFrame([], STATE)
    whole = settle(fold(empty, log))
    assert rows(whole, "document_id", "metadata", "text", "lsn") == WANT
    for cut in (2, 8, 10):
        half = settle(fold(empty, log.filter(F.col("lsn") <= cut)))
        assert rows(fold(half, log, cut)) == rows(whole)
    assert rows(fold(whole, log, 12)) == rows(whole) and fold(empty, log.limit(0)).count() == 0


def test_log_checks(spark):
    check_log(spark.createDataFrame(RECORDS, LOG))
    for bad in ([(1, "rename", "{}")], [(1, None, "{}")], RECORDS[:1] * 2):
        with pytest.raises(LogError):
            check_log(spark.createDataFrame(bad, LOG))
    ordered = lambda *lsns: spark.createDataFrame([(i, n) for i, n in enumerate(lsns)], "place int, lsn bigint")
    check_ascending(ordered(1, 3, 9), "place")
    with pytest.raises(LogError):
        check_ascending(ordered(1, 3, 3), "place")
    assert checkpoint_due(1000, 0) and checkpoint_due(0, 1 << 27) and not checkpoint_due(1, 1)


def lines(records):
    return "".join(json.dumps({"lsn": n, "op": o, "payload": p}) + "\n" for n, o, p in records)


def test_folder_stream(spark, tmp_path):
    log_dir = tmp_path / "log"
    log_dir.mkdir()
    (log_dir / "1.json").write_text(lines(RECORDS[:5]))
    folder = LogFolder(spark, str(log_dir), f"{tmp_path}/out")
    folder.run()
    assert folder.applied_lsn() == 5
    (log_dir / "2.json").write_text(lines(RECORDS[5:]))
    (log_dir / "3.json").write_text('{"lsn": 13, "op": "delete_docu')  # torn
    assert rows(folder.run(1), "document_id", "metadata", "text", "lsn") == WANT
    assert rows(folder.rejected()) == [('{"lsn": 13, "op": "delete_docu',)] and folder.applied_lsn() == 12
    folder.checkpoint()
    assert rows(folder.state(), "document_id", "metadata", "text", "lsn") == WANT and folder.folder.names("delta") == []
    (log_dir / "4.json").write_text(lines([(14, "rename", "{}")]))
    with pytest.raises(Exception, match="unsupported record"):
        folder.run()


def test_folder_takes_records_late_and_again(spark, tmp_path):
    """Every record in a file of its own, in an order as bad as it gets, some twice, with a checkpoint in between."""
    log_dir = tmp_path / "log"
    log_dir.mkdir()
    folder = LogFolder(spark, str(log_dir), f"{tmp_path}/out")
    order = [11, 7, 2, 0, 8, 4, 10, 3, 6, 1, 9, 5]
    for i, n in enumerate(order[:7]):
        (log_dir / f"{i}.json").write_text(lines([RECORDS[n]]))
    folder.run(3)
    folder.checkpoint()
    assert folder.has_applied(12) and not folder.has_applied(10)
    for i, n in enumerate(order[7:] + [0, 6, 9, 11]):
        (log_dir / f"later{i}.json").write_text(lines([RECORDS[n]]))
    assert rows(folder.run(4), "document_id", "metadata", "text", "lsn") == WANT
    # a delete is the last record of its document: the upsert before it, delivered again, must not bring it back
    (log_dir / "z1.json").write_text(lines([set_(20, "x"), record(25, "delete_documents", document_ids=["x"])]))
    folder.run()
    (log_dir / "z2.json").write_text(lines([set_(20, "x"), set_(15, "y")]))
    assert {r["document_id"] for r in folder.run().collect()} == {"a", "b", "d", "y"} and folder.applied_lsn() == 25


def test_appending(spark, tmp_path):
    log_dir = f"{tmp_path}/log"
    first, second = Appender(spark, log_dir), Appender(spark, log_dir)
    assert first.append([("upsert_vectors", {"documents": [{"document_id": "a", "text": "t", "metadata": {}, "vector": [1.0]}]})]) == [1]
    assert second.append([("update_document_payload", {"document_id": "a", "text": "u"}), ("delete_documents", {"document_ids": ["q"]})]) == [2, 3]
    for bad in ([("rename", {})], [("delete_documents", {"document_ids": []})], [("upsert_vectors", {"documents": [{"text": "t"}]})]):
        with pytest.raises(LogError):
            first.append(bad)
    many = spark.range(50).selectExpr("concat('m', id) document_id", "'x' text", "map('n', string(id)) metadata", "array(float(id)) vector")
    lo, hi = second.append_documents(many, per_record=5)
    assert lo == 4 and hi >= 13
    folder = LogFolder(spark, log_dir, f"{tmp_path}/out")
    assert folder.wait_for(hi) and not folder.wait_for(hi + 1, timeout=0.1)
    state = {r["document_id"]: r["text"] for r in folder.state().collect()}
    assert len(state) == 51 and state["a"] == "u"
    assert len({first.allocate(3) for _ in range(4)} | {second.allocate(2) for _ in range(4)}) == 8


def test_segments(spark, tmp_path):
    log = spark.createDataFrame(RECORDS, LOG)
    assert write_segment(log, f"{tmp_path}/s")["records"] == 12
    assert rows(read_segment(spark, f"{tmp_path}/s")) == rows(log)
    for p in (tmp_path / "s" / "records").glob("part-*.json"):
        p.write_text(p.read_text().replace("first", "frist"))
        (tmp_path / "s" / "records" / f".{p.name}.crc").unlink(missing_ok=True)
    with pytest.raises(LogError):
        read_segment(spark, f"{tmp_path}/s")
    with pytest.raises(LogError):
        read_segment(spark, f"{tmp_path}/nowhere")
