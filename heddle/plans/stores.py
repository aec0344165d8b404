"""Queries that go through stored collections, importers and streams, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from ..sources import importers
from ..sources.store import Collection, Config
from ..sources.tables import scratch_dir, table
from ..streaming.log import LogFolder
from . import graphs
from .retrieval import _DOT, _PATCH, _documents, _embeddings, _patches
from .semantics import _hybrid, _lexical

DIM = 64


def _text_store(spark: SparkSession, sf_dir: str) -> Collection:
    d = _documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("document_id"), "text", "metadata")
    store = Collection.create(spark, scratch_dir(spark, "store"), Config(dim=DIM))
    store.add(d)
    return store


def _vector_store(spark: SparkSession, sf_dir: str) -> Collection:
    e = _embeddings(spark, sf_dir)
    store = Collection.create(spark, scratch_dir(spark, "store"), Config(dim=DIM, vector_only=True))
    store.add_vectors(e.select(F.col("vec_id").cast("string").alias("document_id"), "vector", F.create_map(F.lit("label"), F.col("label").cast("string")).alias("metadata")))
    return store


def store_text_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written to a collection and read back."""
    return _text_store(spark, sf_dir).documents.select("document_id", "chunk_count", "content_hash")


def store_text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text_store(spark, sf_dir).chunks.select("document_id", "position", F.size("tokens").alias("n_tokens"), F.size("vector").alias("dim"))


def store_list_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = _text_store(spark, sf_dir).list_documents({"lang": {"$in": ["de", "fr"]}}, after="2", limit=50)
    return page.select("document_id", "chunk_count")


def store_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors replaced for label 1, removed for two ids, payload changed for one."""
    store = _vector_store(spark, sf_dir)
    again = _embeddings(spark, sf_dir).filter("label = 1").select(F.col("vec_id").cast("string").alias("document_id"), "vector", F.create_map(F.lit("label"), F.lit("one")).alias("metadata"))
    store.add_vectors(again)
    store.remove(["3", "5"])
    store.update_payload("7", metadata={"label": "seven"})
    return store.documents.select("document_id", F.try_element_at("metadata", F.lit("label")).alias("label"))


def store_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _text_store(spark, sf_dir).stats()
    return spark.createDataFrame([(s["documents"], s["chunks"])], "documents bigint, chunks bigint")


def count_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a collection, all and those that match."""
    store = _text_store(spark, sf_dir)
    return spark.createDataFrame([(store.count(), store.count({"source": {"$exists": True}, "lang": {"$ne": "en"}}))], "documents bigint, matching bigint")


def dedup_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts added without ids: each distinct one is a document."""
    store = Collection.create(spark, scratch_dir(spark, "store"), Config(dim=DIM))
    store.add_unnamed(_documents(spark, sf_dir).select("text", "metadata"))
    return store.documents.select("document_id", "content_hash")


def store_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three small commits after a large one, one of them without effect: what was written by each, and what stands."""
    store = _text_store(spark, sf_dir)
    docs = _documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("document_id"), "text", "metadata")
    store.add(docs)  # nothing new
    store.add(docs.filter("document_id like '%7'").withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit(" again"))))
    store.remove(docs.filter("document_id like '%3'"))
    made = store.storage()
    total = store.documents.agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("text").endswith(" again")).alias("changed"))
    return total.select("documents", "changed", F.lit(store.generation).cast("int").alias("generation"), F.lit(made["written"]).cast("int").alias("written"), F.lit(made["removed"]).cast("int").alias("removed"))


def store_search_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact vector search on a stored collection."""
    asked = _embeddings(spark, sf_dir).filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "vector")
    return _vector_store(spark, sf_dir).search(asked, 10, mode="vector", nprobe=0).select("query_id", "rank", "score", "document_id")


def store_search_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector search through the stored cluster index, with as many probes as recall needs."""
    store = _vector_store(spark, sf_dir)
    store.build_index()
    asked = _embeddings(spark, sf_dir).filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "vector")
    return store.search(asked, 10, mode="vector").select("query_id", "rank", "score", "document_id")


def store_maxsim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Late interaction on stored patches."""
    docs = _patches(spark, sf_dir, 8).select(F.col("document_id").cast("string").alias("document_id"), "patches", F.create_map().cast("map<string,string>").alias("metadata"))
    store = Collection.create(spark, scratch_dir(spark, "store"), Config(dim=DIM, vector_only=True))
    store.add_patches(docs)
    return store.search_patches(docs.filter("cast(document_id as bigint) % 50 = 0").select(F.col("document_id").alias("query_id"), "patches"), 10)


def log_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON log of events applied to an empty collection in two commits, the second with records of the first again."""
    store = Collection.create(spark, scratch_dir(spark, "store"), Config(dim=8, vector_only=True))
    log = graphs._log(spark, sf_dir, 8)
    half = log.agg(F.percentile_approx("lsn", 0.5)).first()[0]
    store.apply_log(log.filter(F.col("lsn") <= half), "lsn")
    store.apply_log(log, "lsn")
    return store.documents.select("document_id", F.try_element_at("metadata", F.lit("at")).alias("at"), "text")


def store_search_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical search over the chunks of a stored collection with a filter on its documents."""
    asked = _documents(spark, sf_dir).filter("doc_id % 50 = 0 and length(text) > 0").select(F.col("doc_id").alias("query_id"), "text")
    return _text_store(spark, sf_dir).search(asked, 5, {"lang": "en"}, "lexical").select("query_id", "rank", "chunk_id", "document_id")


def store_search_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _documents(spark, sf_dir).filter("doc_id % 50 = 0 and length(text) > 0").select(F.col("doc_id").alias("query_id"), "text")
    return _text_store(spark, sf_dir).search(asked, 5, mode="hybrid").select("query_id", "rank", "chunk_id", "document_id")


def import_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The check before an import, on vectors with all their flaws."""
    v = table(spark, sf_dir, "node_vectors").select(F.col("node_id").alias("id"), "vector")
    return importers.validate(v, DIM).select("rows", "blank_ids", "repeated_ids", "unsound_vectors")


def import_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors exported as JSON points and imported again."""
    path = scratch_dir(spark, "points")
    e = _embeddings(spark, sf_dir)
    payload = F.struct(F.concat(F.lit("text "), F.col("vec_id")).alias("data"), F.col("label").cast("string").alias("label"))
    e.select(F.to_json(F.struct(F.col("vec_id").cast("string").alias("id"), "vector", payload.alias("payload"))).alias("value")).write.text(path)
    got = importers.from_points(spark, path)
    return got.select("id", "text", F.try_element_at("metadata", F.lit("label")).alias("label"), F.size("vector").alias("dim"))


def log_fold_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON log of events in files whose records are mixed up, folded file by file; a part of them arrives again, deletes included."""
    path = scratch_dir(spark, "log")
    log = graphs._log(spark, sf_dir)
    log.repartition(3, F.xxhash64("lsn")).write.json(f"{path}/log")
    folder = LogFolder(spark, f"{path}/log", f"{path}/out")
    folder.run(1)
    log.filter("lsn % 3 = 0").coalesce(1).write.mode("append").json(f"{path}/log")
    state = folder.run(1)
    return state.select("document_id", F.try_element_at("metadata", F.lit("at")).alias("at"), "text")


def event_counts_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts per event type with a watermark, as a stream over the events file that runs to its end."""
    path = f"{sf_dir}/events.parquet"
    work = scratch_dir(spark, "hourly")
    events = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]").withColumn("ts", F.col("ts").cast("timestamp"))
    hourly = events.withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"))

    def emit(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{work}/out/batch={batch_id}")

    hourly.writeStream.outputMode("update").foreachBatch(emit).option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.option("basePath", f"{work}/out").parquet(f"{work}/out")
    last = rows.groupBy("window", "event_type").agg(F.max_by("n", "batch").alias("n"))
    return last.select((F.hour("window.start") * 3600).cast("bigint").alias("second_of_day"), "event_type", "n").groupBy("second_of_day", "event_type").agg(F.sum("n").alias("n"))


_LAST_SET = graphs._FOLD

_CHUNKS = r"""
tt AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, lang, regexp_replace(regexp_replace(coalesce(text, ''), '^[{ws}]+', ''), '[{ws}]+$', '') AS t FROM documents),
cc AS (SELECT document_id, lang, i AS position, substring(t, CAST(i * 900 + 1 AS BIGINT), 900) AS part FROM (SELECT *, unnest(range(0, CAST((length(t) + 899) // 900 AS BIGINT))) AS i FROM tt)),
hh AS (SELECT *, sha256(regexp_replace(regexp_replace(regexp_replace(part, '^[{ws}]+', ''), '[{ws}]+$', ''), '[{ws}]+', ' ', 'g')) AS h FROM cc),
ch AS (SELECT document_id, lang, part, document_id || ':' || h[1:12] || ':' || lpad(CAST(row_number() OVER (PARTITION BY document_id, h ORDER BY position) - 1 AS VARCHAR), 4, '0') AS id FROM hh),
q AS (SELECT doc_id AS query_id, text FROM documents WHERE doc_id % 50 = 0 AND length(text) > 0)"""

ORACLES = {
    "store_text_documents": """
SELECT CAST(doc_id AS VARCHAR) AS document_id, CAST((length(t) + 899) // 900 AS INTEGER) AS chunk_count, sha256(coalesce(text, '')) AS content_hash
FROM (SELECT *, regexp_replace(regexp_replace(coalesce(text, ''), '^[{ws}]+', ''), '[{ws}]+$', '') AS t FROM documents)""",
    "store_text_chunks": """
WITH t AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, regexp_replace(regexp_replace(coalesce(text, ''), '^[{ws}]+', ''), '[{ws}]+$', '') AS t FROM documents),
c AS (SELECT document_id, CAST(i AS INTEGER) AS position, substring(t, CAST(i * 900 + 1 AS BIGINT), 900) AS part FROM (SELECT *, unnest(range(0, CAST((length(t) + 899) // 900 AS BIGINT))) AS i FROM t))
SELECT document_id, position, CAST(len(regexp_extract_all(lower(part), '[0-9a-z]+(?:[-./][0-9a-z]+)*')) AS INTEGER) AS n_tokens, CAST(64 AS INTEGER) AS dim FROM c""",
    "store_list_filtered": """
SELECT CAST(doc_id AS VARCHAR) AS document_id, CAST((length(regexp_replace(regexp_replace(coalesce(text, ''), '^[{ws}]+', ''), '[{ws}]+$', '')) + 899) // 900 AS INTEGER) AS chunk_count
FROM documents WHERE lang IN ('de', 'fr') AND CAST(doc_id AS VARCHAR) > '2' ORDER BY 1 LIMIT 50""",
    "store_vectors": """
SELECT CAST(vec_id AS VARCHAR) AS document_id, CASE WHEN vec_id = 7 THEN 'seven' WHEN label = 1 THEN 'one' ELSE CAST(label AS VARCHAR) END AS label FROM embeddings WHERE vec_id NOT IN (3, 5)""",
    "store_stats": """
SELECT count(*) AS documents, CAST(sum((length(regexp_replace(regexp_replace(coalesce(text, ''), '^[{ws}]+', ''), '[{ws}]+$', '')) + 899) // 900) AS BIGINT) AS chunks FROM documents""",
    "import_validate": """
WITH f AS (SELECT *, vector IS NOT NULL AND (len(vector) <> 64 OR len(list_filter(vector, lambda x: x IS NULL OR NOT isfinite(x))) > 0) AS bad FROM node_vectors)
SELECT count(*) AS rows, count(*) FILTER (WHERE trim(node_id) = '' OR node_id IS NULL) AS blank_ids, (SELECT count(*) FROM (SELECT node_id FROM node_vectors GROUP BY node_id HAVING count(*) > 1)) AS repeated_ids,
  count(*) FILTER (WHERE bad) AS unsound_vectors FROM f""",
    "import_points": "SELECT CAST(vec_id AS VARCHAR) AS id, 'text ' || vec_id AS text, CAST(label AS VARCHAR) AS label, CAST(len(embedding) AS INTEGER) AS dim FROM embeddings",
    "log_fold_stream": _LAST_SET,
    "log_apply": _LAST_SET,
    "count_filtered": "SELECT count(*) AS documents, count(*) FILTER (WHERE source IS NOT NULL AND (lang IS NULL OR lang <> 'en')) AS matching FROM documents",
    "dedup_upsert": "SELECT DISTINCT 'doc-' || sha256(coalesce(text, ''))[1:32] AS document_id, sha256(coalesce(text, '')) AS content_hash FROM documents",
    "store_deltas": """
SELECT count(*) FILTER (WHERE doc_id % 10 <> 3) AS documents, count(*) FILTER (WHERE doc_id % 10 = 7 OR (doc_id % 10 <> 3 AND text LIKE '% again')) AS changed, CAST(3 AS INTEGER) AS generation,
  CAST(count(*) FILTER (WHERE doc_id % 10 = 7) AS INTEGER) AS written, CAST(count(*) FILTER (WHERE doc_id % 10 = 3) AS INTEGER) AS removed FROM documents""",
    "store_search_lexical": "WITH " + _CHUNKS + ", u AS (SELECT id, part AS text, coalesce(lang = 'en', false) AS ok FROM ch)," + _lexical(5) + " SELECT query_id, rank, lex.id AS chunk_id, document_id FROM lex JOIN ch USING (id)",
    "store_search_hybrid": "WITH " + _CHUNKS + ", u AS (SELECT id, part AS text, true AS ok FROM ch)," + _hybrid(5) + " SELECT query_id, rank, hyb.id AS chunk_id, document_id FROM hyb JOIN ch USING (id)",
    "store_search_vector": f"""
WITH n AS (SELECT vec_id, embedding, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(CAST(x / sqrt({_DOT.format(a='embedding', b='embedding')}) AS FLOAT) AS DOUBLE)) AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, n.vec_id, round(list_dot_product(CAST(q.embedding AS DOUBLE[]), n.v), 6) AS score FROM n q, n WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, CAST(vec_id AS VARCHAR)) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, score, CAST(vec_id AS VARCHAR) AS document_id FROM r WHERE rank <= 10""",
    "store_maxsim": f"""
WITH {_PATCH},
m AS (SELECT a.document_id AS query_id, a.n, b.document_id, max(list_dot_product(a.v, b.v)) AS best FROM p a, p b WHERE a.document_id % 50 = 0 GROUP BY ALL),
s AS (SELECT query_id, document_id, round(sum(best), 6) AS score FROM m GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, CAST(document_id AS VARCHAR)) AS INTEGER) AS rank FROM s)
SELECT CAST(query_id AS VARCHAR) AS query_id, rank, score, CAST(document_id AS VARCHAR) AS document_id FROM r WHERE rank <= 10""",
    "event_counts_stream": "SELECT CAST(hour(ts) * 3600 AS BIGINT) AS second_of_day, event_type, count(*) AS n FROM events GROUP BY ALL",
}
_WS = r"\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
ORACLES = {name: sql.replace("{ws}", _WS) for name, sql in ORACLES.items()}

QUERIES = {
    f.__name__: f
    for f in (
        store_text_documents, store_text_chunks, store_list_filtered, store_vectors, store_stats, store_search_lexical, store_search_hybrid, import_validate, import_points,
        count_filtered, dedup_upsert, store_deltas, store_search_vector, store_search_index, store_maxsim, log_apply, log_fold_stream, event_counts_stream,
    )
}
