"""Queries for filters, text identity, vector, lexical and hybrid ranking over the driver's tables, with their SQL.

Table mapping: documents are text documents with lang, source and store_id as
metadata; embeddings are vector documents; every fiftieth id is a query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vectors as V
from ..functions.predicate import apply_filter, from_conditions, from_memory_filters, from_tags, metadata_filter
from ..operators import ann, fusion, lexical, multivec
from ..operators.vector_search import batch_arrays, exact_topk
from ..sources.store import changed_rows, list_page, plan_chunks, vectors_by_request
from ..sources.tables import table
from .search import pool_width, search

K = 10
# fixed values: the characters with the Unicode property White_Space, for the SQL engine's regular expressions
_WS = r"\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with a metadata map; absent values are absent keys."""
    d = table(spark, sf_dir, "documents")
    pairs = F.array(*[F.struct(F.lit(n).alias("k"), F.col(c).cast("string").alias("v")) for n, c in (("lang", "lang"), ("source", "source"), ("store", "store_id"), ("chars", "n_chars"))])
    return d.select("doc_id", "text", F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull())).alias("metadata"))


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"), "label")


def _vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _embeddings(spark, sf_dir).filter(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), "vector")


# --- filters: name, filter tree, SQL condition over documents d

_N = "TRY_CAST(CAST(n_chars AS VARCHAR) AS DOUBLE)"
FILTERS = [
    ("filter_eq", {"lang": "en"}, "lang = 'en'"),
    ("filter_ne", {"lang": {"$ne": "en"}}, "lang IS NULL OR lang <> 'en'"),
    ("filter_in", {"source": {"$in": ["faq", "runbook"]}}, "source IN ('faq', 'runbook')"),
    ("filter_nin", {"source": {"$nin": ["faq", "runbook"]}}, "source IS NULL OR source NOT IN ('faq', 'runbook')"),
    ("filter_exists", {"source": {"$exists": True}}, "source IS NOT NULL"),
    ("filter_absent", {"lang": {"$exists": False}}, "lang IS NULL"),
    ("filter_range", {"chars": {"$gte": 500, "$lt": "2000"}}, f"{_N} >= 500 AND {_N} < 2000"),
    ("filter_text_range", {"source": {"$gt": "faq", "$lte": "ticket"}}, "source > 'faq' AND source <= 'ticket'"),
    ("filter_and", {"$and": [{"lang": "de"}, {"chars": {"$gt": 300}}]}, f"lang = 'de' AND {_N} > 300"),
    ("filter_or", {"$or": [{"lang": "fr"}, {"source": "ticket"}]}, "lang = 'fr' OR source = 'ticket'"),
    ("filter_not", {"$not": {"$or": [{"lang": "en"}, {"source": "ticket"}]}}, "NOT (coalesce(lang = 'en', false) OR coalesce(source = 'ticket', false))"),
    ("filter_conditions", from_conditions([{"key": "lang", "operator": "is_empty", "value": None}, {"key": "source", "operator": "==", "value": "faq"}], "or"), "lang IS NULL OR lang = '' OR source = 'faq'"),
    ("filter_memory", from_memory_filters({"AND": [{"lang": ["de", "fr"]}, {"NOT": [{"source": "ticket"}]}, {"store": "*"}]}), "lang IN ('de', 'fr') AND (source IS NULL OR source <> 'ticket') AND store_id IS NOT NULL"),
    ("filter_tags", from_tags(["lang", "source"], "and", ""), "lang IS NOT NULL AND source IS NOT NULL"),
]


#: Metadata fields and the columns of ``documents`` that hold them.
FIELDS = {"lang": "lang", "source": "source", "store": "store_id", "chars": "n_chars"}


def _filter_query(tree: dict):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return apply_filter(table(spark, sf_dir, "documents"), tree, columns=FIELDS).select("doc_id")

    return query


def _filter_map_query(tree: dict):
    """The same filter on a metadata map."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _documents(spark, sf_dir).filter(metadata_filter(F.col("metadata"), tree)).select("doc_id")

    return query


def filter_doc_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An allowlist of ids (those of the long documents) and a metadata filter, in one envelope."""
    allow = table(spark, sf_dir, "documents").filter("n_chars > 1000").select("doc_id")
    return apply_filter(_documents(spark, sf_dir), {"document_ids": allow, "metadata": {"lang": "en"}}, ident="doc_id").select("doc_id")


def list_keyset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of 100 ids after a cursor, as text ids."""
    d = _documents(spark, sf_dir).select(F.format_string("doc-%08d", "doc_id").alias("document_id"), "metadata")
    page = list_page(d.filter(metadata_filter(F.col("metadata"), {"lang": "en"})), "doc-00000200", 100)
    return page.select("document_id")


def tokenize_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.size(X.tokenize(F.col("text"))).alias("n_tokens"), F.size(F.array_distinct(X.tokenize(F.col("text")))).alias("n_terms"))


def term_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = lexical.with_tokens(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "tokens")
    return lexical.term_stats(lexical.postings(units, "doc_id")).select("term", "df")


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_chunks(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), "text"))


def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).select("document_id", "position", "chunk_hash", "chunk_id")


def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.sha256_text(F.coalesce("text", F.lit(""))).alias("content_hash"))


def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "entities").select("id").distinct()
    return e.select("id", X.stable_id(F.col("id")).cast("string").alias("stable_id"), X.id_fingerprint(F.col("id")).alias("fingerprint"))


def edge_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "edges")
    return e.select("id", X.edge_id(F.col("src"), F.col("relation"), F.col("dst")).alias("edge_id")).distinct()


def noop_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of all documents against a store with the even ids: the rows that would be written."""
    d = _documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("document_id"), X.sha256_text(F.coalesce("text", F.lit(""))).alias("content_hash"), "metadata", "doc_id")
    return changed_rows(d.filter(F.col("doc_id") % 2 == 0).drop("doc_id"), d.drop("doc_id")).select("document_id")


# --- vectors


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk(_vector_queries(spark, sf_dir), _embeddings(spark, sf_dir), K, "vec_id")


def vector_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk(_vector_queries(spark, sf_dir), _embeddings(spark, sf_dir).filter("label = 3"), K, "vec_id")


def vector_batch_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch_arrays(vector_topk(spark, sf_dir), "vec_id").select("query_id", F.concat_ws(",", "ids").alias("ids"))


def vector_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = F.transform("vector", lambda x: x * 3.0)
    unit = V.l2_normalize(scaled)
    return _embeddings(spark, sf_dir).select("vec_id", F.round(V.norm(scaled), 6).alias("norm"), F.round(F.element_at(unit, 1), 6).alias("first"), F.round(F.element_at(unit, 64), 6).alias("last"))


def vector_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = ann.centroids_from_assignment(_embeddings(spark, sf_dir).withColumnRenamed("label", "cluster_id"))
    return c.select("cluster_id", F.posexplode("centroid").alias("dim", "mean")).withColumn("mean", F.round("mean", 6))


def _label_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.centroids_from_assignment(_embeddings(spark, sf_dir).withColumnRenamed("label", "cluster_id"))


def ann_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.assign(_embeddings(spark, sf_dir), _label_centroids(spark, sf_dir), "vec_id").select("vec_id", "cluster_id")


def ann_probe_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    centroids = _label_centroids(spark, sf_dir)
    assigned = ann.assign(_embeddings(spark, sf_dir), centroids, "vec_id")
    return ann.ann_topk(_vector_queries(spark, sf_dir), assigned, centroids, K, None, "vec_id")


def ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole way: fitted centroids, assignment, probing."""
    rows = _embeddings(spark, sf_dir)
    centroids = ann.build_centroids(rows, "vec_id")
    return ann.ann_topk(_vector_queries(spark, sf_dir), ann.assign(rows, centroids, "vec_id"), centroids, K, None, "vec_id")


def rescore_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.two_stage_topk(_vector_queries(spark, sf_dir), _embeddings(spark, sf_dir), K, 4.0, "vec_id")


def _patches(spark: SparkSession, sf_dir: str, per: int) -> DataFrame:
    """Late-interaction documents: ``per`` vectors with neighbouring ids make one document."""
    e = _embeddings(spark, sf_dir).withColumn("doc", F.floor(F.col("vec_id") / per))
    lists = e.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("vec_id", "vector"))).alias("p"))
    return lists.select(F.col("doc").alias("document_id"), F.col("p.vector").alias("patches"))


def maxsim_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _patches(spark, sf_dir, 8)
    queries = docs.filter(F.col("document_id") % 50 == 0).select(F.col("document_id").alias("query_id"), "patches")
    return multivec.maxsim_topk(queries, docs, K)


def mean_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    pooled = multivec.mean_pool(_patches(spark, sf_dir, 8))
    return pooled.select("document_id", F.posexplode("vector").alias("dim", "x")).withColumn("x", F.round("x", 6))


def patch_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multivec.patch_counts(_patches(spark, sf_dir, 8))


def get_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth vector requested, some twice and some unknown, in descending order of id."""
    e = _embeddings(spark, sf_dir).select(F.col("vec_id").cast("string").alias("document_id"), F.col("vec_id").cast("string").alias("chunk_id"), F.lit(0).alias("position"), "vector", "vec_id")
    asked = e.filter("vec_id % 5 = 0").select((-F.col("vec_id")).alias("position"), F.col("chunk_id").alias("id"))
    asked = asked.unionByName(asked.select(F.col("position") + 1_000_000, "id").toDF("position", "id")).unionByName(spark.createDataFrame([(5, "none")], "position bigint, id string"))
    got = vectors_by_request(e.drop("vec_id"), asked)
    return got.select("chunk_id", "request")


# --- lexical and hybrid


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.with_tokens(table(spark, sf_dir, "documents").select("doc_id", "lang", "text")).select("doc_id", "lang", "tokens")


def _text_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tokens of every fiftieth document."""
    u = _units(spark, sf_dir).filter("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "tokens")
    return u.filter(F.size("tokens") > 0)


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.bm25_topk(_text_queries(spark, sf_dir), _units(spark, sf_dir), K, "doc_id")


def bm25_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.bm25_topk(_text_queries(spark, sf_dir), _units(spark, sf_dir), K, "doc_id", F.col("lang") == "en")


def bm25_local_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.bm25_topk(_text_queries(spark, sf_dir), _units(spark, sf_dir), K, "doc_id", F.col("lang") == "en", "filtered")


def hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document is one chunk, with the vector of the same id where there is one; every fiftieth vector asks, with the text of its document if it has one."""
    vectors = _embeddings(spark, sf_dir).select(F.col("vec_id").alias("doc_id"), "vector")
    texts = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    both = texts.join(vectors, "doc_id", "full")
    # a vector without document is ranked by the vectors, but is no unit of the texts' statistics
    tokens = F.when(F.col("text").isNotNull(), X.tokenize(F.col("text")))
    chunks = both.select(F.col("doc_id").alias("document_id"), F.col("doc_id").alias("chunk_id"), tokens.alias("tokens"), "vector")
    queries = both.filter("doc_id % 50 = 0 and vector is not null").select(F.col("doc_id").alias("query_id"), F.coalesce("text", F.lit("")).alias("text"), "vector")
    found = search(chunks.select("document_id", F.create_map().cast("map<string,string>").alias("metadata")), chunks, queries, K, mode="hybrid", dim=64)
    return found.hits.select("query_id", "rank", "score", F.col("document_id").alias("id"))


def _event_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user the event types in the order of events, as lists that repeat ids."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("query_id"), (F.col("event_id") % 3).cast("int").alias("list_id"), F.col("event_id").alias("at"), F.col("event_type").alias("id"))


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("query_id", "list_id").orderBy("at")
    return _event_lists(spark, sf_dir).withColumn("rank", F.row_number().over(w)).withColumn("position", F.col("rank") - 1)


def rrf_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    weighted = _placed(spark, sf_dir).withColumn("weight", (F.col("list_id") + 1).cast("double"))
    return fusion.rrf(weighted, "id").select("query_id", "rank", "score", "id")


def graph_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.rrf_positions(_placed(spark, sf_dir), "id").select("query_id", "id", "score")


def mmr_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = vector_topk(spark, sf_dir)
    vectors = _embeddings(spark, sf_dir).select("vec_id", "vector")
    asked = _vector_queries(spark, sf_dir).select("query_id", F.col("vector").alias("query_vector"))
    candidates = hits.join(vectors, "vec_id").join(asked, "query_id").withColumn("position", F.col("rank"))
    return fusion.maximal_marginal_relevance(candidates, "vec_id", 0.7, digits=6).select("query_id", "vec_id", "score")


def context_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest episodes per source that fit into 2000 characters."""
    e = table(spark, sf_dir, "episodes").groupBy("id").agg(F.min(F.struct("created_at", "source", "body", "occurred_at")).alias("e")).select("id", "e.*")
    found = fusion.context_block(e.filter(F.col("body").isNotNull()), 2000, "source", [F.desc_nulls_last("occurred_at"), F.asc("id")], "body")
    return found.select("source", "rank", "id", "chars_so_far")


def fused_subqueries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three sub-queries per query (its vector and those of the two next ids), fused, with what matched."""
    base = _vector_queries(spark, sf_dir).select("query_id")
    subs = base.select("query_id", F.explode(F.array(*[F.struct(F.lit(i).alias("sub_query"), (F.col("query_id") + i).alias("vec_id")) for i in range(3)])).alias("s")).select("query_id", "s.*")
    asked = subs.join(_embeddings(spark, sf_dir).select("vec_id", "vector"), "vec_id").select(F.struct("query_id", "sub_query").alias("query_id"), "vector")
    asked = asked.select((F.col("query_id.query_id") * 10 + F.col("query_id.sub_query")).alias("query_id"), "vector")
    hits = exact_topk(asked, _embeddings(spark, sf_dir), K, "vec_id")
    hits = hits.select(F.floor(F.col("query_id") / 10).alias("q"), (F.col("query_id") % 10).alias("sub_query"), "rank", "vec_id").withColumnRenamed("q", "query_id")
    return fusion.fuse_subqueries(hits, "vec_id", K).select("query_id", "rank", "score", "vec_id", F.concat_ws(",", F.transform("matched", lambda m: m.cast("string"))).alias("matched"))


# --- SQL

_DOT = "list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"
_VQ = "q AS (SELECT vec_id AS query_id, embedding AS v FROM embeddings WHERE vec_id % 50 = 0)"


def _top_sql(where: str = "true", k: int = K) -> str:
    return f"""
WITH {_VQ},
s AS (SELECT query_id, vec_id, round({_DOT.format(a='q.v', b='e.embedding')}, 6) AS score FROM q, embeddings e WHERE {where}),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, score, vec_id FROM r WHERE rank <= {k}"""


_TOK = "regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z]+(?:[-./][0-9a-z]+)*')"
_CENTROIDS = """
c AS (SELECT label AS cluster_id, list(mean ORDER BY dim) AS centroid FROM (
  SELECT label, dim, avg(CAST(embedding[dim] AS DOUBLE)) AS mean FROM embeddings, range(1, 65) t(dim) GROUP BY label, dim) GROUP BY label),
a AS (SELECT vec_id, cluster_id, embedding FROM (
  SELECT e.vec_id, e.embedding, c.cluster_id, row_number() OVER (PARTITION BY e.vec_id ORDER BY round(list_dot_product(CAST(e.embedding AS DOUBLE[]), c.centroid), 9) DESC, c.cluster_id) AS rn
  FROM embeddings e, c) WHERE rn = 1)"""


def _bm25_sql(allowed: str = "true", local: bool = False, k: int = K, queries: str = "") -> str:
    scope = f"WHERE {allowed}" if local else ""
    return f"""
w AS (SELECT doc_id, lang, {_TOK} AS tokens FROM documents),
q AS (SELECT doc_id AS query_id, unnest(list_distinct(tokens)) AS term FROM w WHERE doc_id % 50 = 0 {queries}),
u AS (SELECT * FROM w {scope}),
st AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM u),
tf AS (SELECT doc_id, lang, term, any_value(len) AS len, count(*) AS tf FROM (SELECT doc_id, lang, len(tokens) AS len, unnest(tokens) AS term FROM u) GROUP BY doc_id, lang, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
b AS (SELECT query_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avgdl))) AS score
      FROM q JOIN tf USING (term) JOIN df USING (term), st WHERE {allowed} GROUP BY query_id, doc_id),
bm AS (SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS INTEGER) AS rank, round(score, 6) AS score, doc_id FROM b) WHERE rank <= {k})"""


_CHUNK_SQL = rf"""
WITH t AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, regexp_replace(regexp_replace(coalesce(text, ''), '^[{_WS}]+', ''), '[{_WS}]+$', '') AS t FROM documents),
c AS (SELECT document_id, CAST(i AS INTEGER) AS position, substring(t, CAST(i * 900 + 1 AS BIGINT), 900) AS part FROM (SELECT *, unnest(range(0, CAST((length(t) + 899) // 900 AS BIGINT))) AS i FROM t)),
h AS (SELECT document_id, position, sha256(regexp_replace(regexp_replace(regexp_replace(part, '^[{_WS}]+', ''), '[{_WS}]+$', ''), '[{_WS}]+', ' ', 'g')) AS chunk_hash FROM c)
SELECT document_id, position, chunk_hash,
  document_id || ':' || chunk_hash[1:12] || ':' || lpad(CAST(row_number() OVER (PARTITION BY document_id, chunk_hash ORDER BY position) - 1 AS VARCHAR), 4, '0') AS chunk_id
FROM h"""

_PATCH = "p AS (SELECT CAST(vec_id // 8 AS BIGINT) AS document_id, vec_id, CAST(embedding AS DOUBLE[]) AS v, row_number() OVER (PARTITION BY vec_id // 8 ORDER BY vec_id) AS n FROM embeddings)"

_EVENTS = """
e AS (SELECT user_id AS query_id, CAST(event_id % 3 AS INTEGER) AS list_id, event_type AS id,
      row_number() OVER (PARTITION BY user_id, event_id % 3 ORDER BY event_id) AS rank FROM events)"""

ORACLES = {
    **{name: f"SELECT doc_id FROM documents d WHERE {condition}" for name, _, condition in FILTERS},
    **{name.replace("filter_", "filter_map_"): f"SELECT doc_id FROM documents d WHERE {condition}" for name, _, condition in FILTERS},
    "filter_doc_ids": "SELECT doc_id FROM documents WHERE n_chars > 1000 AND lang = 'en'",
    "list_keyset": "SELECT 'doc-' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS document_id FROM documents WHERE lang = 'en' AND doc_id > 200 ORDER BY 1 LIMIT 100",
    "tokenize_counts": f"SELECT doc_id, CAST(len({_TOK}) AS INTEGER) AS n_tokens, CAST(len(list_distinct({_TOK})) AS INTEGER) AS n_terms FROM documents",
    "term_frequencies": f"SELECT term, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct({_TOK})) AS term FROM documents) GROUP BY term",
    "chunk_ids": _CHUNK_SQL,
    "content_hashes": "SELECT doc_id, sha256(coalesce(text, '')) AS content_hash FROM documents",
    "stable_ids": """
WITH h AS (SELECT DISTINCT id, sha256(id) AS s FROM entities)
SELECT id, CAST(CAST('0x' || s[15:16] || s[13:14] || s[11:12] || s[9:10] || s[7:8] || s[5:6] || s[3:4] || s[1:2] AS UBIGINT) AS VARCHAR) AS stable_id, s[1:12] AS fingerprint FROM h""",
    "edge_ids": "SELECT DISTINCT id, concat_ws(':', src, relation, dst) AS edge_id FROM edges",
    "noop_upsert": "SELECT CAST(doc_id AS VARCHAR) AS document_id FROM documents WHERE doc_id % 2 <> 0",
    "vector_topk": _top_sql(),
    "vector_topk_filtered": _top_sql("e.label = 3"),
    "vector_batch_arrays": f"SELECT query_id, string_agg(CAST(vec_id AS VARCHAR), ',' ORDER BY rank) AS ids FROM ({_top_sql()}) GROUP BY query_id",
    "vector_normalize": f"""
SELECT vec_id, round(n, 6) AS norm, round(s[1] / n, 6) AS first, round(s[64] / n, 6) AS last
FROM (SELECT vec_id, s, sqrt(list_dot_product(s, s)) AS n FROM (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * 3) AS s FROM embeddings))""",
    "vector_centroids": "SELECT label AS cluster_id, CAST(dim - 1 AS INTEGER) AS dim, round(avg(CAST(embedding[dim] AS DOUBLE)), 6) AS mean FROM embeddings, range(1, 65) t(dim) GROUP BY label, dim",
    "ann_assign": f"WITH {_CENTROIDS} SELECT vec_id, cluster_id FROM a",
    "rescore_topk": f"""
WITH {_VQ},
z AS (SELECT vec_id, embedding, list_max(list_transform(CAST(embedding AS DOUBLE[]), lambda x: abs(x))) AS m FROM embeddings),
i AS (SELECT vec_id, embedding, m, list_transform(CAST(embedding AS DOUBLE[]), lambda x: round_even(x / m * 127, 0)) AS code FROM z),
c AS (SELECT * FROM (SELECT query_id, vec_id, embedding, row_number() OVER (PARTITION BY query_id ORDER BY round(list_dot_product(CAST(q.v AS DOUBLE[]), code) * m / 127, 9) DESC, vec_id) AS rn FROM q, i) WHERE rn <= {4 * K}),
s AS (SELECT query_id, vec_id, round({_DOT.format(a='q.v', b='c.embedding')}, 6) AS score FROM c JOIN q USING (query_id)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, score, vec_id FROM r WHERE rank <= {K}""",
    "maxsim_topk": f"""
WITH {_PATCH},
m AS (SELECT a.document_id AS query_id, a.n, b.document_id, max(list_dot_product(a.v, b.v)) AS best FROM p a, p b WHERE a.document_id % 50 = 0 GROUP BY ALL),
s AS (SELECT query_id, document_id, round(sum(best), 6) AS score FROM m GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, score, document_id FROM r WHERE rank <= {K}""",
    "mean_pool": f"""
WITH {_PATCH},
d AS (SELECT document_id, dim, avg(v[dim]) AS x FROM p, range(1, 65) t(dim) GROUP BY ALL)
SELECT document_id, CAST(dim - 1 AS INTEGER) AS dim, round(x / sqrt(sum(x * x) OVER (PARTITION BY document_id)), 6) AS x FROM d""",
    "patch_counts": f"WITH {_PATCH} SELECT count(DISTINCT document_id) AS documents, count(*) AS patches FROM p",
    "get_vectors": "SELECT CAST(vec_id AS VARCHAR) AS chunk_id, -vec_id AS request FROM embeddings WHERE vec_id % 5 = 0",
    "bm25_topk": f"WITH {_bm25_sql()} SELECT query_id, rank, score, doc_id FROM bm",
    "bm25_filtered": f"WITH {_bm25_sql('lang = ' + repr('en'))} SELECT query_id, rank, score, doc_id FROM bm",
    "bm25_local_stats": f"WITH {_bm25_sql('lang = ' + repr('en'), local=True)} SELECT query_id, rank, score, doc_id FROM bm",
    "hybrid_topk": f"""
WITH v AS ({_top_sql(k=pool_width(K))}),
{_bm25_sql(k=pool_width(K), queries='AND doc_id IN (SELECT vec_id FROM embeddings)')},
f AS (SELECT query_id, id, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT query_id, rank, vec_id AS id FROM v UNION ALL SELECT query_id, rank, doc_id FROM bm) GROUP BY query_id, id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM f)
SELECT query_id, rank, score, id FROM r WHERE rank <= {K}""",
    "rrf_weighted": f"""
WITH {_EVENTS},
f AS (SELECT query_id, list_id, id, min(rank) AS rank FROM e GROUP BY ALL),
s AS (SELECT query_id, id, round(sum((list_id + 1) / (60.0 + rank)), 9) AS score FROM f GROUP BY ALL)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank, score, id FROM s""",
    "graph_rrf": f"WITH {_EVENTS} SELECT query_id, id, round(sum(1.0 / rank), 9) AS score FROM e GROUP BY query_id, id",
    "mmr_rerank": f"""
WITH t AS ({_top_sql()}),
c AS (SELECT t.query_id, t.rank, t.vec_id, CAST(e.embedding AS DOUBLE[]) AS v, CAST(x.embedding AS DOUBLE[]) AS qv FROM t JOIN embeddings e USING (vec_id) JOIN embeddings x ON x.vec_id = t.query_id),
m AS (SELECT a.query_id, a.vec_id, any_value(list_cosine_similarity(a.qv, a.v)) AS rel,
        greatest(0, max(CASE WHEN a.rank <> b.rank THEN list_cosine_similarity(a.v, b.v) END)) AS near FROM c a JOIN c b USING (query_id) GROUP BY a.query_id, a.vec_id)
SELECT query_id, vec_id, round(0.7 * rel - 0.3 * near, 6) AS score FROM m""",
    "context_block": """
WITH f AS (SELECT id, source, body, occurred_at FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY created_at NULLS FIRST) AS rn FROM episodes) WHERE rn = 1 AND body IS NOT NULL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY source ORDER BY occurred_at DESC NULLS LAST, id) AS INTEGER) AS rank FROM f),
s AS (SELECT source, rank, id, CAST(sum(length(body)) OVER (PARTITION BY source ORDER BY rank ROWS UNBOUNDED PRECEDING) AS BIGINT) AS chars_so_far FROM r)
SELECT source, rank, id, chars_so_far FROM s WHERE chars_so_far <= 2000""",
    "fused_subqueries": f"""
WITH s AS (SELECT q.vec_id AS query_id, i AS sub_query, e.embedding AS v FROM embeddings q, range(0, 3) t(i) JOIN embeddings e ON e.vec_id = q.vec_id + i WHERE q.vec_id % 50 = 0),
h AS (SELECT query_id, sub_query, e.vec_id, row_number() OVER (PARTITION BY query_id, sub_query ORDER BY round({_DOT.format(a='s.v', b='e.embedding')}, 6) DESC, e.vec_id) AS rank FROM s, embeddings e),
f AS (SELECT query_id, vec_id, round(sum(1.0 / (60 + rank)), 9) AS score, string_agg(CAST(sub_query AS VARCHAR), ',' ORDER BY sub_query) AS matched FROM h WHERE rank <= {K} GROUP BY query_id, vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM f)
SELECT query_id, rank, score, vec_id, matched FROM r WHERE rank <= {K}""",
}

QUERIES = {
    **{name: _filter_query(tree) for name, tree, _ in FILTERS},
    **{name.replace("filter_", "filter_map_"): _filter_map_query(tree) for name, tree, _ in FILTERS},
    **{
        f.__name__: f
        for f in (
            filter_doc_ids, list_keyset, tokenize_counts, term_frequencies, chunk_ids, content_hashes, stable_ids, edge_ids, noop_upsert,
            vector_topk, vector_topk_filtered, vector_batch_arrays, vector_normalize, vector_centroids, ann_assign, ann_probe_topk, ann_search, rescore_topk, maxsim_topk, mean_pool,
            patch_counts, get_vectors, bm25_topk, bm25_filtered, bm25_local_stats, hybrid_topk, rrf_weighted, graph_rrf, mmr_rerank, context_block, fused_subqueries,
        )
    },
}
