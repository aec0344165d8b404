"""Queries for semantic retrieval over the graphs of the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.embedding import HashEmbedder
from ..functions.frames import AsOf
from ..operators import semantic as S
from ..sources.tables import cut_lineage, table
from .graphs import FRAMES, T0
from .search import pool_width

DIM, K = 64, 5
EMBEDDER = HashEmbedder(DIM)
AT = AsOf.at(T0)


def _asked(rows: DataFrame, ident: str = "id") -> DataFrame:
    """Rows whose hexadecimal id is divisible by 50."""
    return rows.filter(F.conv(F.regexp_extract(ident, "-([0-9a-f]{8})$", 1), 16, 10).cast("bigint") % 50 == 0)


def _node_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sound vector per node id."""
    v = table(spark, sf_dir, "node_vectors").filter(V.valid_vector(F.col("vector"), DIM) & F.exists("vector", lambda x: x != 0))
    return v.groupBy("node_id").agg(F.max("vector").alias("vector")).withColumnRenamed("node_id", "id")


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nodes").select("id", "type", "label", "properties")


def _node_index(spark: SparkSession, sf_dir: str, retained: bool) -> DataFrame:
    elements = _nodes(spark, sf_dir).select("id", F.col("type").alias("label"), F.col("label").alias("text"))
    return cut_lineage(S.build_index(elements, "node", EMBEDDER, _node_vectors(spark, sf_dir) if retained else None), "index")


def _entity_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.build_index(table(spark, sf_dir, "entities").select("id", F.col("type").alias("label"), F.col("label").alias("text")), "entity", EMBEDDER)


def _fact_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.build_index(table(spark, sf_dir, "facts").select("id", F.col("relation").alias("label"), F.col("fact").alias("text")), "fact", EMBEDDER)


def _texts(index: DataFrame) -> DataFrame:
    return _asked(index).select(F.col("id").alias("query_id"), "text")


def semantic_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By retained vectors, among the concepts of one tier; every fiftieth vector asks."""
    queries = _asked(_node_vectors(spark, sf_dir)).select(F.col("id").alias("query_id"), V.l2_normalize(F.col("vector")).alias("vector"))
    return S.semantic_nodes(_nodes(spark, sf_dir), _node_index(spark, sf_dir, True), queries, K, EMBEDDER, "concept", {"tier": "gold"})


def semantic_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the words of relation and ends, among the edges that cite."""
    edges = table(spark, sf_dir, "edges").select("id", "relation", F.concat_ws(" ", "src", F.regexp_replace("relation", "_", " "), "dst").alias("text"))
    index = cut_lineage(S.build_index(edges.select("id", F.col("relation").alias("label"), "text"), "edge", EMBEDDER), "index")
    return S.semantic_edges(edges, index, _texts(index), K, EMBEDDER, "cites", "lexical")


def semantic_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By name, vectors and words fused, among the entities valid at a time."""
    index = cut_lineage(_entity_index(spark, sf_dir), "index")
    return S.semantic_entities(table(spark, sf_dir, "entities"), index, _texts(index), K, EMBEDDER, AT)


def semantic_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By words, among the facts that hold now."""
    index = cut_lineage(_fact_index(spark, sf_dir), "index")
    return S.semantic_facts(table(spark, sf_dir, "facts"), index, _texts(index), K, EMBEDDER, AsOf.now(), mode="lexical")


def resolve_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates for the names of every fiftieth entity, in upper case, of all times; the index holds facts as well."""
    names = cut_lineage(_entity_index(spark, sf_dir), "index")
    index = cut_lineage(names.unionByName(_fact_index(spark, sf_dir)), "index")
    return S.resolve_entity(table(spark, sf_dir, "entities"), index, _texts(names).withColumn("text", F.upper("text")), K, EMBEDDER)


def subgraph_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid seeds for the label of the first node, and one hop around them."""
    index = _node_index(spark, sf_dir, False)
    query = index.agg(F.min("id").alias("query_id"), F.min_by("text", "id").alias("text"))
    found = S.search_graph(_nodes(spark, sf_dir), table(spark, sf_dir, "edges"), index, query, K, 1, EMBEDDER)
    return found.nodes.join(found.seeds, "id", "left")


def subgraph_temporal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity and fact seeds for the text of the first fact, and one hop around them, at a time."""
    entities, facts = table(spark, sf_dir, "entities"), table(spark, sf_dir, "facts")
    told = _fact_index(spark, sf_dir)
    index = cut_lineage(_entity_index(spark, sf_dir).unionByName(told), "index")
    query = index.filter("kind = 'fact'").agg(F.min("id").alias("query_id"), F.min_by("text", "id").alias("text"))
    found = S.search_temporal(entities, facts, index, query, K, 1, EMBEDDER, AT, "both", mode="lexical")
    return found.nodes.join(found.seeds.distinct(), "id", "full").select("id", "hop", "score")


def graph_reindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The node index rebuilt after every second type has gone from the topology: counts."""
    nodes = _nodes(spark, sf_dir)
    elements = nodes.select("id", F.col("type").alias("label"), F.col("label").alias("text"))
    left = elements.filter(F.length("label") % 2 == 0)
    _, counts = S.reindex(_node_index(spark, sf_dir, True), left, "node", EMBEDDER, _node_vectors(spark, sf_dir))
    return counts


# --- SQL

_TOK = "regexp_extract_all(lower(coalesce({t}, '')), '[0-9a-z]+(?:[-./][0-9a-z]+)*')"
_SOUND = "len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0"
_HEX = "TRY_CAST('0x' || regexp_extract({c}, '-([0-9a-f]{{8}})$', 1) AS BIGINT) % 50 = 0"


def _hash_vector(text: str) -> str:
    digest = f"sha256('0:' || {text}) || sha256('1:' || {text})"
    raw = f"list_transform(range(0, 64), lambda i: (CAST('0x' || substring({digest}, CAST(i * 2 + 1 AS BIGINT), 2) AS INTEGER) - 127.5) / 127.5)"
    return f"(SELECT list_transform(r, lambda x: CAST(CAST(x / sqrt(list_dot_product(r, r)) AS FLOAT) AS DOUBLE)) FROM (SELECT CAST({raw} AS DOUBLE[]) AS r))"


def _lexical(k: int) -> str:
    """CTEs from u (id, text, ok) and q (query_id, text) to lex (query_id, rank, score, id)."""
    return f"""
uw AS (SELECT id, ok, {_TOK.format(t='text')} AS tokens FROM u),
qt AS (SELECT query_id, unnest(list_distinct({_TOK.format(t='text')})) AS term FROM q),
st AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM uw),
tf AS (SELECT id, ok, term, any_value(len) AS len, count(*) AS tf FROM (SELECT id, ok, len(tokens) AS len, unnest(tokens) AS term FROM uw) GROUP BY id, ok, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
bs AS (SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avgdl))), 6) AS score
       FROM qt JOIN tf USING (term) JOIN df USING (term), st WHERE ok GROUP BY query_id, id),
lex AS (SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank, score, id FROM bs) WHERE rank <= {k})"""


def _vector(k: int) -> str:
    """CTEs from ux (id, v) and qx (query_id, v), all of them allowed, to vec (query_id, rank, score, id)."""
    return f"""
vs AS (SELECT query_id, id, round(list_dot_product(qx.v, ux.v), 6) AS score FROM qx, ux),
vec AS (SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank, score, id FROM vs) WHERE rank <= {k})"""


def _hybrid(k: int) -> str:
    """CTEs from u and q to hyb (query_id, rank, score, id), with hash vectors."""
    width = pool_width(k)
    return f"""
ux AS (SELECT id, {_hash_vector('text')} AS v FROM u WHERE ok), qx AS (SELECT query_id, {_hash_vector('text')} AS v FROM q),
{_vector(width)},
{_lexical(width)},
fs AS (SELECT query_id, id, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT query_id, rank, id FROM vec UNION ALL SELECT query_id, rank, id FROM lex) GROUP BY query_id, id),
hyb AS (SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank, score, id FROM fs) WHERE rank <= {k})"""


_AT = FRAMES["asof_at"][1]
_NOW = FRAMES["asof_now"][1]
_ENTITY_UNITS = "SELECT id, min(label) AS text FROM entities WHERE id IS NOT NULL GROUP BY id HAVING trim(min(label)) <> ''"
_FACT_UNITS = "SELECT id, min(fact) AS text FROM facts WHERE id IS NOT NULL GROUP BY id HAVING trim(min(fact)) <> ''"
_NODE_UNITS = "SELECT id, min(label) AS text FROM nodes WHERE id IS NOT NULL GROUP BY id HAVING trim(min(label)) <> ''"
_UNIT_VECTORS = f"SELECT node_id AS id, max(vector) AS v FROM node_vectors WHERE {_SOUND} GROUP BY node_id"
_UNIT = "list_transform(CAST({v} AS DOUBLE[]), lambda x: x / sqrt(list_dot_product(CAST({v} AS DOUBLE[]), CAST({v} AS DOUBLE[]))))"

ORACLES = {
    "semantic_nodes": f"""
WITH nv AS ({_UNIT_VECTORS}),
live AS (SELECT DISTINCT id FROM nodes WHERE type = 'concept' AND json_extract_string(properties, '$.tier') = 'gold'),
lab AS (SELECT id, arg_min(type, struct_pack(a := label, b := type)) AS type FROM nodes GROUP BY id),
qx AS (SELECT id AS query_id, {_UNIT.format(v='v')} AS v FROM nv WHERE {_HEX.format(c='id')}),
rt AS (SELECT id, list_transform({_UNIT.format(v='v')}, lambda x: CAST(CAST(x AS FLOAT) AS DOUBLE)) AS v FROM nv),
hs AS (SELECT id, {_hash_vector('text')} AS v FROM ({_NODE_UNITS}) WHERE id NOT IN (SELECT id FROM nv)),
ux AS (SELECT * FROM (SELECT * FROM rt UNION ALL SELECT * FROM hs) WHERE id IN (SELECT id FROM live) AND id IN (SELECT id FROM lab WHERE type = 'concept')),
{_vector(K)}
SELECT query_id, rank, score, id FROM vec""",
    "semantic_edges": f"""
WITH u0 AS (SELECT id, min(t) AS text, arg_min(relation, struct_pack(a := t, b := relation)) AS relation FROM (SELECT id, relation, concat_ws(' ', src, replace(relation, '_', ' '), dst) AS t FROM edges) GROUP BY id),
u AS (SELECT id, text, relation = 'cites' AS ok FROM u0 WHERE trim(text) <> ''), q AS (SELECT id AS query_id, text FROM u WHERE {_HEX.format(c='id')}),
{_lexical(K)}
SELECT query_id, rank, score, id FROM lex""",
    "semantic_entities": f"""
WITH live AS (SELECT DISTINCT id FROM entities WHERE {_AT}),
u AS (SELECT id, text, id IN (SELECT id FROM live) AS ok FROM ({_ENTITY_UNITS})), q AS (SELECT id AS query_id, text FROM u WHERE {_HEX.format(c='id')}),
{_hybrid(K)}
SELECT query_id, rank, score, id FROM hyb""",
    "semantic_facts": f"""
WITH live AS (SELECT DISTINCT id FROM facts WHERE {_NOW}),
u AS (SELECT id, text, id IN (SELECT id FROM live) AS ok FROM ({_FACT_UNITS})), q AS (SELECT id AS query_id, text FROM u WHERE {_HEX.format(c='id')}),
{_lexical(K)}
SELECT query_id, rank, score, id FROM lex""",
    "resolve_entity": f"""
WITH u AS (SELECT id, text, true AS ok FROM ({_ENTITY_UNITS}) UNION ALL SELECT 'fact:' || id, text, false FROM ({_FACT_UNITS})),
q AS (SELECT id AS query_id, upper(text) AS text FROM u WHERE ok AND {_HEX.format(c='id')}),
{_hybrid(K)}
SELECT query_id, rank, score, id FROM hyb""",
    "subgraph_hybrid": f"""
WITH u AS (SELECT id, text, true AS ok FROM ({_NODE_UNITS})), q AS (SELECT id AS query_id, text FROM u ORDER BY id LIMIT 1),
{_hybrid(K)},
h0 AS (SELECT id, 0 AS hop FROM hyb),
e1 AS (SELECT * FROM edges WHERE src IS NOT NULL AND dst IS NOT NULL AND (src IN (SELECT id FROM h0) OR dst IN (SELECT id FROM h0))),
h1 AS (SELECT * FROM h0 UNION ALL SELECT DISTINCT id, 1 FROM (SELECT src AS id FROM e1 UNION SELECT dst FROM e1) WHERE id NOT IN (SELECT id FROM h0))
SELECT h1.id, CAST(hop AS INTEGER) AS hop, score FROM h1 LEFT JOIN hyb ON hyb.id = h1.id""",
    "subgraph_temporal": f"""
WITH le AS (SELECT DISTINCT id FROM entities WHERE {_AT}), lf AS (SELECT DISTINCT id, src, dst FROM facts WHERE {_AT}),
un AS (SELECT 'entity:' || id AS id, text FROM ({_ENTITY_UNITS}) UNION ALL SELECT 'fact:' || id, text FROM ({_FACT_UNITS})),
q AS (SELECT id AS query_id, text FROM ({_FACT_UNITS}) ORDER BY id LIMIT 1),
u AS (SELECT id, text, substring(id, strpos(id, ':') + 1) IN (SELECT id FROM le UNION SELECT id FROM lf) AS ok FROM un),
{_lexical(1 << 30)},
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id, split_part(id, ':', 1) ORDER BY rank) AS place FROM lex),
es AS (SELECT substring(id, 8) AS id, score FROM rk WHERE id LIKE 'entity:%' AND place <= {K}),
ft AS (SELECT lf.*, rk.score FROM rk JOIN lf ON 'fact:' || lf.id = rk.id WHERE place <= {K} AND src IN (SELECT id FROM le) AND dst IN (SELECT id FROM le)),
sd AS (SELECT id, score FROM es UNION SELECT 'fact:' || id, score FROM ft),
h0 AS (SELECT DISTINCT id, 0 AS hop FROM (SELECT id FROM es UNION SELECT src FROM ft UNION SELECT dst FROM ft)),
e1 AS (SELECT * FROM lf WHERE src IN (SELECT id FROM le) AND dst IN (SELECT id FROM le) AND (src IN (SELECT id FROM h0) OR dst IN (SELECT id FROM h0))),
h1 AS (SELECT * FROM h0 UNION ALL SELECT DISTINCT id, 1 FROM (SELECT src AS id FROM e1 UNION SELECT dst FROM e1) WHERE id NOT IN (SELECT id FROM h0))
SELECT coalesce(h1.id, sd.id) AS id, CAST(hop AS INTEGER) AS hop, score FROM h1 FULL JOIN sd ON sd.id = h1.id""",
    "graph_reindex": f"""
WITH nv AS ({_UNIT_VECTORS}), a AS (SELECT id, min(label) AS text FROM nodes GROUP BY id), l AS (SELECT id, min(label) AS text FROM nodes WHERE length(type) % 2 = 0 GROUP BY id),
ix AS (SELECT id FROM a WHERE trim(text) <> '' OR id IN (SELECT id FROM nv))
SELECT (SELECT count(*) FROM l WHERE trim(text) <> '' OR id IN (SELECT id FROM nv)) AS reindexed, (SELECT count(*) FROM l WHERE coalesce(trim(text), '') = '' AND id NOT IN (SELECT id FROM nv)) AS unrebuildable,
  (SELECT count(*) FROM ix WHERE id NOT IN (SELECT id FROM l)) AS removed_orphans""",
}

QUERIES = {
    f.__name__: f
    for f in (semantic_nodes, semantic_edges, semantic_entities, semantic_facts, resolve_entity, subgraph_hybrid, subgraph_temporal, graph_reindex)
}
