"""Queries for graphs, temporal frames, change logs and snapshots over the driver's tables, with their SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.frames import AsOf, encode_ts
from ..operators import fusion, graph, temporal_graph as tg
from ..operators.vector_search import exact_topk
from ..sources import sync
from ..sources.tables import cut_lineage, table
from ..streaming.log import document_changes, fold, last_writers

T0, T1 = 1_700_000_000_000, 1_680_000_000_000
HUB = "nod-hub-atlasroot"


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nodes").select("id", "type", "label", "properties")


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "edges").select("id", "src", "relation", "dst", "properties")


def _seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of type chunk whose label begins with 'late'."""
    return _nodes(spark, sf_dir).filter("type = 'chunk' and label like 'late%'").select("id").distinct()


def graph_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbors(_edges(spark, sf_dir), HUB).select("id", "src", "relation", "dst").distinct()


def graph_neighbors_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbors(_edges(spark, sf_dir), HUB, "in", "links_to").select("id", "src").distinct()


def khop_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.k_hop(_edges(spark, sf_dir), _seeds(spark, sf_dir), 2, "out").nodes


def khop_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.k_hop(_edges(spark, sf_dir), _seeds(spark, sf_dir), 2, "both").edges.select("id")


def khop_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.k_hop(_edges(spark, sf_dir), _seeds(spark, sf_dir), 3, "out", "links_to").nodes


def subgraph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds are the five nodes nearest to one node's vector; one hop from them."""
    v = table(spark, sf_dir, "node_vectors").filter(F.size("vector") == 64).groupBy("node_id").agg(F.max("vector").alias("vector"))
    v = v.filter(F.forall("vector", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0))
    first = v.agg(F.min("node_id").alias("query_id"), F.min_by("vector", "node_id").alias("vector"))
    seeds = exact_topk(first, v, 5, "node_id", metric="cosine").select(F.col("node_id").alias("id"), "score")
    found = graph.search_subgraph(_edges(spark, sf_dir), seeds, 1)
    return found.nodes.join(found.seeds, "id", "left")


def graph_triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.triplets(_nodes(spark, sf_dir), _edges(spark, sf_dir), relation_names=["cites"], properties={"tier": "gold"})


def graph_triplets_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.triplets(_nodes(spark, sf_dir), _edges(spark, sf_dir), entity_names=[HUB])


def relation_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.relation_map(_nodes(spark, sf_dir), _edges(spark, sf_dir), ["nod-00009e37"], 2, 30, ["cites"])


def nodes_by_property(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.nodes_with(_nodes(spark, sf_dir), {"tier": "gold", "owner": "team-violet"}).select("id").distinct()


def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.graph_stats(_nodes(spark, sf_dir), _edges(spark, sf_dir))


def dangling_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.dangling_edges(_nodes(spark, sf_dir), _edges(spark, sf_dir)).select("id").distinct()


def remove_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges left after all nodes of type concept have been removed."""
    nodes, edges = _nodes(spark, sf_dir), _edges(spark, sf_dir)
    return graph.remove_nodes(nodes, edges, nodes.filter("type = 'concept'"))[1].select("id").distinct()


def upsert_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels after the even half of the nodes has been written again in upper case."""
    nodes = _nodes(spark, sf_dir).groupBy("id").agg(F.min(F.struct("type", "label", "properties")).alias("n")).select("id", "n.*")
    fresh = nodes.filter(F.length("label") % 2 == 0).withColumn("label", F.upper("label"))
    return graph.upsert(nodes, fresh).select("id", "label")


def distance_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes in the order of their ids, reranked by hops from a hub."""
    nodes = _nodes(spark, sf_dir).select("id").distinct()
    hops = graph.k_hop(_edges(spark, sf_dir), spark.createDataFrame([(HUB,)], "id string"), 2).nodes.select("id", F.col("hop").alias("hops"))
    placed = nodes.select(F.lit(1).alias("query_id"), F.col("id").alias("position"), "id")
    return fusion.distance_rerank(placed, hops, "id").select("id", "rank", "hops")


def mention_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity types' members reranked by the number of episodes about them."""
    about = table(spark, sf_dir, "episodes").select(F.col("id").alias("episode_id"), F.get_json_object("properties", "$.entity_id").alias("entity_id")).filter("entity_id is not null")
    counts = tg.mention_counts(about).withColumnRenamed("entity_id", "id")
    e = table(spark, sf_dir, "entities").groupBy("id").agg(F.min("type").alias("query_id"))
    placed = e.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("id")))
    return fusion.mentions_rerank(placed, counts, "id").select("query_id", "id", "mentions", "rank")


# --- temporal frames

FRAMES = {
    "asof_now": (AsOf.now(), "expired_at IS NULL AND invalid_at IS NULL"),
    "asof_at": (AsOf.at(T0), f"(valid_at IS NULL OR valid_at <= {T0}) AND (invalid_at IS NULL OR invalid_at > {T0})"),
    "asof_now_valid": (
        AsOf.now_valid(T0),
        f"(valid_at IS NULL OR valid_at <= {T0}) AND (invalid_at IS NULL OR invalid_at > {T0}) AND created_at <= {T0} AND (expired_at IS NULL OR expired_at > {T0})",
    ),
    "asof_known": (
        AsOf.at_known(T0, T1),
        f"(valid_at IS NULL OR valid_at <= {T0}) AND created_at <= {T1} AND (expired_at IS NULL OR expired_at > {T1}) AND (expired_at > {T1} OR invalid_at IS NULL OR invalid_at > {T0})",
    ),
    "asof_all": (AsOf.all(), "true"),
}


def _frame_query(frame: AsOf):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return tg.facts_as_of(table(spark, sf_dir, "facts"), frame).select("id").distinct()

    return query


def entities_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tg.entities_as_of(table(spark, sf_dir, "entities"), AsOf.at(T0), "team").select("id", "created_at").distinct()


def fact_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tg.history(table(spark, sf_dir, "facts"), "ent-00009e37").select("id", "created_at").distinct()


def facts_of_episode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of every episode, counted by first and by any provenance."""
    links = tg.provenance(table(spark, sf_dir, "facts"))
    return links.groupBy("episode_id").agg(F.countDistinct("id").alias("facts"), F.count_if(F.col("place") == 0).alias("owned"))


def facts_by_episode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts of the episode that the most facts name (the smallest id of several)."""
    facts = table(spark, sf_dir, "facts")
    counts = tg.provenance(facts).groupBy("episode_id").agg(F.countDistinct("id").alias("n"))
    most = counts.orderBy(F.desc("n"), "episode_id").first()
    return tg.facts_by_episode(facts, most[0] if most else "").select("id", "created_at").distinct()


def reference_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tg.reference_times(table(spark, sf_dir, "facts").select("id", "episodes").distinct(), table(spark, sf_dir, "episodes"))


def temporal_khop(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts, entities = table(spark, sf_dir, "facts"), table(spark, sf_dir, "entities")
    seeds = spark.createDataFrame([("ent-00009e37",), ("ent-hub-lumenpost",)], "id string")
    return tg.k_hop(entities, facts, seeds, 2, AsOf.at(T0), "out", gate=F.coalesce(F.col("type") != "team", F.lit(True)) | F.col("id").startswith("ent-hub")).nodes


def temporal_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fact seeds: facts of relation located_in under the frame. The seeds that survive, with their score, and the nodes one hop from their ends, with the hop."""
    facts, entities = table(spark, sf_dir, "facts"), table(spark, sf_dir, "entities")
    seeds = facts.filter("relation = 'located_in'").select("id").distinct().withColumn("score", F.lit(1.0))
    found = tg.search_subgraph(entities, facts, 1, AsOf.at(T0), fact_seeds=seeds)
    return found.nodes.join(found.seeds.distinct(), "id", "full").select("id", "hop", "score")


def temporal_dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, f, p = (table(spark, sf_dir, n) for n in ("entities", "facts", "episodes"))
    empty = tg.TemporalTables.empty(spark)
    return tg.dangling(tg.TemporalTables(p, e, f, empty.mentions, empty.versions))


def _event_facts(spark: SparkSession, sf_dir: str) -> tuple[tg.TemporalTables, DataFrame]:
    """Users and event types as entities, and events as facts between them, numbered per user."""
    e = table(spark, sf_dir, "events").select(
        F.format_string("e%d", "event_id").alias("id"), F.format_string("u%d", "user_id").alias("src"), F.lit("did").alias("relation"), F.concat(F.lit("t-"), "event_type").alias("dst"), F.col("event_id").alias("valid_at"),
    )
    w = Window.partitionBy("src").orderBy("valid_at")
    facts = e.select("*", F.concat_ws(" ", "src", "dst").alias("fact"), F.lit("{}").alias("properties"), F.array().cast("array<string>").alias("episodes"), F.row_number().over(w).alias("n"), F.lag("id").over(w).alias("before"))
    names = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    none = {c: F.lit(None).cast("bigint") for c in ("valid_at", "invalid_at", "expired_at")}
    empty = tg.TemporalTables.empty(spark)
    entities = names.select("id", F.lit("t").alias("type"), F.col("id").alias("label"), F.lit("{}").alias("properties"), F.lit(1).cast("bigint").alias("created_at")).withColumns(none)
    return tg.TemporalTables(empty.episodes, cut_lineage(entities.select(*empty.entities.columns), "entities"), empty.facts, empty.mentions, empty.versions), cut_lineage(facts, "facts")


def _chained(spark: SparkSession, sf_dir: str) -> tg.TemporalTables:
    """Each user's events 1, 3, 5, ... are added, then 2, 4, 6, ..., each of which ends the event before it."""
    tables, facts = _event_facts(spark, sf_dir)
    batch = lambda odd: facts.filter(F.col("n") % 2 == odd).withColumn("invalidates", F.when(F.lit(odd == 0), F.array("before")).otherwise(F.array().cast("array<string>")))
    first = tg.add_facts(tables, batch(1), 1_000_000)
    return tg.add_facts(replace(first, facts=cut_lineage(first.facts, "facts")), batch(0), 2_000_000)


def supersede_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as facts that supersede one another, after both batches."""
    return _chained(spark, sf_dir).facts.select("id", "valid_at", "invalid_at", "created_at", "expired_at")


def invalidate_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All facts that a third of the relations make, closed at a time; those that have expired stay as they are."""
    f = table(spark, sf_dir, "facts")
    empty = tg.TemporalTables.empty(spark)
    ids = f.filter(F.length("relation") % 3 == 0).select("id").distinct().withColumn("invalid_at", F.lit(T0))
    after = tg.invalidate_facts(tg.TemporalTables(empty.episodes, empty.entities, f, empty.mentions, empty.versions), ids, T0 + 1)
    return after.facts.select("id", "created_at", "invalid_at", "expired_at").distinct()


def temporal_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    empty = tg.TemporalTables.empty(spark)
    tables = tg.TemporalTables(empty.episodes, table(spark, sf_dir, "entities"), table(spark, sf_dir, "facts"), empty.mentions, empty.versions)
    return tg.stats(tables)


def ingest_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges after a batch that writes the citations again under another relation and without ids."""
    nodes, edges = _nodes(spark, sf_dir), _edges(spark, sf_dir).dropDuplicates(["id"])
    batch = edges.filter("relation = 'cites' and src is not null and dst is not null").select(F.lit(None).cast("string").alias("id"), "src", F.lit("cited").alias("relation"), "dst", F.lit("{}").alias("properties")).distinct()
    return graph.ingest(nodes.dropDuplicates(["id"]), edges, nodes.limit(0), batch)[1].select("id", "relation")


def remove_episode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts and their provenance after the episode with the smallest id among first sources has gone."""
    f = table(spark, sf_dir, "facts").select("id", "episodes").distinct()
    first = f.agg(F.min(F.try_element_at("episodes", F.lit(1)))).first()[0]
    empty = tg.TemporalTables.empty(spark)
    left = tg.remove_episode(tg.TemporalTables(empty.episodes, empty.entities, f, empty.mentions, empty.versions), first).facts
    return left.select("id", F.size("episodes").alias("sources")).distinct()


def property_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of the JSON properties after the entities have been upserted version by version, oldest versions first."""
    e = table(spark, sf_dir, "entities").groupBy("id", "created_at").agg(F.min(F.struct("type", "label", "properties", "valid_at")).alias("e")).select("id", "created_at", "e.*")
    return tg.lineage(e).select("entity_id", "property_key", "value", "valid_at", "invalid_at", "created_at", "expired_at")


def encoded_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "facts")
    return f.select("id", encode_ts(F.col("valid_at"), "a").alias("since"), encode_ts(F.col("invalid_at"), "c").alias("until")).distinct()


# --- logs and snapshots


def log_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log of whole rows per user: the last one counts, an error deletes the user."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    return last_writers(e, "user_id", "event_id", F.col("event_type") == "error").select("user_id", "event_id", "event_type")


def _log(spark: SparkSession, sf_dir: str, dim: int = 1) -> DataFrame:
    """Events as a JSON log: purchase sets, view patches text, click patches metadata, error deletes."""
    e = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("d"), "event_type", "value")
    metadata = F.create_map(F.lit("at"), F.col("event_id").cast("string"))
    text = F.col("event_id").cast("string")
    doc = F.to_json(F.struct(F.array(F.struct(F.col("d").alias("document_id"), text.alias("text"), metadata.alias("metadata"), F.array(*[F.lit(1.0)] * dim).alias("vector"))).alias("documents")))
    op = (
        F.when(F.col("event_type") == "purchase", F.struct(F.lit("upsert_vectors").alias("op"), doc.alias("payload")))
        .when(F.col("event_type") == "error", F.struct(F.lit("delete_documents").alias("op"), F.to_json(F.struct(F.array("d").alias("document_ids"))).alias("payload")))
        .when(F.col("event_type") == "view", F.struct(F.lit("update_document_payload").alias("op"), F.to_json(F.struct(F.col("d").alias("document_id"), text.alias("text"))).alias("payload")))
        .when(F.col("event_type") == "click", F.struct(F.lit("update_document_payload").alias("op"), F.to_json(F.struct(F.col("d").alias("document_id"), metadata.alias("metadata"))).alias("payload")))
    )
    return e.select(F.col("event_id").alias("lsn"), op.alias("o")).filter("o is not null").select("lsn", "o.*")


def log_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_changes(_log(spark, sf_dir)).groupBy("kind").agg(F.count(F.lit(1)).alias("changes"), F.countDistinct("document_id").alias("documents"))


def log_fold_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    empty = spark.createDataFrame([], "document_id string, metadata map<string,string>, text string, vector array<float>, lsn bigint")
    state = fold(empty, _log(spark, sf_dir))
    return state.select("document_id", F.try_element_at("metadata", F.lit("at")).alias("at"), "text")


def fold_in_two_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same fold, cut at an lsn, with records of the first step delivered again."""
    log = _log(spark, sf_dir)
    empty = spark.createDataFrame([], "document_id string, metadata map<string,string>, text string, vector array<float>, lsn bigint")
    half = fold(empty, log.filter("lsn <= 400"))
    return fold(half, log, 400).select("document_id", F.try_element_at("metadata", F.lit("at")).alias("at"), "text")


def inventory_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as artifacts of two generations: some gone, some new, some changed."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("artifact"), F.col("c_mktsegment").alias("sha256"))
    after = c.filter("k % 7 <> 0").withColumn("sha256", F.when(F.col("k") % 5 == 0, F.lit("new")).otherwise(F.col("sha256")))
    return sync.inventory_diff(c.filter("k % 11 <> 0").drop("k"), after.drop("k"))


def sync_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as indexes with local, base and remote pointers derived from their keys."""
    k = F.col("c_custkey")

    def snap(absent, generation, logical) -> F.Column:
        present = F.struct(generation.alias("generation"), logical.alias("snapshot_id"), logical.alias("logical_id"), F.lit(None).cast("string").alias("text_id"), F.lit(None).cast("string").alias("lexical_id"))
        return F.when(~absent, present)

    local = snap(k % 13 == 0, F.lit(5) + k % 3, F.concat(F.lit("c"), (k % 2).cast("string")))
    base = snap(k % 11 == 0, F.lit(5) + F.when(k % 17 == 0, 4).otherwise(0), F.lit("c0"))
    remote = snap(k % 7 == 0, F.lit(5) + k % 4, F.concat(F.lit("c"), (F.floor(k / 2) % 3).cast("string")))
    states = table(spark, sf_dir, "customer").select("c_custkey", local.alias("local"), base.alias("base"), remote.alias("remote"))
    return sync.classify(states).select("c_custkey", "state")


# --- SQL

_SEEDS = "seeds AS (SELECT DISTINCT id FROM nodes WHERE type = 'chunk' AND label LIKE 'late%')"


def _khop_sql(k: int, direction: str, seeds: str = _SEEDS, edges: str = "edges", relation: str | None = None, select: str = "") -> str:
    """Levels one by one: h0 the seeds, e1 the edges of h0, h1 their new nodes, and so on."""
    where = f"WHERE src IS NOT NULL AND dst IS NOT NULL{f' AND relation = {relation!r}' if relation else ''}"
    parts = [seeds, f"ed AS (SELECT DISTINCT id, src, dst FROM {edges} {where})", "h0 AS (SELECT id, 0 AS hop FROM seeds)"]
    for i in range(1, k + 1):
        at = f"(SELECT id FROM h{i - 1} WHERE hop = {i - 1})"
        match = {"out": f"src IN {at}", "in": f"dst IN {at}", "both": f"(src IN {at} OR dst IN {at})"}[direction]
        ends = {"out": "SELECT dst AS id FROM e{i}", "in": "SELECT src AS id FROM e{i}", "both": "SELECT src AS id FROM e{i} UNION SELECT dst FROM e{i}"}[direction].format(i=i)
        parts.append(f"e{i} AS (SELECT * FROM ed WHERE {match})")
        parts.append(f"h{i} AS (SELECT * FROM h{i - 1} UNION ALL SELECT DISTINCT id, {i} AS hop FROM ({ends}) WHERE id NOT IN (SELECT id FROM h{i - 1}))")
    return "WITH " + ",\n".join(parts) + "\n" + (select or f"SELECT id, CAST(hop AS INTEGER) AS hop FROM h{k}")


_AT = FRAMES["asof_at"][1]

ORACLES = {
    "graph_neighbors": f"SELECT DISTINCT id, src, relation, dst FROM edges WHERE src = '{HUB}' OR dst = '{HUB}'",
    "graph_neighbors_in": f"SELECT DISTINCT id, src FROM edges WHERE dst = '{HUB}' AND relation = 'links_to'",
    "khop_nodes": _khop_sql(2, "out"),
    "khop_edges": _khop_sql(2, "both", select="SELECT DISTINCT id FROM (SELECT id FROM e1 UNION SELECT id FROM e2)"),
    "khop_relation": _khop_sql(3, "out", relation="links_to"),
    "subgraph_search": _khop_sql(
        1,
        "both",
        """v AS (SELECT node_id, max(vector) AS v FROM node_vectors WHERE len(vector) = 64 GROUP BY node_id),
s AS (SELECT node_id, CAST(v AS DOUBLE[]) AS v FROM v WHERE len(list_filter(v, lambda x: NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
q AS (SELECT v AS qv FROM s ORDER BY node_id LIMIT 1),
seeds AS (SELECT node_id AS id, round(list_cosine_similarity(qv, v), 6) AS score FROM s, q ORDER BY score DESC, id LIMIT 5)""",
        select="SELECT h1.id, CAST(hop AS INTEGER) AS hop, score FROM h1 LEFT JOIN seeds ON seeds.id = h1.id",
    ),
    "graph_triplets": """
WITH n AS (SELECT id, any_value(json_extract_string(properties, '$.tier')) AS tier FROM nodes GROUP BY id),
e AS (SELECT id, any_value(src) AS src, any_value(dst) AS dst, any_value(relation) AS relation, any_value(json_extract_string(properties, '$.tier')) AS tier FROM edges WHERE relation = 'cites' GROUP BY id)
SELECT e.id AS edge_id, src AS source, relation, dst AS target FROM e JOIN n a ON a.id = src JOIN n b ON b.id = dst WHERE e.tier = 'gold' OR a.tier = 'gold' OR b.tier = 'gold'""",
    "graph_triplets_entity": f"""
SELECT DISTINCT e.id AS edge_id, src AS source, relation, dst AS target FROM edges e
WHERE (src = '{HUB}' OR dst = '{HUB}') AND src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes)""",
    "relation_map": """
WITH w AS (SELECT DISTINCT id, src, relation, dst FROM edges WHERE src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes)),
a AS (SELECT *, 0 AS depth FROM w WHERE src = 'nod-00009e37' OR dst = 'nod-00009e37'),
b AS (SELECT *, 1 AS depth FROM w WHERE src IN (SELECT dst FROM a) OR dst IN (SELECT dst FROM a)),
m AS (SELECT id, src, relation, dst, CAST(min(depth) AS INTEGER) AS depth FROM (SELECT * FROM a UNION ALL SELECT * FROM b) WHERE relation <> 'cites' GROUP BY ALL)
SELECT id AS edge_id, src AS source, relation, dst AS target, depth FROM m ORDER BY depth, id LIMIT 30""",
    "nodes_by_property": "SELECT DISTINCT id FROM nodes WHERE json_extract_string(properties, '$.tier') = 'gold' OR json_extract_string(properties, '$.owner') = 'team-violet'",
    "graph_stats": "SELECT (SELECT count(DISTINCT id) FROM nodes) AS nodes, (SELECT count(DISTINCT id) FROM edges) AS edges",
    "dangling_edges": "SELECT DISTINCT id FROM edges WHERE src IS NULL OR dst IS NULL OR src NOT IN (SELECT id FROM nodes) OR dst NOT IN (SELECT id FROM nodes)",
    "remove_nodes": "WITH c AS (SELECT id FROM nodes WHERE type = 'concept') SELECT DISTINCT id FROM edges e WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.id = e.src OR c.id = e.dst)",
    "upsert_nodes": """
WITH n AS (SELECT id, min(struct_pack(type := type, label := label, properties := properties)) AS n FROM nodes GROUP BY id)
SELECT id, CASE WHEN length(n.label) % 2 = 0 THEN upper(n.label) ELSE n.label END AS label FROM n""",
    "distance_rerank": _khop_sql(
        2,
        "both",
        f"seeds AS (SELECT '{HUB}' AS id)",
        select="""SELECT p.id, CAST(row_number() OVER (ORDER BY hop NULLS LAST, p.id) AS INTEGER) AS rank, CAST(hop AS INTEGER) AS hops
FROM (SELECT DISTINCT id FROM nodes) p LEFT JOIN h2 ON h2.id = p.id""",
    ),
    "mention_rerank": """
WITH c AS (SELECT json_extract_string(properties, '$.entity_id') AS id, count(DISTINCT id) AS mentions FROM episodes GROUP BY 1),
e AS (SELECT id, min(type) AS query_id FROM entities GROUP BY id)
SELECT query_id, e.id, coalesce(mentions, 0) AS mentions, CAST(row_number() OVER (PARTITION BY query_id ORDER BY coalesce(mentions, 0) DESC, e.id) AS INTEGER) AS rank FROM e LEFT JOIN c ON c.id = e.id""",
    **{name: f"SELECT DISTINCT id FROM facts WHERE {sql}" for name, (_, sql) in FRAMES.items()},
    "entities_as_of": f"SELECT DISTINCT id, created_at FROM entities WHERE type = 'team' AND {_AT}",
    "fact_history": "SELECT DISTINCT id, created_at FROM facts WHERE src = 'ent-00009e37' OR dst = 'ent-00009e37'",
    "facts_of_episode": """
WITH l AS (SELECT DISTINCT id, i, episodes[i] AS episode_id FROM (SELECT id, episodes, unnest(range(1, len(episodes) + 1)) AS i FROM facts))
SELECT episode_id, count(DISTINCT id) AS facts, count(*) FILTER (WHERE i = 1) AS owned FROM l WHERE episode_id IS NOT NULL GROUP BY episode_id""",
    "reference_times": """
WITH l AS (SELECT DISTINCT id, unnest(episodes) AS episode_id FROM facts)
SELECT l.id, min(occurred_at) AS reference_time FROM l JOIN episodes e ON e.id = l.episode_id GROUP BY l.id""",
    "temporal_khop": _khop_sql(
        2,
        "out",
        f"""live AS (SELECT DISTINCT id FROM entities WHERE {_AT} AND (type IS NULL OR type <> 'team' OR id LIKE 'ent-hub%')),
f AS (SELECT * FROM facts WHERE {_AT} AND src IN (SELECT id FROM live) AND dst IN (SELECT id FROM live)),
seeds AS (SELECT id FROM live WHERE id IN ('ent-00009e37', 'ent-hub-lumenpost'))""",
        "f",
    ),
    "temporal_subgraph": f"""
WITH live AS (SELECT DISTINCT id FROM entities WHERE {_AT}),
f AS (SELECT DISTINCT id, src, dst, relation FROM facts WHERE {_AT} AND src IN (SELECT id FROM live) AND dst IN (SELECT id FROM live)),
s AS (SELECT DISTINCT id, src, dst FROM f WHERE relation = 'located_in'),
h0 AS (SELECT src AS id, 0 AS hop FROM s UNION SELECT dst, 0 FROM s),
e1 AS (SELECT * FROM f WHERE src IN (SELECT id FROM h0) OR dst IN (SELECT id FROM h0)),
h1 AS (SELECT * FROM h0 UNION ALL SELECT DISTINCT id, 1 FROM (SELECT src AS id FROM e1 UNION SELECT dst FROM e1) WHERE id NOT IN (SELECT id FROM h0))
SELECT id, CAST(hop AS INTEGER) AS hop, CAST(NULL AS DOUBLE) AS score FROM h1 UNION ALL SELECT DISTINCT 'fact:' || id, CAST(NULL AS INTEGER), CAST(1.0 AS DOUBLE) FROM s""",
    "temporal_dangling": """
SELECT DISTINCT id, 'entity' AS reason FROM facts WHERE (src IS NOT NULL AND src NOT IN (SELECT id FROM entities)) OR (dst IS NOT NULL AND dst NOT IN (SELECT id FROM entities))
UNION SELECT id, 'episode' FROM (SELECT id, unnest(episodes) AS e FROM facts) WHERE e IS NOT NULL AND e NOT IN (SELECT id FROM episodes)""",
    "supersede_history": """
WITH n AS (SELECT event_id, row_number() OVER w AS n, lead(event_id) OVER w AS nxt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT 'e' || event_id AS id, CAST(event_id AS BIGINT) AS valid_at, CASE WHEN n % 2 = 1 THEN CAST(nxt AS BIGINT) END AS invalid_at, CAST(CASE WHEN n % 2 = 1 THEN 1000000 ELSE 2000000 END AS BIGINT) AS created_at,
  CASE WHEN n % 2 = 1 AND nxt IS NOT NULL THEN CAST(2000000 AS BIGINT) END AS expired_at FROM n""",
    "invalidate_facts": f"""
SELECT DISTINCT id, created_at, CASE WHEN length(relation) % 3 = 0 AND expired_at IS NULL THEN {T0} ELSE invalid_at END AS invalid_at,
  CASE WHEN length(relation) % 3 = 0 AND expired_at IS NULL THEN {T0 + 1} ELSE expired_at END AS expired_at FROM facts""",
    "temporal_stats": "SELECT (SELECT count(DISTINCT id) FROM entities) AS entities, (SELECT count(DISTINCT id) FROM facts) AS facts, CAST(0 AS BIGINT) AS indexed_documents",
    "ingest_batch": """
SELECT DISTINCT id, relation FROM edges
UNION SELECT src || ':cited:' || dst, 'cited' FROM edges WHERE relation = 'cites' AND src IS NOT NULL AND dst IS NOT NULL""",
    "facts_by_episode": """
WITH l AS (SELECT DISTINCT id, unnest(episodes) AS e FROM facts), m AS (SELECT e FROM l WHERE e IS NOT NULL GROUP BY e ORDER BY count(DISTINCT id) DESC, e LIMIT 1)
SELECT DISTINCT id, created_at FROM facts WHERE list_contains(episodes, (SELECT e FROM m))""",
    "remove_episode": """
WITH f AS (SELECT DISTINCT id, episodes FROM facts), g AS (SELECT min(episodes[1]) AS gone FROM f)
SELECT DISTINCT id, CAST(len(list_filter(episodes, lambda x: x <> gone)) AS INTEGER) AS sources FROM f, g WHERE episodes[1] IS NULL OR episodes[1] <> gone""",
    "property_lineage": """
WITH e AS (SELECT id, created_at, min(struct_pack(type := type, label := label, properties := properties, valid_at := valid_at)) AS e FROM entities GROUP BY id, created_at),
r AS (SELECT id, e.properties AS p, lag(e.properties) OVER w AS o, e.valid_at AS valid_at, row_number() OVER w AS n FROM e WINDOW w AS (PARTITION BY id ORDER BY created_at)),
k AS (SELECT id, valid_at, n, o, p, unnest(list_distinct(list_concat(coalesce(json_keys(o), []), coalesce(json_keys(p), [])))) AS key FROM r),
v AS (SELECT id, valid_at, n, key, json_extract_string(o, '$."' || key || '"') AS ov, json_extract_string(p, '$."' || key || '"') AS nv FROM k),
c AS (SELECT * FROM v WHERE ov IS DISTINCT FROM nv),
l AS (SELECT id, key, nv, valid_at, 1000 * n AS made, 1000 * lead(n) OVER w AS next_at, lead(valid_at) OVER w AS next_valid FROM c WINDOW w AS (PARTITION BY id, key ORDER BY n))
SELECT id AS entity_id, key AS property_key, nv AS value, valid_at, CASE WHEN next_at IS NOT NULL THEN coalesce(next_valid, next_at) END AS invalid_at, CAST(made AS BIGINT) AS created_at,
  CAST(next_at AS BIGINT) AS expired_at FROM l WHERE nv IS NOT NULL""",
    "encoded_times": """
SELECT DISTINCT id, CASE WHEN valid_at IS NULL THEN 'a' ELSE 'b' || lpad(CAST(CAST(valid_at AS HUGEINT) + 9223372036854775808 AS VARCHAR), 20, '0') END AS since,
  CASE WHEN invalid_at IS NULL THEN 'c' ELSE 'b' || lpad(CAST(CAST(invalid_at AS HUGEINT) + 9223372036854775808 AS VARCHAR), 20, '0') END AS until FROM facts""",
    "log_fold": """
SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1 AND event_type <> 'error'""",
    "log_changes": """
SELECT kind, count(*) AS changes, count(DISTINCT user_id) AS documents FROM (
  SELECT user_id, CASE event_type WHEN 'purchase' THEN 'set' WHEN 'error' THEN 'delete' WHEN 'view' THEN 'patch' WHEN 'click' THEN 'patch' END AS kind FROM events) WHERE kind IS NOT NULL GROUP BY kind""",
}
_FOLD = """
WITH l AS (SELECT user_id, max(event_id) AS last_lsn, max_by(event_type, event_id) AS kind FROM events WHERE event_type IN ('purchase', 'error') GROUP BY user_id),
s AS (SELECT user_id, last_lsn FROM l WHERE kind = 'purchase'),
t AS (SELECT s.user_id, max(event_id) AS t FROM s JOIN events e ON e.user_id = s.user_id AND event_type = 'view' AND event_id > last_lsn GROUP BY 1),
m AS (SELECT s.user_id, max(event_id) AS m FROM s JOIN events e ON e.user_id = s.user_id AND event_type = 'click' AND event_id > last_lsn GROUP BY 1)
SELECT 'u' || s.user_id AS document_id, CAST(coalesce(m, last_lsn) AS VARCHAR) AS "at", CAST(coalesce(t, last_lsn) AS VARCHAR) AS "text" FROM s LEFT JOIN t USING (user_id) LEFT JOIN m USING (user_id)"""
ORACLES |= {
    "log_fold_partial": _FOLD,
    "fold_in_two_steps": _FOLD,
    "inventory_diff": """
SELECT c_name AS artifact, CASE WHEN c_custkey % 11 = 0 THEN 'added' WHEN c_custkey % 7 = 0 THEN 'removed' ELSE 'changed' END AS change FROM customer
WHERE NOT (c_custkey % 11 = 0 AND c_custkey % 7 = 0) AND (c_custkey % 11 = 0 OR c_custkey % 7 = 0 OR c_custkey % 5 = 0)""",
    "sync_states": """
WITH s AS (SELECT c_custkey AS k, c_custkey % 13 <> 0 AS hl, c_custkey % 11 <> 0 AS hb, c_custkey % 7 <> 0 AS hr, 5 + c_custkey % 3 AS gl,
  5 + CASE WHEN c_custkey % 17 = 0 THEN 4 ELSE 0 END AS gb, 5 + c_custkey % 4 AS gr, c_custkey % 2 AS l, (c_custkey // 2) % 3 AS r FROM customer)
SELECT k AS c_custkey, CASE WHEN NOT hl AND NOT hr THEN 'in_sync' WHEN hb AND ((hl AND gl < gb) OR (hr AND gr < gb)) THEN 'unknown' WHEN NOT hr THEN 'local_ahead' WHEN NOT hl THEN 'remote_ahead'
  WHEN l = r THEN 'in_sync' WHEN NOT hb THEN 'unknown' WHEN l <> 0 AND r = 0 THEN 'local_ahead' WHEN l = 0 AND r <> 0 THEN 'remote_ahead' ELSE 'diverged' END AS state FROM s""",
}

QUERIES = {
    **{name: _frame_query(frame) for name, (frame, _) in FRAMES.items()},
    **{
        f.__name__: f
        for f in (
            graph_neighbors, graph_neighbors_in, khop_nodes, khop_edges, khop_relation, subgraph_search, graph_triplets, graph_triplets_entity, relation_map, nodes_by_property, graph_stats,
            dangling_edges, remove_nodes, upsert_nodes, distance_rerank, mention_rerank, entities_as_of, fact_history, facts_of_episode, reference_times, temporal_khop, temporal_subgraph,
            temporal_dangling, supersede_history, invalidate_facts, temporal_stats, ingest_batch, facts_by_episode, remove_episode, property_lineage, encoded_times, log_fold, log_changes, log_fold_partial, fold_in_two_steps, inventory_diff, sync_states,
        )
    },
}
