"""Bi-temporal graph tables: episodes, entities, facts, property versions.

Mutations take the current tables and a batch and return the new tables; a batch
is checked as a whole before anything is applied. All times are epoch ms.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import AsOf
from . import graph

EPISODE = "id string, source string, body string, occurred_at bigint, created_at bigint, properties string"
ENTITY = "id string, type string, label string, properties string, valid_at bigint, invalid_at bigint, created_at bigint, expired_at bigint"
FACT = "id string, src string, relation string, dst string, fact string, properties string, episodes array<string>, valid_at bigint, invalid_at bigint, created_at bigint, expired_at bigint, reference_time bigint"
MENTION = "episode_id string, entity_id string"
VERSION = "entity_id string, property_key string, value string, episode_id string, valid_at bigint, invalid_at bigint, created_at bigint, expired_at bigint"


class GraphError(ValueError):
    """A batch that must not be applied."""


@dataclass(frozen=True)
class TemporalTables:
    episodes: DataFrame
    entities: DataFrame
    facts: DataFrame
    mentions: DataFrame
    versions: DataFrame

    @classmethod
    def empty(cls, spark) -> TemporalTables:
        return cls(*[spark.createDataFrame([], s) for s in (EPISODE, ENTITY, FACT, MENTION, VERSION)])


def _refuse(bad: DataFrame, why: str) -> None:
    rows = bad.limit(3).collect()
    if rows:
        raise GraphError(f"{why}: {[tuple(r) for r in rows]}")


def _blank(*columns: str):
    tests = [F.coalesce(F.trim(c) == "", F.lit(True)) for c in columns]
    found = tests[0]
    for t in tests[1:]:
        found = found | t
    return found


# --- reads


def entities_as_of(entities: DataFrame, frame: AsOf, type: str | None = None, ordered: bool = False) -> DataFrame:
    """Entities under a frame, in no order unless ``ordered`` by id and created_at."""
    kept = entities.filter(frame.predicate())
    kept = kept.filter(F.col("type") == type) if type is not None else kept
    return kept.orderBy("id", "created_at") if ordered else kept


def facts_as_of(facts: DataFrame, frame: AsOf, node: str | None = None, direction: str = "both", relation: str | None = None) -> DataFrame:
    """Facts under a frame, of one entity if given."""
    kept = facts.filter(frame.predicate())
    if node is not None:
        return graph.neighbors(kept, node, direction, relation)
    return kept.filter(F.col("relation") == relation) if relation is not None else kept


def k_hop(entities: DataFrame, facts: DataFrame, seeds: DataFrame, k: int, frame: AsOf, direction: str = "both", relation: str | None = None, gate=None) -> graph.Subgraph:
    """k hops over facts that match the frame, between entities that do and pass ``gate`` (a Column); seeds must too."""
    live = entities.filter(frame.predicate())
    if gate is not None:
        live = live.filter(gate)
    return graph.k_hop(facts.filter(frame.predicate()), seeds, k, direction, relation, node_gate=live)


def search_subgraph(entities: DataFrame, facts: DataFrame, k: int, frame: AsOf, entity_seeds: DataFrame | None = None, fact_seeds: DataFrame | None = None, gate=None, **options) -> graph.Subgraph:
    """Expands ranked entity seeds (id, score) and fact seeds (id, score; both ends must be allowed, reported as ``fact:<id>``)."""
    live = entities.filter(frame.predicate())
    live = (live.filter(gate) if gate is not None else live).select("id").distinct()
    starts, scored = [], []
    if entity_seeds is not None:
        ok = entity_seeds.join(live, "id", "left_semi")
        starts.append(ok.select("id"))
        scored.append(ok.select("id", "score"))
    if fact_seeds is not None:
        ok = (
            facts.filter(frame.predicate()).join(fact_seeds.select("id", "score"), "id")
            .join(live.withColumnRenamed("id", "src"), "src", "left_semi").join(live.withColumnRenamed("id", "dst"), "dst", "left_semi")
        )
        starts.append(ok.select(F.explode(F.array("src", "dst")).alias("id")))
        scored.append(ok.select(F.concat(F.lit("fact:"), "id").alias("id"), "score"))
    if not starts:
        raise GraphError("no seeds")
    start, seeds = starts[0], scored[0]
    for a, b in zip(starts[1:], scored[1:]):
        start, seeds = start.unionByName(a), seeds.unionByName(b)
    grown = k_hop(entities, facts, start.distinct(), k, frame, gate=gate, **options)
    return graph.Subgraph(grown.nodes, grown.edges, seeds)


def history(facts: DataFrame, entity: str) -> DataFrame:
    """All facts that touch an entity, by created_at and id."""
    return graph.neighbors(facts, entity).orderBy("created_at", "id")


def facts_by_episode(facts: DataFrame, episode: str) -> DataFrame:
    return facts.filter(F.array_contains("episodes", episode)).orderBy("created_at", "id")


def provenance(facts: DataFrame) -> DataFrame:
    """episode_id, id, place: every link of a fact to an episode, once; place 0 is the fact's first source."""
    return facts.select("id", F.posexplode("episodes").alias("place", "episode_id")).filter("episode_id is not null").distinct()


def mention_counts(mentions: DataFrame) -> DataFrame:
    """entity_id, mentions: number of distinct episodes."""
    return mentions.distinct().groupBy("entity_id").agg(F.count(F.lit(1)).alias("mentions"))


def property_history(versions: DataFrame, entity: str, key: str | None = None) -> DataFrame:
    kept = versions.filter(F.col("entity_id") == entity)
    return (kept.filter(F.col("property_key") == key) if key else kept).orderBy("property_key", "created_at")


def reference_times(facts: DataFrame, episodes: DataFrame) -> DataFrame:
    """id, reference_time: the earliest occurred_at of a fact's episodes."""
    links = facts.select("id", F.explode("episodes").alias("episode_id"))
    times = episodes.select(F.col("id").alias("episode_id"), "occurred_at")
    return links.join(times, "episode_id").groupBy("id").agg(F.min("occurred_at").alias("reference_time"))


def dangling(tables: TemporalTables) -> DataFrame:
    """Facts whose ends or episodes are missing: id, reason. A null end or episode is none, the others of its fact count."""
    ids = tables.entities.select("id").distinct()
    ends = tables.facts.select("id", F.explode(F.array("src", "dst")).alias("end")).filter("end is not null")
    lost = ends.join(ids.withColumnRenamed("id", "end"), "end", "left_anti").select("id", F.lit("entity").alias("reason"))
    links = tables.facts.select("id", F.explode("episodes").alias("e")).filter("e is not null")
    unknown = links.join(tables.episodes.select(F.col("id").alias("e")), "e", "left_anti").select("id", F.lit("episode").alias("reason"))
    return lost.unionByName(unknown).distinct()


# --- writes


def add_episodes(tables: TemporalTables, batch: DataFrame, mentions: DataFrame | None = None) -> TemporalTables:
    """Adds episodes; an identical one again is no change.

    A different one under a known id, or two different ones of an id in the
    batch, are refused, as are mentions of unknown entities. created_at may differ: the earliest counts.
    """
    payload = [c for c in tables.episodes.columns if c != "created_at"]
    _refuse(batch.select(*payload).distinct().groupBy("id").count().filter("count > 1").select("id"), "episodes of one id differ in the batch")
    known = tables.episodes.select("id", F.struct(*payload).alias("old"))
    _refuse(batch.join(known, "id").filter(~F.struct(*payload).eqNullSafe(F.col("old"))).select("id"), "episodes exist with other content")
    fresh = batch.groupBy(*payload).agg(F.min("created_at").alias("created_at")).join(known, "id", "left_anti").select(*tables.episodes.columns)
    linked = tables.mentions
    if mentions is not None:
        _refuse(mentions.join(tables.entities.select(F.col("id").alias("entity_id")), "entity_id", "left_anti"), "mentions of unknown entities")
        linked = linked.unionByName(mentions.select(*linked.columns)).distinct()
    return replace(tables, episodes=tables.episodes.unionByName(fresh), mentions=linked)


def upsert_entities(tables: TemporalTables, batch: DataFrame, now: int, sources: DataFrame | None = None) -> TemporalTables:
    """Inserts or replaces entities (id, type, label, properties, valid_at, invalid_at) and keeps the lineage of their properties.

    The first created_at stays and expired_at becomes open. A property whose
    JSON value is unchanged keeps its version; changed and removed ones are
    closed, changed and new ones begin a version. ``sources`` (entity_id,
    property_key, episode_id) name where properties come from and must exist.
    """
    _refuse(batch.groupBy("id").count().filter("count > 1"), "entities repeated in a batch")
    _refuse(batch.filter(_blank("id")).select("id"), "blank ids")
    old = tables.entities.select("id", F.col("properties").alias("old_properties"), F.col("created_at").alias("old_created"))
    joined = batch.join(old, "id", "left")
    as_map = lambda c: F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))
    pairs = (
        joined.select("id", "valid_at", as_map(F.col("old_properties")).alias("o"), as_map(F.col("properties")).alias("n"))
        .select("id", "valid_at", "o", "n", F.explode(F.array_distinct(F.concat(F.map_keys("o"), F.map_keys("n")))).alias("property_key"))
        .select("id", "valid_at", "property_key", F.try_element_at("o", "property_key").alias("ov"), F.try_element_at("n", "property_key").alias("nv"))
    )
    changed = pairs.filter(~F.col("ov").eqNullSafe(F.col("nv")))
    if sources is not None:
        has = pairs.filter(F.col("nv").isNotNull()).select(F.col("id").alias("entity_id"), "property_key")
        _refuse(sources.join(has, ["entity_id", "property_key"], "left_anti"), "sources of missing properties")
    closing = changed.select(F.col("id").alias("entity_id"), "property_key", F.coalesce("valid_at", F.lit(now)).alias("__end"))
    closed = (
        tables.versions.join(closing, ["entity_id", "property_key"], "left")
        .withColumn("__now", F.col("__end").isNotNull() & F.col("expired_at").isNull())
        .withColumn("invalid_at", F.when(F.col("__now"), F.col("__end")).otherwise(F.col("invalid_at")))
        .withColumn("expired_at", F.when(F.col("__now"), F.lit(now)).otherwise(F.col("expired_at")))
        .select(*tables.versions.columns)
    )
    fresh = changed.filter(F.col("nv").isNotNull()).select(F.col("id").alias("entity_id"), "property_key", F.col("nv").alias("value"), "valid_at")
    fresh = fresh.join(sources, ["entity_id", "property_key"], "left") if sources is not None else fresh.withColumn("episode_id", F.lit(None).cast("string"))
    fresh = fresh.withColumns({"invalid_at": F.lit(None).cast("bigint"), "created_at": F.lit(now).cast("bigint"), "expired_at": F.lit(None).cast("bigint")})
    rows = joined.withColumn("created_at", F.coalesce("old_created", F.lit(now))).withColumn("expired_at", F.lit(None).cast("bigint"))
    return replace(tables, entities=graph.upsert(tables.entities, rows.select(*tables.entities.columns)), versions=closed.unionByName(fresh.select(*tables.versions.columns)))


def lineage(history: DataFrame, order: str = "created_at", step: int = 1000) -> DataFrame:
    """All property versions of recorded entity versions (id, ``order``, properties, valid_at), each time one per entity.

    The result is that of ``upsert_entities`` called for the first versions of
    all entities at ``step``, for the second ones at 2 x ``step`` and so on.
    """
    as_map = lambda c: F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))
    entity = Window.partitionBy("id").orderBy(order)
    placed = history.select(
        "id", "valid_at", as_map(F.lag("properties").over(entity)).alias("o"), as_map(F.col("properties")).alias("n"), (F.row_number().over(entity) * F.lit(step).cast("bigint")).alias("created_at")
    )
    pairs = (
        placed.select("id", "valid_at", "created_at", "o", "n", F.explode(F.array_distinct(F.concat(F.map_keys("o"), F.map_keys("n")))).alias("property_key"))
        .withColumns({"ov": F.try_element_at("o", "property_key"), "value": F.try_element_at("n", "property_key")})
    )
    changes = Window.partitionBy("id", "property_key").orderBy("created_at")
    ended = (
        pairs.filter(~F.col("ov").eqNullSafe(F.col("value")))
        .withColumn("expired_at", F.lead("created_at").over(changes))
        .withColumn("invalid_at", F.when(F.col("expired_at").isNotNull(), F.coalesce(F.lead("valid_at").over(changes), "expired_at")))
    )
    rows = ended.filter(F.col("value").isNotNull()).withColumnRenamed("id", "entity_id").withColumn("episode_id", F.lit(None).cast("string"))
    return rows.select("entity_id", "property_key", "value", "episode_id", "valid_at", "invalid_at", "created_at", "expired_at")


def add_facts(tables: TemporalTables, batch: DataFrame, now: int) -> TemporalTables:
    """Adds facts (id, src, relation, dst, fact, properties, episodes, valid_at, invalidates) and closes the facts they supersede.

    Ends and episodes must exist; a superseded fact must exist and not be
    expired. It ends at the new fact's valid_at, else its reference time, else
    now, and expires now; a superseding fact without valid_at takes that time.
    A fact that is there with the same content is no change, with other content
    an error. The batch is refused as a whole.
    """
    _refuse(batch.filter(_blank("id", "src", "relation", "dst")).select("id"), "blank fields")
    _refuse(batch.groupBy("id").count().filter("count > 1"), "facts repeated in a batch")
    _refuse(batch.select(F.explode(F.array("src", "dst")).alias("id")).join(tables.entities, "id", "left_anti"), "unknown ends")
    _refuse(batch.select(F.explode("episodes").alias("id")).join(tables.episodes, "id", "left_anti"), "unknown episodes")
    batch = batch.join(reference_times(batch, tables.episodes), "id", "left")
    supersedes = F.coalesce(F.size("invalidates"), F.lit(0)) > 0
    batch = batch.withColumn("valid_at", F.when(F.col("valid_at").isNull() & supersedes, F.coalesce("reference_time", F.lit(now))).otherwise(F.col("valid_at")))
    content = ["src", "relation", "dst", "fact", "properties", "episodes", "valid_at", "reference_time"]
    known = tables.facts.select("id", F.struct(*content).alias("old"))
    again = batch.join(known, "id")
    _refuse(again.filter(~F.struct(*content).eqNullSafe(F.col("old"))).select("id"), "facts exist with other content")
    fresh = batch.join(known, "id", "left_anti")
    closing = fresh.select(F.explode("invalidates").alias("id"), F.coalesce("valid_at", "reference_time", F.lit(now)).alias("__end"))
    _refuse(closing.join(tables.facts.filter("expired_at is null"), "id", "left_anti").select("id"), "superseded facts that are unknown or expired")
    ends = closing.groupBy("id").agg(F.min("__end").alias("__end"))
    closed = (
        tables.facts.join(ends, "id", "left")
        .withColumn("invalid_at", F.coalesce("__end", "invalid_at"))
        .withColumn("expired_at", F.when(F.col("__end").isNotNull(), F.lit(now)).otherwise(F.col("expired_at")))
        .select(*tables.facts.columns)
    )
    rows = fresh.withColumns({"invalid_at": F.lit(None).cast("bigint"), "created_at": F.lit(now).cast("bigint"), "expired_at": F.lit(None).cast("bigint")})
    return replace(tables, facts=closed.unionByName(rows.select(*tables.facts.columns)))


def invalidate_facts(tables: TemporalTables, ids: DataFrame, now: int) -> TemporalTables:
    """Closes facts (id, invalid_at; may stay open) that are not expired yet."""
    ends = ids.select("id", F.col("invalid_at").alias("__end"), F.lit(True).alias("__hit"))
    hit = F.col("__hit") & F.col("expired_at").isNull()
    facts = (
        tables.facts.join(ends, "id", "left")
        .withColumn("__do", F.coalesce(hit, F.lit(False)))
        .withColumn("invalid_at", F.when(F.col("__do"), F.col("__end")).otherwise(F.col("invalid_at")))
        .withColumn("expired_at", F.when(F.col("__do"), F.lit(now)).otherwise(F.col("expired_at")))
    )
    return replace(tables, facts=facts.select(*tables.facts.columns))


def changed_by(tables: TemporalTables, ids: DataFrame) -> DataFrame:
    """Of the facts to be invalidated (id) those that will change: known and not expired yet."""
    return tables.facts.filter("expired_at is null").select("id").distinct().join(ids.select("id"), "id", "left_semi")


def stats(tables: TemporalTables, index: DataFrame | None = None) -> DataFrame:
    """entities, facts (distinct ids), indexed_documents."""
    ids = lambda df, name: df.agg(F.countDistinct("id").alias(name))
    units = index.agg(F.count(F.lit(1)).alias("indexed_documents")) if index is not None else tables.entities.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("indexed_documents"))
    return ids(tables.entities, "entities").crossJoin(ids(tables.facts, "facts")).crossJoin(units)


def remove_episode(tables: TemporalTables, episode: str) -> TemporalTables:
    """Removes an episode, the facts it is the first source of, and its link from the others."""
    first = F.coalesce(F.try_element_at("episodes", F.lit(1)) == episode, F.lit(False))
    facts = tables.facts.filter(~first).withColumn("episodes", F.array_remove("episodes", episode))
    return replace(
        tables, facts=facts, episodes=tables.episodes.filter(F.col("id") != episode), mentions=tables.mentions.filter(F.col("episode_id") != episode)
    )


def remove_entity(tables: TemporalTables, entity: str) -> TemporalTables:
    """Removes an entity with its facts, mentions and property versions."""
    touches = F.coalesce((F.col("src") == entity) | (F.col("dst") == entity), F.lit(False))
    return replace(
        tables,
        entities=tables.entities.filter(F.col("id") != entity),
        facts=tables.facts.filter(~touches),
        mentions=tables.mentions.filter(F.col("entity_id") != entity),
        versions=tables.versions.filter(F.col("entity_id") != entity),
    )


def remove_fact(tables: TemporalTables, fact: str) -> TemporalTables:
    return replace(tables, facts=tables.facts.filter(F.col("id") != fact))


def current_versions(versions: DataFrame) -> DataFrame:
    """The live version of every property: the latest that has not expired."""
    latest = Window.partitionBy("entity_id", "property_key").orderBy(F.desc("created_at"))
    return versions.filter("expired_at is null").withColumn("__rn", F.row_number().over(latest)).filter("__rn = 1").drop("__rn")
