"""Attributes as known at event time.

Every event is matched to the entity version that was valid, and on record, at
the event's time. Events and versions of one entity are merged in time order;
hot entities are cut into time shards, each of which starts with the earlier
versions that can still win inside it (the carry-in: those that end there and
the best that outlasts it), so shards are merged independently and no
correctness is lost at their borders.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import sharding
from .sharding import CUTS, SHARD

LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sweeps rows sorted by key, shard, time and kind; emits the events with their version."""
    place, heap = None, []
    for batch in batches:
        names = batch.schema.names
        columns = [batch.column(names.index(c)).to_pylist() for c in ("__key", SHARD, "__at", "__kind", "__valid", "__created", "__end")]
        rows, valid_of, created_of = [], [], []
        for i, (key, shard, at, kind, valid, created, end) in enumerate(zip(*columns)):
            if place != (key, shard):
                place, heap = (key, shard), []
            if kind == 0:
                heapq.heappush(heap, (-valid, -created, -end))
                continue
            while heap and -heap[0][2] <= at:
                heapq.heappop(heap)
            rows.append(i)
            valid_of.append(-heap[0][0] if heap else None)
            created_of.append(-heap[0][1] if heap else None)
        kept = batch.take(pa.array(rows, pa.int64()))
        events = [c for c in names if c.startswith("e_")]
        yield pa.RecordBatch.from_arrays(
            [kept.column(names.index(c)) for c in events] + [pa.array(valid_of, pa.int64()), pa.array(created_of, pa.int64())],
            names=[*events, "__valid", "__created"],
        )


def asof_versions(
    events: DataFrame,
    versions: DataFrame,
    event_key: str,
    event_time: str,
    version_key: str = "id",
    rows_per_shard: int = sharding.ROWS_PER_SHARD,
) -> DataFrame:
    """Adds ``version_valid_at`` and ``version_created_at`` to every event.

    ``versions`` has the key and valid_at, invalid_at, created_at, expired_at
    (epoch ms). At time t a version counts if created_at <= t, valid_at is null
    or <= t, and invalid_at is null or > t or was not yet on record
    (expired_at > t). The latest valid_at (null earliest), then the latest
    created_at wins. Both columns are null for events without such a version,
    without key or without time; a version's own valid_at may be null as well,
    so test ``version_created_at``. Versions without key or created_at never
    match. Repeated rows on either side are kept (events) or harmless
    (versions). Any further columns of the events are carried along.
    """
    names = events.columns
    e = events.select(
        F.col(f"`{event_key}`").cast("string").alias("__key"),
        F.col(f"`{event_time}`").cast("bigint").alias("__at"),
        *[F.col(f"`{c}`").alias(f"e_{i}") for i, c in enumerate(names)],
    )
    matchable = F.col("__key").isNotNull() & F.col("__at").isNotNull()
    v = (
        versions.filter(F.col(version_key).isNotNull() & F.col("created_at").isNotNull())
        .select(
            F.col(version_key).alias("__key"),
            F.greatest(F.col("created_at"), F.coalesce("valid_at", F.lit(LOWEST))).alias("__at"),
            F.greatest(F.coalesce("valid_at", F.lit(LOWEST + 1)), F.lit(LOWEST + 1)).alias("__valid"),
            F.greatest(F.col("created_at"), F.lit(LOWEST + 1)).alias("__created"),
            F.when(F.col("invalid_at").isNull(), F.lit(HIGHEST))
            .otherwise(F.greatest(F.col("invalid_at"), F.coalesce("expired_at", F.lit(LOWEST + 1))))
            .alias("__end"),
        )
        .filter(F.col("__end") > F.col("__at"))
        .distinct()
    )
    hit = e.filter(matchable)
    keys = ["__key"]
    cuts = sharding.hot_key_cuts(v.select("__key", "__at").unionByName(hit.select("__key", "__at")), keys, "__at", rows_per_shard)
    v = sharding.with_shard(v, cuts, keys, "__at")
    hit = sharding.with_shard(hit, cuts, keys, "__at", sharding.row_salt(hit))
    if cuts is not None:
        v = v.unionByName(_carry_in(v, cuts, keys))

    lacking = [F.lit(None).cast(f.dataType).alias(f.name) for f in e.schema.fields if f.name.startswith("e_")]
    both = v.select("__key", SHARD, "__at", F.lit(0).alias("__kind"), "__valid", "__created", "__end", *lacking).unionByName(
        hit.select(
            "__key", SHARD, "__at", F.lit(1).alias("__kind"), *[F.lit(0).cast("bigint").alias(c) for c in ("__valid", "__created", "__end")], *[c for c in hit.columns if c.startswith("e_")]
        )
    )
    out = T.StructType(
        [T.StructField(f.name, f.dataType, True) for f in e.schema.fields if f.name.startswith("e_")]
        + [T.StructField("__valid", T.LongType()), T.StructField("__created", T.LongType())]
    )
    merged = both.repartition("__key", SHARD).sortWithinPartitions("__key", SHARD, "__at", "__kind").mapInArrow(_merge, out)
    rest = e.filter(~matchable).select(
        *[c for c in e.columns if c.startswith("e_")], *[F.lit(None).cast("bigint").alias(c) for c in ("__valid", "__created")]
    )
    return merged.unionByName(rest).select(
        *[F.col(f"e_{i}").alias(c) for i, c in enumerate(names)],
        F.when(F.col("__valid") > LOWEST + 1, F.col("__valid")).alias("version_valid_at"),
        F.col("__created").alias("version_created_at"),
    )


def _carry_in(v: DataFrame, cuts: DataFrame, keys: list[str]) -> DataFrame:
    """For each later shard of a hot key the earlier versions that can win there.

    A version that ends in a later shard is carried into that one. Of the
    versions that hold throughout a shard only the best can win, so each shard
    gets one such row. Hence there are at most as many carried rows as versions
    and shards. The best of a shard comes from a binary tree over the shards: a
    version is noted at the few nodes that make up the shards it spans, the
    notes are reduced to the best per node, and a shard looks up its ancestors.
    """
    held = v.join(F.broadcast(cuts), keys).withColumn("__last", F.size(F.filter(CUTS, lambda c: c < F.col("__end"))))
    held = held.filter(F.col("__last") > F.col(SHARD))
    columns = [*keys, "__at", "__valid", "__created", "__end", SHARD]
    ending = held.withColumn("__at", F.get(F.col(CUTS), F.col("__last") - 1)).withColumn(SHARD, F.col("__last")).select(*columns)

    # shards SHARD + 1 ... __last - 1 as nodes (level, node): node n of level k stands for the shards n * 2^k ... (n + 1) * 2^k - 1
    levels = range(sharding.MAX_SHARDS.bit_length() + 1)
    node = lambda k, n, keep: F.when(keep, F.struct(F.lit(k).alias("level"), n.cast("int").alias("node")))
    spanned = []
    for k in levels:
        first, beyond = F.ceil((F.col(SHARD) + 1) / (1 << k)), F.floor(F.col("__last") / (1 << k))
        spanned += [node(k, first, (first < beyond) & (first % 2 == 1)), node(k, beyond - 1, (first < beyond) & (beyond % 2 == 1))]
    above = [F.struct(F.lit(k).alias("level"), F.floor(F.col(SHARD) / (1 << k)).cast("int").alias("node")) for k in levels]

    best = F.struct("__valid", "__created", "__end")
    notes = (
        held.filter(F.col("__last") > F.col(SHARD) + 1)
        .select(*keys, best.alias("best"), F.inline(F.array_compact(F.array(*spanned))))
        .groupBy(*keys, "level", "node").agg(F.max("best").alias("best"))
    )
    shards = sharding.all_shards(cuts, keys).filter(F.col(SHARD) > 0).select("*", F.inline(F.array(*above)))
    spanning = (
        notes.join(F.broadcast(shards), [*keys, "level", "node"])
        .groupBy(*keys, SHARD, "__floor").agg(F.max("best").alias("best"))
        .select(*keys, F.col("__floor").alias("__at"), "best.*", SHARD)
    )
    return ending.unionByName(spanning.select(*columns))


def json_field(properties: Column, name: str) -> Column:
    """A top-level JSON value as string; null if absent, null or not JSON."""
    return F.get_json_object(properties, f"$.{name}")
