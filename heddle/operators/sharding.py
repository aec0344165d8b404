"""Range shards for hot keys.

A key that holds a large share of all rows cannot be handled by one task. The
helpers here find such keys, cut their rows into shards along an ordering
column, and leave every other key in its single shard 0. The list of cuts is
bounded: a key counts as hot from ``max(rows_per_shard, total / max_shards)``
rows on, so there are at most ``max_shards`` hot keys and as many cuts. Rows
that share one value of the ordering column are split as well, see ``shard_of``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS_PER_SHARD = 250_000
MAX_SHARDS = 4096

SHARD = "__shard"
CUTS = "__cuts"


def hot_key_cuts(
    points: DataFrame, keys: list[str], at: str, rows_per_shard: int = ROWS_PER_SHARD, max_shards: int = MAX_SHARDS
) -> DataFrame | None:
    """One row per hot key with its ascending cut points, or None without hot keys.

    ``points`` holds the key columns and the bigint ordering column of all rows
    that will be matched. Counting is pre-aggregated before its shuffle, and the
    quantiles are taken of hot keys only.
    """
    counts = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    total, most = counts.agg(F.coalesce(F.sum("__n"), F.lit(0)), F.coalesce(F.max("__n"), F.lit(0))).first()
    limit = max(rows_per_shard, math.ceil(total / max_shards))
    if most <= limit:
        return None
    parts = math.ceil(most / limit)
    hot = counts.filter(F.col("__n") > limit)
    fractions = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    wanted = F.least(F.ceil(F.col("__n") / F.lit(limit)), F.lit(parts)).cast("int")
    cuts = (
        points.join(F.broadcast(hot), keys, "left_semi")
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("__n"),
            F.percentile_approx(at, fractions, max(10_000, 10 * parts)).alias("__q"),
        )
        .select(
            *keys,
            F.array_sort(
                F.transform(
                    F.sequence(F.lit(1), wanted - 1),
                    lambda j: F.element_at("__q", F.least(F.greatest((j * parts / wanted).cast("int"), F.lit(1)), F.lit(parts - 1))).cast("bigint"),
                )
            ).alias(CUTS),
        )
    )
    return points.sparkSession.createDataFrame(cuts.collect(), cuts.schema)


def shard_of(at: Column, salt: Column | None = None) -> Column:
    """The shard of a value: how many cuts lie at or before it.

    A value that many rows share is a cut several times over and has as many
    shards. Rows with a ``salt`` are dealt to all of them, rows without stay in
    the first, from where later shards know them as carried rows.
    """
    upto = F.size(F.filter(F.col(CUTS), lambda c: c <= at))
    before = F.size(F.filter(F.col(CUTS), lambda c: c < at))
    tied = upto - before
    own = before + F.lit(1) + (F.pmod(salt, tied) if salt is not None else F.lit(0))
    return F.when(F.col(CUTS).isNull() | at.isNull(), F.lit(0)).when(tied > 1, own).otherwise(upto).cast("int")


def row_salt(df: DataFrame) -> Column:
    """A hash of each row by which tied rows are dealt: the same on every attempt of a task; maps cannot be hashed and play no part."""
    kinds = {f.name: f.dataType.json() for f in df.schema.fields}
    return F.xxhash64(*[F.col(f"`{c}`") for c, kind in kinds.items() if '"map"' not in kind and "variant" not in kind])


def with_shard(df: DataFrame, cuts: DataFrame | None, keys: list[str], at: str, salt: Column | None = None) -> DataFrame:
    """Adds ``__shard``; the cuts are broadcast, their number is bounded above."""
    if cuts is None:
        return df.withColumn(SHARD, F.lit(0))
    return df.join(F.broadcast(cuts), keys, "left").withColumn(SHARD, shard_of(F.col(at), salt)).drop(CUTS)


def all_shards(cuts: DataFrame, keys: list[str]) -> DataFrame:
    """Every (key, shard) of the hot keys with ``__floor``, the shard's lower cut."""
    return cuts.select(*keys, CUTS, F.explode(F.sequence(F.lit(0), F.size(CUTS))).alias(SHARD)).select(
        *keys, SHARD, F.when(F.col(SHARD) > 0, F.get(F.col(CUTS), F.col(SHARD) - 1)).alias("__floor")
    )
