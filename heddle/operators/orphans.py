"""References to records that do not exist, are deleted, or arrive later.

Parent ids become integer keys, sorted keys are compressed into contiguous
runs, and every distinct reference is matched as-of to the preceding run start;
a reference beyond that run's end has no parent. The same covering match, with
record times in place of keys, tells references made before the first record
(``late``) from those made when no record was live (``deleted``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import sharding
from .sharding import SHARD

#: Keys are cut into ranges of this many values; a range holds at most as many distinct keys.
RANGE = 1 << 20
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1


def integer_key(ident: Column, hexadecimal: bool = True) -> dict[str, Column]:
    """Splits an id, reversibly, into a stem and a trailing integer of known width.

    Ids without trailing digits keep their whole text as stem, with width 0.
    """
    digits = F.regexp_extract(ident, r"([0-9a-f]{1,15})\z" if hexadecimal else r"([0-9]{1,18})\z", 1)
    width = F.length(digits)
    value = F.when(width == 0, F.lit(0)).otherwise(F.conv(digits, 16 if hexadecimal else 10, 10).cast("bigint"))
    return {
        "stem": F.substring(ident, F.lit(1), F.length(ident) - width),
        "width": width,
        "value": value.cast("bigint"),
    }


def key_runs(keys: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Contiguous runs (``run_start``, ``run_end``) of the distinct integers per group.

    Runs end at multiples of ``RANGE`` too, so that no group outgrows a task.
    """
    spread = keys.filter(F.col(value).isNotNull()).withColumn("range", F.floor(F.col(value) / F.lit(RANGE)).cast("bigint"))
    at = Window.partitionBy(*by, "range").orderBy(value)
    return (
        spread.select(*by, "range", value)
        .distinct()
        .withColumn("island", F.col(value) - F.row_number().over(at))
        .groupBy(*by, "range", "island")
        .agg(F.min(value).alias("run_start"), F.max(value).alias("run_end"))
        .drop("island")
    )


def covering_end(
    refs: DataFrame, runs: DataFrame, by: list[str], at: str, cuts: DataFrame | None = None
) -> DataFrame:
    """As-of match of each reference to the runs that start at or before it.

    Adds ``cover_end``, the greatest ``run_end`` among runs of the same group
    with ``run_start <= at``: null when no run starts that early, below ``at``
    when the reference lies beyond every such run. Hot groups are sharded along
    ``at`` with the greatest end of all earlier shards as carry-in; references
    that share one ``at`` are dealt to several shards. Rows whose ``at`` or
    group is null match nothing.
    """
    fields = refs.columns
    held = F.struct(*[F.col(f"`{c}`") for c in fields])
    sides = runs.select(*by, F.col("run_start").alias("__at"), F.lit(0).alias("__kind"), F.col("run_end").alias("__end"), F.lit(None).alias("__ref")).unionByName(
        refs.select(*by, F.col(at).alias("__at"), F.lit(1).alias("__kind"), F.lit(None).cast("bigint").alias("__end"), held.alias("__ref"))
    )
    sides = sharding.with_shard(sides, cuts, by, "__at", F.when(F.col("__kind") == 1, sharding.row_salt(sides)).otherwise(F.lit(0)))
    if cuts is not None:
        own = sharding.with_shard(runs.select(*by, "run_start", "run_end"), cuts, by, "run_start")
        tops = own.groupBy(*by, SHARD).agg(F.max("run_end").alias("__top"))
        earlier = Window.partitionBy(*by).orderBy(SHARD).rowsBetween(Window.unboundedPreceding, -1)
        carry = (
            sharding.all_shards(cuts, by)
            .join(tops, [*by, SHARD], "left")
            .withColumn("__end", F.max("__top").over(earlier))
            .filter(F.col("__end").isNotNull())
            .select(*by, F.lit(LOWEST).alias("__at"), F.lit(0).alias("__kind"), "__end", F.lit(None).alias("__ref"), SHARD)
        )
        sides = sides.unionByName(carry)
    upto = Window.partitionBy(*by, SHARD).orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    return sides.withColumn("cover_end", F.max("__end").over(upto)).filter("__kind = 1").select("__ref.*", "cover_end")


def orphan_references(
    refs: DataFrame, parents: DataFrame, rows_per_shard: int = sharding.ROWS_PER_SHARD, hexadecimal: bool = True
) -> DataFrame:
    """The references without a usable parent, each with its reason.

    ``refs``: ref_table, record_id, field, ref (string), t (bigint or null) and
    parent_table; ``parents``: parent_table, id, since, until (null: open).
    Result: ref_table, record_id, field, reason, period; distinct.

    Null refs are no references and never appear. Without t only ``missing`` is
    possible and the period is ``unknown``. A parent without ``since`` counts as
    always on record. Empty strings are ordinary ids. With no parents at all
    every reference is missing.
    """
    refs = refs.filter(F.col("ref").isNotNull())  # repeated rows do no harm until the end
    parents = parents.filter(F.col("id").isNotNull())
    group = ["parent_table", "stem", "width"]

    ids = parents.select("parent_table", *[c.alias(n) for n, c in integer_key(F.col("id"), hexadecimal).items()])
    runs = key_runs(ids, group)
    named = refs.select("parent_table", "ref").distinct()
    keyed = named.select("*", *[c.alias(n) for n, c in integer_key(F.col("ref"), hexadecimal).items()]).withColumn(
        "range", F.floor(F.col("value") / F.lit(RANGE)).cast("bigint")
    )
    missing = (
        covering_end(keyed, runs, [*group, "range"], "value")
        .filter(F.col("cover_end").isNull() | (F.col("cover_end") < F.col("value")))
        .select("parent_table", "ref", F.lit(True).alias("missing"))
    )

    # the last moment at which a record is live: until itself lies outside
    live = parents.select(
        "parent_table",
        F.col("id").alias("ref"),
        F.coalesce("since", F.lit(LOWEST)).alias("run_start"),
        F.coalesce(F.col("until") - 1, F.lit(HIGHEST)).alias("run_end"),
    ).groupBy("parent_table", "ref", "run_start").agg(F.max("run_end").alias("run_end"))
    dated = refs.filter(F.col("t").isNotNull())
    by = ["parent_table", "ref"]
    points = live.select(*by, F.col("run_start").alias("t")).unionByName(dated.select(*by, "t"))
    cuts = sharding.hot_key_cuts(points, by, "t", rows_per_shard)
    covered = covering_end(dated, live, by, "t", cuts)
    failing = covered.filter(F.col("cover_end").isNull() | (F.col("cover_end") < F.col("t")))
    undated = refs.filter(F.col("t").isNull()).withColumn("cover_end", F.lit(None).cast("bigint"))

    reason = (
        F.when(F.col("missing"), F.lit("missing"))
        .when(F.col("t").isNull(), F.lit(None))
        .when(F.col("cover_end").isNull(), F.lit("late"))
        .otherwise(F.lit("deleted"))
    )
    return (
        failing.unionByName(undated)
        .join(missing, by, "left")
        .withColumn("reason", reason)
        .filter(F.col("reason").isNotNull())
        .select("ref_table", "record_id", "field", "reason", month_of(F.col("t")).alias("period"))
        .distinct()
    )


def month_of(ms: Column) -> Column:
    """UTC month ``YYYY-MM`` of epoch milliseconds, whatever the session's zone; ``unknown`` for null."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ms / F.lit(86_400_000)).cast("int"))
    return F.coalesce(F.date_format(day, "yyyy-MM"), F.lit("unknown"))


def orphan_counts(orphans: DataFrame) -> DataFrame:
    """References that fail, counted per table, period and reason."""
    return orphans.groupBy("ref_table", "period", "reason").agg(F.count(F.lit(1)).alias("n_refs"))
