"""Continuous periods and gaps from overlapping, nested and open intervals.

Every interval becomes an event whose session lasts exactly as long as the
interval, so Spark's own session windows merge whatever overlaps. Periods that
only touch are joined afterwards, and gaps follow from the next period's start.
Hot keys are merged in shards along the start; a shard learns how far the
earlier ones reach from one carried row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import sharding
from .sharding import SHARD

#: Times at or beyond +-LIMIT ms (about 110,000 years) count as open; session windows count microseconds.
LIMIT = 3_500_000_000_000_000
HOUR = 3_600_000


def _duration(ms: Column) -> Column:
    zero = F.lit(0)
    return F.make_interval(zero, zero, zero, zero, F.floor(ms / HOUR).cast("int"), zero, ((ms % HOUR).cast("decimal(18,6)") / 1000).cast("decimal(18,6)"))


def continuous_periods(
    intervals: DataFrame, key: str, start: str, end: str, rows_per_shard: int = sharding.ROWS_PER_SHARD
) -> DataFrame:
    """Merges [start, end) per key into periods and lists the gaps between them.

    Times are epoch milliseconds; null means open. Result: key, kind
    (``period`` or ``gap``), start_ms, end_ms, with -1 for an open side of a
    period. Intervals with end <= start and rows with a null key are ignored;
    repeated rows count once; touching intervals form one period. A key whose
    intervals are all ignored does not appear; further columns play no part.
    """
    low, high = F.lit(-LIMIT), F.lit(LIMIT)
    bounded = lambda c, open_end: F.greatest(low, F.least(high, F.coalesce(F.col(f"`{c}`"), open_end)))
    rows = (
        intervals.filter(F.col(f"`{key}`").isNotNull())
        .filter(F.col(f"`{start}`").isNull() | F.col(f"`{end}`").isNull() | (F.col(f"`{end}`") > F.col(f"`{start}`")))
        .select(F.col(f"`{key}`").alias("k"), bounded(start, low).alias("s"), bounded(end, high).alias("e"))
        .filter("e > s")
        .groupBy("k", "s").agg(F.max("e").alias("e"))  # of intervals with one start the longest covers the others
    )
    keys = ["k"]
    cuts = sharding.hot_key_cuts(rows.select("k", "s"), keys, "s", rows_per_shard)
    pieces = (
        sharding.with_shard(rows, cuts, keys, "s")
        .groupBy("k", SHARD, F.session_window(F.timestamp_micros(F.col("s") * 1000), _duration(F.col("e") - F.col("s"))).alias("w"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select("k", SHARD, F.expr("unix_micros(w.start) div 1000").alias("s"), F.expr("unix_micros(w.end) div 1000").alias("e"))
    )
    in_shard = Window.partitionBy("k", SHARD).orderBy("s")
    pieces = pieces.withColumn("reach", F.max("e").over(in_shard.rowsBetween(Window.unboundedPreceding, -1))).withColumn(
        "top", F.max("e").over(Window.partitionBy("k", SHARD))
    )
    if cuts is not None:
        grid = sharding.all_shards(cuts, keys).select("k", SHARD)
        tops = grid.join(pieces.groupBy("k", SHARD).agg(F.max("e").alias("t")), ["k", SHARD], "left")
        order = Window.partitionBy("k").orderBy(SHARD)
        tops = tops.select(
            "k", SHARD, F.max("t").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("carried"), F.max("t").over(Window.partitionBy("k")).alias("last_end")
        )
        pieces = pieces.join(F.broadcast(tops), ["k", SHARD], "left").withColumn("reach", F.greatest("reach", "carried"))
    begins = pieces.filter(F.col("reach").isNull() | (F.col("s") > F.col("reach")))
    begins = begins.withColumn("next_reach", F.lead("reach").over(in_shard))
    if cuts is not None:
        firsts = grid.join(begins.groupBy("k", SHARD).agg(F.min_by("reach", "s").alias("r")), ["k", SHARD], "left").select(
            "k", SHARD, F.first("r", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("later_reach")
        )
        begins = begins.join(F.broadcast(firsts), ["k", SHARD], "left")
        close = F.coalesce("next_reach", "later_reach", "last_end", "top")
    else:
        close = F.coalesce("next_reach", "top")
    begins = begins.withColumn("close", close)
    parts = F.array(
        F.struct(
            F.lit("period").alias("kind"),
            F.when(F.col("s") <= low, F.lit(-1)).otherwise(F.col("s")).cast("bigint").alias("start_ms"),
            F.when(F.col("close") >= high, F.lit(-1)).otherwise(F.col("close")).cast("bigint").alias("end_ms"),
        ),
        F.when(
            F.col("reach").isNotNull(),
            F.struct(F.lit("gap").alias("kind"), F.col("reach").alias("start_ms"), F.col("s").alias("end_ms")),
        ),
    )
    return begins.select(F.col("k").alias(key), F.inline(F.filter(parts, lambda p: p.isNotNull())))
