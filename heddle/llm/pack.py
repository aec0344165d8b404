"""Filling containers of fixed capacity with items, by minimum bin slack.

Each container starts with the largest item left; a bitset dynamic program over
the lengths at hand finds the fullest combination for the rest of its room, and
the items of that combination are removed. Items are dealt to shards of bounded
size by hash and every shard is packed on its own; at most one poorly filled
container per shard is the price.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARD_ITEMS = 40_000
MAX_SPECS = 1_000

PACKED = "spec_id int, capacity int, container string, doc_id bigint, piece int, tokens bigint"


def fullest(counts: dict[int, int], lengths: list[int], room: int) -> dict[int, int]:
    """How many items of each length fill ``room`` best; larger lengths are tried first.

    Bit s of the bitset tells whether some combination has sum s. Copies of one
    length enter in powers of two; the bitset before every entry is kept, so the
    best sum can be taken apart again.
    """
    reach, goal, mask = 1, 1 << room, (1 << (room + 1)) - 1
    steps: list[tuple[int, int, int]] = []
    for length in lengths:
        if length > room or length == 0:
            continue
        left, k = min(counts[length], room // length), 1
        while left:
            k = min(k, left)
            steps.append((length, k, reach))
            reach |= (reach << (length * k)) & mask
            left -= k
            k *= 2
            if reach & goal:
                break
        if reach & goal:
            break
    best, used = reach.bit_length() - 1, {}
    for length, k, before in reversed(steps):
        if not before >> best & 1:
            used[length] = used.get(length, 0) + k
            best -= length * k
    return used


def minimum_bin_slack(sizes: list[int], capacity: int) -> list[int]:
    """The container number of each item; every size must be at most the capacity."""
    held: dict[int, list[int]] = {}
    for i, size in enumerate(sizes):
        held.setdefault(size, []).append(i)
    empty = held.pop(0, [])
    counts = {size: len(items) for size, items in held.items()}
    lengths = sorted(counts, reverse=True)
    place, bins = [0] * len(sizes), 0
    while lengths:
        first = lengths[0]
        counts[first] -= 1
        used = fullest(counts, lengths, capacity - first)
        counts[first] += 1
        used[first] = used.get(first, 0) + 1
        # the same combination stays the best as long as all of its lengths last
        for _ in range(min(counts[size] // k for size, k in used.items())):
            for size, k in used.items():
                for _ in range(k):
                    place[held[size].pop()] = bins
                counts[size] -= k
            bins += 1
        if any(counts[size] == 0 for size in used):
            lengths = [size for size in lengths if counts[size]]
    for i in empty:
        place[i] = 0
    return place


def _pack_shard(part: pd.DataFrame) -> pd.DataFrame:
    part = part.sort_values(["doc_id", "piece"], kind="stable")
    capacity = int(part["capacity"].iloc[0])
    bins = minimum_bin_slack(part["tokens"].tolist(), capacity)
    return pd.DataFrame(
        {
            "spec_id": part["spec_id"],
            "capacity": part["capacity"],
            "container": [f"{s}-{b}" for s, b in zip(part["shard"], bins)],
            "doc_id": part["doc_id"],
            "piece": part["piece"],
            "tokens": part["tokens"],
        }
    )


def pack(sizes: DataFrame, specs: DataFrame, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """Assigns every document to containers, once for each capacity.

    ``sizes``: doc_id, tokens; ``specs``: spec_id, capacity_tokens (at most
    ``MAX_SPECS`` rows, else ValueError; rows with a null or a capacity below 1
    are ignored). Result: spec_id, capacity, container, doc_id, piece, tokens.

    A document within the capacity is one piece 0. A longer one becomes full
    containers of its own (``full-`` and doc_id) and a last piece that is packed like the rest. Null
    tokens count as 0; items without tokens take no room and join container 0
    of their shard. Repeated rows are packed each. ``sizes`` is read twice (once
    to count it), so pass a written table.
    """
    wanted = specs.select("spec_id", "capacity_tokens").limit(MAX_SPECS + 1).collect()
    if len(wanted) > MAX_SPECS:
        raise ValueError(f"more than {MAX_SPECS} specs")
    wanted = [(r[0], r[1]) for r in wanted if r[0] is not None and r[1] is not None and r[1] >= 1]
    if not wanted:
        return sizes.sparkSession.createDataFrame([], PACKED)
    shards = max(1, math.ceil(sizes.count() / shard_items))
    each = F.array(*[F.struct(F.lit(s).cast("int").alias("spec_id"), F.lit(c).cast("int").alias("capacity")) for s, c in wanted])
    items = sizes.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("tokens", F.lit(0)).cast("bigint").alias("n"), F.inline(each))
    full = F.floor((F.greatest(F.col("n"), F.lit(1)) - 1) / F.col("capacity")).cast("int")
    items = items.withColumn("full", full)
    whole = items.filter("full > 0").select(
        "spec_id", "capacity", F.format_string("full-%d", F.col("doc_id")).alias("name"), "doc_id", F.explode(F.sequence(F.lit(0), F.col("full") - 1)).alias("piece"), F.col("capacity").cast("bigint").alias("tokens")
    ).select("spec_id", "capacity", F.concat_ws("-", "name", "piece").alias("container"), "doc_id", "piece", "tokens")
    rest = items.select(
        "spec_id", "capacity", "doc_id", F.col("full").alias("piece"), (F.col("n") - F.col("full").cast("bigint") * F.col("capacity")).alias("tokens"),
        F.pmod(F.xxhash64("doc_id", "n"), F.lit(shards)).cast("int").alias("shard"),
    )
    packed = rest.groupBy("spec_id", "shard").applyInPandas(_pack_shard, PACKED)
    return packed.unionByName(whole)


def fill_report(packed: DataFrame) -> DataFrame:
    """Containers, tokens and the share of all room used, per spec."""
    bins = packed.groupBy("spec_id", "capacity", "container").agg(F.sum("tokens").alias("n"), F.count(F.lit(1)).alias("items"))
    return bins.groupBy("spec_id", "capacity").agg(
        F.count(F.lit(1)).alias("containers"),
        F.sum("items").alias("items"),
        F.sum("n").alias("tokens"),
        F.max("n").alias("fullest"),
        (F.sum("n") / (F.count(F.lit(1)) * F.first("capacity"))).alias("filled"),
    )
