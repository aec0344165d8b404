"""Fusing and reordering ranked lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..sources.tables import cut_lineage
from .vector_search import top_k

RRF_C = 60


def rrf(ranked: DataFrame, ident: str, c: int = RRF_C, k: int | None = None, digits: int = 9) -> DataFrame:
    """Reciprocal-rank fusion: sum of weight / (c + rank) over the lists, ranks from 1.

    ``ranked``: query_id, list_id, rank, the id and optionally ``weight``. An id
    that a list holds more than once counts at its first place there.
    """
    weight = F.col("weight") if "weight" in ranked.columns else F.lit(1.0)
    first = ranked.withColumn("weight", weight).groupBy("query_id", "list_id", ident).agg(F.min("rank").alias("rank"), F.first("weight").alias("weight"))
    fused = first.groupBy("query_id", ident).agg(F.sum(F.col("weight") / (F.col("rank") + c)).alias("score"))
    return top_k(fused, k or (1 << 30), ident, digits=digits)


def rrf_positions(ranked: DataFrame, ident: str, const: int = 1, digits: int = 9) -> DataFrame:
    """The reranking variant: places from 0, every occurrence counts, ties keep the first-seen order (list, then place)."""
    fused = ranked.groupBy("query_id", ident).agg(
        F.sum(1.0 / (F.col("position") + const)).alias("score"), F.min(F.struct("list_id", "position")).alias("seen")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "seen")
    return fused.withColumn("score", F.round("score", digits)).withColumn("rank", F.row_number().over(order)).drop("seen")


def maximal_marginal_relevance(candidates: DataFrame, ident: str, lam: float = 0.5, digits: int = 9) -> DataFrame:
    """Scores every candidate once: lam x cos(query, c) - (1 - lam) x max(0, greatest cos to another candidate).

    ``candidates``: query_id, position, id, vector, query_vector; ties keep the
    positions. Candidates of one query are a ranked list, so they are compared
    with one another inside one row.
    """
    unit = candidates.withColumn("u", V.l2_normalize(F.col("vector"))).withColumn("rel", V.cosine(F.col("query_vector"), F.col("vector")))
    lists = unit.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("position", ident, "rel", "u"))).alias("all"))
    near = lambda x: F.aggregate(
        "all", F.lit(0.0), lambda m, y: F.greatest(m, F.when(y["position"] != x["position"], F.coalesce(V.dot(x["u"], y["u"]), F.lit(0.0))).otherwise(0.0))
    )
    scored = lists.select(
        "query_id",
        F.inline(F.transform("all", lambda x: F.struct(x[ident].alias(ident), x["position"].alias("position"), F.round(lam * x["rel"] - (1 - lam) * near(x), digits).alias("score")))),
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "position")
    return scored.withColumn("rank", F.row_number().over(order)).drop("position")


def numbered(rows: DataFrame, by: str, order: list, total: Column | None = None, name: str = "rank", so_far: str = "so_far") -> DataFrame:
    """Adds ``rank`` from 1 within ``by`` in the given order and, of ``total``, the sum up to and including each row.

    A group may have any number of rows: they are sorted across tasks, and every
    slice of a group goes on from the slices before it, of which one row each is known.
    """
    value = F.lit(0) if total is None else total
    rows = cut_lineage(rows.withColumn("__value", value).repartitionByRange(by, *order).withColumn("__slice", F.spark_partition_id()), "ranks")
    sizes = rows.groupBy(by, "__slice").agg(F.count(F.lit(1)).alias("__n"), F.sum("__value").alias("__s"))
    earlier = Window.partitionBy(by).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(by, "__slice", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("__n", "__s")])
    own = Window.partitionBy(by, "__slice").orderBy(*order)
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    # null groups are groups too
    left = rows.withColumns({"__own": F.row_number().over(own), "__sum": F.sum("__value").over(upto)}).withColumnRenamed("__slice", "__l")
    joined = left.join(offsets.withColumnRenamed(by, "__by"), (left["__l"] == offsets["__slice"]) & left[by].eqNullSafe(F.col("__by")))
    out = joined.withColumn(name, (F.col("__n_before") + F.col("__own")).cast("int"))
    if total is not None:
        out = out.withColumn(so_far, F.col("__s_before") + F.col("__sum"))
    return out.drop("__value", "__slice", "__l", "__own", "__sum", "__by", "__n_before", "__s_before")


def distance_rerank(candidates: DataFrame, distances: DataFrame, ident: str) -> DataFrame:
    """Nearest first by ``hops``; ids without a distance last; ties keep their position (anything that sorts)."""
    return numbered(candidates.join(distances, ident, "left"), "query_id", [F.asc_nulls_last("hops"), F.asc_nulls_last("position")])


def mentions_rerank(candidates: DataFrame, mentions: DataFrame, ident: str) -> DataFrame:
    """Most ``mentions`` first, none counts as 0; ties keep their position."""
    order = Window.partitionBy("query_id").orderBy(F.desc("mentions"), "position")
    joined = candidates.join(mentions, ident, "left").withColumn("mentions", F.coalesce("mentions", F.lit(0)))
    return joined.withColumn("rank", F.row_number().over(order))


def context_block(pieces: DataFrame, max_chars: int, by: str = "query_id", order: str | list = "rank", text: str = "text") -> DataFrame:
    """The leading pieces per query whose total length stays within ``max_chars``, with ``rank`` and ``chars_so_far``; null texts have no length."""
    order = [F.col(order)] if isinstance(order, str) else order
    placed = numbered(pieces, by, order, F.coalesce(F.length(text), F.lit(0)).cast("bigint"), "__rank", "chars_so_far")
    placed = placed.drop("rank").withColumnRenamed("__rank", "rank")
    return placed.filter(F.col("chars_so_far") <= max_chars)


def fuse_subqueries(hits: DataFrame, ident: str, k: int, c: int = RRF_C) -> DataFrame:
    """Fuses the rankings of several sub-queries (``sub_query``) and tells which of them matched."""
    fused = rrf(hits.withColumn("list_id", F.col("sub_query")), ident, c, k)
    matched = hits.groupBy("query_id", ident).agg(F.array_sort(F.collect_set("sub_query")).alias("matched"))
    return fused.join(matched, ["query_id", ident])
