"""BM25 ranking over token lists.

Statistics (units, document frequencies, mean length) are those of the whole
collection; a filter only restricts which units are scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import tokenize
from ..sources.tables import cut_lineage
from .vector_search import top_k

K1, B = 1.2, 0.75
#: Queries and units per packed row, and up to how many pairs a term is expanded together with the other rare ones.
QUERY_BLOCK, UNIT_BLOCK, RARE = 256, 2048, 64


def with_tokens(units: DataFrame, text: str = "text") -> DataFrame:
    return units.withColumn("tokens", tokenize(F.col(text)))


def corpus_stats(units: DataFrame) -> DataFrame:
    """One row: n, avgdl; units with an empty token list count, those with none (null) are not indexed by words."""
    return units.agg(F.count("tokens").alias("n"), F.avg(F.when(F.col("tokens").isNotNull(), F.size("tokens")).cast("double")).alias("avgdl"))


def postings(units: DataFrame, unit: str) -> DataFrame:
    """unit, term, tf, length; one row per unit and term."""
    words = units.select(unit, F.size("tokens").alias("length"), F.explode("tokens").alias("term"))
    return words.groupBy(unit, "term").agg(F.count(F.lit(1)).alias("tf"), F.first("length").alias("length"))


def term_stats(posting: DataFrame) -> DataFrame:
    return posting.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def bm25_weight(tf: Column, length: Column, df: Column, n: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
    return F.when(idf > 0, idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / avgdl))).otherwise(0.0)


def query_weights(terms: DataFrame, units: DataFrame, unit: str = "chunk_id", allowed: Column | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """unit, term, w: the weight of each of ``terms`` (term) in every allowed unit that has it.

    Only postings of these terms are built: they restrict the exploded tokens
    before the first shuffle.
    """
    stats = corpus_stats(units)
    scored = F.coalesce(allowed, F.lit(False)) if allowed is not None else F.lit(True)
    hits = (
        units.select(F.col(unit), scored.alias("__ok"), F.size("tokens").alias("length"), F.explode("tokens").alias("term"))
        .join(terms.select("term").distinct(), "term", "left_semi")
        .groupBy(unit, "term")
        .agg(F.count(F.lit(1)).alias("tf"), F.first("length").alias("length"), F.first("__ok").alias("__ok"))
    )
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return (
        hits.filter("__ok")
        .join(df, "term")
        .crossJoin(F.broadcast(stats))
        .select(unit, "term", bm25_weight(F.col("tf"), F.col("length"), F.col("df"), F.col("n"), F.col("avgdl"), k1, b).alias("w"))
        .filter("w > 0")
    )


def bm25_scores(queries: DataFrame, units: DataFrame, unit: str = "chunk_id", allowed: Column | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """query_id, unit, score of every allowed unit that shares a term with the query: all of them, one row per pair.

    ``queries``: query_id, tokens (a repeated term counts once). ``units``: unit,
    tokens and whatever ``allowed`` refers to. Queries or units without tokens
    have no rows. For the best few of each query use ``bm25_topk``.
    """
    terms = queries.select("query_id", F.explode(F.array_distinct("tokens")).alias("term"))
    return query_weights(terms, units, unit, allowed, k1, b).join(terms, "term").groupBy("query_id", unit).agg(F.sum("w").alias("score"))


def _pack(block: int):
    """Rows (id, terms, weights) to packed rows: ids, sizes, terms (int64), weights (float64)."""

    def flush(held: list) -> pa.RecordBatch:
        ids = pa.concat_arrays([h[0] for h in held])
        sizes = np.concatenate([h[1] for h in held])
        offsets = pa.array([0, len(ids)], pa.int32())
        blobs = [pa.array([np.concatenate([h[i] for h in held]).tobytes()], pa.binary()) for i in (2, 3)]
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, ids), pa.ListArray.from_arrays(offsets, pa.array(sizes, pa.int32())), *blobs], names=["ids", "sizes", "terms", "weights"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            sizes = np.asarray(batch.column(1).value_lengths().fill_null(0), np.int64)
            ends = np.cumsum(sizes)
            terms = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            weights = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            at = 0
            while at < batch.num_rows:
                stop = min(batch.num_rows, at + block - n)
                lo, hi = ends[at] - sizes[at], ends[stop - 1]
                held.append((batch.column(0).slice(at, stop - at), sizes[at:stop], terms[lo:hi], weights[lo:hi]))
                n += stop - at
                at = stop
                if n == block:
                    yield flush(held)
                    held, n = [], 0
        if held:
            yield flush(held)

    return run


def _packed(rows: DataFrame, ident: str, block: int) -> DataFrame:
    schema = T.StructType(
        [T.StructField("ids", T.ArrayType(rows.schema[ident].dataType)), T.StructField("sizes", T.ArrayType(T.IntegerType())), T.StructField("terms", T.BinaryType()), T.StructField("weights", T.BinaryType())]
    )
    return rows.select(ident, F.transform("t", lambda x: x["n"]).alias("terms"), F.transform("t", lambda x: x["w"]).alias("weights")).mapInArrow(_pack(block), schema)


def _products(q_sizes: np.ndarray, q_terms: np.ndarray, c_sizes: np.ndarray, c_terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sums of the units' weights over the terms of each query: queries x units."""
    scores = np.zeros((len(q_sizes), len(c_sizes)))
    q_of, c_of = np.repeat(np.arange(len(q_sizes)), q_sizes), np.repeat(np.arange(len(c_sizes)), c_sizes)
    q_order, c_order = np.argsort(q_terms, kind="stable"), np.argsort(c_terms, kind="stable")
    q_of, q_terms, c_of, c_terms, weights = q_of[q_order], q_terms[q_order], c_of[c_order], c_terms[c_order], weights[c_order]
    shared = np.intersect1d(q_terms, c_terms)
    qa, qb = np.searchsorted(q_terms, shared), np.searchsorted(q_terms, shared, "right")
    ca, cb = np.searchsorted(c_terms, shared), np.searchsorted(c_terms, shared, "right")
    pairs = (qb - qa) * (cb - ca)
    rare = np.flatnonzero(pairs <= RARE)
    if len(rare):
        # every pair of the rare terms at once: pair number divided by the units of the term is the query
        term = np.repeat(rare, pairs[rare])
        number = np.arange(len(term)) - np.repeat(np.cumsum(pairs[rare]) - pairs[rare], pairs[rare])
        width = (cb - ca)[term]
        unit = ca[term] + number % width
        flat = q_of[qa[term] + number // width] * len(c_sizes) + c_of[unit]
        scores += np.bincount(flat, weights[unit], scores.size).reshape(scores.shape)
    for i in np.flatnonzero(pairs > RARE).tolist():
        scores[np.ix_(q_of[qa[i] : qb[i]], c_of[ca[i] : cb[i]])] += weights[ca[i] : cb[i]]
    return scores


def bm25_topk(queries: DataFrame, units: DataFrame, k: int, unit: str = "chunk_id", allowed: Column | None = None, stats_scope: str = "global", digits: int = 6) -> DataFrame:
    """The ``k`` best units per query, ties by the smaller unit id.

    Units and queries become packed blocks of sparse rows; every block of
    queries meets every block of units, a task adds up the weights of a pair of
    blocks and keeps the best k per query. So the pairs of queries and units,
    whose number is that of the queries times that of the units where words are
    frequent, never become rows of a table. A unit whose score rounds to 0 is no hit.

    With ``stats_scope="filtered"`` the statistics are those of the allowed units.
    """
    if stats_scope not in ("global", "filtered"):
        raise ValueError("stats_scope is global or filtered")
    if stats_scope == "filtered" and allowed is not None:
        units, allowed = units.filter(F.coalesce(allowed, F.lit(False))), None
    terms = queries.select("query_id", F.explode(F.array_distinct("tokens")).alias("term"))
    names = cut_lineage(terms.select("term").distinct().withColumn("n", F.monotonically_increasing_id()), "terms")
    weights = query_weights(names, units, unit, allowed).join(names, "term")
    rows = weights.groupBy(unit).agg(F.collect_list(F.struct("n", "w")).alias("t"))
    asked = terms.join(names, "term").groupBy("query_id").agg(F.collect_list(F.struct("n", F.lit(1.0).alias("w"))).alias("t"))
    blocks = [df.select(*[F.col(c).alias(f"{s}_{c}") for c in df.columns]) for s, df in (("c", _packed(rows, unit, UNIT_BLOCK)), ("q", _packed(asked, "query_id", QUERY_BLOCK)))]
    q_type, id_type = queries.schema["query_id"].dataType, units.schema[unit].dataType
    q_arrow, id_arrow = to_arrow_type(q_type), to_arrow_type(id_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(j)[i] for j, n in enumerate(batch.schema.names)}
                numbers = lambda name, kind: np.frombuffer(row[name].as_buffer(), kind)  # noqa: B023, E731
                sizes = {s: row[f"{s}_sizes"].values.to_numpy() for s in "qc"}
                scores = np.round(_products(sizes["q"], numbers("q_terms", "<i8"), sizes["c"], numbers("c_terms", "<i8"), numbers("c_weights", "<f8")), digits)
                n = scores.shape[1]
                cut = np.partition(scores, n - k, axis=1)[:, n - k, None] if n > k else -np.inf
                at_q, at_c = np.nonzero((scores >= cut) & (scores > 0))
                yield pa.RecordBatch.from_arrays([row["q_ids"].values.take(pa.array(at_q)).cast(q_arrow), row["c_ids"].values.take(pa.array(at_c)).cast(id_arrow), pa.array(scores[at_q, at_c])], names=["query_id", unit, "score"])

    out = T.StructType([T.StructField("query_id", q_type), T.StructField(unit, id_type), T.StructField("score", T.DoubleType())])
    return top_k(blocks[0].crossJoin(blocks[1]).mapInArrow(run, out), k, unit).select("query_id", "rank", "score", unit)


def replace_groups(units: DataFrame, replacement: DataFrame, group: str = "document_id") -> DataFrame:
    """Units after all groups of ``replacement`` have been replaced: the incremental index equals a bulk build of these."""
    return units.join(replacement.select(group).distinct(), group, "left_anti").unionByName(replacement)
