"""Exact top-k by similarity for a set of queries against all rows, in blocks.

Both sides are packed into rows that hold the vectors of a few thousand items as
one binary matrix. Every block of queries meets every block of the corpus; numpy
multiplies the two matrices, first in single precision, then the few products
that matter in double, and keeps the best k per query and block, so that only
``queries x blocks x k`` rows reach the shuffle. Spark broadcasts the packed
queries only while they are below its threshold; beyond it block pairs are
dealt to tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Items per packed row.
QUERY_BLOCK, CORPUS_BLOCK = 1024, 4096
#: Keys that the blocks of one group are dealt to.
SALTS = 8


def top_k(scored: DataFrame, k: int, ident: str, score: str = "score", by: str = "query_id", digits: int | None = None) -> DataFrame:
    """Ranks per query by score, ties by the smaller id; adds ``rank`` from 1."""
    if digits is not None:
        scored = scored.withColumn(score, F.round(score, digits))
    order = Window.partitionBy(by).orderBy(F.desc(score), ident)
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _pack(block: int, unit: bool):
    """Rows (id, vector, parts, group) to packed rows: dim, group, ids, parts, data (of the vectors' own precision, unit vectors in doubles).

    The vector column holds one vector, or the vectors of the item one after
    another with their number in ``parts``; items of different dim or group go to different rows.
    """

    def flush(dim: int, group: int, held: list, id_type: pa.DataType) -> pa.RecordBatch:
        rows = np.concatenate([h[2] for h in held]).reshape(-1, dim)
        if unit:
            norm = np.linalg.norm(rows, axis=1, keepdims=True)
            rows = np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 0)
        width = "<f4" if rows.dtype == np.float32 else "<f8"
        ids = pa.concat_arrays([h[0] for h in held])
        offsets = pa.array([0, len(ids)], pa.int32())
        return pa.RecordBatch.from_arrays(
            [
                pa.array([dim], pa.int32()),
                pa.array([group], pa.int32()),
                pa.ListArray.from_arrays(offsets, ids),
                pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([h[1] for h in held]), pa.int32())),
                pa.array([rows.astype(width, copy=False).tobytes()], pa.binary()),
            ],
            names=["dim", "group", "ids", "parts", "data"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[tuple[int, int], list] = {}
        id_type = None
        for batch in batches:
            id_type = batch.column(0).type
            column = batch.column(1)
            sizes = np.asarray(column.value_lengths().fill_null(0), np.int64)
            parts = np.asarray(batch.column(2).fill_null(0), np.int64)
            groups = np.asarray(batch.column(3).fill_null(-1), np.int64)
            flat = column.flatten().to_numpy(zero_copy_only=False)
            if unit or flat.dtype != np.float32:
                flat = flat.astype(np.float64)
            begin = np.cumsum(sizes) - sizes
            sound = (sizes > 0) & (parts > 0) & (sizes % np.maximum(parts, 1) == 0)
            dims = np.where(sound, sizes // np.maximum(parts, 1), 0)
            for dim, group in np.unique(np.stack([dims[sound], groups[sound]], 1), axis=0).tolist() if sound.any() else []:
                rows = np.flatnonzero(sound & (dims == dim) & (groups == group))
                held = waiting.setdefault((dim, group), [])
                while len(rows):
                    some, rows = rows[: block - sum(len(h[1]) for h in held)], rows[block - sum(len(h[1]) for h in held) :]
                    spread = np.repeat(begin[some] - (np.cumsum(sizes[some]) - sizes[some]), sizes[some]) + np.arange(sizes[some].sum())
                    held.append((batch.column(0).take(pa.array(some)), parts[some], flat[spread]))
                    if sum(len(h[1]) for h in held) >= block:
                        yield flush(dim, group, held, id_type)
                        held.clear()
        for (dim, group), held in waiting.items():
            if held:
                yield flush(dim, group, held, id_type)

    return run


def packed(rows: DataFrame, ident: str, vector: str, block: int, unit: bool = False, nested: bool = False, group: str | None = None) -> DataFrame:
    """``rows`` as packed blocks, each of one ``group`` (an int column) if given; null and empty vectors are passed over."""
    flat = F.flatten(vector) if nested else F.col(vector)
    parts = F.size(vector) if nested else F.lit(1)
    schema = T.StructType(
        [T.StructField("dim", T.IntegerType()), T.StructField("group", T.IntegerType()), T.StructField("ids", T.ArrayType(rows.schema[ident].dataType)), T.StructField("parts", T.ArrayType(T.IntegerType())), T.StructField("data", T.BinaryType())]
    )
    kind = rows.schema[vector].dataType
    kind = kind.elementType if nested else kind
    exact = "array<float>" if isinstance(kind.elementType, T.FloatType) else "array<double>"
    kept = rows.filter(F.col(vector).isNotNull()).select(ident, flat.cast(exact).alias("v"), parts.alias("parts"), (F.col(group).cast("int") if group else F.lit(0)).alias("group"))
    return kept.mapInArrow(_pack(block, unit), schema)


def _matrix(data, dim: int, vectors: int) -> np.ndarray:
    return np.frombuffer(data, "<f4" if data.size == 4 * dim * vectors else "<f8").reshape(-1, dim)


def _dot_hits(q: np.ndarray, c: np.ndarray, k: int, digits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of the best k rows per query and all that might tie with them, scores in doubles.

    A product in single precision comes first. Its error is at most (dim + 2)
    rounding steps of the product of the two lengths, so whatever could belong to
    the best k lies within twice that of the k-th, and only this is computed anew.
    """
    with np.errstate(all="ignore"):
        low_q, low_c = q.astype(np.float32, copy=False), c.astype(np.float32, copy=False)
        coarse = low_q @ low_c.T
    n = coarse.shape[1]
    if not np.isfinite(coarse).all():
        scores = np.round(q.astype(np.float64) @ c.astype(np.float64).T, digits)
        cut = np.partition(scores, n - k, axis=1)[:, n - k, None] if n > k else -np.inf
        at_q, at_c = np.nonzero(scores >= cut)
        return at_q, at_c, scores[at_q, at_c]
    if n > k:
        slack = 2 * (q.shape[1] + 2) * np.finfo(np.float32).eps * np.linalg.norm(q.astype(np.float64), axis=1) * float(np.linalg.norm(c, axis=1).max()) + 10.0**-digits
        at_q, at_c = np.nonzero(coarse >= np.partition(coarse, n - k, axis=1)[:, n - k, None] - slack[:, None].astype(np.float32))
    else:
        at_q, at_c = np.nonzero(np.ones_like(coarse, bool))
    exact = np.empty(len(at_q))
    for i in range(0, len(at_q), 65_536):
        part = slice(i, i + 65_536)
        exact[part] = np.einsum("ij,ij->i", q[at_q[part]].astype(np.float64), c[at_c[part]].astype(np.float64))
    return at_q, at_c, np.round(exact, digits)


def scored_blocks(
    queries: DataFrame, corpus: DataFrame, k: int, ident: str, score: Callable | None = None, digits: int = 6, grouped: bool = False
) -> DataFrame:
    """query_id, id, score: the best ``k`` (and ties) of every pair of packed blocks of one group and dim.

    Ungrouped blocks all meet, which is queries x rows work for a stated set of
    queries. Blocks of groups meet by an equi-join, in which the blocks of a
    group are dealt to ``SALTS`` keys, so that a large group is no single task.
    """
    q_type, id_type = queries.schema["ids"].dataType.elementType, corpus.schema["ids"].dataType.elementType
    q_arrow, id_arrow = to_arrow_type(q_type), to_arrow_type(id_type)
    out = T.StructType([T.StructField("query_id", q_type), T.StructField(ident, id_type), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(j)[i] for j, n in enumerate(batch.schema.names)}
                dim = row["q_dim"].as_py()
                if dim != row["c_dim"].as_py():
                    continue
                parts = [row[f"{s}_parts"].values.to_numpy() for s in "qc"]
                q, c = (_matrix(row[f"{s}_data"].as_buffer(), dim, int(n.sum())) for s, n in zip("qc", parts))
                if score is None:
                    at_q, at_c, found = _dot_hits(q, c, k, digits)
                else:
                    scores = np.round(score(q.astype(np.float64), c.astype(np.float64), *parts), digits)
                    n = scores.shape[1]
                    # whatever ties with the k-th best stays, ids decide later
                    cut = np.partition(scores, n - k, axis=1)[:, n - k, None] if n > k else -np.inf
                    at_q, at_c = np.nonzero(scores >= cut)
                    found = scores[at_q, at_c]
                yield pa.RecordBatch.from_arrays(
                    [
                        row["q_ids"].values.take(pa.array(at_q)).cast(q_arrow),
                        row["c_ids"].values.take(pa.array(at_c)).cast(id_arrow),
                        pa.array(found),
                    ],
                    names=["query_id", ident, "score"],
                )

    sides = [df.select("group", *[F.col(c).alias(f"{s}_{c}") for c in ("dim", "ids", "parts", "data")]) for s, df in (("c", corpus), ("q", queries))]
    if not grouped:
        return sides[0].drop("group").crossJoin(sides[1].drop("group")).mapInArrow(run, out)
    dealt = sides[0].withColumn("salt", F.pmod(F.xxhash64("c_ids"), F.lit(SALTS)))
    every = sides[1].withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    return dealt.join(every, ["group", "salt"]).drop("group", "salt").mapInArrow(run, out)


def exact_topk(
    queries: DataFrame, corpus: DataFrame, k: int, ident: str = "document_id", vector: str = "vector", metric: str = "dot", digits: int = 6
) -> DataFrame:
    """query_id, rank, score and the id of the ``k`` best rows of ``corpus`` per query.

    ``queries``: query_id, vector. ``metric`` is ``dot`` or ``cosine``. Filter
    the corpus before the call: ranks are those of the matching rows. Scores are
    rounded to ``digits`` decimals and equal ones rank by the smaller id. Null
    vectors and vectors of another length than the query's are passed over; with
    k above the corpus all its rows come out; no queries, no rows.
    """
    if k < 1:
        raise ValueError("k must be positive")
    unit = metric == "cosine"
    asked = packed(queries, "query_id", "vector", QUERY_BLOCK, unit)
    rows = packed(corpus, ident, vector, CORPUS_BLOCK, unit)
    return top_k(scored_blocks(asked, rows, k, ident, digits=digits), k, ident).select("query_id", "rank", "score", ident)


def batch_arrays(hits: DataFrame, ident: str = "document_id") -> DataFrame:
    """One row per query with parallel arrays ``ids`` and ``scores`` in rank order."""
    ranked = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.col(ident).alias("id"), "score"))).alias("h"))
    return ranked.select("query_id", F.col("h.id").alias("ids"), F.col("h.score").alias("scores"))


def hydrate(hits: DataFrame, documents: DataFrame, ident: str = "document_id") -> DataFrame:
    """Joins document columns to hits; hits of unknown documents are dropped."""
    return hits.join(documents, ident)
