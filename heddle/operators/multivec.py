"""Late interaction: documents and queries as sets of vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from .vector_search import packed, scored_blocks, top_k

#: Items per packed row; an item has many vectors.
QUERY_PATCH_BLOCK, PATCH_BLOCK = 64, 256


def _maxsim(q: np.ndarray, c: np.ndarray, q_parts: np.ndarray, c_parts: np.ndarray) -> np.ndarray:
    first = lambda parts: np.cumsum(parts) - parts
    return np.add.reduceat(np.maximum.reduceat(q @ c.T, first(c_parts), axis=1), first(q_parts), axis=0)


def maxsim_topk(queries: DataFrame, documents: DataFrame, k: int, ident: str = "document_id", digits: int = 6) -> DataFrame:
    """query_id, rank, score and id; score = sum over the query's vectors of the greatest dot product with one of the document's patches.

    ``queries``: query_id, patches; ``documents``: id, patches. Documents and
    queries without patches, or with patches of differing lengths that do not
    add up, are passed over; equal scores rank by the smaller id.
    """
    asked = packed(queries.filter(F.size("patches") > 0), "query_id", "patches", QUERY_PATCH_BLOCK, nested=True)
    rows = packed(documents.filter(F.size("patches") > 0), ident, "patches", PATCH_BLOCK, nested=True)
    return top_k(scored_blocks(asked, rows, k, ident, _maxsim, digits), k, ident).select("query_id", "rank", "score", ident)


def mean_pool(patches: DataFrame, ident: str = "document_id") -> DataFrame:
    """The normalised mean of each document's patches; the first patch where the mean is zero."""
    total = F.aggregate(F.slice("patches", 2, F.greatest(F.size("patches") - 1, F.lit(0))), V.doubles(F.element_at("patches", 1)), lambda a, p: F.zip_with(a, V.doubles(p), lambda x, y: x + y))
    return (
        patches.filter(F.size("patches") > 0)
        .select(ident, V.l2_normalize(F.transform(total, lambda x: x / F.size("patches"))).alias("pooled"), V.l2_normalize(F.element_at("patches", 1)).alias("first"))
        .select(ident, F.coalesce("pooled", "first").alias("vector"))
    )


def patch_counts(documents: DataFrame) -> DataFrame:
    """documents, patches: how many documents own patches, and how many there are."""
    n = F.coalesce(F.size("patches"), F.lit(0))
    return documents.agg(F.sum(F.when(n > 0, 1).otherwise(0)).alias("documents"), F.sum(F.greatest(n, F.lit(0))).alias("patches"))
