"""Search in a mode: vector, lexical or hybrid, for a batch of queries over chunk tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicate import apply_filter
from ..functions.text import hash_embedding_column, tokenize
from ..operators.fusion import RRF_C, rrf
from ..operators.lexical import bm25_topk
from ..operators.vector_search import exact_topk

MODES = ("vector", "lexical", "hybrid")


def pool_width(k: int) -> int:
    """How many hits each ranker hands to the fusion."""
    return max(5 * k, 50)


def resolve_mode(mode: str | None, has_text_index: bool) -> str:
    """None means hybrid where tokens are kept, else vector."""
    if mode is None:
        return "hybrid" if has_text_index else "vector"
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    if mode != "vector" and not has_text_index:
        raise ValueError(f"{mode} search needs kept tokens")
    return mode


def with_vectors(queries: DataFrame, mode: str, embed: Callable[[Column], Column], dim: int) -> DataFrame:
    """Adds the vectors of text queries where the mode needs them; given vectors stay. A lexical part needs text."""
    if mode != "vector" and "text" not in queries.columns:
        raise ValueError(f"{mode} search needs the text of the queries")
    if mode == "lexical" or "vector" in queries.columns:
        return queries
    return queries.withColumn("vector", embed(F.col("text")).cast("array<double>"))


@dataclass
class Results:
    """hits: query_id, rank, score, chunk_id, document_id, metadata; total_considered: matching documents."""

    hits: DataFrame
    total_considered: DataFrame


def search(
    documents: DataFrame, chunks: DataFrame, queries: DataFrame, k: int, filter: dict | None = None, mode: str | None = None, embed: Callable[[Column], Column] | None = None, dim: int = 64, digits: int = 6
) -> Results:
    """The ``k`` best chunks per query (query_id, text and/or vector).

    The filter restricts documents before any ranking; BM25 statistics stay
    those of all chunks. Ties go to the smaller chunk id.
    """
    mode = resolve_mode(mode, "tokens" in chunks.columns)
    embed = embed or (lambda text: hash_embedding_column(text, dim))
    kept = apply_filter(documents, filter)
    allowed = chunks if filter is None else chunks.join(kept.select("document_id"), "document_id", "left_semi").select(*chunks.columns)
    width = k if mode != "hybrid" else pool_width(k)
    lists = []
    if mode != "lexical":
        asked = with_vectors(queries, mode, embed, dim)
        lists.append(exact_topk(asked, allowed, width, "chunk_id", "vector", digits=digits).withColumn("list_id", F.lit(0)))
    if mode != "vector":
        worded = queries.select("query_id", tokenize(F.col("text")).alias("tokens"))
        units = chunks
        ok = None
        if filter is not None:
            flags = kept.select("document_id", F.lit(True).alias("__allowed"))
            units, ok = chunks.join(flags, "document_id", "left"), F.col("__allowed")
        lists.append(bm25_topk(worded, units, width, "chunk_id", ok, digits=digits).withColumn("list_id", F.lit(1)))
    if mode == "hybrid":
        ranked = rrf(lists[0].unionByName(lists[1]), "chunk_id", RRF_C, k)
    else:
        ranked = lists[0]
    owners = chunks.select("chunk_id", "document_id").join(documents.select("document_id", "metadata"), "document_id")
    hits = ranked.join(owners, "chunk_id").select("query_id", "rank", "score", "chunk_id", "document_id", "metadata")
    return Results(hits, kept.agg(F.count(F.lit(1)).alias("total_considered")))


def distance(hits: DataFrame) -> DataFrame:
    """Cosine distance instead of similarity, as some callers rank ascending."""
    return hits.withColumn("score", 1 - F.col("score"))
