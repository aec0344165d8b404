"""The verbs by which frameworks use a collection, where they differ from its own methods.

Each class serves one family of callers. Vectors and hits are DataFrames;
allowlists may be DataFrames of any size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicate import FilterError, apply_filter, from_conditions, from_memory_filters, from_pairs
from ..functions.vectors import l2_normalize
from ..operators.lexical import bm25_topk
from ..plans.search import distance
from .store import Collection, Config, Spaces, list_page

HITS = "query_id string, rank int, score double, chunk_id string, document_id string, metadata map<string,string>"


def _none(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], HITS)


def _and(*trees: dict | None) -> dict | None:
    kept = [t for t in trees if t]
    return None if not kept else kept[0] if len(kept) == 1 else {"$and": kept}


def search_within(store: Collection, queries: DataFrame, k: int, tree: dict | None = None, ids: DataFrame | None = None, mode: str | None = None) -> DataFrame:
    """A search among the documents that match ``tree`` and are listed in ``ids`` (document_id)."""
    spec = {n: v for n, v in (("metadata", tree), ("document_ids", ids)) if v is not None}
    return store.search(queries, k, spec or None, mode)


class Texts:
    """Callers that add texts and ask for similar ones, with the text attached to every hit."""

    def __init__(self, store: Collection):
        self.store = store

    @classmethod
    def from_texts(cls, spark: SparkSession, path: str, texts: DataFrame, config: Config) -> Texts:
        made = cls(Collection.create(spark, path, config))
        made.add(texts)
        return made

    def add(self, texts: DataFrame) -> DataFrame:
        """Adds (text, metadata) and returns document_id, text; rows that bring a document_id keep it."""
        if "document_id" in texts.columns:
            self.store.add(texts)
            return texts.select("document_id", "text")
        return self.store.add_unnamed(texts)

    def similar(self, queries: DataFrame, k: int = 4, filter: dict | None = None) -> DataFrame:
        """query_id, rank, score, document_id, text, metadata."""
        hits = self.store.search(queries, k, filter)
        texts = self.store.documents.select("document_id", "text")
        return hits.join(texts, "document_id").select("query_id", "rank", "score", "document_id", "text", "metadata")

    def delete(self, ids: list[str]) -> int:
        return self.store.remove(ids)


class Nodes:
    """Callers whose rows are nodes of source documents: the metadata field ``ref_doc_id`` names the source."""

    def __init__(self, store: Collection):
        self.store = store

    def delete(self, ref_doc_id: str) -> int:
        return self.store.remove_matching({"ref_doc_id": ref_doc_id})

    def delete_nodes(self, ids: list[str] | None = None, conditions: list[dict] | None = None, combine: str = "and") -> int:
        if ids is None and not conditions:
            raise FilterError("name the nodes by ids or conditions")
        rows = self.store.documents
        rows = rows.filter(F.col("document_id").isin(ids)) if ids is not None else rows
        rows = apply_filter(rows, from_conditions(conditions, combine)) if conditions else rows
        return self.store.remove(rows.select("document_id"))

    def get(self, ids: list[str]) -> DataFrame:
        """position, document_id, text, metadata in the order of the request; unknown ids are left out, repeated ones come once."""
        asked = self.store.spark.createDataFrame([(i, d) for i, d in enumerate(dict.fromkeys(ids))], "position int, document_id string")
        return asked.join(self.store.documents, "document_id").select("position", "document_id", "text", "metadata").orderBy("position")

    def query(self, queries: DataFrame, k: int, mode: str = "default", conditions: list[dict] | None = None, combine: str = "and", node_ids: list[str] | None = None, doc_ids: list[str] | None = None) -> DataFrame:
        """``node_ids`` and ``doc_ids`` (sources) restrict the rows; an empty list of either means no hits. Reranking for diversity is refused."""
        if mode not in ("default", "text_search", "hybrid"):
            raise ValueError(f"{mode} is no mode of this store")
        if node_ids == [] or doc_ids == []:
            return _none(self.store.spark)
        tree = _and(from_conditions(conditions, combine) if conditions else None, {"ref_doc_id": {"$in": doc_ids}} if doc_ids else None)
        ids = self.store.spark.createDataFrame([(i,) for i in node_ids], "document_id string") if node_ids else None
        return search_within(self.store, queries, k, tree, ids, {"default": "vector", "text_search": "lexical", "hybrid": "hybrid"}[mode])


class Memories:
    """Callers that keep memories under filters with AND, OR, NOT and lists."""

    def __init__(self, store: Collection):
        self.store = store

    def insert(self, rows: DataFrame) -> None:
        """(document_id, vector, metadata, optional text)."""
        self.store.add_vectors(rows)

    def search(self, queries: DataFrame, k: int = 5, filters: dict | None = None) -> DataFrame:
        return search_within(self.store, queries, k, from_memory_filters(filters) if filters else None, mode="vector")

    def keyword_search(self, queries: DataFrame, k: int = 5, filters: dict | None = None) -> DataFrame:
        """By words (query_id, text), with the statistics of the matching rows alone."""
        from ..functions.text import tokenize

        kept = apply_filter(self.store.documents, from_memory_filters(filters) if filters else None)
        units = self.store.chunks.join(kept.select("document_id"), "document_id", "left_semi")
        asked = queries.select("query_id", tokenize(F.col("text")).alias("tokens"))
        hits = bm25_topk(asked, units, k, "chunk_id")
        return hits.join(units.select("chunk_id", "document_id"), "chunk_id").join(kept.select("document_id", "metadata"), "document_id").select("query_id", "rank", "score", "chunk_id", "document_id", "metadata")

    def get(self, ident: str) -> DataFrame:
        return self.store.documents.filter(F.col("document_id") == ident).select("document_id", "text", "metadata")

    def list(self, filters: dict | None = None, top_k: int | None = 100) -> DataFrame:
        """The first rows by id."""
        kept = apply_filter(self.store.documents, from_memory_filters(filters) if filters else None)
        return list_page(kept.select("document_id", "text", "metadata"), limit=top_k)

    def update(self, ident: str, vector: list[float] | None = None, metadata: dict | None = None, text: str | None = None) -> None:
        """Changes what is given; a new vector keeps the metadata and text that are not given."""
        if vector is None:
            self.store.update_payload(ident, metadata, text)
            return
        old = self.get(ident).first()
        if old is None:
            raise ValueError(f"no memory {ident!r}")
        row = (ident, [float(x) for x in vector], old["metadata"] if metadata is None else metadata, old["text"] if text is None else text)
        self.store.add_vectors(self.store.spark.createDataFrame([row], "document_id string, vector array<float>, metadata map<string,string>, text string"))

    def delete(self, ids: list[str]) -> int:
        return self.store.remove(ids)

    def delete_all(self, filters: dict | None = None) -> int:
        kept = apply_filter(self.store.documents, from_memory_filters(filters) if filters else None)
        return self.store.remove(kept.select("document_id"))

    def info(self) -> dict:
        s = self.store.stats()
        return {"rows": s["documents"], "dim": s["dim"]}


class Points:
    """Callers with many named spaces that rank by distance; a space that does not exist holds nothing."""

    def __init__(self, spaces: Spaces):
        self.spaces = spaces

    def _open(self, space: str) -> Collection | None:
        return self.spaces.open(space) if space in self.spaces.names() else None

    def upsert(self, space: str, rows: DataFrame, config: Config) -> None:
        """(document_id, text, metadata) or, with a vector column, vectors; the space is made if need be."""
        store = self._open(space) or self.spaces.create(space, config)
        store.add_vectors(rows) if "vector" in rows.columns else store.add(rows)

    def retrieve(self, space: str, ids: list[str]) -> DataFrame:
        store = self._open(space)
        if store is None:
            return self.spaces.spark.createDataFrame([], "document_id string, text string, metadata map<string,string>")
        return store.documents.filter(F.col("document_id").isin(ids)).select("document_id", "text", "metadata")

    def search(self, space: str, queries: DataFrame, limit: int | None = 10, tags: dict | None = None) -> DataFrame:
        """Hits with ``score`` = 1 - cosine, nearest first; without ``limit`` all rows come."""
        store = self._open(space)
        if store is None:
            return _none(self.spaces.spark)
        k = limit if limit is not None else max(1, store.chunks.count())
        if "vector" in queries.columns:
            queries = queries.withColumn("vector", l2_normalize(F.col("vector")))
        return distance(store.search(queries, k, tags, "vector"))

    def delete(self, space: str, ids: list[str]) -> int:
        store = self._open(space)
        return store.remove(ids) if store is not None else 0

    def remove_tags(self, space: str, tags: list[str], ids: list[str] | None = None) -> None:
        store = self._open(space)
        if store is not None:
            store.remove_tags(tags, ids=ids)

    def prune(self) -> list[str]:
        """Drops all spaces and returns their names."""
        from .files import Folder

        names = self.spaces.names()
        for name in names:
            Folder(self.spaces.spark, self.spaces.root).delete(name)
        return names


class Passages:
    """Callers that restrict a query by ids, by source documents and by two filters at once."""

    def __init__(self, store: Collection):
        self.store = store

    def query(self, queries: DataFrame, k: int, ids: list[str] | None = None, doc_ids: list[str] | None = None, filters: dict | None = None, where: dict | None = None) -> DataFrame:
        """Rows must be in every list that is given (an empty one means no hits) and match both filters."""
        lists = [x for x in (ids, doc_ids) if x is not None]
        tree = _and(from_pairs(filters) if filters else None, where)
        if not lists:
            return search_within(self.store, queries, k, tree, mode="vector")
        both = set(lists[0]).intersection(*lists[1:])
        if not both:
            return _none(self.store.spark)
        return search_within(self.store, queries, k, tree, self.store.spark.createDataFrame([(i,) for i in sorted(both)], "document_id string"), "vector")

    def delete(self, ids: list[str]) -> int:
        return self.store.remove(ids)

    def count(self) -> int:
        return self.store.count()
