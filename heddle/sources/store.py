"""Versioned collections of documents and chunks on Parquet.

A collection is a folder: ``config.json``, a ``commits`` folder with one small
file per generation, and a ``segments`` folder with tables. A commit lists the
segments that make up its version, the base first; every later one holds the
documents written and the ids removed by one commit, so a small write stays
small. Of several writers that start from the same generation only one can
create the next commit file; the others are refused and their segments belong to
no version. All reads are DataFrames over the version the handle was opened on.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable
from copy import copy
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vectors as V
from ..functions.embedding import HashEmbedder
from ..functions.predicate import apply_filter
from ..operators import ann
from ..operators.multivec import maxsim_topk, mean_pool
from .files import Folder
from .tables import cut_lineage

DOCUMENT = "document_id string, text string, metadata map<string,string>, content_hash string, chunk_count int, patches array<array<float>>"
CHUNK = "document_id string, chunk_id string, position int, text string, tokens array<string>, vector array<float>"
#: Versions to keep beside the current one.
KEEP = 2


class StoreError(ValueError):
    """A write that must not be applied, or a read the collection does not offer."""


@dataclass(frozen=True)
class Config:
    dim: int
    bit_width: int = 4
    store_text: bool = True
    index_text: bool | None = None
    chunk_limit: int = X.CHUNK_LIMIT
    vector_only: bool = False
    model: str | None = None

    def __post_init__(self):
        # fixed values: the limits of dimension and code width
        if not 1 <= self.dim <= 65536 or self.dim % 8:
            raise StoreError("dim is a multiple of 8 from 8 to 65536")
        if self.bit_width not in (2, 4):
            raise StoreError("bit_width is 2 or 4")
        if self.chunk_limit < 1:
            raise StoreError("chunk_limit is positive")

    @property
    def keeps_tokens(self) -> bool:
        return self.store_text if self.index_text is None else self.index_text


# --- pure DataFrame steps


def plan_chunks(documents: DataFrame, limit: int = X.CHUNK_LIMIT) -> DataFrame:
    """document_id, position, text, chunk_hash, chunk_id of (document_id, text) rows.

    Identical chunks of a document are told apart by an occurrence number, so
    chunks are dealt by document and hash; no row holds more than its own chunk.
    """
    each = documents.select("document_id", F.posexplode(X.chunk_text(F.col("text"), limit)).alias("position", "text"))
    hashed = each.withColumn("chunk_hash", X.normalized_chunk_hash(F.col("text")))
    copies = Window.partitionBy("document_id", "chunk_hash").orderBy("position")
    return hashed.withColumn("occurrence", F.row_number().over(copies) - 1).select(
        "document_id", "position", "text", "chunk_hash", X.chunk_id(F.col("document_id"), F.col("chunk_hash"), F.col("occurrence")).alias("chunk_id")
    )


def latest_by_id(batch: DataFrame, seq: str | None) -> DataFrame:
    """Of an id repeated in a batch the last row counts (by ``seq``); without ``seq`` repeats are refused."""
    if seq is None:
        repeated = batch.groupBy("document_id").count().filter("count > 1").limit(3).collect()
        if repeated:
            raise StoreError(f"repeated ids: {[r[0] for r in repeated]}")
        return batch
    order = Window.partitionBy("document_id").orderBy(F.desc(seq))
    return batch.withColumn("__rn", F.row_number().over(order)).filter("__rn = 1").drop("__rn", seq)


def replace_rows(table: DataFrame, rows: DataFrame, key: str = "document_id") -> DataFrame:
    return table.join(rows.select(key).distinct(), key, "left_anti").select(*table.columns).unionByName(rows.select(*table.columns))


def changed_rows(table: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of a batch that differ from the stored ones in content hash, metadata, text or patches (where both tables have these)."""
    kept = [c for c in ("content_hash", "metadata", "text", "patches") if c in rows.columns and c in table.columns]
    same = lambda p: F.struct(*[F.array_sort(F.map_entries(f"{p}{c}")) if c == "metadata" else F.col(f"{p}{c}") for c in kept])
    old = table.select("document_id", *[F.col(c).alias(f"o_{c}") for c in kept])
    return rows.join(old, "document_id", "left").filter(F.col("o_content_hash").isNull() | ~same("").eqNullSafe(same("o_"))).select(*rows.columns)


def list_page(documents: DataFrame, after: str | None = None, limit: int | None = None, ident: str = "document_id") -> DataFrame:
    """Keyset page: ids above ``after`` in ascending order."""
    page = documents.filter(F.col(ident) > after) if after is not None else documents
    page = page.orderBy(ident)
    return page.limit(limit) if limit is not None else page


def vectors_by_request(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """Chunks of requested ids (position, id): an id is a document, else a chunk; each chunk once, at its first request."""
    asked = ids.groupBy("id").agg(F.min("position").alias("request"))
    of_docs = chunks.join(asked.withColumnRenamed("id", "document_id"), "document_id")
    other = asked.join(chunks.select(F.col("document_id").alias("id")).distinct(), "id", "left_anti")
    of_chunks = chunks.join(other.withColumnRenamed("id", "chunk_id"), "chunk_id").select(*of_docs.columns)
    first = Window.partitionBy("chunk_id").orderBy("request")
    rows = of_docs.unionByName(of_chunks).withColumn("__rn", F.row_number().over(first)).filter("__rn = 1")
    return rows.select("request", "document_id", "chunk_id", "position", "vector").orderBy("request", "position")


def needs_compaction(segments: int, changed: int, live: int) -> bool:
    """Whether deltas should be folded into a new base."""
    # fixed values: segments and the share of changed documents
    return segments >= 64 or changed * 4 >= max(live, 1)


# --- the stored collection


@dataclass(frozen=True)
class Segment:
    """Tables written by one commit: ``rows`` documents written and ``gone`` ids removed."""

    path: str
    rows: int
    gone: int


@dataclass(frozen=True)
class Commit:
    generation: int
    applied_lsn: int
    segments: tuple[Segment, ...]
    index: str | None = None

    @classmethod
    def parse(cls, text: str) -> Commit:
        raw = json.loads(text)
        return cls(raw["generation"], raw["applied_lsn"], tuple(Segment(**s) for s in raw["segments"]), raw.get("index"))


class Collection:
    """A handle on one version of a stored collection."""

    def __init__(self, spark: SparkSession, path: str, read_only: bool = False, embed: Callable[[Column], Column] | None = None, generation: int | None = None, embedder=None):
        """``embed`` turns a text Column into vectors; ``embedder`` does so in the roles of document and query. ``generation`` pins an older version."""
        self.spark, self.path, self.read_only = spark, path.rstrip("/"), read_only
        self.folder = Folder(spark, self.path)
        self.config = Config(**json.loads(self.folder.read("config.json")))
        self.embedder = embedder or HashEmbedder(self.config.dim)
        self.embedder.check(self.config.dim)
        self.embed = embed or self.embedder.documents
        self.commit = self._commit_file(generation) if generation is not None else self._latest()

    @classmethod
    def create(cls, spark: SparkSession, path: str, config: Config, **options) -> Collection:
        if not Folder(spark, path).create_once("config.json", json.dumps(asdict(config))):
            raise StoreError(f"{path} exists")
        Folder(spark, path).create_once(f"commits/{0:010d}.json", json.dumps(asdict(Commit(0, 0, ()))))
        return cls(spark, path, **options)

    def _commit_file(self, generation: int) -> Commit:
        name = f"commits/{generation:010d}.json"
        if not self.folder.exists(name):
            raise StoreError(f"no version {generation}")
        return Commit.parse(self.folder.read(name))

    def _latest(self) -> Commit:
        names = [n for n in self.folder.names("commits") if n.endswith(".json")]
        for name in reversed(names):
            try:
                return Commit.parse(self.folder.read(f"commits/{name}"))
            except ValueError:  # the file is just being written
                continue
        raise StoreError(f"{self.path} has no commit")

    @property
    def generation(self) -> int:
        return self.commit.generation

    @property
    def applied_lsn(self) -> int:
        return self.commit.applied_lsn

    def refresh(self) -> None:
        """Moves the handle to the version that is current now."""
        self.commit = self._latest()

    def _read(self, kind: str, schema: str) -> DataFrame:
        """The rows that stand: those of the last segment that wrote or removed their document."""
        segments = self.commit.segments
        parts = lambda kind, schema, least=0: [
            self.spark.read.schema(schema).parquet(f"{self.path}/segments/{s.path}/{kind}").withColumn("__seg", F.lit(i))
            for i, s in enumerate(segments) if i >= least and (s.gone if kind == "gone" else s.rows)
        ]
        tables = parts(kind, schema)
        if not tables:
            return self.spark.createDataFrame([], schema)
        every = tables[0]
        for t in tables[1:]:
            every = every.unionByName(t)
        touched = [t.select("document_id", "__seg") for t in (*parts("documents", DOCUMENT, 1), *parts("gone", "document_id string", 1))]
        if not touched:
            return every.drop("__seg")
        newest = touched[0]
        for t in touched[1:]:
            newest = newest.unionByName(t)
        newest = newest.groupBy("document_id").agg(F.max("__seg").alias("__last"))
        stands = F.col("__last").isNull() | (F.col("__seg") >= F.col("__last"))
        # a document removed by the last segment that touches it has no rows there, so nothing of it stands
        return every.join(newest, "document_id", "left").filter(stands).drop("__seg", "__last")

    @property
    def documents(self) -> DataFrame:
        return self._read("documents", DOCUMENT)

    @property
    def chunks(self) -> DataFrame:
        return self._read("chunks", CHUNK)

    def _write(self, documents: DataFrame | None, chunks: DataFrame | None, gone: DataFrame | None = None, applied_lsn: int | None = None) -> None:
        """Writes a segment and commits it after those of this version; once deltas are many or large they are folded into a new base."""
        if self.read_only:
            raise StoreError("opened read-only")
        if self._latest().generation != self.generation:
            raise StoreError("the collection has moved on since this handle was opened")
        name, sizes = f"{self.generation + 1:010d}-{uuid.uuid4().hex[:12]}", {"documents": 0, "gone": 0}
        for kind, rows in (("documents", documents), ("chunks", chunks), ("gone", gone)):
            if rows is not None:
                path = f"{self.path}/segments/{name}/{kind}"
                rows.write.parquet(path)
                if kind in sizes:
                    sizes[kind] = self.spark.read.parquet(path).count()
        segments = (*self.commit.segments, Segment(name, sizes["documents"], sizes["gone"]))
        deltas = segments[1:]
        if len(deltas) > 1 and needs_compaction(len(deltas), sum(s.rows + s.gone for s in deltas), segments[0].rows):
            segments = (self._folded(segments),)
        self._publish(segments, applied_lsn)

    def _folded(self, segments: tuple[Segment, ...]) -> Segment:
        """What the segments amount to, written as one; documents stay together, chunks in their order."""
        view = copy(self)
        view.commit = Commit(self.generation + 1, self.applied_lsn, segments)
        name = f"{self.generation + 1:010d}-{uuid.uuid4().hex[:12]}"
        path = f"{self.path}/segments/{name}"
        view.documents.write.parquet(f"{path}/documents")
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        view.chunks.repartitionByRange(n, "document_id").sortWithinPartitions("document_id", "position").write.parquet(f"{path}/chunks")
        return Segment(name, self.spark.read.parquet(f"{path}/documents").count(), 0)

    def _publish(self, segments: tuple[Segment, ...], applied_lsn: int | None = None, index: str | None = None) -> None:
        commit = Commit(self.generation + 1, self.applied_lsn if applied_lsn is None else applied_lsn, segments, index)
        if not self.folder.create_once(f"commits/{commit.generation:010d}.json", json.dumps(asdict(commit))):
            raise StoreError("another writer was faster; nothing was changed")
        self.commit = commit

    # writes

    def plan(self, batch: DataFrame, seq: str | None = None) -> dict[str, DataFrame]:
        """What ``add`` would do, without doing it: ``documents`` that change, their ``chunks``, and of these the ``fresh`` ones that need a vector.

        A document with the same text and metadata as the stored one does not change.
        """
        if self.config.vector_only:
            raise StoreError("a vector-only collection takes no text")
        rows = latest_by_id(batch.select("document_id", "text", "metadata", *([seq] if seq else [])), seq)
        self._refuse_ids(rows)
        rows = rows.withColumn("metadata", F.coalesce("metadata", F.create_map().cast("map<string,string>")))
        if self.config.store_text:
            hashed = rows.withColumn("content_hash", X.sha256_text(F.coalesce("text", F.lit(""))))
            hashed = changed_rows(self.documents.select("document_id", "content_hash", "metadata", "text"), hashed)
            planned = cut_lineage(plan_chunks(hashed, self.config.chunk_limit), "plan")
        else:
            planned = cut_lineage(plan_chunks(rows, self.config.chunk_limit), "plan")
        counts = planned.groupBy("document_id").agg(F.count(F.lit(1)).cast("int").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda s: s["text"]), "\n").alias("joined"))
        hashed = (hashed if self.config.store_text else rows).join(counts, "document_id", "left")
        docs = hashed.select(
            "document_id",
            F.col("text") if self.config.store_text else F.lit(None).cast("string").alias("text"),
            "metadata",
            F.col("content_hash") if self.config.store_text else X.sha256_text(F.coalesce("joined", F.lit(""))).alias("content_hash"),
            F.coalesce("n", F.lit(0)).alias("chunk_count"),
            F.lit(None).cast("array<array<float>>").alias("patches"),
        )
        if not self.config.store_text:
            docs = changed_rows(self.documents, docs)
            planned = planned.join(docs.select("document_id"), "document_id", "left_semi").select(*planned.columns)
        known = self.chunks.select("chunk_id")
        return {"documents": docs, "chunks": planned, "fresh": planned.join(known, "chunk_id", "left_anti")}

    def add(self, batch: DataFrame, seq: str | None = None) -> None:
        """Text documents (document_id, text, metadata); a known id is replaced as a whole.

        Chunks that exist already keep their vectors, only new ones are
        embedded. A batch that changes nothing makes no version.
        """
        plan = self.plan(batch, seq)
        docs = cut_lineage(plan["documents"], "batch")
        if docs.isEmpty():
            return
        columns = ["chunk_id", "document_id", "position", "text"]
        reused = plan["chunks"].select(*columns).join(self.chunks.select("chunk_id", "vector"), "chunk_id")
        fresh = plan["fresh"].select(*columns).withColumn("vector", self.embed(F.col("text")).cast("array<float>"))
        self._write(docs, self._chunk_rows(reused.unionByName(fresh)))

    def _chunk_rows(self, made: DataFrame) -> DataFrame:
        text = F.col("text") if self.config.store_text else F.lit(None).cast("string")
        tokens = X.tokenize(F.col("text")) if self.config.keeps_tokens else F.lit(None).cast("array<string>")
        return made.select("document_id", "chunk_id", "position", text.alias("text"), tokens.alias("tokens"), F.col("vector").cast("array<float>").alias("vector"))

    def add_unnamed(self, batch: DataFrame, prefix: str = "doc") -> DataFrame:
        """Adds texts (text, metadata) under ids made from their content, and returns document_id, text; equal texts share one document."""
        named = cut_lineage(batch.withColumn("document_id", F.concat_ws("-", F.lit(prefix), F.substring(X.sha256_text(F.coalesce("text", F.lit(""))), 1, 32))).groupBy("document_id").agg(F.min("text").alias("text"), F.first("metadata").alias("metadata")), "named")
        self.add(named)
        return named.select("document_id", "text")

    def add_vectors(self, batch: DataFrame, seq: str | None = None, normalize: bool = True) -> None:
        """Vector documents (document_id, vector, metadata, optional text and patches), each a single chunk of the same id.

        A batch that changes nothing makes no version.
        """
        for name, kind in (("text", "string"), ("patches", "array<array<float>>")):
            if name not in batch.columns:
                batch = batch.withColumn(name, F.lit(None).cast(kind))
        rows = latest_by_id(batch, seq)
        self._refuse_ids(rows)
        bad = rows.filter(~V.valid_vector(F.col("vector"), self.config.dim) | (V.norm(F.col("vector")) == 0)).select("document_id").limit(3).collect()
        if bad:
            raise StoreError(f"unsound vectors: {[r[0] for r in bad]}")
        vector = (V.l2_normalize(F.col("vector")) if normalize else F.col("vector")).cast("array<float>")
        rows = cut_lineage(rows.withColumn("vector", vector), "batch")  # hashed, stored and joined from one written copy
        docs = rows.select(
            "document_id", F.col("text") if self.config.store_text else F.lit(None).cast("string").alias("text"),
            F.coalesce("metadata", F.create_map().cast("map<string,string>")).alias("metadata"), V.sha256_f32(F.col("vector")).alias("content_hash"), F.lit(1).alias("chunk_count"), "patches",
        )
        docs = cut_lineage(changed_rows(self.documents, docs), "changed")
        if docs.isEmpty():
            return
        made = rows.join(docs.select("document_id"), "document_id", "left_semi").select("document_id", F.col("document_id").alias("chunk_id"), F.lit(0).alias("position"), "text", "vector")
        self._write(docs, self._chunk_rows(made))

    def add_patches(self, batch: DataFrame, seq: str | None = None) -> None:
        """Late-interaction documents (document_id, patches, metadata); their vector is the pooled mean of the patches."""
        pooled = mean_pool(batch.select("document_id", "patches")).withColumnRenamed("vector", "__v")
        self.add_vectors(batch.join(pooled, "document_id").withColumn("vector", F.col("__v").cast("array<float>")).drop("__v"), seq)

    def add_images(self, batch: DataFrame, embed_images: Callable[[Column], Column], seq: str | None = None) -> None:
        """Images (document_id, image binary, metadata) as vector documents; the hook turns the image Column into vectors."""
        self.add_vectors(batch.withColumn("vector", embed_images(F.col("image")).cast("array<float>")).drop("image"), seq)

    def remove(self, ids: list[str] | DataFrame) -> int:
        """Deletes documents (a list of ids or a DataFrame with document_id); unknown and repeated ids do no harm. Returns how many there were."""
        asked = ids.select("document_id").distinct() if isinstance(ids, DataFrame) else self.spark.createDataFrame([(i,) for i in sorted(set(ids))], "document_id string")
        gone = cut_lineage(self.documents.select("document_id").join(asked, "document_id", "left_semi"), "gone")
        n = gone.count()
        if n:
            self._write(None, None, gone)
        return n

    def remove_matching(self, filter: dict) -> int:
        return self.remove(apply_filter(self.documents, filter).select("document_id"))

    def update_payload(self, document_id: str, metadata: dict | None = None, text: str | None = None, clear_text: bool = False) -> None:
        """Changes metadata and/or caption of one document: no text leaves it, ``clear_text`` removes it."""
        hit = F.col("document_id") == document_id
        docs, chunks = self.documents.filter(hit), self.chunks.filter(hit)
        if docs.isEmpty():
            raise StoreError(f"no document {document_id!r}")
        new_text = F.lit(None).cast("string") if clear_text else F.lit(text) if text is not None and self.config.store_text else F.col("text")
        if metadata is not None:
            docs = docs.withColumn("metadata", F.create_map(*[F.lit(x) for kv in metadata.items() for x in kv]).cast("map<string,string>"))
        if clear_text or text is not None:
            tokens = X.tokenize(F.lit(None if clear_text else text).cast("string")) if self.config.keeps_tokens else F.lit(None).cast("array<string>")
            own = F.col("chunk_id") == F.col("document_id")
            chunks = chunks.withColumn("tokens", F.when(own, tokens).otherwise(F.col("tokens"))).withColumn("text", F.when(own, new_text).otherwise(F.col("text")))
        self._write(docs.withColumn("text", new_text), chunks)

    def remove_tags(self, tags: list[str], prefix: str = "tag:", ids: list[str] | None = None) -> None:
        """Strips tags (metadata keys with a prefix) and deletes the rows they leave without any tag."""
        names = [prefix + t for t in tags]
        scope = F.lit(True) if ids is None else F.col("document_id").isin(ids)
        hit = self.documents.filter(scope & F.exists(F.map_keys("metadata"), lambda k: k.isin(names)))
        stripped = cut_lineage(hit.withColumn("metadata", F.map_filter("metadata", lambda k, v: ~k.isin(names))), "stripped")
        tagged = F.exists(F.map_keys("metadata"), lambda k: k.startswith(prefix))
        left = stripped.filter(tagged)
        self._write(left, self.chunks.join(left.select("document_id"), "document_id", "left_semi").select(*self.chunks.columns), stripped.filter(~tagged).select("document_id"))

    def apply_log(self, log: DataFrame, order: str | None = None) -> None:
        """Applies log records (lsn, op, payload) above ``applied_lsn`` in one commit, vectors as they are.

        With ``order`` (a column that tells the order of receipt) records must
        ascend in it, else the whole batch is refused; numbers at or below
        ``applied_lsn`` are skipped. Updates of unknown documents have no effect.
        """
        from ..streaming import log as L

        if order is not None:
            L.check_ascending(log, order)
        L.check_log(log)
        log = log.filter(F.col("lsn") > self.applied_lsn)
        last = log.agg(F.max("lsn")).first()[0]
        if last is None:
            return
        folded = cut_lineage(L.fold_changes(L.document_changes(log)), "folded")
        vectors = self.chunks.filter(F.col("chunk_id") == F.col("document_id")).select("document_id", "vector")
        stored = self.documents.join(vectors, "document_id").join(folded.select("document_id"), "document_id", "left_semi")
        old = L.as_folded(stored.select("document_id", "metadata", "text", "vector", F.lit(self.applied_lsn).cast("bigint").alias("lsn")))
        after = cut_lineage(L.documents_of(L.merge(old.unionByName(folded))), "after")
        bad = after.filter(~V.valid_vector(F.col("vector"), self.config.dim)).select("document_id").limit(3).collect()
        if bad:
            raise StoreError(f"unsound vectors: {[r[0] for r in bad]}")
        docs = after.select("document_id", F.col("text") if self.config.store_text else F.lit(None).cast("string").alias("text"), "metadata", V.sha256_f32(F.col("vector")).alias("content_hash"), F.lit(1).alias("chunk_count"), F.lit(None).cast("array<array<float>>").alias("patches"))
        made = after.select("document_id", F.col("document_id").alias("chunk_id"), F.lit(0).alias("position"), "text", "vector")
        gone = self.documents.select("document_id").join(folded.filter("whole.kind = 'delete'").select("document_id"), "document_id", "left_semi")
        self._write(docs, self._chunk_rows(made), gone, applied_lsn=last)

    def wait_for(self, lsn: int, timeout: float = 60.0) -> bool:
        """Read your writes: refreshes until a version has this record, or the time is up."""
        import time

        until = time.monotonic() + timeout
        while True:
            self.refresh()
            if self.applied_lsn >= lsn or time.monotonic() >= until:
                return self.applied_lsn >= lsn
            time.sleep(min(0.5, max(0.0, until - time.monotonic())))

    def compact(self) -> None:
        """Folds all segments into one base, chunks sorted by document."""
        if self.read_only:
            raise StoreError("opened read-only")
        self._publish((self._folded(self.commit.segments),))

    def rollback(self, generation: int) -> None:
        """Makes the content of an older version, if it is still there, that of a new one."""
        old = self._commit_file(generation)
        if any(not self.folder.exists(f"segments/{s.path}") for s in old.segments):
            raise StoreError(f"version {generation} has been vacuumed")
        self._publish(old.segments, old.applied_lsn)

    def vacuum(self, keep: int = KEEP) -> list[int]:
        """Forgets all versions but the current one and the ``keep`` before it, and deletes the segments and indexes that no version needs."""
        versions = self.versions()
        kept = [v for v in versions if v >= self.generation - keep]
        commits = [self._commit_file(v) for v in kept]
        needed = {s.path for c in commits for s in c.segments}
        for name in self.folder.names("segments"):
            # segments of commits that are still being written are younger than this version
            if name not in needed and int(name.split("-")[0]) <= self.generation:
                self.folder.delete(f"segments/{name}")
        for name in self.folder.names("index"):
            if name not in {c.index for c in commits}:
                self.folder.delete(f"index/{name}")
        gone = [v for v in versions if v not in kept]
        for v in gone:
            self.folder.delete(f"commits/{v:010d}.json")
        return gone

    def versions(self) -> list[int]:
        return sorted(int(n.split(".")[0]) for n in self.folder.names("commits") if n.endswith(".json"))

    def _refuse_ids(self, rows: DataFrame) -> None:
        bad = rows.filter(F.coalesce(F.trim("document_id") == "", F.lit(True))).limit(1).collect()
        if bad:
            raise StoreError("blank document ids")

    # reads

    def get_texts(self, ids: list[str]) -> DataFrame:
        if not self.config.store_text:
            raise StoreError("this collection keeps no text")
        return self.documents.filter(F.col("document_id").isin(ids) & F.col("text").isNotNull()).select("document_id", "text")

    def get_documents(self, ids: list[str]) -> DataFrame:
        return self.documents.filter(F.col("document_id").isin(ids)).select("document_id", "metadata", "chunk_count", "content_hash")

    def get_vectors(self, ids: list[str]) -> DataFrame:
        asked = self.spark.createDataFrame(list(enumerate(ids)), "position int, id string")
        return vectors_by_request(self.chunks, asked)

    def list_documents(self, filter: dict | None = None, after: str | None = None, limit: int | None = None) -> DataFrame:
        kept = apply_filter(self.documents, filter)
        return list_page(kept.select("document_id", "metadata", "chunk_count", "content_hash"), after, limit)

    def count(self, filter: dict | None = None) -> int:
        return apply_filter(self.documents, filter).count()

    def token_lists(self, ids: list[str]) -> DataFrame:
        return self.chunks.filter(F.col("document_id").isin(ids)).select("document_id", "position", "tokens").orderBy("document_id", "position")

    # search

    def build_index(self, clusters: int | None = None) -> None:
        """Writes the chunks by cluster, so that a search reads the clusters it probes, with the exact vectors beside their ids."""
        rows = self.chunks.filter(F.col("vector").isNotNull()).select("chunk_id", "document_id", "vector")
        centroids = ann.build_centroids(rows, "chunk_id", clusters=clusters)
        name = f"{self.generation:010d}-{uuid.uuid4().hex[:12]}"
        centroids.write.parquet(f"{self.path}/index/{name}/centroids")
        assigned = ann.assign(rows, centroids, "chunk_id")
        assigned.repartition("cluster_id", F.pmod(F.xxhash64("chunk_id"), F.lit(ann.files_per_cluster(rows.count(), centroids.count())))).sortWithinPartitions("cluster_id").write.partitionBy("cluster_id").parquet(f"{self.path}/index/{name}/rows")
        self._publish(self.commit.segments, index=name)

    def _indexed(self) -> tuple[DataFrame, DataFrame] | None:
        """(rows with cluster_id, centroids) if this very version has been indexed."""
        if self.commit.index is None:
            return None
        at = f"{self.path}/index/{self.commit.index}"
        return self.spark.read.parquet(f"{at}/rows"), self.spark.read.parquet(f"{at}/centroids")

    def search(self, queries: DataFrame, k: int = 10, filter: dict | None = None, mode: str | None = None, nprobe: int | None = None) -> DataFrame:
        """The ``k`` best chunks per query: query_id, rank, score, chunk_id, document_id, metadata.

        ``queries``: query_id, text and/or vector. ``mode`` is vector, lexical
        or hybrid; None means hybrid where tokens are kept. Vector search goes
        through the cluster index if this version has one, no filter is given and
        probing would skip at least half of the rows; ``nprobe`` 0 asks for the
        exact search, None for as many probes as recall needs.
        """
        from ..plans import search as S

        mode = S.resolve_mode(mode, self.config.keeps_tokens)
        queries = S.with_vectors(queries, mode, self.embedder.queries, self.config.dim)
        index = self._indexed()
        if mode == "vector" and filter is None and index is not None and nprobe != 0:
            rows, centroids = index
            clusters, total = centroids.count(), rows.count()
            probes = nprobe or ann.probes_for_recall(rows, centroids, k, "chunk_id")
            if ann.use_clusters(total, clusters, probes, False, math.ceil(total * probes / clusters)):
                hits = ann.ann_topk(queries, rows, centroids, k, probes, "chunk_id")
                owners = rows.select("chunk_id", "document_id").join(self.documents.select("document_id", "metadata"), "document_id")
                return hits.join(owners, "chunk_id").select("query_id", "rank", "score", "chunk_id", "document_id", "metadata")
        return S.search(self.documents, self.chunks, queries, k, filter, mode, dim=self.config.dim).hits

    def search_patches(self, queries: DataFrame, k: int = 10, filter: dict | None = None) -> DataFrame:
        """Late interaction: query_id, rank, score, document_id of the documents whose patches match the query's (query_id, patches) best."""
        kept = apply_filter(self.documents, filter).filter(F.size("patches") > 0)
        return maxsim_topk(queries, kept.select("document_id", "patches"), k)

    def recall(self, queries: DataFrame, k: int = 10, filter: dict | None = None, mode: str | None = None) -> DataFrame:
        """Fuses the rankings of several sub-queries per question (query_id, sub_query, text): query_id, rank, score, chunk_id, matched."""
        from ..operators.fusion import fuse_subqueries

        each = queries.withColumn("__q", F.struct("query_id", "sub_query"))
        hits = self.search(each.drop("query_id").withColumn("query_id", F.to_json("__q")), k, filter, mode)
        parsed = F.from_json("query_id", queries.select("query_id", "sub_query").schema)
        return fuse_subqueries(hits.withColumn("__q", parsed).select("__q.query_id", "__q.sub_query", "rank", "chunk_id"), "chunk_id", k)

    def stats(self) -> dict:
        docs, chunks, patches = self.documents.agg(F.count(F.lit(1)), F.coalesce(F.sum("chunk_count"), F.lit(0)), F.coalesce(F.sum(F.coalesce(F.size("patches"), F.lit(0))), F.lit(0))).first()
        return {"documents": docs, "chunks": chunks, "patches": patches, "generation": self.generation, "dim": self.config.dim, "bit_width": self.config.bit_width, "applied_lsn": self.applied_lsn}

    def storage(self) -> dict:
        """What the version is made of: segments, documents written and removed since the base, whether it is indexed."""
        deltas = self.commit.segments[1:]
        return {"segments": len(self.commit.segments), "written": sum(s.rows for s in deltas), "removed": sum(s.gone for s in deltas), "indexed": self.commit.index is not None}

    def audit(self, forbidden: list[str] | None = None) -> DataFrame:
        """Findings: chunks without document, documents whose chunk count is wrong, content hashes that do not fit,
        unsound vectors, raw text in a collection that keeps none, and metadata under a ``forbidden`` key."""
        docs, chunks = self.documents, self.chunks
        lost = chunks.join(docs, "document_id", "left_anti").select("document_id", F.lit("chunk without document").alias("finding"))
        counted = chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
        off = docs.join(counted, "document_id", "left").filter(F.col("chunk_count") != F.coalesce("n", F.lit(0))).select("document_id", F.lit("wrong chunk count").alias("finding"))
        bad = chunks.filter(~V.valid_vector(F.col("vector"), self.config.dim)).select("document_id", F.lit("unsound vector").alias("finding"))
        found = lost.unionByName(off).unionByName(bad)
        if self.config.store_text and not self.config.vector_only:
            whole = docs.join(chunks.filter(F.col("chunk_id") == F.col("document_id")).select("document_id"), "document_id", "left_anti")
            found = found.unionByName(whole.filter(X.sha256_text(F.coalesce("text", F.lit(""))) != F.col("content_hash")).select("document_id", F.lit("wrong content hash").alias("finding")))
        own = docs.join(chunks.filter(F.col("chunk_id") == F.col("document_id")).select("document_id", "vector"), "document_id")
        found = found.unionByName(own.filter(V.sha256_f32(F.col("vector")) != F.col("content_hash")).select("document_id", F.lit("wrong content hash").alias("finding")))
        if not self.config.store_text:
            found = found.unionByName(docs.filter(F.col("text").isNotNull()).select("document_id", F.lit("raw text").alias("finding")))
            found = found.unionByName(chunks.filter(F.col("text").isNotNull()).select("document_id", F.lit("raw text").alias("finding")))
        for key in forbidden or []:
            found = found.unionByName(docs.filter(F.map_contains_key("metadata", key)).select("document_id", F.lit(f"forbidden key {key}").alias("finding")))
        return found.distinct()


class Spaces:
    """Several collections below one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def create(self, name: str, config: Config, **options) -> Collection:
        return Collection.create(self.spark, f"{self.root}/{name}", config, **options)

    def open(self, name: str, **options) -> Collection:
        return Collection(self.spark, f"{self.root}/{name}", **options)

    def names(self) -> list[str]:
        folder = Folder(self.spark, self.root)
        return [n for n in folder.names() if folder.exists(f"{n}/config.json")]
