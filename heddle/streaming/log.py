"""The append-only change log of a collection: writing it, folding it, shipping parts of it.

Log rows: lsn, op, payload (JSON). Upserts replace a document, deletes remove
it, payload updates change only the fields they carry. What a document is after
any set of records follows from three of them: its newest upsert or delete, and
its newest update of the text and of the metadata. Keeping just these, each with
its number, makes folding independent of the order and number of deliveries:
states merge by the greater number, whatever arrives late or again.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.orphans import key_runs
from ..sources.files import Folder
from ..sources.tables import cut_lineage

LOG = "lsn bigint, op string, payload string"
# fixed values: the operations of the log
OPS = ("upsert_vectors", "apply_embedded_documents", "delete_documents", "update_document_payload")
STATE = "document_id string, metadata map<string,string>, text string, vector array<float>, lsn bigint"
FOLDED = (
    "document_id string, whole struct<at:struct<lsn:bigint,place:int>,kind:string,text:string,metadata:map<string,string>,vector:array<float>>, "
    "new_text struct<lsn:bigint,text:string>, new_metadata struct<lsn:bigint,metadata:map<string,string>>"
)
_DOC = "struct<document_id:string,text:string,metadata:map<string,string>,vector:array<float>>"
_EMPTY = "map<string,string>"


class LogError(ValueError):
    """A log that must not be applied."""


def check_log(log: DataFrame) -> None:
    """Refuses unknown operations, payloads without what their operation needs, missing or repeated sequence numbers."""
    needed = F.when(F.col("op") == "delete_documents", "$.document_ids").when(F.col("op") == "update_document_payload", "$.document_id").otherwise("$.documents")
    has = lambda path: F.get_json_object("payload", path).isNotNull()
    told = F.when(needed == "$.document_ids", has("$.document_ids")).when(needed == "$.document_id", has("$.document_id")).otherwise(has("$.documents"))
    sound = F.col("op").isin(*OPS) & F.col("lsn").isNotNull() & told
    bad = log.filter(~F.coalesce(sound, F.lit(False))).limit(1).collect()
    if bad:
        raise LogError(f"unsupported record: {bad[0]['op']!r} at {bad[0]['lsn']!r}")
    twice = log.groupBy("lsn").count().filter("count > 1").limit(1).collect()
    if twice:
        raise LogError(f"lsn {twice[0]['lsn']} is repeated")


def check_ascending(batch: DataFrame, order: str) -> None:
    """Refuses an external batch whose sequence numbers do not ascend in its own order.

    The rows are sorted across tasks; each task looks at its own slice, and the
    driver compares one row per slice.
    """
    slices = cut_lineage(batch.select(F.col(order).alias("__order"), "lsn").repartitionByRange("__order").withColumn("__slice", F.spark_partition_id()), "ascending")
    before = F.lag("lsn").over(Window.partitionBy("__slice").orderBy("__order", "lsn"))
    ok = slices.withColumn("__b", before).filter((F.col("__b") >= F.col("lsn")) | F.col("lsn").isNull()).isEmpty()
    edges = slices.groupBy("__slice").agg(F.min("__order").alias("o"), F.min("lsn").alias("lo"), F.max("lsn").alias("hi")).orderBy("o").collect()
    if not ok or any(a["hi"] >= b["lo"] for a, b in zip(edges, edges[1:])):
        raise LogError("sequence numbers must ascend")


def document_changes(log: DataFrame) -> DataFrame:
    """One row per document and record: document_id, lsn, place, kind (set, delete, patch), and what it carries."""
    docs = F.from_json(F.get_json_object("payload", "$.documents"), f"array<{_DOC}>")
    ids = F.from_json(F.get_json_object("payload", "$.document_ids"), "array<string>")
    columns = lambda kind, doc: [
        doc("document_id"), "lsn", "place", F.lit(kind).alias("kind"), doc("text"), doc("metadata"), doc("vector"), F.lit(True).alias("has_text"), F.lit(True).alias("has_metadata"),
    ]
    sets = log.filter(F.col("op").isin("upsert_vectors", "apply_embedded_documents")).select("lsn", F.posexplode(docs).alias("place", "d"))
    sets = sets.select(*columns("set", lambda n: F.col(f"d.{n}").alias(n)))
    none = {"document_id": "string", "text": "string", "metadata": "map<string,string>", "vector": "array<float>"}
    deletes = log.filter("op = 'delete_documents'").select("lsn", F.posexplode(ids).alias("place", "id"))
    deletes = deletes.select(*columns("delete", lambda n: (F.col("id") if n == "document_id" else F.lit(None)).cast(none[n]).alias(n)))
    patch = log.filter("op = 'update_document_payload'")
    keys = F.json_object_keys("payload")
    patches = patch.select(
        F.get_json_object("payload", "$.document_id").alias("document_id"), "lsn", F.lit(0).alias("place"), F.lit("patch").alias("kind"),
        F.get_json_object("payload", "$.text").alias("text"), F.from_json(F.get_json_object("payload", "$.metadata"), "map<string,string>").alias("metadata"),
        F.lit(None).cast("array<float>").alias("vector"), F.array_contains(keys, "text").alias("has_text"), F.array_contains(keys, "metadata").alias("has_metadata"),
    )
    return sets.unionByName(deletes).unionByName(patches).filter(F.col("document_id").isNotNull())


def fold_changes(changes: DataFrame) -> DataFrame:
    """``FOLDED`` rows of document changes: one aggregation, combined before its shuffle, so long histories stay small."""
    at = F.struct("lsn", "place")
    whole, text, metadata = F.col("kind") != "patch", (F.col("kind") == "patch") & F.col("has_text"), (F.col("kind") == "patch") & F.col("has_metadata")
    newest = lambda value, hit, by: F.max_by(value, F.when(hit, by))
    return changes.groupBy("document_id").agg(
        newest(F.struct(at.alias("at"), "kind", "text", "metadata", "vector"), whole, at).alias("whole"),
        newest(F.struct("lsn", "text"), text, F.col("lsn")).alias("new_text"),
        newest(F.struct("lsn", "metadata"), metadata, F.col("lsn")).alias("new_metadata"),
    )


def merge(folded: DataFrame) -> DataFrame:
    """One row per document of ``FOLDED`` rows that may hold several; the order of the rows does not matter, nor do repeats."""
    return folded.groupBy("document_id").agg(
        F.max_by("whole", "whole.at").alias("whole"), F.max_by("new_text", "new_text.lsn").alias("new_text"), F.max_by("new_metadata", "new_metadata.lsn").alias("new_metadata")
    )


def documents_of(folded: DataFrame) -> DataFrame:
    """``STATE`` rows of the documents that stand: an update counts if it is newer than the upsert."""
    newer = lambda c: F.coalesce(F.col(f"{c}.lsn") > F.col("whole.at.lsn"), F.lit(False))
    return folded.filter("whole.kind = 'set'").select(
        "document_id",
        F.coalesce(F.when(newer("new_metadata"), F.col("new_metadata.metadata")).otherwise(F.col("whole.metadata")), F.create_map().cast(_EMPTY)).alias("metadata"),
        F.when(newer("new_text"), F.col("new_text.text")).otherwise(F.col("whole.text")).alias("text"),
        F.col("whole.vector").alias("vector"),
        F.greatest("whole.at.lsn", "new_text.lsn", "new_metadata.lsn").alias("lsn"),
    )


def as_folded(documents: DataFrame) -> DataFrame:
    """Documents (``STATE``) as if each had been upserted at its lsn."""
    at = F.struct("lsn", F.lit(0).alias("place")).alias("at")
    kinds = dict(c.split(" ", 1) for c in FOLDED.split(", "))
    none = lambda c: F.lit(None).cast(kinds[c]).alias(c)
    return documents.select("document_id", F.struct(at, F.lit("set").alias("kind"), "text", "metadata", "vector").alias("whole"), none("new_text"), none("new_metadata"))


def fold(base: DataFrame, log: DataFrame, watermark: int = 0) -> DataFrame:
    """The documents after all records above ``watermark``: columns of ``STATE``, as has ``base``.

    Updates of unknown documents have no effect. Applying the same records
    again, or in another order, changes nothing.
    """
    changes = fold_changes(document_changes(log.filter(F.col("lsn") > watermark)))
    return documents_of(merge(as_folded(base).unionByName(changes)))


def last_writers(log: DataFrame, key: str, sequence: str, deleted) -> DataFrame:
    """For logs of whole rows: the newest row per key, without the keys whose newest row is a delete (``deleted``: a Column)."""
    rows = log.groupBy(key).agg(F.max_by(F.struct(*[F.col(c) for c in log.columns if c != key], deleted.alias("__gone")), sequence).alias("r"))
    return rows.filter("not r.__gone").select(key, *[F.col(f"r.{c}").alias(c) for c in log.columns if c != key])


class LogFolder:
    """Folds log files (JSON lines) that arrive in a folder.

    Every micro-batch reduces its own records and writes ``delta/v<batch>``,
    the numbers it has seen as runs, and the lines it could not read; a batch
    that is run again overwrites its own folders. The state is the merge of the
    last base and the deltas after it; ``checkpoint`` folds them into a new
    base. Since states merge in any order, files may arrive late, twice and
    mixed up: deletes are kept as such and outlive redelivered upserts.
    """

    def __init__(self, spark: SparkSession, log_dir: str, out: str):
        self.spark, self.log_dir, self.out = spark, log_dir.rstrip("/"), out.rstrip("/")
        self.folder = Folder(spark, self.out)

    def run(self, max_files_per_trigger: int | None = None) -> DataFrame:
        """Folds what is there now and returns the documents.

        Lines that are no JSON, such as one that was torn while being written,
        are kept in ``rejected``. Records with an unknown operation, an
        incomplete payload, or one number for two contents stop the run.
        """
        reader = self.spark.readStream
        if max_files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)

        def step(batch: DataFrame, batch_id: int) -> None:
            lines = batch.filter("trim(value) <> ''").select("value", F.from_json("value", f"{LOG}, __bad string", {"columnNameOfCorruptRecord": "__bad"}).alias("r")).persist()
            try:
                log = lines.filter("r.__bad is null").select("r.lsn", "r.op", "r.payload").distinct()
                check_log(log)
                put = lambda df, kind: df.write.mode("overwrite").parquet(f"{self.out}/{kind}/v{batch_id:08d}")
                put(lines.filter("r.__bad is not null").select("value"), "rejected")
                put(key_runs(log.select(F.lit(0).alias("log"), F.col("lsn").alias("value")), ["log"]).select("run_start", "run_end"), "seen")
                put(fold_changes(document_changes(log)), "delta")
            finally:
                lines.unpersist()

        stream = reader.text(self.log_dir).writeStream.foreachBatch(step).option("checkpointLocation", f"{self.out}/checkpoint")
        stream.trigger(availableNow=True).start().awaitTermination()
        deltas = self._since_base()[1]
        if checkpoint_due(len(deltas), sum(self.folder.size(f"delta/{v}") for v in deltas)):
            self.checkpoint()
        return self.state()

    def _versions(self, kind: str) -> list[str]:
        return [v for v in self.folder.names(kind) if self.folder.exists(f"{kind}/{v}/_SUCCESS")]

    def _since_base(self) -> tuple[str | None, list[str]]:
        bases = self._versions("base")
        base = bases[-1] if bases else None
        return base, [v for v in self._versions("delta") if base is None or v > base]

    def _all(self, kind: str, schema: str, versions: list[str] | None = None) -> DataFrame:
        paths = [f"{self.out}/{kind}/{v}" for v in (self._versions(kind) if versions is None else versions)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def folded(self) -> DataFrame:
        base, deltas = self._since_base()
        return merge(self._all("base", FOLDED, [base] if base else []).unionByName(self._all("delta", FOLDED, deltas)))

    def state(self) -> DataFrame:
        """The documents after all records folded so far (``STATE``)."""
        return documents_of(self.folded())

    def checkpoint(self) -> None:
        """Folds all deltas into a new base and deletes them, and bases before the last one."""
        base, deltas = self._since_base()
        if not deltas:
            return
        self.folded().write.mode("overwrite").parquet(f"{self.out}/base/{deltas[-1]}")
        for v in deltas:
            self.folder.delete(f"delta/{v}")
        if base:
            self.folder.delete(f"base/{base}")

    def rejected(self) -> DataFrame:
        """The lines that could not be read: value."""
        return self._all("rejected", "value string")

    def seen(self) -> DataFrame:
        return self._all("seen", "run_start bigint, run_end bigint")

    def applied_lsn(self) -> int:
        """The greatest number folded so far, whatever became of its documents; 0 before the first."""
        return self.seen().agg(F.coalesce(F.max("run_end"), F.lit(0))).first()[0]

    def has_applied(self, lsn: int) -> bool:
        """Whether this very record is in the state; numbers below ``applied_lsn`` may still be on their way."""
        return not self.seen().filter((F.col("run_start") <= lsn) & (F.col("run_end") >= lsn)).isEmpty()

    def wait_for(self, lsn: int, timeout: float = 60.0) -> bool:
        """Read your writes: folds until the record is in the state, or the time is up."""
        until = time.monotonic() + timeout
        while not self.has_applied(lsn):
            if time.monotonic() > until:
                return False
            self.run()
            if not self.has_applied(lsn):
                time.sleep(min(1.0, max(0.0, until - time.monotonic())))
        return True


# fixed values: records and bytes after which deltas are folded into a base
def checkpoint_due(ops: int, size_bytes: int, max_ops: int = 1000, max_bytes: int = 64 << 20) -> bool:
    return ops >= max_ops or size_bytes >= max_bytes


# --- writing


class Appender:
    """Writes records to a log folder; any number of processes may do so at the same time.

    Numbers are allocated in ranges: the claim on a range is a file named after
    its first number that only one writer can create.
    """

    def __init__(self, spark: SparkSession, log_dir: str):
        self.spark, self.folder = spark, Folder(spark, log_dir)

    def allocate(self, n: int) -> int:
        """The first of ``n`` consecutive numbers that no one else gets; they start at 1."""
        if n < 1:
            raise LogError("at least one number")
        while True:
            claims = self.folder.names("_lsn")
            first = int(self.folder.read(f"_lsn/{claims[-1]}") or claims[-1]) + 1 if claims else 1
            if self.folder.create_once(f"_lsn/{first:020d}", str(first + n - 1)):
                return first

    def append(self, records: list[tuple[str, dict]]) -> list[int]:
        """Appends (op, payload) records as one file and returns their numbers."""
        for op, payload in records:
            if op not in OPS:
                raise LogError(f"unsupported operation {op!r}")
            ids = payload.get("document_ids") if op == "delete_documents" else [d.get("document_id") for d in payload.get("documents", [payload])]
            if not ids or not all(isinstance(i, str) and i.strip() for i in ids):
                raise LogError("records name their documents")
        if not records:
            return []
        first = self.allocate(len(records))
        lines = [json.dumps({"lsn": first + i, "op": op, "payload": json.dumps(payload)}) for i, (op, payload) in enumerate(records)]
        self.folder.create_once(f"{first:020d}-{uuid.uuid4().hex}.json", "\n".join(lines) + "\n")
        return list(range(first, first + len(records)))

    def append_documents(self, documents: DataFrame, per_record: int = 1000) -> tuple[int, int]:
        """Appends embedded documents (document_id, text, metadata, vector) as upserts; first and last number.

        The documents are packed and numbered by the tasks that hold them; the driver sees one count per task.
        """
        doc = F.struct("document_id", "text", "metadata", "vector")
        place = Window.partitionBy("__task").orderBy("document_id")
        placed = documents.withColumn("__task", F.spark_partition_id()).withColumn("__n", F.floor((F.row_number().over(place) - 1) / per_record))
        packed = cut_lineage(placed.groupBy("__task", "__n").agg(F.collect_list(doc).alias("documents")), "records")
        counts = packed.groupBy("__task").count().orderBy("__task").collect()
        if not counts:
            return 0, 0
        total = sum(r[1] for r in counts)
        first = self.allocate(total)
        begins, at = [], first
        for task, n in counts:
            begins.append((task, at))
            at += n
        offsets = self.spark.createDataFrame(begins, "__task int, __begin bigint")
        numbered = packed.join(F.broadcast(offsets), "__task")
        line = F.struct((F.col("__begin") + F.col("__n")).alias("lsn"), F.lit("apply_embedded_documents").alias("op"), F.to_json(F.struct("documents")).alias("payload"))
        numbered.select(F.to_json(line).alias("value")).write.mode("append").text(self.folder.root)
        return first, first + total - 1


def write_segment(log: DataFrame, path: str) -> dict:
    """A part of a log as an immutable folder that can be shipped elsewhere; its manifest holds count, range and digest."""
    log.select("lsn", "op", "payload").write.json(f"{path}/records")
    manifest = _digest(log.sparkSession.read.schema(LOG).json(f"{path}/records"))
    if not Folder(log.sparkSession, path).create_once("manifest.json", json.dumps(manifest)):
        raise LogError(f"{path} is written already")
    return manifest


def read_segment(spark: SparkSession, path: str) -> DataFrame:
    """The records of a shipped segment, refused unless they are exactly those that were written."""
    folder = Folder(spark, path)
    if not folder.exists("manifest.json"):
        raise LogError(f"{path} has no manifest")
    log = spark.read.schema(LOG).json(f"{path}/records")
    if _digest(log) != json.loads(folder.read("manifest.json")):
        raise LogError(f"{path} is damaged")
    check_log(log)
    return log


def _digest(log: DataFrame) -> dict:
    """Count, range of numbers, and a sum of row hashes that does not depend on their order."""
    each = F.xxhash64("lsn", "op", "payload").cast("decimal(38,0)")
    return {k: None if v is None else int(v) for k, v in log.agg(F.count(F.lit(1)).alias("records"), F.min("lsn").alias("first"), F.max("lsn").alias("last"), F.sum(each).alias("digest")).first().asDict().items()}
