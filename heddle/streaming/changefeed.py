"""Applying a feed of inserts, updates and deletes with keyed streaming state.

Per key the state store holds the last accepted sequence, its payload and
whether it is a tombstone; only newer changes are accepted, so repeated and
out-of-order changes do no harm. Each micro-batch writes the keys it changed
into a folder named after its batch id and overwrites that folder if the batch
is run again, which makes the upserts idempotent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import Folder
from ..sources.tables import scratch_dir

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
VERSION = "applied_batch"


def streaming_session(spark: SparkSession) -> SparkSession:
    """A session of its own for streams, so that their settings touch no other query.

    State grows with the number of keys, so it is kept in RocksDB, not on the heap.
    """
    own = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if name.startswith("spark.sql.") and spark.conf.isModifiable(name):
            own.conf.set(name, value)
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return own


def keyed_upserts(changes: DataFrame, keys: list[str], sequence: Column, payload: Column, out: str, checkpoint: str) -> None:
    """Runs the change stream over all that is available now.

    ``changes`` is a streaming DataFrame, best of a ``streaming_session``. ``sequence`` must order the changes of
    a key; the payload of the greatest one is kept, equal sequences resolve to
    one of their payloads. Changes are combined per task before the shuffle, so
    a key with very many changes stays cheap. Rows appear in
    ``out/applied_batch=N``; a later run with the same checkpoint continues.
    """
    # the batch id is only known inside the sink, hence the partition folder named by hand
    state = changes.groupBy(*keys).agg(F.max_by(payload, sequence).alias("payload"), F.max(sequence).alias("sequence"))

    def emit(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{VERSION}={batch_id}")

    state.writeStream.outputMode("update").foreachBatch(emit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def current_rows(spark: SparkSession, out: str, keys: list[str], done: int = -1) -> DataFrame:
    """The latest accepted payload of each key over all batches written so far.

    ``fresh`` tells whether it was written after batch ``done``, ``replaced``
    whether in that case the key had another payload before.
    """
    rows = spark.read.option("basePath", out).parquet(out)
    before = F.max_by("payload", F.when(F.col(VERSION) <= done, F.col(VERSION)))
    found = rows.groupBy(*keys).agg(F.max_by("payload", VERSION).alias("payload"), F.max(VERSION).alias("__hi"), before.alias("__before"))
    fresh = F.col("__hi") > done
    return found.select(*keys, "payload.*", fresh.alias("fresh"), (fresh & F.col("__before").isNotNull() & ~F.col("__before").eqNullSafe(F.col("payload"))).alias("replaced"))


def journal_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Streams a Parquet folder or a single file; a pattern, since Spark takes plain paths for folders."""
    schema = spark.read.parquet(path).schema
    path = path.rstrip("/")
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


def generation_changes(deliveries: DataFrame) -> DataFrame:
    """One row per document change of the accepted deliveries.

    Columns: store_id, document_id, document_hash, deleted, sequence. Within a
    generation deletes sort before upserts and upserts by their place.
    """
    deletes = F.transform(
        F.coalesce("deletes", F.array().cast("array<string>")),
        lambda d: F.struct(d.alias("document_id"), F.lit(None).cast("string").alias("document_hash"), F.lit(True).alias("deleted"), F.lit(-1).alias("place")),
    )
    upserts = F.transform(
        F.coalesce("upserts", F.array().cast("array<struct<document_id:string,document_hash:string>>")),
        lambda u, i: F.struct(u["document_id"].alias("document_id"), u["document_hash"].alias("document_hash"), F.lit(False).alias("deleted"), i.alias("place")),
    )
    return (
        deliveries.select("store_id", "generation", F.inline(F.concat(deletes, upserts)))
        .filter(F.col("document_id").isNotNull())
        .select("store_id", "document_id", "document_hash", "deleted", F.struct("generation", "place").alias("sequence"))
    )


def apply_journal(spark: SparkSession, path: str, work: str | None = None, max_files_per_trigger: int | None = None) -> DataFrame:
    """The documents each store holds after all its generations: store_id, document_id, document_hash.

    Two keyed streams run one after the other. The first is keyed by store and
    generation, sequenced by received_at, and keeps one delivery of each
    generation; equal received_at resolve to the greater content. The second is
    keyed by store and document, sequenced by generation and place. A call
    applies everything received so far. If ``work`` names the folder of an
    earlier call both streams resume: the second gets the changes of the
    generations that are new. Only if a redelivery replaced a generation that
    had been applied, whose changes keyed state cannot take back, does it start
    afresh from all accepted deliveries.

    Rows without store_id or generation have no place in the order and are
    ignored, as are null documents; null lists are empty; deletes of unknown
    documents have no effect; a null received_at counts as earliest.
    """
    work = work or scratch_dir(spark, "journal")
    own = streaming_session(spark)
    upserts = F.transform("upserted_documents", lambda d: F.struct(d["document_id"].alias("document_id"), d["document_hash"].alias("document_hash")))
    raw = journal_stream(own, path, max_files_per_trigger).filter(F.col("store_id").isNotNull() & F.col("generation").isNotNull())
    delivery = F.struct(upserts.alias("upserts"), F.col("deleted_document_ids").alias("deletes"))
    deliveries = f"{work}/deliveries"
    keyed_upserts(raw, ["store_id", "generation"], F.struct("received_at", delivery.alias("content")), delivery, deliveries, f"{work}/checkpoint-deliveries")

    keys, folder = ["store_id", "generation"], Folder(spark, work)
    batches = [int(n.split("=")[1]) for n in folder.names("deliveries") if n.startswith(f"{VERSION}=")]
    rounds = [n for n in folder.names("applied") if n.startswith("round=")]
    last = rounds[-1] if rounds else None
    done = max((int(n.split("=")[1]) for n in folder.names(f"applied/{last}/changes") if folder.exists(f"applied/{last}/changes/{n}/_SUCCESS")), default=-1) if last else -1
    accepted = current_rows(spark, deliveries, keys, done)
    if last is None:
        last = f"round={0:06d}"
    elif not accepted.filter("replaced").isEmpty():
        last, done = f"round={int(last.split('=')[1]) + 1:06d}", -1
        accepted = current_rows(spark, deliveries, keys, done)
    at = f"{work}/applied/{last}"
    if max(batches) > done:
        generation_changes(accepted.filter("fresh")).write.mode("overwrite").parquet(f"{at}/changes/upto={max(batches)}")
    schema = spark.read.parquet(f"{at}/changes/upto={max(batches)}").schema
    changes = own.readStream.schema(schema).option("basePath", f"{at}/changes").parquet(f"{at}/changes/*")
    keyed_upserts(changes, ["store_id", "document_id"], F.col("sequence"), F.struct("document_hash", "deleted"), f"{at}/documents", f"{at}/checkpoint")
    held = current_rows(spark, f"{at}/documents", ["store_id", "document_id"])
    return held.filter("not deleted").select("store_id", "document_id", "document_hash")
