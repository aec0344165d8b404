"""Importers: other stores' exports as one uniform row, and the job that loads them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.text import id_fingerprint

EXPORT = "id string, text string, metadata map<string,string>, vector array<float>, ref_doc_id string, raw_payload string"
_META = "map<string,string>"


def _uniform(df: DataFrame, **columns) -> DataFrame:
    kinds = dict(c.split(" ", 1) for c in EXPORT.split(", "))
    return df.select(*[columns.get(n, F.lit(None)).cast(t).alias(n) for n, t in kinds.items()])


def from_jdbc(
    spark: SparkSession, url: str, table: str, ident: str, text: str, vector: str, metadata: str | None = None, partitions: int = 8, bounds: tuple[int, int] | None = None,
    columns: list[str] | None = None, after: str | int | None = None, **options,
) -> DataFrame:
    """A table with a vector column (as text ``[1,2]``), read in ranges of a numeric key if ``bounds`` are given.

    ``columns`` become metadata beside the JSON of ``metadata``; with ``after``
    only rows with a greater key are read, so an import can go on where an
    earlier one ended. Only the named columns and rows leave the database.
    """
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if bounds:
        reader = reader.option("partitionColumn", ident).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", partitions)
    return from_vector_table(reader.load(), ident, text, vector, metadata, columns, after)


def from_vector_table(rows: DataFrame, ident: str, text: str, vector: str, metadata: str | None = None, columns: list[str] | None = None, after: str | int | None = None) -> DataFrame:
    if after is not None:
        rows = rows.filter(F.col(ident) > F.lit(after))
    values = F.from_json(F.col(vector).cast("string"), "array<float>")
    meta = F.from_json(F.col(metadata).cast("string"), _META) if metadata else F.lit(None).cast(_META)
    if columns:
        pairs = F.filter(F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).cast("string").alias("v")) for c in columns]), lambda p: p["v"].isNotNull())
        meta = F.map_concat(F.map_filter(F.coalesce(meta, F.create_map().cast(_META)), lambda k, v: ~k.isin(columns)), F.map_from_entries(pairs))
    return _uniform(rows, id=F.col(ident), text=F.col(text), vector=values, metadata=meta)


def from_points(spark: SparkSession, path: str) -> DataFrame:
    """Exported points, one JSON object per line: id, vector, payload."""
    rows = spark.read.text(path)
    p = F.get_json_object("value", "$.payload")
    text = F.coalesce(F.get_json_object(p, "$.data"), F.get_json_object(p, "$.text"), F.get_json_object(p, "$.memory"))
    meta = F.map_filter(F.from_json(p, _META), lambda k, v: ~k.isin("data", "text", "memory") & v.isNotNull())
    return _uniform(rows, id=F.get_json_object("value", "$.id"), vector=F.from_json(F.get_json_object("value", "$.vector"), "array<float>"), text=text, metadata=meta, raw_payload=p)


def from_memory_dump(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object that maps ids to {text, metadata, vector}."""
    whole = spark.read.text(path, wholetext=True)
    entries = whole.select(F.explode(F.from_json("value", "map<string,struct<id:string,text:string,metadata:map<string,string>,vector:array<float>>>")).alias("k", "v"))
    return _uniform(entries, id=F.coalesce("v.id", "k"), text=F.col("v.text"), metadata=F.col("v.metadata"), vector=F.col("v.vector"))


def from_docstore(spark: SparkSession, path: str) -> DataFrame:
    """A docstore JSON: ``docstore/data`` maps node ids to ``{"__data__": {text, metadata, relationships}}``."""
    whole = spark.read.text(path, wholetext=True)
    data = F.get_json_object("value", "$['docstore/data']")
    entries = whole.select(F.explode(F.from_json(data, "map<string,struct<__data__:string>>")).alias("k", "v"))
    inner = F.col("v.__data__")
    ref = F.get_json_object(inner, "$.relationships.1.node_id")
    return _uniform(entries, id=F.col("k"), text=F.get_json_object(inner, "$.text"), metadata=F.from_json(F.get_json_object(inner, "$.metadata"), _META), ref_doc_id=ref, raw_payload=inner)


def from_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files; the path is the id."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("id"), F.col("value").alias("text"))
    return _uniform(rows, id=F.col("id"), text=F.col("text"))


def validate(rows: DataFrame, dim: int | None = None) -> DataFrame:
    """One row: rows, blank_ids, repeated_ids, unsound_vectors, dims."""
    unsound = F.col("vector").isNotNull() & ~V.valid_vector(F.col("vector"), dim)
    base = rows.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.coalesce(F.trim("id") == "", F.lit(True))).alias("blank_ids"),
        F.count_if(unsound).alias("unsound_vectors"),
        F.array_sort(F.collect_set(F.size("vector"))).alias("dims"),
    )
    repeated = rows.groupBy("id").count().filter("count > 1").agg(F.count(F.lit(1)).alias("repeated_ids"))
    return base.crossJoin(repeated)


def load(rows: DataFrame, collection, dry_run: bool = False) -> dict:
    """Checks an export and adds it to a collection in one commit; nothing is written if the check fails or for a dry run."""
    report = validate(rows, collection.config.dim).first().asDict()
    report["ok"] = not (report["blank_ids"] or report["repeated_ids"] or report["unsound_vectors"])
    if report["ok"] and not dry_run:
        docs = rows.withColumnRenamed("id", "document_id")
        if rows.filter(F.col("vector").isNull()).isEmpty():
            collection.add_vectors(docs.select("document_id", "vector", "metadata", "text"))
        else:
            collection.add(docs.select("document_id", "text", "metadata"))
    return report


def sample_report(rows: DataFrame, every: int) -> DataFrame:
    """Every n-th id, by hash order, as a fingerprint: no payload leaves the report."""
    return rows.filter(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).select(id_fingerprint(F.col("id")).alias("fingerprint"), F.length("text").alias("chars"), F.size("vector").alias("dim"))
