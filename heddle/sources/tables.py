"""Readers and scratch space shared by all queries."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

#: Scratch folders of this process that nobody has swept yet.
_made: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder below the cluster's shared checkpoint folder.

    The folder is read from ``spark.checkpoint.dir``. Only a local master, whose
    tasks all see one disk, may leave it unset: a temporary folder is made then.
    On a cluster that would scatter a table over the disks of the executors, so
    it is refused. Folders are deleted by ``sweep``, at the latest when the
    process ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        made = spark.sparkContext._jsc.sc().getCheckpointDir()
        if made.isDefined():
            base = made.get()
        elif not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        else:
            base = tempfile.mkdtemp(prefix="heddle-")
            atexit.register(shutil.rmtree, base, ignore_errors=True)
            spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(sweep)
    _made.append(path)
    return path


def sweep() -> int:
    """Deletes all scratch folders of this process; DataFrames that still read them cannot be used afterwards."""
    gone = 0
    while _made:
        path = _made.pop()
        try:
            jvm = SparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            context = SparkContext._active_spark_context
            conf = context._jsc.hadoopConfiguration() if context is not None else jvm.org.apache.hadoop.conf.Configuration()
            gone += bool(p.getFileSystem(conf).delete(p, True))
        except Exception:  # the JVM may be gone at the end of the process
            shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)
    return gone


def cut_lineage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a lost executor never
    forces the work behind it to be repeated, and the plan starts afresh."""
    spark = df.sparkSession
    path = scratch_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
