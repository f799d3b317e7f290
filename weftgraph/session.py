"""What a session needs: workers that can import this package, and tables written to the shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_shipped: set[str] = set()
#: Rows of an Arrow batch, where the session has Spark's own number: texts are long, and a batch is held by JVM and worker.
BATCH, _BATCH_KEY, _SPARKS_BATCH = 2_000, "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def prepare(spark: SparkSession) -> SparkSession:
    """Let workers find the package: by its folder on one machine, as a zip on a cluster. Once for each application."""
    sc = spark.sparkContext
    if spark.conf.get(_BATCH_KEY, _SPARKS_BATCH) == _SPARKS_BATCH:
        spark.conf.set(_BATCH_KEY, str(BATCH))
    if sc.applicationId in _shipped:
        return spark
    if sc.master.startswith("local"):
        known = sc.environment.get("PYTHONPATH", "")
        sc.environment["PYTHONPATH"] = f"{_ROOT}{os.pathsep}{known}" if known else _ROOT
    else:
        path = os.path.join(tempfile.mkdtemp(prefix="weftgraph-"), "weftgraph.zip")  # Spark's file server hands it out
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, names in os.walk(os.path.join(_ROOT, "weftgraph")):
                for n in names:
                    if n.endswith(".py"):
                        full = os.path.join(folder, n)
                        z.write(full, os.path.relpath(full, _ROOT))
        sc.addPyFile(path)
    _shipped.add(sc.applicationId)
    return spark


#: Bytes of a shuffle's part and of a file's split at most: rows take some fifty times these bytes, compressed, in a task's memory.
PART, SPLIT = 8 << 20, 32 << 20
#: Bytes of input for each part that a shuffle starts with, and such parts at most; adaptive execution joins small ones.
PART_INPUT, PARTS = 2 << 20, 4_000


def dealt(spark: SparkSession, folder: str) -> SparkSession:
    """Let tasks hold a bounded share of the tables in ``folder``, whatever their size; smaller shares of the session stay."""
    conf = spark._jsparkSession.sessionState().conf()
    number = lambda key: spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(conf.getConfString(key))
    for key, most in (("spark.sql.adaptive.advisoryPartitionSizeInBytes", PART), ("spark.sql.files.maxPartitionBytes", SPLIT)):
        if number(key) > most:
            spark.conf.set(key, str(most))
    path, files = _hadoop(spark, folder)
    parts = min(PARTS, files.getContentSummary(path).getLength() // PART_INPUT)
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    if parts > int(spark.conf.get(key, None) or spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set(key, str(parts))
    return spark


_folders: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where the session names none, a local session gets a temporary folder of its own; a cluster
    has no folder that is safe to guess, so that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = f"file://{tempfile.mkdtemp(prefix='weftgraph-')}"
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def written(df: DataFrame) -> DataFrame:
    """``df``, written as Parquet to the shared folder and read again: its lineage ends in files that outlive executors.

    The application's files go when the driver ends, or with ``discard``.
    """
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/weftgraph/{spark.sparkContext.applicationId}"
    if folder not in _folders:
        _folders.add(folder)
        path, files = _hadoop(spark, folder)
        files.mkdirs(path)
        files.deleteOnExit(path)
    at = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out._written_at = at
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a written table that nothing will read any more."""
    path, files = _hadoop(df.sparkSession, df._written_at)
    files.delete(path, True)


def _hadoop(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def small(df: DataFrame, rows: int) -> DataFrame:
    """A written ``df``, marked for broadcast if it has at most so many rows; else joins shuffle it."""
    return F.broadcast(df) if df.count() <= rows else df
