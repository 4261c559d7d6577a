"""Shared pieces of the training-data operators."""

from __future__ import annotations

import atexit
import re
import shutil
import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but a space or the ASCII controls tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes, and rows, that go to Python at a time: whole texts are long, and their buffers are kept off the heap.
ARROW_BYTES, ARROW_ROWS = 16 << 20, 1000

#: Rows and bytes (as JSON) of a side table up to which it is broadcast; beyond either, it is joined by shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20


def ship(module: str) -> None:
    """Send a module's functions to Python workers by value, so executors need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


ship(__name__)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir). Only a local session may do without: it gets a temporary one."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="shared-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Bound what the session sends to Python workers at a time; narrower settings stay. Operators with Python code call it."""
    for name, most in (("maxBytesPerBatch", ARROW_BYTES), ("maxRecordsPerBatch", ARROW_ROWS)):
        now = re.sub(r"\D", "", spark.conf.get(f"spark.sql.execution.arrow.{name}") or "")
        if not now or not 0 < int(now) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def _path(spark: SparkSession, folder: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def saved(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts lineage and survives lost executors.

    The table goes when the driver's JVM ends."""
    spark = df.sparkSession
    small_batches(spark)
    folder = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    at, fs = _path(spark, folder)
    fs.deleteOnExit(at)
    df.write.parquet(folder, compression=codec)
    return spark.read.schema(df.schema).parquet(folder)


def drop_saved(df: DataFrame) -> None:
    """Delete the tables that saved() wrote and df reads, once nothing reads them any more; other files stay."""
    spark = df.sparkSession
    at, fs = _path(spark, shared_dir(spark))
    root = fs.makeQualified(at).toUri().getPath().rstrip("/") + "/"
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        at, fs = _path(spark, folder)
        if fs.makeQualified(at).toUri().getPath().startswith(root):
            fs.delete(at, True)


def small(df: DataFrame) -> DataFrame:
    """Mark a side table for broadcast if its rows and bytes are within the limits; otherwise leave the join to shuffle."""
    rows, size = df.limit(BROADCAST_ROWS + 1).agg(F.count(F.lit(1)), F.sum(F.octet_length(F.to_json(F.struct("*"))))).head()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES else df


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
