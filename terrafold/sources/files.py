"""Digests of files of any size, made by executors."""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A file of more bytes than this is read piece by piece; a smaller one is one value of a row.
WHOLE = 64 << 20
#: Bytes of a piece.
PIECE = 8 << 20

# Executors get this module's functions by value, so they need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def opened(path: str):
    """A stream of a file's bytes; path as Spark names it (file:/a, hdfs://host/a, s3a://bucket/a)."""
    from pyarrow import fs

    found = re.match(r"([a-z][a-z0-9+.-]*)://([^/]*)(/.*)", path, re.DOTALL)
    if path.startswith("file:") or not found:
        return fs.LocalFileSystem().open_input_stream(re.sub(r"^file:/+", "/", path))
    scheme = {"s3a": "s3", "s3n": "s3"}.get(found[1], found[1])
    system, root = fs.FileSystem.from_uri(f"{scheme}://{found[2]}/")
    return system.open_input_stream(root.rstrip("/") + found[3])


def sha256_of(path: str) -> str:
    digest = hashlib.sha256()
    with opened(path) as read:
        while piece := read.read(PIECE):
            digest.update(piece)
    return digest.hexdigest()


def file_digests(spark: SparkSession, path: str, whole: int = WHOLE) -> DataFrame:
    """(path, length, sha256) of the files under a path.

    Files up to `whole` bytes are read by Spark, from any store it knows. Larger ones are streamed by a task each, in pieces,
    so no task holds a file and none is too large; their store must be one that Arrow opens too (local, HDFS, S3, GCS).
    Spark itself packs the files into tasks by their lengths, so contents are read once and not shuffled. Its scans pass over
    empty files, which are taken from its listing: names, no contents, reach the driver, where that listing is."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sha256_of(p) for p in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.string())], ["path", "length", "sha256"])

    small = listed.where(F.col("length") <= whole).select("path", "length", F.sha2("content", 256).alias("sha256"))
    large = listed.where(F.col("length") > whole).select("path", "length").mapInArrow(streamed, "path string, length long, sha256 string")
    names = spark.createDataFrame([(re.sub("^file:/+", "file:/", unquote(n)),) for n in listed.inputFiles()], "path string")
    empty = names.join(listed.select("path"), "path", "left_anti").select("path", F.lit(0).cast("long").alias("length"), F.lit(hashlib.sha256().hexdigest()).alias("sha256"))
    return small.unionByName(large).unionByName(empty)
