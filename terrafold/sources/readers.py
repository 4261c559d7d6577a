"""Reading evidence: hashed files, JSON documents, CSV, snapshots, reviewed bundles. Every gate fails closed."""

from __future__ import annotations

import posixpath
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import scope
from ..operators.predicates import must
from .files import file_digests


def file_hashes(spark: SparkSession, path: str, root: str | None = None) -> DataFrame:
    """(path, length, sha256) of files of any size. With a root, a path that does not lie under it once it is resolved is refused
    before anything is read."""
    if root is not None:
        resolve = lambda p: posixpath.normpath(p if "://" in p or p.startswith("/") else posixpath.join(root, p))
        if not (resolve(path) + "/").startswith(resolve(root) + "/"):
            raise ValueError(f"{path} lies outside {root}")
    return file_digests(spark, path)


def json_documents(spark: SparkSession, path: str, row: T.StructType, wrappers: Sequence[str] = ("places", "items", "mentions", "records")) -> DataFrame:
    """Rows of JSON files that are a list, or an object with the list under one of the wrapper names; adds path."""
    read = spark.read.option("wholetext", "true").text(path).select(F.col("value"), F.col("_metadata.file_path").alias("path"))
    lists = T.ArrayType(row)
    wrapped = T.StructType([T.StructField(w, lists) for w in wrappers])
    is_list = F.ltrim("value").startswith("[")
    obj = F.from_json("value", wrapped)
    found = F.when(is_list, F.from_json("value", lists)).otherwise(F.coalesce(*[obj[w] for w in wrappers]))
    return read.select("path", F.posexplode(found).alias("ord", "r")).select("path", "ord", "r.*")


def csv_rows(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """CSV with a header, all text, a byte order mark taken off."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).option("header", "true").option("enforceSchema", "true").option("encoding", "UTF-8").csv(path)


def snapshot_files(rows: DataFrame, least: int = scope.MIN_SNAPSHOT_ROWS) -> DataFrame:
    """(path, day, rows, valid) of snapshot rows (path, name): complete if large enough and every row has a name."""
    day = F.regexp_extract("path", r"(20\d{2}-\d{2}-\d{2})[^/]*$", 1)
    g = rows.groupBy("path").agg(F.count(F.lit(1)).alias("rows"), F.every(F.coalesce(F.trim("name") != "", F.lit(False))).alias("named"))
    return g.select("path", day.alias("day"), "rows", ((F.col("rows") >= least) & F.col("named") & (day != "")).alias("valid"))


def complete_snapshots(rows: DataFrame, least: int = scope.MIN_SNAPSHOT_ROWS) -> DataFrame:
    """The rows of the last complete snapshot of each day, by path."""
    files = snapshot_files(rows, least).where("valid").groupBy("day").agg(F.max("path").alias("path"))
    return rows.join(files, "path")


def catalogue(rows: DataFrame, least: int = 5000, crs: str = "WGS84", box: tuple[float, float, float, float] = scope.COVERAGE) -> DataFrame:
    """Geographic rows (id, lat, lng, crs), or an error: too few rows, another datum, a coordinate outside the coverage."""
    n = rows.agg(F.count(F.lit(1)).alias("__n"))
    w, s, e, t = box
    ok = (F.col("__n") >= least) & (F.col("crs") == crs) & (F.col("lat").isNull() | (F.col("lat").between(s, t) & F.col("lng").between(w, e)))
    return rows.crossJoin(F.broadcast(n)).withColumn("id", must(ok, "the catalogue is incomplete or outside its coverage", F.col("id"))).drop("__n")


def complete_probe(probe: dict) -> dict:
    """A probe of a pointed-to source, if it is valid, without errors and complete."""
    if not (probe.get("valid") and not probe.get("errors") and probe.get("success") == probe.get("rows")):
        raise ValueError("the probe is not complete")
    return probe


def reviewed_bundles(manifest: dict, hashes: DataFrame, counts: DataFrame) -> DataFrame:
    """(path, kind) of a manifest's bundles, or an error: not reviewed, changed bytes, another number of records.

    hashes: (path, sha256); counts: (path, records). Paths compare by their end."""
    if manifest.get("schema_version") != 1 or manifest.get("reviewed") is not True:
        raise ValueError("the manifest is not reviewed")
    spark = hashes.sparkSession
    want = spark.createDataFrame([(b["path"], b["kind"], b["sha256"], b["records"]) for b in manifest["bundles"]], "bundle string, kind string, want_sha string, want_records long")
    have = hashes.join(counts, "path", "left")
    j = want.join(have, F.expr("endswith(path, bundle)"), "left")
    ok = (F.col("sha256") == F.col("want_sha")) & (F.col("records") == F.col("want_records"))
    return j.select(must(ok, "a bundle is changed or incomplete", F.col("path")).alias("path"), "kind")


def paged_receipts(pages: DataFrame, key: str) -> DataFrame:
    """Items of cached pages (query, start, total, items: array of structs with the key), or an error: the pages of a query
    must hold exactly its total of items, each key once. A page that was fetched twice counts once."""
    items = pages.select("query", "start", "total", F.posexplode("items").alias("at", "item")).dropDuplicates(["query", "start", "at"])
    n = items.groupBy("query").agg(F.count(F.lit(1)).alias("__n"), F.countDistinct(f"item.{key}").alias("__d"), F.max("total").alias("__t"))
    ok = (F.col("__n") == F.col("__t")) & (F.col("__d") == F.col("__t"))
    j = items.join(n, "query")
    return j.select(must(ok, "the pages are incomplete or repeat an item", F.col("query")).alias("query"), (F.col("start") + F.col("at")).alias("ord"), "item.*")
