"""Publishing: staged versions, exports in shards, manifests. All files go through Spark's file systems."""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .. import scope
from ..functions.values import shard
from .files import file_digests


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def workspace(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which all executors share; it goes when the driver's JVM ends.

    Only a local session may do without that setting: its folder is a temporary one."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="shared-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
    folder = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    fs, path, _ = _fs(spark, folder)
    fs.deleteOnExit(path)
    return folder


def _replace(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file whole in place of an old one."""
    fs, draft, jvm = _fs(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(draft, jvm.org.apache.hadoop.fs.Path(path), options)


def _read(spark: SparkSession, path: str) -> str | None:
    fs, at, _ = _fs(spark, path)
    if not fs.exists(at):
        return None
    read = fs.open(at)
    try:
        return bytes(read.readAllBytes()).decode()
    finally:
        read.close()


def export_changed(details: DataFrame, root: str, key: str = "id", shards: int = scope.SHARDS, **facts) -> dict:
    """Export one JSON row per place in shards, writing only those that differ from the last export; the new listing.

    A shard is compared by its number of rows and a digest that does not depend on their order. Listings name each shard's
    folder, so an unchanged shard stays where it lies; LISTING is replaced whole at the end, and the one before stays as
    LISTING.previous. A failed export leaves both as they were. A row per shard reaches the driver."""
    spark, revision = details.sparkSession, uuid.uuid4().hex
    rows = details.select(shard(F.col(key), shards).alias("shard"), F.to_json(F.struct(*details.columns), {"ignoreNullFields": "false"}).alias("value"))
    found = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.xxhash64("value").cast("decimal(38,0)")).alias("a"), F.sum(F.hash("value").cast("decimal(38,0)")).alias("b")).collect()
    old = json.loads(_read(spark, f"{root}/LISTING") or '{"shards": {}}')
    listed = {}
    for r in sorted(found):
        digest = f"{r['rows']}:{r['a']}:{r['b']}"
        kept = old["shards"].get(r["shard"], {})
        listed[r["shard"]] = {"digest": digest, "rows": r["rows"], "folder": kept["folder"] if kept.get("digest") == digest else f"exports/{revision}/shard={r['shard']}"}
    written = sorted(s for s, x in listed.items() if revision in x["folder"])
    if written:
        rows.where(F.col("shard").isin(*written)).repartition(len(written), "shard").write.partitionBy("shard").text(f"{root}/exports/{revision}")
    entry = {"schema_version": 1, "revision": revision, "shards": listed, "written": written, **facts}
    if old["shards"]:
        _replace(spark, f"{root}/LISTING.previous", json.dumps(old))
    _replace(spark, f"{root}/LISTING", json.dumps(entry, ensure_ascii=False))
    return entry


def exported(spark: SparkSession, root: str, listing: str = "LISTING") -> DataFrame:
    """(shard, value): the rows of an export, as its listing has them."""
    entry = json.loads(_read(spark, f"{root}/{listing}") or '{"shards": {}}')
    folders = [f"{root}/{x['folder']}" for x in entry["shards"].values()]
    read = spark.read.text(folders) if folders else spark.createDataFrame([], "value string").withColumn("path", F.lit(""))
    return read.select(F.regexp_extract(F.col("_metadata.file_path") if folders else F.col("path"), "shard=([0-9]+)", 1).alias("shard"), "value")


def static_page(template: str, marker: str, head: str, swaps: dict[str, str]) -> str:
    """A page for a static site: marker and head go in after the only <head>, and swaps replace what is there exactly once.

    A template in which one of them is missing or ambiguous is refused."""
    for found in ("<head>", *swaps):
        if template.count(found) != 1:
            raise ValueError(f"the template has {template.count(found)} of {found}")
    if marker in template:
        raise ValueError("the template is a static page already")
    out = template.replace("<head>", f"<head>{marker}{head}")
    for old, new in swaps.items():
        out = out.replace(old, new)
    return out


def digest_of(columns: Sequence[str]) -> list[Column]:
    """Aggregates: number of rows, and two sums of row hashes, which do not depend on the rows' order."""
    row = [F.col(c) for c in columns]
    return [F.count(F.lit(1)).alias("rows"), F.sum(F.xxhash64(*row).cast("decimal(38,0)")).alias("a"), F.sum(F.hash(*row).cast("decimal(38,0)")).alias("b")]


def _shown(found: dict) -> dict:
    return {"rows": found["rows"], "digest": f"{found['a'] or 0}:{found['b'] or 0}"}


def publish(tables: dict[str, DataFrame], root: str, checks: dict[str, DataFrame] | None = None, metrics: dict[str, dict[str, Column]] | None = None, gates: dict[str, Callable[[dict], bool]] | None = None) -> str:
    """Write all tables under a new revision, judge them, then point CURRENT at it; the revision.

    While a table is written its rows are counted and digested, and its metrics (aggregates by name) are gathered: one job
    a table. Gates get all of that as {table: {rows, digest, metric…}} and must hold; checks must have no row. What was
    gathered is the revision's receipt. A failed write, gate or check leaves the last good revision current."""
    spark = next(iter(tables.values())).sparkSession
    revision, receipt = uuid.uuid4().hex, {}
    for name, df in tables.items():
        seen, more = Observation(), (metrics or {}).get(name, {})
        df.observe(seen, *digest_of(df.columns), *[c.alias(f"m_{k}") for k, c in more.items()]).write.parquet(f"{root}/revisions/{revision}/{name}")
        receipt[name] = _shown(seen.get) | {k: seen.get[f"m_{k}"] for k in more}
    for name, holds in (gates or {}).items():
        if not holds(receipt):
            raise ValueError(f"gate failed: {name}")
    for name, bad in (checks or {}).items():
        if not bad.isEmpty():
            raise ValueError(f"check failed: {name}")
    _replace(spark, f"{root}/revisions/{revision}/RECEIPT", json.dumps(receipt, default=str))
    _replace(spark, f"{root}/CURRENT", revision)
    return revision


def receipt(spark: SparkSession, root: str) -> dict:
    """What was gathered while the current revision was written."""
    return json.loads(_read(spark, f"{root}/revisions/{current(spark, root)}/RECEIPT"))


def recounted(spark: SparkSession, root: str) -> dict:
    """Rows and digest of the current revision's tables, counted anew: equal to the receipt's unless a file has changed."""
    return {name: _shown(df.agg(*digest_of(df.columns)).head().asDict()) for name in receipt(spark, root) for df in [table(spark, root, name)]}


def current(spark: SparkSession, root: str) -> str:
    return spark.read.text(f"{root}/CURRENT").head()[0]


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/revisions/{current(spark, root)}/{name}")


def export_shards(details: DataFrame, path: str, key: str = "id", shards: int = scope.SHARDS) -> None:
    """One JSON row per place, in folders by shard of its id. One file per shard: rows are dealt by shard first."""
    details.withColumn("shard", shard(F.col(key), shards)).repartition(shards, "shard").write.partitionBy("shard").json(path)


def manifest(spark: SparkSession, path: str, **facts) -> str:
    """JSON with the bytes and digest of each exported file, and facts. Digests are made by executors; only names,
    sizes and digests, one row per file, reach the driver."""
    rows = file_digests(spark, path).orderBy("path").collect()
    base = path.rstrip("/").split("/")[-1]
    listed = [{"path": r.path.rsplit(f"/{base}/", 1)[-1], "bytes": r.length, "sha256": r.sha256} for r in rows]
    return json.dumps({"schema_version": 1, "files": listed, **facts}, ensure_ascii=False)


def public(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Only the listed keys leave the build."""
    return df.select(*[k for k in keys if k in df.columns])


def orphans(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """Rows whose foreign key points nowhere: a check for publish()."""
    return child.where(F.col(fk).isNotNull()).join(parent.select(F.col(pk).alias(fk)), fk, "left_anti")


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files (path, sha256) whose bytes are no longer what was read."""
    return before.select("path", "sha256").exceptAll(after.select("path", "sha256"))


def api_rows(df: DataFrame) -> Column:
    """A row as strict JSON; a NaN or infinity is an error, not a token that JSON lacks."""
    bad = F.lit(False)
    for name, kind in df.dtypes:
        if kind in ("double", "float"):
            bad = bad | F.coalesce(F.isnan(name) | (F.abs(name) == float("inf")), F.lit(False))
    text = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    return F.when(bad, F.raise_error(F.lit("not a JSON number")).cast("string")).otherwise(text)
