"""Substring dedup over a log-structured fingerprint index.

A window (WIDTH consecutive words) has as fingerprint the least hash of the PROBE-word runs in it, so neighbouring windows
mostly share one. A batch of documents becomes a run: its distinct fingerprints with a holder, sorted, in buckets by hash,
written once. A new run is merge-joined bucket by bucket with the older ones, which lie in the same buckets and are not
dealt again; documents whose fingerprints meet are candidates. Candidates are verified on 96-bit hashes of their whole windows. Once there are MAX_RUNS runs, the next merge
writes them, and the new one, as one compacted run in the same pass. A log can live in a folder, for batches to come.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _path, drop_saved, saved, shared_dir, ship, small_batches
from .hashing import mixed, rolling, text_chunks, words

WIDTH, PROBE = 13, 5
#: Characters of text for each bucket of the index, about.
BUCKET_CHARS = 16_000_000
#: Bytes of texts that are hashed together; what repeats inside such a chunk is settled there and sent on once.
CHUNK = 1 << 21
#: Characters of text in a partition of the texts' exchange, about.
PARTITION_CHARS = 64_000_000
#: A batch that finds so many runs compacts them; a whole table is taken in so many batches, so it meets that.
MAX_RUNS, BATCHES = 2, 3
#: Buckets of a run's table at most; an index of more buckets has several in each.
MOST_TABLE_BUCKETS = 8192
_CHECK = np.uint64(0xA0761D6478BD642F)
RUN = "bucket int, base long, keys binary, checks binary, docs binary"


def hashed_windows(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH):
    """Row, first word, hash, check and fingerprint of every window of a chunk, and the words' start, end and row."""
    starts, ends, row, hashed = words(data, offsets)
    whole, check, probes = rolling(hashed, width), rolling(hashed, width, _CHECK), rolling(hashed, min(PROBE, width))
    n = len(whole)
    print_ = probes[:n].copy()
    for k in range(1, width - min(PROBE, width) + 1):
        np.minimum(print_, probes[k : k + n], out=print_)
    at = np.flatnonzero(row[:n] == row[width - 1 :][:n]) if n else np.zeros(0, np.int64)
    return (row[at], at, whole[at], (check[at] >> np.uint64(32)).astype(np.uint32), mixed(print_[at])), (starts, ends, row)


def _distinct(key: np.ndarray, doc: np.ndarray, check: np.ndarray | None = None):
    """Sorted distinct (key, check, doc), and where each new (key, check) starts."""
    order = np.lexsort((doc, key) if check is None else (doc, check, key))
    key, doc = key[order], doc[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    if check is not None:
        check = check[order]
        new[1:] |= check[1:] != check[:-1]
    keep = new.copy()
    keep[1:] |= doc[1:] != doc[:-1]
    return key[keep], doc[keep], None if check is None else check[keep], new[keep]


def _runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """Start and end of each run of equal values."""
    if len(values):
        cuts = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1], [True])))
        yield from zip(cuts[:-1], cuts[1:], strict=True)


def _by_doc(doc: np.ndarray, key: np.ndarray) -> Iterator[tuple[int, bytes]]:
    order = np.argsort(doc, kind="stable")
    doc, key = doc[order], key[order]
    for a, b in _runs(doc):
        yield int(doc[a]), key[a:b].tobytes()


class _Out:
    """Rows of RUN, and of (doc, keys) with bucket -1, gathered for one batch."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []

    def batch(self) -> pa.RecordBatch:
        cols = list(zip(*self.rows, strict=True)) or [()] * 5
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["bucket", "base", "keys", "checks", "docs"])

    def to_buckets(self, bucket: np.ndarray, key: np.ndarray, doc: np.ndarray, check: np.ndarray | None = None) -> None:
        order = np.argsort(bucket, kind="stable")
        bucket, key, doc = bucket[order], key[order], doc[order]
        check = None if check is None else check[order]
        for a, b in _runs(bucket):
            base = int(doc[a:b].min())
            wide = int(doc[a:b].max()) - base >= 1 << 32
            docs = doc[a:b].tobytes() if wide else (doc[a:b] - base).astype(np.uint32).tobytes()
            self.rows.append((int(bucket[a]), base, key[a:b].tobytes(), None if check is None else check[a:b].tobytes(), docs))


def _unpacked(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys = [np.frombuffer(k, np.uint64) for k in rows["keys"]]
    docs = [np.frombuffer(d, np.int64) if len(d) == 8 * len(k) else np.frombuffer(d, np.uint32).astype(np.int64) + b for d, b, k in zip(rows["docs"], rows["base"], keys, strict=True)]
    checks = [np.frombuffer(c, np.uint32) if c is not None else np.zeros(len(k), np.uint32) for c, k in zip(rows["checks"], keys, strict=True)]
    empty = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint32))
    return tuple(np.concatenate(x) if x else e for x, e in zip((keys, docs, checks), empty, strict=True))


def _frame(rows: Iterator[tuple[int, bytes]]) -> pd.DataFrame:
    return pd.DataFrame(list(rows), columns=["doc", "keys"]).astype({"doc": "int64"})


class FingerprintLog:
    """Sorted immutable runs of fingerprints, each a table in buckets: in a folder that outlives the session, if one is named.

    A run has one row per bucket, with its sorted distinct fingerprints; runs lie in the same buckets, so a batch meets
    them bucket by bucket where they lie, and only the batch itself is dealt."""

    def __init__(self, n_buckets: int, width: int = WIDTH, folder: str | None = None) -> None:
        self.n_buckets, self.width, self.folder, self.runs, self.version = n_buckets, width, folder, [], 0
        #: The session's tables of the runs, by run; the folders of those that were listed.
        self._names: list[str] = []
        self._places: list[str] = []

    @property
    def spread(self) -> int:
        """Buckets of the tables: each holds some of the index's buckets."""
        return min(self.n_buckets, MOST_TABLE_BUCKETS)

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> FingerprintLog:
        """The log as its last complete batch left it: the newest of the folder's listings names the runs."""
        at, fs = _path(spark, folder)
        listed = [f.getPath().getName() for f in fs.listStatus(at)]
        found = [n for n in listed if n.startswith("listing-") and fs.exists(_path(spark, f"{folder}/{n}/_SUCCESS")[0])]
        row = spark.read.parquet(f"{folder}/{max(found)}").head()
        log = cls(row["n_buckets"], row["width"], folder)
        log.version = int(max(found)[8:])
        for n in row["runs"]:
            log._add(spark, f"{folder}/{n}")
        return log

    def _add(self, spark: SparkSession, place: str) -> DataFrame:
        """A bucketed table of the session's catalog over a run's folder, as the newest run."""
        name = f"fingerprints_{uuid.uuid4().hex}"
        spark.sql(f"CREATE TABLE {name} ({RUN}) USING parquet CLUSTERED BY (bucket) SORTED BY (bucket) INTO {self.spread} BUCKETS LOCATION '{place}'")
        self._names.append(name)
        self._places.append(place)
        self.runs.append(spark.table(name))
        return self.runs[-1]

    def _written(self, rows: DataFrame) -> DataFrame:
        spark = rows.sparkSession
        small_batches(spark)
        root = self.folder or shared_dir(spark)
        place = f"{root}/run-{uuid.uuid4().hex}"
        at, fs = _path(spark, place)
        place = fs.makeQualified(at).toString()
        if self.folder is None:
            fs.deleteOnExit(at)
        run = self._add(spark, place)
        rows.write.insertInto(self._names[-1])
        spark.catalog.refreshTable(self._names[-1])
        return run

    def _forget(self, spark: SparkSession, n: int) -> None:
        """Take the oldest n runs out of the log, and their files away unless the log lives in a folder of its own."""
        for name, place in zip(self._names[:n], self._places[:n], strict=True):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
            if self.folder is None:
                at, fs = _path(spark, place)
                fs.delete(at, True)
        del self.runs[:n], self._names[:n], self._places[:n]

    def close(self, spark: SparkSession) -> None:
        """Forget all runs; those of a named folder can be opened again."""
        self._forget(spark, len(self.runs))

    def _list(self, spark: SparkSession) -> None:
        if self.folder is not None:
            self.version += 1
            names = [p.rstrip("/").rsplit("/", 1)[1] for p in self._places]
            row = spark.createDataFrame([(self.n_buckets, self.width, names)], "n_buckets int, width int, runs array<string>")
            row.coalesce(1).write.parquet(f"{self.folder}/listing-{self.version:012d}")

    def _fresh(self, docs: DataFrame) -> DataFrame:
        """A batch's fingerprints by bucket; candidates that a chunk has found itself have negative buckets and no docs."""
        n_buckets, width = self.n_buckets, self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids = b.column(0).to_numpy(zero_copy_only=False)
                for at, data, offsets in text_chunks(b.column(1), CHUNK):
                    out = _Out()
                    (row, _, _, _, print_), _ = hashed_windows(data, offsets, width)
                    key, doc, _, new = _distinct(print_, ids[at + row])
                    shared = ~new
                    shared[:-1] |= ~new[1:]
                    out.rows += [(-1 - d % (4 * n_buckets), d, k, None, None) for d, k in _by_doc(doc[shared], key[shared])]
                    out.to_buckets((key[new] % np.uint64(n_buckets)).astype(np.int64), key[new], doc[new])
                    yield out.batch()

        return docs.select("doc", "text").mapInArrow(run, RUN)

    def add(self, docs: DataFrame) -> DataFrame:
        """Append a run for the rows (doc, text); returns the candidates (doc, keys): fingerprints shared within the
        batch or with an older run, for the batch's documents and for the older holders.

        The batch is dealt by bucket and merged with the older runs where they lie; what is written is the candidates and
        the new run, in one table. Where MAX_RUNS runs are there already, the new run takes all of them in, with the
        smallest holder of each fingerprint; the others have been candidates before."""
        spark, due, before = docs.sparkSession, len(self.runs) >= MAX_RUNS, len(self.runs)

        def merge(rows: pd.DataFrame) -> pd.DataFrame:
            bucket = int(rows["bucket"].iloc[0])
            if bucket < 0:
                return rows.drop(columns="fresh")
            fresh = rows["fresh"].to_numpy(bool)
            key, doc, _ = _unpacked(rows)
            mine = np.repeat(fresh, [len(k) // 8 for k in rows["keys"]])
            own_key, own_doc, _, own_new = _distinct(key[mine], doc[mine])
            key, doc, _, new = _distinct(key, doc)
            shared = ~new
            shared[:-1] |= ~new[1:]
            if len(own_key):
                at = np.minimum(np.searchsorted(own_key, key), len(own_key) - 1)
                shared &= own_key[at] == key
            else:
                shared[:] = False
            out = _Out()
            out.rows += [(bucket, d, k, None, None) for d, k in _by_doc(doc[shared], key[shared])]
            if due:
                out.to_buckets(np.full(new.sum(), bucket), key[new], doc[new])
            elif len(own_key):
                out.to_buckets(np.full(own_new.sum(), bucket), own_key[own_new], own_doc[own_new])
            return out.batch().to_pandas()

        rows = self._fresh(docs).withColumn("fresh", F.lit(True)).repartition(self.spread, "bucket")
        for old in self.runs:
            rows = rows.unionByName(old.where("docs is not null").withColumn("fresh", F.lit(False)))
        met = self._written(rows.groupBy("bucket").applyInPandas(merge, RUN))
        found = saved(met.where("docs is null").select(F.col("base").alias("doc"), "keys"), "candidates")
        if due:
            self._forget(spark, before)
        self._list(spark)
        return found

    def compact(self) -> None:
        """Merge all runs into one now, with the smallest holder of each fingerprint."""

        def merge(rows: pd.DataFrame) -> pd.DataFrame:
            key, doc, _ = _unpacked(rows)
            key, doc, _, new = _distinct(key, doc)
            out = _Out()
            out.to_buckets(np.full(new.sum(), rows["bucket"].iloc[0]), key[new], doc[new])
            return out.batch().to_pandas()

        if self.runs:
            before = len(self.runs)
            rows = reduce(DataFrame.unionByName, self.runs)
            self._written(rows.where("docs is not null").groupBy("bucket").applyInPandas(merge, RUN))
            self._forget(rows.sparkSession, before)
            self._list(rows.sparkSession)


def _repeated(with_parts: DataFrame, n_buckets: int, width: int) -> DataFrame:
    """(doc, keys): hashes of candidates' windows that also start in a document of smaller id. Input (doc, text, parts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(b.column(2).is_valid())
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for at, data, offsets in text_chunks(b.column(1), CHUNK):
                out = _Out()
                (row, _, whole, check, print_), _ = hashed_windows(data, offsets, width)
                cuts, ok = np.searchsorted(row, np.arange(len(offsets))), np.zeros(len(row), bool)
                for k in range(len(offsets) - 1):
                    if cuts[k] < cuts[k + 1]:
                        known = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in b.column(2)[at + k].values])
                        ok[cuts[k] : cuts[k + 1]] = np.isin(print_[cuts[k] : cuts[k + 1]], known)
                # All windows with one hash have one fingerprint, so they share a bucket.
                key, doc, checks, new = _distinct(whole[ok], ids[at + row[ok]], check[ok])
                bucket_of = dict_like(whole[ok], print_[ok] % np.uint64(n_buckets))
                out.rows += [(-1, d, k, None, b"") for d, k in _by_doc(doc[~new], key[~new])]
                out.to_buckets(bucket_of(key[new]).astype(np.int64), key[new], doc[new], checks[new])
                yield out.batch()

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        if rows["bucket"].iloc[0] < 0:
            return pd.DataFrame({"doc": rows["base"].astype("int64"), "keys": rows["keys"]})
        key, doc, check = _unpacked(rows)
        key, doc, _, new = _distinct(key, doc, check)
        return _frame(_by_doc(doc[~new], key[~new]))

    sent = with_parts.mapInArrow(run, RUN)
    # Rows of bucket -1 are results already; they are dealt by document, only to pass through.
    deal = F.when(F.col("bucket") < 0, -1 - F.pmod(F.xxhash64("base"), F.lit(4 * n_buckets))).otherwise(F.col("bucket"))
    return sent.withColumn("deal", deal).groupBy("deal").applyInPandas(merge, "doc long, keys binary")


def dict_like(keys: np.ndarray, values: np.ndarray):
    """Looks keys up among keys."""
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    return lambda x: values[np.searchsorted(keys, x)] if len(keys) else np.zeros(0, np.uint64)


def _cleaned(docs: DataFrame, width: int) -> DataFrame:
    """doc, n_words, n_removed, kept (text) from (doc, text, parts): words covered by a window of parts go."""
    schema = "doc long, n_words long, n_removed long, kept string, kept_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, data, offsets in text_chunks(b.column(1), CHUNK):
                (row, first, whole, _, _), (starts, ends, word_row) = hashed_windows(data, offsets, width)
                windows, bounds = np.searchsorted(row, np.arange(len(offsets))), np.searchsorted(word_row, np.arange(len(offsets)))
                n, gone, kept, digests = [], [], [], []
                for k in range(len(offsets) - 1):
                    a, z = bounds[k], bounds[k + 1]
                    drop = np.zeros(z - a + 1, np.int64)
                    parts = b.column(2)[at + k]
                    if parts.is_valid and windows[k] < windows[k + 1]:
                        known = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in parts.values])
                        own = slice(windows[k], windows[k + 1])
                        hit = first[own][np.isin(whole[own], known)] - a
                        np.add.at(drop, hit, 1)
                        np.add.at(drop, hit + width, -1)
                    stay = np.flatnonzero(np.cumsum(drop[:-1]) == 0)
                    text = b" ".join([data[s:e].tobytes() for s, e in zip(starts[a + stay], ends[a + stay], strict=True)])
                    n.append(int(z - a))
                    gone.append(int(z - a - len(stay)))
                    kept.append(text)
                    digests.append(hashlib.sha256(text).hexdigest())
                yield pa.RecordBatch.from_arrays([b.column(0)[at : at + len(n)], pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(digests)], ["doc", "n_words", "n_removed", "kept", "kept_sha256"])

    return docs.select("doc", "text", "parts").mapInArrow(run, schema)


def gathered(found: DataFrame) -> DataFrame:
    return found.groupBy("doc").agg(F.collect_list("keys").alias("parts"))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, batches: int = BATCHES) -> DataFrame:
    """One row per input row: doc, n_words, n_removed, kept (its other words, joined by spaces), kept_sha256.

    A word goes if a window that covers it has a word sequence that also starts in a document of smaller id; windows are
    judged on the input. Documents come in so many batches by ascending id, each merged with the runs before it.

    What repeats inside a chunk is settled there, so a passage that very many documents share reaches the index once per
    chunk. Null and empty texts have no words. Rows with null ids are neither matched nor changed. Rows that share an id
    are compared with smaller ids only, not with each other. An empty table gives no rows; other columns are ignored.
    """
    # No alias where the name is right already: Spark drops a redundant one in one of the two joins only, and the texts'
    # exchange, which both need, would not be reused.
    read = docs.select(F.col(key).cast("long").alias("doc"), F.col(text) if text == "text" else F.col(text).alias("text"))
    known = read.where("doc is not null")
    seen = known.agg(F.sum(F.length("text")), F.percentile_approx("doc", F.array(*[F.lit(k / batches) for k in range(1, batches)]) if batches > 1 else F.array(F.lit(1.0)), F.lit(1000))).head()
    chars = seen[0] or 0
    log = FingerprintLog(max(16, -(-chars // BUCKET_CHARS)), width)
    cuts = sorted(set(seen[1] or [])) if batches > 1 else []
    candidates = []
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        part = known if low is None else known.where(F.col("doc") > low)
        candidates.append(log.add(part if high is None else part.where(F.col("doc") <= high)))
    parts = saved(gathered(reduce(DataFrame.unionByName, candidates)), "candidate-parts")
    for old in candidates:
        drop_saved(old)
    log.close(docs.sparkSession)
    spread = -(-chars // PARTITION_CHARS)
    if spread > int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        known = known.repartition(spread, "doc")
    joined = known.join(parts, "doc", "left").select("doc", "text", "parts")
    repeated = gathered(_repeated(joined, log.n_buckets, width))
    out = known.join(repeated, "doc", "left").select("doc", "text", "parts")
    return _cleaned(out.unionByName(read.where("doc is null").withColumn("parts", F.lit(None).cast("array<binary>"))), width)


ship(__name__)
