"""Target-distribution importance resampling over hashed word features, by tries of words.

Features are all runs of one to three words. A partition grows a trie of its own from each stretch of text: a node stands
for a feature, holds how often it occurs and the CRC of its bytes, which goes on from its parent's state. Tries of the
corpus and of the target give totals by bucket, these a gain for each bucket; documents are then scored by walking their
paths in tries whose nodes carry gains. Documents are drawn without replacement by Gumbel noise on their scores.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, ship, small, small_batches
from .hashing import LOWER, spans, text_chunks

#: Words in a feature at most, buckets of features, words that a document needs to be drawn, percent that are drawn.
RUN, BUCKETS, MIN_WORDS, PERCENT = 3, 10_000, 20, 5
SEED = 42
#: Bytes of text, and words, of a trie: both bound its memory, whatever the partition or the text.
CHUNK, BLOCK = 2 << 20, 1 << 19
#: A word: a run of ASCII letters (A-Z lower-cased before), digits and all that is not ASCII.
INSIDE = np.zeros(256, bool)
INSIDE[0x30:0x3A] = INSIDE[0x61:0x7B] = INSIDE[0x80:] = True
#: The CRC-32 polynomial, reflected.
POLYNOMIAL = 0xEDB88320
_shifts: list[np.ndarray] = []


def shifted(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """CRCs moved on by so many bytes: crc(a + b) is crc(a) moved on by len(b), xor crc(b).

    Moving on is linear in the bits, so it is four table look-ups for each power of two in the length."""
    if not _shifts:
        one = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            one = (one >> np.uint32(1)) ^ np.where(one & np.uint32(1), np.uint32(POLYNOMIAL), np.uint32(0))
        _shifts.append(np.stack([one, *[np.arange(256, dtype=np.uint32) << np.uint32(8 * (k - 1)) for k in (1, 2, 3)]]))
    crc, power = crc.astype(np.uint32), 0
    while (n_bytes >> power).any():
        if power == len(_shifts):
            table = _shifts[-1]
            _shifts.append(np.stack([_moved(_moved(np.arange(256, dtype=np.uint32) << np.uint32(8 * k), table), table) for k in range(4)]))
        at = np.flatnonzero((n_bytes >> power) & 1)
        crc[at] = _moved(crc[at], _shifts[power])
        power += 1
    return crc


def _moved(crc: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][(crc >> 8) & 255] ^ table[2][(crc >> 16) & 255] ^ table[3][crc >> 24]


def _numbered(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """A number for each value, equal ones the same, and the distinct values by number."""
    found = values.dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary


def trie(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Level by level: the CRCs of a level's nodes, the word at which each path to the level begins, and its node.

    Words are those of some rows, in order, given by their first and last bytes; a path stays within a row."""
    lengths = ends - starts
    if not len(starts):
        return
    total = np.cumsum(lengths)
    place = np.arange(total[-1]) + np.repeat(starts - (total - lengths), lengths)
    joined = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.concatenate(([0], total)).astype(np.int64)), pa.py_buffer(data[place])])
    word, distinct = _numbered(joined)
    listed = distinct.to_pylist()
    word_crc = np.fromiter((zlib.crc32(w) for w in listed), np.uint32, len(listed))
    space = zlib.crc32(b" ")
    next_crc = np.fromiter((zlib.crc32(w, space) for w in listed), np.uint32, len(listed))
    step = np.fromiter(map(len, listed), np.int64, len(listed)) + 1
    at, node, crc = np.arange(len(starts)), word, word_crc
    yield crc, at, node
    for k in range(1, RUN):
        goes_on = at + k < len(row)
        goes_on[goes_on] = row[at[goes_on] + k] == row[at[goes_on]]
        at, parent = at[goes_on], node[goes_on]
        if not len(at):
            return
        node, children = _numbered(pa.array(parent * len(listed) + word[at + k]))
        up, last = np.divmod(children.to_numpy(zero_copy_only=False), len(listed))
        crc = shifted(crc[up], step[last]) ^ next_crc[last]
        yield crc, at, node


def blocks(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, Iterator]]:
    """(words, of these new, rows of words, trie) of stretches of a chunk's words; the last two words come again, so that
    paths go on from block to block."""
    data = LOWER[data]
    starts, ends, row = spans(data, offsets, INSIDE[data])
    for a in range(0, len(starts), BLOCK):
        own = slice(a, a + BLOCK + RUN - 1)
        yield len(starts[own]), min(BLOCK, len(starts) - a), row[own], trie(data, starts[own], ends[own], row[own])


def bucket_totals(docs: DataFrame, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how many features of all texts fall into each bucket; each partition sums its tries' nodes first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for _, data, offsets in text_chunks(b.column(0), CHUNK):
                for _, new, _, levels in blocks(data, offsets):
                    for crc, at, node in levels:
                        counts = np.bincount(node[at < new], minlength=len(crc))
                        total += np.bincount(crc % np.uint32(buckets), counts, buckets).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], ["bucket", "n"])

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Gain of each bucket: floor(1000 * ln of its smoothed share in the target over that in the corpus).

    A row per bucket at most comes to the driver: that is a parameter and does not grow with the tables."""
    small_batches(docs.sparkSession)
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for into, found in ((s, bucket_totals(docs, text, buckets)), (t, bucket_totals(target, target_text, buckets))):
        for r in found.collect():
            into[r["bucket"]] = r["n"]
    all_s, all_t = float(s.sum()) + buckets, float(t.sum()) + buckets
    return np.array([math.floor(1000 * math.log((float(y) + 1) * all_s / ((float(x) + 1) * all_t))) for x, y in zip(s, t, strict=True)], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, text: str = "text") -> DataFrame:
    """docs with n_words, n_features and weight (the sum of its features' gains) in place of the text."""
    made = ["n_words", "n_features", "weight"]
    others = [c for c in docs.columns if c not in (text, *made)]
    buckets = len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, data, offsets in text_chunks(b.column(len(others)), CHUNK):
                n = len(offsets) - 1
                found = np.zeros((3, n), np.int64)
                for _, new, row, levels in blocks(data, offsets):
                    for level, (crc, at, node) in enumerate(levels):
                        at, node = at[at < new], node[at < new]
                        counts = np.bincount(row[at], minlength=n)
                        found[0] += counts * (level == 0)
                        found[1] += counts
                        total = np.concatenate(([0], np.cumsum(gain[crc % np.uint32(buckets)][node])))
                        until = np.cumsum(counts)
                        found[2] += total[until] - total[until - counts]
                yield pa.RecordBatch.from_arrays([*[b.column(k).slice(first, n) for k in range(len(others))], *map(pa.array, found)], [*others, *made])

    read = docs.select(*others, text)
    schema = read.drop(text).schema
    for m in made:
        schema = schema.add(m, "long")
    return read.mapInArrow(run, schema)


def noise(key: Column, seed: int = SEED) -> Column:
    """floor(1000 * a standard Gumbel variable) from a digest of the seed and the key."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """rows with their place (1, 2, ...) in this order: rows are dealt by ranges and sorted there, ranges are counted.

    Only one row per range meets in one task. The sorted rows are written, so that a lost executor changes no place."""
    placed = saved(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "ranges")
    part = F.shiftright("__at", 33)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = small(saved(sizes.select("__part", before.alias("__before")), "range-sizes"))
    place = F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.withColumn("__part", part).join(sizes, "__part").withColumn("rank", place).drop("__at", "__part", "__before")


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", buckets: int = BUCKETS, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """One row per input row: doc, n_words, n_features, weight, score, rank (null: not drawn).

    Drawn are the highest scores, ties to the smaller id, of as many documents as `percent` of those with min_words words,
    rounded down. Null and empty texts have no features and weight 0. Rows with a null id have no score and are not drawn
    or counted; repeated rows count and are drawn each, in no defined order among themselves; an empty table gives no
    rows, an empty target gains that only smooth. Other columns are ignored.
    """
    read = docs.select(F.col(key).alias("doc"), F.col(text).alias("text"))
    found = weighed(read, gains(docs, target, text, target_text, buckets)).withColumn("score", F.col("weight") + noise(F.col("doc"), seed))
    found = saved(found, "weighed")
    may = (F.col("n_words") >= min_words) & F.col("doc").isNotNull()
    drawn = found.where(may).count() * percent // 100
    ranked = numbered(found.where(may), F.desc("score"), F.asc("doc"))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return ranked.unionByName(found.where(~may).withColumn("rank", F.lit(None).cast("long")))


ship(__name__)
