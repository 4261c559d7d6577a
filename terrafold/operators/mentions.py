"""Mentions of places in texts: exact longest spans, and co-mentions within one body."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import scope
from ..functions.text import named_home, nfkc

#: Bits of the filter of names: about so many for each name, in all at least and at most (32 MB).
BITS_PER_NAME, LEAST_BITS, MOST_BITS = 16, 1 << 20, 1 << 28
#: First characters of a name that are looked up before the whole name; characters of text that are hashed at a time.
PREFIX, BLOCK = 3, 1 << 20
#: Names are hashed as polynomials in their code points modulo this prime. Hashes only sort out; names decide.
PRIME, BASE = 2147483647, 1540483477
_powers: list[np.ndarray] = []

# Executors get this module's functions by value, so they need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, n at least."""
    while not _powers or len(_powers[0]) < n:
        have = len(_powers[0]) if _powers else 0
        if not have:
            _powers[:] = [np.ones(1, np.int64), np.ones(1, np.int64)]
        else:
            inverse = pow(BASE, -1, PRIME)
            _powers[:] = [np.concatenate([p, p * pow(b, have, PRIME) % PRIME]) for p, b in zip(_powers, (BASE, inverse), strict=True)]
    return _powers


def _sums(codes: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(codes.astype(np.int64) * _tables(len(codes))[0][: len(codes)] % PRIME)))


def _hashed(sums: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Hash of the so many characters from each place on, whatever stands before."""
    total = (sums[at + length] - sums[at]) % PRIME * _tables(len(sums))[1][at] % PRIME
    mixed = (total.astype(np.uint64) + np.uint64(length)) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def mention_names(entities: DataFrame, least: int = scope.MIN_MENTION) -> DataFrame:
    """(name, ids): full names and aliases of schools and homes, in NFKC, of at least three characters."""
    e = entities.where(F.col("kind").isin("school", "residential"))
    names = F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    flat = e.select("id", F.explode(names).alias("n")).select("id", F.trim(nfkc(F.coalesce("n", F.lit("")))).alias("name"))
    return flat.where(F.length("name") >= least).groupBy("name").agg(F.sort_array(F.collect_set("id")).alias("ids"))


def name_filter(names: DataFrame, bits: int, prefix: int) -> np.ndarray:
    """A bitmap with the hashes of all names and of their first characters: of fixed size, however many names there are.

    Names are hashed where they lie, and bits meet in partial aggregates; only the bitmap reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for name in b.column(0).to_pylist():
                sums = _sums(_codes(name))
                found += [int(_hashed(sums, np.zeros(1, np.int64), n)[0]) % bits for n in {prefix, len(sums) - 1}]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], ["bit"])

    rows = names.select("name").mapInArrow(run, "bit long").select((F.col("bit") + 1).alias("bit"))
    maps = rows.groupBy(F.bitmap_bucket_number("bit").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("map")).collect()
    out = np.zeros(bits // 8, np.uint8)
    for r in maps:
        at = (r["part"] - 1) * len(r["map"])
        out[at : at + len(r["map"])] = np.frombuffer(r["map"], np.uint8)[: len(out) - at]
    return out


def spans(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(id, name, start, end): all occurrences of the names in texts (id, text), overlapping ones too.

    One pass over the texts, however many names there are: places whose first characters may begin a name, and whose
    characters may be one, by a bitmap of hashes, become candidates, and the names that they are equal to are joined. Of
    the names only their lengths, their number and the bitmap go through the driver."""
    spark = texts.sparkSession
    read = texts.select("id", nfkc(F.coalesce("text", F.lit(""))).alias("text"))
    schema = f"id {texts.schema['id'].dataType.simpleString()}, name string, start long, end long"
    words = names.select("name").where(F.length("name") > 0).distinct()
    sizes = words.groupBy(F.length("name").alias("n")).agg(F.count(F.lit(1)).alias("c")).collect()  # a row per length
    if not sizes:
        return spark.createDataFrame([], schema)
    lengths = sorted(r["n"] for r in sizes)
    prefix = min(PREFIX, lengths[0])
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_PER_NAME * sum(r["c"] for r in sizes) - 1).bit_length()))
    sent = spark.sparkContext.broadcast(name_filter(words, bits, prefix).tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(sent.value, np.uint8)

        def maybe(sums: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
            bit = (_hashed(sums, at, n) % np.uint64(bits)).astype(np.int64)
            return at[(known[bit >> 3] >> (bit & 7) & 1) > 0]

        for b in batches:
            out: list[tuple] = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                codes = _codes(text)
                for low in range(0, len(codes), BLOCK):
                    sums = _sums(codes[low : low + BLOCK + lengths[-1] - 1])
                    own = np.arange(min(BLOCK, len(codes) - low))
                    own = maybe(sums, own[own + prefix < len(sums)], prefix)
                    for n in lengths:
                        for start in (low + maybe(sums, own[own + n < len(sums)], n)).tolist():
                            out.append((i, text[start : start + n], start, start + n))
            cols = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.schema.field(0).type), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], ["id", "name", "start", "end"])

    return read.mapInArrow(run, schema).join(words, "name", "left_semi").select("id", "name", "start", "end")


def longest(found: DataFrame) -> DataFrame:
    """Spans that no longer span of the same text contains; spans that merely overlap both stay.

    By running maxima, not by pairs: a span is contained if an earlier start reaches further, or if a longer span has the
    same start or the same end."""
    earlier = W.partitionBy("id").orderBy("start", F.desc("end"), "name").rowsBetween(W.unboundedPreceding, -1)
    contained = (F.coalesce(F.max("end").over(earlier), F.lit(-1)) > F.col("end")) | (F.col("start") > F.min("start").over(W.partitionBy("id", "end")))
    return found.withColumn("__c", contained).where(~F.col("__c")).drop("__c")


def matched(texts: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, entity_id) of names that belong to one place, and (id, name) of ambiguous ones, over longest spans."""
    kept = longest(spans(texts, names)).select("id", "name").distinct().join(names, "name")
    sure = kept.where(F.size("ids") == 1).select("id", F.element_at("ids", 1).alias("entity_id")).distinct()
    return sure, kept.where(F.size("ids") != 1).select("id", "name").distinct()


def co_mentions(places: DataFrame, entities: DataFrame) -> DataFrame:
    """(a, b, post_id), a < b: schools and named homes in one body. places: (post_id, entity_id)."""
    e = places.join(entities.select(F.col("id").alias("entity_id"), "kind", "name"), "entity_id")
    schools = e.where("kind = 'school'").select("post_id", F.col("entity_id").alias("s"))
    homes = e.where("kind = 'residential'").where(named_home(F.col("name"))).select("post_id", F.col("entity_id").alias("h"))
    return schools.join(homes, "post_id").select(F.least("s", "h").alias("a"), F.greatest("s", "h").alias("b"), "post_id").distinct()


def merged_evidence(old: DataFrame, new: DataFrame) -> DataFrame:
    """(a, b, post_ids): old pairs keep their posts, new ones are added; sorted and distinct."""
    return old.unionByName(new).groupBy("a", "b").agg(F.sort_array(F.collect_set("post_id")).alias("post_ids"))
