"""MinHash near-dedup: banded candidates, odd sketches to judge them, exact set similarity to confirm."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, ship
from .components import components
from .hashing import mixed, text_chunks, windows, words

#: Two sets of similarity 0.8 share none of 32 bands of 5 samples with a chance of 3 in a million, and links are seen
#: through any document of a group, so a lost pair seldom loses a link.
BANDS, ROWS = 32, 5
SAMPLES = BANDS * ROWS
#: Bits of an odd sketch, in 64-bit columns.
BITS = 512
SKETCH = [f"s{k}" for k in range(BITS // 64)]
#: A candidate is confirmed exactly unless its sketch puts it so far below the threshold (about five deviations).
SLACK = 0.2
#: Bands of more classes than this are compared in blocks of so many, inside tasks; a pair there is never a row.
SMALL_BAND, BLOCK = 32, 1024
#: Bytes of sets in a block, about: blocks of long texts have fewer of them.
BLOCK_BYTES = 64 << 20
#: Document ids that are broadcast (16 MB); more are joined by shuffle.
BROADCAST_IDS = 1_000_000
#: Shingles hashed at a time for samples.
PART = 4096

_rng = np.random.default_rng(20)
_MUL = _rng.integers(1, 1 << 63, SAMPLES, dtype=np.uint64) | np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, SAMPLES, dtype=np.uint64)
_SALT = mixed(np.arange(1, SAMPLES + 1, dtype=np.uint64))


def shingle_sets(column: pa.Array, width: int, lower: bool) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words has one shingle, none without words."""
    for _, data, offsets in text_chunks(column):
        _, _, row, hashed = words(data, offsets, lower)
        found, at = windows(hashed, row, width)
        counts = np.bincount(row, minlength=len(offsets) - 1)
        bounds = np.searchsorted(row[at], np.arange(len(offsets)))
        first = np.concatenate(([0], np.cumsum(counts)))
        for k in range(len(offsets) - 1):
            if counts[k] >= width:
                yield np.unique(found[bounds[k] : bounds[k + 1]])
            elif counts[k]:
                yield windows(hashed[first[k] : first[k + 1]], row[first[k] : first[k + 1]], int(counts[k]))[0]
            else:
                yield np.zeros(0, np.uint64)


def samples(shingles: np.ndarray) -> np.ndarray:
    least = np.full(SAMPLES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), PART):
        np.minimum(least, (shingles[at : at + PART, None] * _MUL + _ADD).min(0), out=least)
    return least


def bands_of(least: np.ndarray) -> np.ndarray:
    total = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        total = mixed(total + least.reshape(BANDS, ROWS)[:, k])
    return total.astype(np.int64)


def odd_sketch(least: np.ndarray) -> np.ndarray:
    """Parity of how many samples fall on each bit."""
    odd = np.bincount((mixed(least ^ _SALT) % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def most_bits(similarity: float) -> int:
    """Differing sketch bits that are expected at this similarity."""
    return math.ceil(BITS / 2 * (1 - (1 - 2 / BITS) ** (2 * SAMPLES * (1 - max(similarity, 0.0)))))


def signatures(docs: DataFrame, key: str, text: str, width: int, lower: bool) -> DataFrame:
    """doc, n, digest (of the whole set), bands, and the sketch columns, for each row."""
    schema = "doc long, n long, digest binary, bands array<long>, " + ", ".join(f"{s} long" for s in SKETCH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, digests, bands, sketches = [], [], [], []
            for s in shingle_sets(b.column(1), width, lower):
                least = samples(s)
                n.append(len(s))
                digests.append(hashlib.md5(s.tobytes()).digest())
                bands.append(bands_of(least) if len(s) else None)
                sketches.append(odd_sketch(least))
            sketch = np.array(sketches, np.int64).reshape(len(n), len(SKETCH))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64())), *(pa.array(sketch[:, k]) for k in range(len(SKETCH)))], ["doc", "n", "digest", "bands", *SKETCH])

    return docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text")).mapInArrow(run, schema)


def packed_sets(docs: DataFrame, width: int, lower: bool) -> DataFrame:
    """(doc, shingles) with the sorted 64-bit shingle hashes of (doc, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.tobytes() for s in shingle_sets(b.column(1), width, lower)], pa.binary())], ["doc", "shingles"])

    return docs.select("doc", "text").mapInArrow(run, "doc long, shingles binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                same = _same(x, y)
                keep.append(same > 0 and 100 * same >= percent * (len(x) + len(y) - same))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(sets.withColumnsRenamed({"doc": "a", "shingles": "x"}), "a").join(sets.withColumnsRenamed({"doc": "b", "shingles": "y"}), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _same(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    x, y = (x, y) if len(x) <= len(y) else (y, x)
    return int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(x) else 0


def block_links(percent: int):
    """Links between classes of one pair of blocks that are not yet in one part; only those that join parts are given."""
    most = most_bits(percent / 100 - SLACK)

    def run(rows: pa.Table) -> pa.Table:
        doc, part, block, n = (rows.column(c).to_numpy() for c in ("doc", "part", "block", "n"))
        sketch = np.stack([rows.column(c).to_numpy() for c in SKETCH], 1).view(np.uint64)
        sets = [np.frombuffer(x, np.uint64) for x in rows.column("shingles").to_pylist()]
        inner = rows.column("low")[0] == rows.column("high")[0]
        part = np.unique(part, return_inverse=True)[1]
        edges = []
        for i in range(len(doc)):
            j = np.arange(i + 1, len(doc))
            j = j[(part[j] != part[i]) & (100 * np.minimum(n[j], n[i]) >= percent * np.maximum(n[j], n[i]))]
            if not inner:
                j = j[block[j] != block[i]]
            bits = np.bitwise_count(sketch[j] ^ sketch[i]).sum(1)
            j = j[bits <= most][np.argsort(bits[bits <= most], kind="stable")]
            for k in j:
                if part[k] != part[i]:
                    same = _same(sets[i], sets[k])
                    if 100 * same >= percent * (len(sets[i]) + len(sets[k]) - same):
                        edges.append((doc[i], doc[k]))
                        part[part == part[k]] = part[i]
        return pa.table({"a": pa.array([e[0] for e in edges], pa.int64()), "b": pa.array([e[1] for e in edges], pa.int64())})

    return run


def likely(percent: int, left: str, right: str) -> Column:
    """Neither the sets' sizes nor their odd sketches rule the pair out."""
    bits = sum((F.bit_count(F.col(f"{left}.{s}").bitwiseXOR(F.col(f"{right}.{s}"))) for s in SKETCH[1:]), F.bit_count(F.col(f"{left}.{SKETCH[0]}").bitwiseXOR(F.col(f"{right}.{SKETCH[0]}"))))
    x, y = F.col(f"{left}.n"), F.col(f"{right}.n")
    return (100 * F.least(x, y) >= percent * F.greatest(x, y)) & (bits <= most_bits(percent / 100 - SLACK))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80, lower: bool = True) -> DataFrame:
    """One row per input row: doc, n_shingles, component_id (smallest linked id), kept (doc is that id).

    Documents with equal sets become one class, whose smallest id stands for it. In each band, the smallest class is
    compared with every other (a star); the classes that it links leave few others, and these are compared with all
    classes of the band that are not yet in their component. So every candidate pair is either confirmed, refuted, or
    inside one component already, without all pairs of a hot band. Bands of many classes that hang together are compared
    in blocks: a task gets two blocks of sets, and returns no pairs but the links that join components. Sizes and odd
    sketches sort out candidates before the sets are fetched or compared.

    Null and empty texts and texts without words have no shingles and link with nothing. Null ids link with nothing and
    have a null component_id and are kept. Rows that share an id are one document: if their texts differ, the set of the
    smallest digest is compared, and n_shingles is each row's own. An empty table gives no rows; columns other than key
    and text are ignored.
    """
    sig = saved(signatures(docs, key, text, width, lower), "signatures")
    full = sig.where("n > 0 and doc is not null")
    # A document has the set of the smallest digest among the rows of its id.
    own = full.groupBy("doc").agg(F.min("digest").alias("digest"))
    reps = saved(own.groupBy("digest").agg(F.min("doc").alias("rep")), "classes")
    stands = full.join(reps.select(F.col("rep").alias("doc"), "digest"), ["doc", "digest"], "left_semi").dropDuplicates(["doc"])
    stands = saved(stands, "class-signatures")
    rows = stands.select(F.explode("bands").alias("band"), "doc")
    first = rows.groupBy("band").agg(F.min("doc").alias("leader"), F.count(F.lit(1)).alias("size")).where("size > 1").select("band", "leader")
    rows = saved(rows.join(first, "band"), "bands")
    slim = stands.select("doc", "n", *SKETCH)

    def judged(pairs: DataFrame) -> DataFrame:
        x, y = slim.alias("x"), slim.alias("y")
        return pairs.distinct().join(x, F.col("a") == F.col("x.doc")).join(y, F.col("b") == F.col("y.doc")).where(likely(percent, "x", "y")).select("a", "b")

    source = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))

    def sets_of(needed: DataFrame, most: int) -> DataFrame:
        """Sets of the documents in needed; it has so many rows at most."""
        needed = needed.distinct()
        if most > BROADCAST_IDS:
            needed = saved(needed, "needed")
            most = needed.limit(BROADCAST_IDS + 1).count()
        if most <= BROADCAST_IDS:
            needed = F.broadcast(needed)
        sets = packed_sets(source.join(needed, "doc", "left_semi"), width, lower).where(F.octet_length("shingles") > 0)
        return saved(sets.groupBy("doc").agg(F.min_by("shingles", F.md5("shingles")).alias("shingles")), "sets")

    def linked(pairs: DataFrame) -> DataFrame:
        pairs = saved(judged(pairs), "candidates")
        if not (n := pairs.count()):
            return pairs
        sets = sets_of(pairs.select(F.col("a").alias("doc")).union(pairs.select(F.col("b").alias("doc"))), 2 * n)
        return saved(confirmed(pairs, sets, percent), "links")

    star = linked(rows.where("doc <> leader").select(F.col("leader").alias("a"), F.col("doc").alias("b")))
    groups = components(star).withColumnsRenamed({"node": "doc", "component": "__c"})
    placed = saved(rows.join(groups, "doc", "left").select("band", "leader", "doc", F.coalesce("__c", "doc").alias("part")), "placed")
    parts = placed.groupBy("band", "part").agg(F.count(F.lit(1)).alias("size"))
    top = parts.groupBy("band").agg(F.max(F.struct("size", "part")).alias("top"), F.sum("size").alias("size"), F.count(F.lit(1)).alias("parts"))
    top = top.where("parts > 1").select("band", F.col("top.part").alias("main"), "size")
    mixed_bands = saved(placed.join(top, "band"), "mixed-bands")

    # Without bands of either kind, their queries would only run over empty tables.
    links, sizes = star, mixed_bands.agg(F.count_if(F.col("size") <= SMALL_BAND), F.count_if(F.col("size") > SMALL_BAND)).head()
    if sizes[0]:
        few = mixed_bands.where(F.col("size") <= SMALL_BAND)
        rest = few.where("part <> main").select("band", F.col("doc").alias("a"), F.col("part").alias("part_a"))
        others = few.select("band", F.col("doc").alias("b"), F.col("part").alias("part_b"), "main")
        links = links.unionByName(linked(rest.join(others, "band").where("part_a <> part_b and (part_b = main or a < b)").select("a", "b")))
    if sizes[1]:
        many = mixed_bands.where(F.col("size") > SMALL_BAND)
        tied = components(many.select(F.col("doc").alias("a"), F.col("leader").alias("b"))).withColumnsRenamed({"node": "doc", "component": "cluster"})
        blocks = F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)), F.ceil(F.sum("n") * 8 / F.lit(BLOCK_BYTES))).cast("int")
        sized = tied.join(slim.select("doc", "n"), "doc").groupBy("cluster").agg(blocks.alias("blocks"))
        tied = saved(tied.join(sized, "cluster").withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int")), "clusters")
        tied = tied.join(sets_of(tied.select("doc"), tied.count()), "doc").join(slim, "doc").join(many.groupBy("doc").agg(F.min("part").alias("part")), "doc")
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        tied = tied.withColumn("__k", other).withColumns({"low": F.least("block", "__k"), "high": F.greatest("block", "__k")})
        blocked = saved(tied.select("cluster", "low", "high", "block", "doc", "part", "n", "shingles", *SKETCH).groupBy("cluster", "low", "high").applyInArrow(block_links(percent), "a long, b long"), "links")
        links = links.unionByName(blocked)
    final = saved(components(links), "components")

    out = sig.join(own.join(reps, "digest").select("doc", "rep"), "doc", "left").join(final.withColumnsRenamed({"node": "rep", "component": "__c"}), "rep", "left")
    comp = F.when(F.col("n") > 0, F.coalesce("__c", "rep", "doc")).otherwise(F.col("doc"))
    out = out.select("doc", F.col("n").alias("n_shingles"), F.when(F.col("doc").isNotNull(), comp).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc") == F.col("component_id"), F.lit(True)))


ship(__name__)
