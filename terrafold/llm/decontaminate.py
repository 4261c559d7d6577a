"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact weighted similarity.

DataFrame functions only. Words are runs of letters and digits, lower-cased; shingles are five words (all words of a
shorter item).
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_saved, saved, small

WIDTH = 5
SIMILARITY = 0.8
#: Fingerprints of 64 bits match within this distance: of 19 differing bits, some block of sixteen has four at most, so
#: probing each block's value and its 2,516 neighbours finds every fingerprint within the radius. The items, whose number
#: does not go with the corpus, are probed so (flips of windows' and of items' blocks). Windows of similarity 0.8 or more
#: differ by 10 bits in the mean; beyond 19 bits are 3 in a thousand at most, whatever shingles they lack or add, of items
#: with six shingles or more.
RADIUS = 19
BLOCKS = 4
BLOCK_BITS = 64 // BLOCKS
FLIPS = (0, 4)
#: Items of so few shingles are looked up by these shingles instead: of five, one that is cut off moves a majority of
#: bits, and fingerprints lie too far apart (1 in a hundred would be missed).
FEW = 5
#: Bit counters of 31 bits, two to a long: an array cannot have more elements than one counts.
LANE = 31
#: First words that a row of windows covers, so that a row's size does not go with the square of a document's matches.
SEGMENT = 512


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def shingles(words: Column, width: int) -> Column:
    """Hashes of all shingles of this width, by position; empty if there are fewer words."""
    hashed = F.transform(words, lambda x: F.xxhash64(x))
    parts = F.arrays_zip(*[F.slice(hashed, k + 1, F.greatest(F.size(hashed) - width + 1, F.lit(0))).alias(f"w{k}") for k in range(width)])
    return F.transform(parts, lambda p: F.xxhash64(*[p[f"w{k}"] for k in range(width)]))


def shingle_rows(rows: DataFrame, hashed: str, widths: list[int]) -> DataFrame:
    """A row (pos, h) with the other columns for each shingle of these widths, from an array of word hashes.

    Word hashes are paired before they become rows and hashed after: one pass over the texts for all widths."""
    others = [c for c in rows.columns if c != hashed]
    words = F.arrays_zip(*[F.slice(hashed, k + 1, F.greatest(F.size(hashed) - k, F.lit(0))).alias(f"w{k}") for k in range(max(widths))])
    rows = rows.select(*others, F.size(hashed).alias("__n"), F.posexplode(words).alias("pos", "__w"))
    of = lambda w: F.when(F.col("pos") <= F.col("__n") - w, F.xxhash64(*[F.col(f"__w.w{k}") for k in range(w)]))
    h = of(widths[0]) if len(widths) == 1 else F.explode(F.array(*map(of, widths)))
    return rows.select(*others, "pos", h.alias("h")).where("h is not null")


def fingerprints(rows: DataFrame, key: str) -> DataFrame:
    """(key, fp): the SimHash of each key's shingle hashes h, every occurrence counting (that is the weight)."""
    bit = lambda b: F.shiftrightunsigned(F.col("h"), b).bitwiseAND(F.lit(1))
    lanes = [F.sum(F.shiftleft(bit(b + 1), LANE) + bit(b)).alias(f"l{b}") for b in range(0, 64, 2)]
    sums = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n"), *lanes)
    count = lambda b: F.shiftrightunsigned(F.col(f"l{b - b % 2}"), LANE * (b % 2)).bitwiseAND(F.lit((1 << LANE) - 1))
    fp = F.lit(0).cast("long")
    for b in range(64):
        fp = fp.bitwiseOR(F.when(2 * count(b) > F.col("__n"), F.shiftleft(F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")))
    return sums.select(key, fp.alias("fp"))


def block(fp: Column, k: int) -> Column:
    return F.shiftrightunsigned(fp, k * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int")


def probes(fp: Column, flips: int) -> Column:
    """(block, value) of each block of a fingerprint and of all that differ from it in so many bits at most."""
    masks = [sum(1 << b for b in bits) for k in range(flips + 1) for bits in combinations(range(BLOCK_BITS), k)]
    masks = F.expr(f"array({', '.join(map(str, masks))})")
    blocks = F.array(*[F.struct(F.lit(k).alias("k"), block(fp, k).alias("v")) for k in range(BLOCKS)])
    masked = lambda p: F.transform(masks, lambda m: F.struct(p["k"].alias("k"), p["v"].bitwiseXOR(m).alias("v")))
    return F.flatten(F.transform(blocks, masked))


def within_radius(left: DataFrame, right: DataFrame, a: str, b: str, on: tuple[str, ...] = ()) -> DataFrame:
    """All (a, b) of equal `on` whose fingerprints differ in RADIUS bits at most: left (a, fp), right (b, fp)."""
    x = left.select(a, "fp", *on, F.explode(probes(F.col("fp"), FLIPS[0])).alias("__p"))
    y = right.select(b, F.col("fp").alias("__fp"), *on, F.explode(probes(F.col("fp"), FLIPS[1])).alias("__p"))
    # Both sides are dealt by key: items in probes are many times their own size, too large to broadcast unseen.
    found = x.join(y.hint("merge"), ["__p", *on]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("__fp"))) <= RADIUS)
    return found.select(a, b).distinct()


def sharing_rare(grains: DataFrame, grams: DataFrame, similarity: float) -> DataFrame:
    """All (ck, it) where window ck has one of the item's shingles that fewest windows have: grains (ck, h), grams (it, h).

    For items too short for the index (FEW). A window this similar lacks m - ceil(similarity * m) of an item's m shingles at most, repeated ones counted, so of
    one more than that it has some; the rarest are asked for. No such pair is missed, whatever its fingerprints.
    """
    grains = grains.distinct()
    known = grams.select("it", "h").join(grains.groupBy("h").agg(F.count(F.lit(1)).alias("__df")), "h", "left")
    item = Window.partitionBy("it")
    known = known.select("it", "h", F.row_number().over(item.orderBy(F.coalesce("__df", F.lit(0)), "h")).alias("__k"), F.count(F.lit(1)).over(item).alias("__m"))
    rare = known.where(F.col("__k") <= F.col("__m") - F.ceil(F.lit(similarity) * F.col("__m") - F.lit(1e-9)) + 1).select("it", "h").distinct()
    return rare.join(grains, "h").select("ck", "it").distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per document and benchmark item that a window of it repeats: key, item, similarity (best), n_windows.

    A window has as many words as an item and is compared with items of that size. It can only be similar to an item if
    it has a shingle of it, and moving its start to the first of these never lowers the similarity; so the windows are
    those that start at a shingle of the benchmark and have the size of an item with that shingle. Windows of equal
    content, in whatever documents, are fingerprinted once, over all of their shingles. The index gives all fingerprints
    within RADIUS bits of an item's; items of FEW shingles or fewer are looked up by shingle. Weighted shingle similarity
    (sum of the smaller counts over sum of the larger ones) decides among these candidates. Equal windows are never missed,
    similar ones by 3 in a thousand at most, see RADIUS.

    The benchmark's shingles are broadcast up to a row limit, beyond it they are joined by shuffle. Null ids on either
    side are left out (nothing could be reported); null and empty texts and items without words match nothing; repeated
    rows report once; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    items = benchmark.where(F.col(item).isNotNull()).select(F.col(item).alias("item"), tokens(F.col(item_text)).alias("words")).where(F.size("words") > 0)
    items = items.select(F.xxhash64("item", F.concat_ws(" ", "words")).alias("it"), "item", "words", F.size("words").alias("n"), F.least(F.size("words"), F.lit(WIDTH)).alias("width")).dropDuplicates(["it"])
    items = saved(items, "items")
    widths = sorted(r[0] for r in items.select("width").distinct().collect())
    if not widths:
        return docs.limit(0).select(key).join(benchmark.limit(0).select(item)).withColumns({"similarity": F.lit(0.0), "n_windows": F.lit(0).cast("long")})
    parts = [items.where(F.col("width") == w).select("it", "item", "n", "width", F.explode(shingles(F.col("words"), w)).alias("h")) for w in widths]
    grams = parts[0]
    for p in parts[1:]:
        grams = grams.unionByName(p)
    grams = saved(grams, "item-shingles")
    vocabulary = small(saved(grams.groupBy("width", "h").agg(F.collect_set("n").alias("sizes")), "item-vocabulary"))
    longest = items.agg(F.max("n")).head()[0]

    read = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("doc"), F.xxhash64(text).alias("row"), F.col(text).alias("text"))
    hashed = read.select("doc", "row", F.transform(tokens(F.col("text")), lambda x: F.xxhash64(x)).alias("hashed"))
    hits = shingle_rows(hashed.where(F.size("hashed") >= widths[0]), "hashed", widths).join(vocabulary, "h")
    parts = hits.groupBy("doc", "row", "width", (F.col("pos") / SEGMENT).cast("int").alias("seg")).agg(F.collect_set(F.struct("pos", "sizes")).alias("hits"))
    per_doc = saved(parts.groupBy("doc", "row", "width").agg(F.collect_list(F.struct("seg", "hits")).alias("segs")), "hits")

    of = F.lit(None).cast("array<bigint>")
    for w in widths:
        of = F.when(F.col("width") == w, shingles(F.col("words"), w)).otherwise(of)
    matched = read.join(small(per_doc), ["doc", "row"]).select("doc", "width", "segs", tokens(F.col("text")).alias("words"))
    matched = saved(matched.select("doc", "width", "segs", of.alias("sh")), "matched")
    part = lambda s: F.struct(s["seg"].alias("seg"), s["hits"].alias("hits"), F.slice("sh", s["seg"] * SEGMENT + 1, SEGMENT + longest).alias("sh"))
    spans = matched.select("doc", "width", F.explode(F.transform("segs", part)).alias("s")).select("doc", "width", "s.*")
    # Places and sizes become rows first, so that no row holds more than one window's content.
    spans = spans.select("doc", "width", "seg", "sh", F.explode("hits").alias("x")).select("doc", "width", "seg", "sh", "x.pos", F.explode("x.sizes").alias("n"))
    content = F.slice("sh", F.col("pos") - F.col("seg") * SEGMENT + 1, F.col("n") - F.col("width") + 1)
    spans = spans.select("doc", "width", "pos", "n", content.alias("content"))
    spans = saved(spans.withColumn("ck", F.xxhash64("width", "n", "content")), "windows")
    contents = saved(spans.groupBy("ck").agg(F.first("width").alias("width"), F.first("n").alias("n"), F.first("content").alias("content")), "contents")

    grains = contents.select("ck", F.explode("content").alias("h"))
    size = lambda rows, k: rows.select(k, "n", "width").distinct()
    windows = saved(fingerprints(grains, "ck").join(size(contents, "ck"), "ck"), "window-prints")
    prints = saved(fingerprints(grams, "it").join(size(items, "it"), "it"), "item-prints")
    pairs = within_radius(windows, prints, "ck", "it", ("n", "width"))
    few = items.where(F.col("n") - F.col("width") + 1 <= FEW)
    short = contents.join(small(saved(few.select("n", "width").distinct(), "few-sizes")), ["n", "width"], "left_semi").select("ck", F.explode("content").alias("h"))
    pairs = pairs.unionByName(sharing_rare(short, grams.join(few.select("it"), "it", "left_semi"), similarity)).distinct()
    pairs = pairs.join(contents.select("ck", "n", "width", F.size("content").alias("total")), "ck").join(items.select("it", "item", F.col("n").alias("__n"), F.col("width").alias("__w"), (F.col("n") - F.col("width") + 1).alias("m")), "it").where("width = __w and n = __n")
    x = grains.groupBy("ck", "h").agg(F.count(F.lit(1)).alias("x"))
    y = grams.groupBy("it", "h").agg(F.count(F.lit(1)).alias("y"))
    both = pairs.join(x, "ck").join(y, ["it", "h"]).groupBy("ck", "it", "item", "total", "m").agg(F.sum(F.least("x", "y")).alias("same"))
    alike = both.withColumn("similarity", F.col("same") / (F.col("total") + F.col("m") - F.col("same"))).where(F.col("similarity") >= similarity)
    alike = small(saved(alike.groupBy("ck", "item").agg(F.max("similarity").alias("similarity")), "alike"))
    for done in (items, grams, per_doc, matched, contents, windows, prints):
        drop_saved(done)
    out = spans.select("doc", "pos", "ck").join(alike, "ck").groupBy("doc", "item").agg(F.max("similarity").alias("similarity"), F.countDistinct("pos").alias("n_windows"))
    return out.withColumnsRenamed({"doc": key, "item": item})


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The documents without a contaminated window, with their columns as they are. Null ids stay."""
    found = small(saved(contaminated(docs, benchmark, key, **options).select(key).distinct(), "contaminated"))
    return docs.join(found, key, "left_anti").select(*docs.columns)
