"""Filter interaction audit: what each filter removes in every order in which a set of filters can be applied.

Texts are scanned as Arrow buffers: a table of byte classes and prefix sums count characters, capitals, symbols and words,
sorted word hashes, verified on the words' bytes, count distinct words. Each document becomes a mask of the filters that it
fails; all orders are then sums over masks, of which there are 2 to the number of filters at most.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, ship, small
from .hashing import CHUNK, same_words, text_chunks, words

SYMBOLS = "#$%&*|"
#: Filters by letter, in the order of their bits: the condition on a document's measures under which it fails.
FILTERS: dict[str, str] = {
    "A": "n_words < 200",
    "B": "100 * n_distinct < 50 * n_words",
    "C": "100 * n_capitals > 3 * n_chars",
    "D": "n_symbols > 0",
    "E": "repeated",
}
MEASURES = ("n_words", "n_distinct", "n_capitals", "n_symbols", "n_chars")
_CAPITAL, _SYMBOL, _CONTINUED = 1, 2, 4
CLASSES = np.zeros(256, np.uint8)
CLASSES[65:91] |= _CAPITAL
CLASSES[list(SYMBOLS.encode())] |= _SYMBOL
CLASSES[0x80:0xC0] |= _CONTINUED


def distinct_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray, hashed: np.ndarray, n_rows: int) -> np.ndarray:
    """Distinct words of each row: its hashes are sorted, and words that meet in one are compared byte by byte."""
    order = np.lexsort((hashed, row))
    met = (row[order][1:] == row[order][:-1]) & (hashed[order][1:] == hashed[order][:-1])
    pairs = np.flatnonzero(met)
    wrong = pairs[~same_words(data, starts, ends, order[pairs + 1], order[pairs])]
    found = np.bincount(row, minlength=n_rows) - np.bincount(row[order[pairs]], minlength=n_rows)
    for r in np.unique(row[order[wrong]]):  # two words with one hash: this row is counted by its words
        own = np.flatnonzero(row == r)
        found[r] = len({data[starts[k] : ends[k]].tobytes() for k in own})
    return found


def measures(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """MEASURES of each row of a chunk of UTF-8 texts."""
    kinds = CLASSES[data]

    def counted(kind: int) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum((kinds & kind) > 0, dtype=np.int64)))
        return total[offsets[1:]] - total[offsets[:-1]]

    starts, ends, row, hashed = words(data, offsets)
    n_rows = len(offsets) - 1
    return {
        "n_words": np.bincount(row, minlength=n_rows),
        "n_distinct": distinct_words(data, starts, ends, row, hashed, n_rows),
        "n_capitals": counted(_CAPITAL),
        "n_symbols": counted(_SYMBOL),
        "n_chars": np.diff(offsets) - counted(_CONTINUED),
    }


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with MEASURES in place of the text. Null text counts as empty; input columns of these names are replaced."""
    others = [c for c in docs.columns if c not in (text, *MEASURES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, data, offsets in text_chunks(b.column(len(others)), CHUNK):
                found = measures(data, offsets)
                n = len(offsets) - 1
                yield pa.RecordBatch.from_arrays([*[b.column(k).slice(at, n) for k in range(len(others))], *[pa.array(found[m], pa.int64()) for m in MEASURES]], [*others, *MEASURES])

    read = docs.select(*others, text)
    schema = read.drop(text).schema
    for m in MEASURES:
        schema = schema.add(m, "long")
    return read.mapInArrow(run, schema)


def failures(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str | Column = "lang", filters: Mapping[str, str] = FILTERS) -> DataFrame:
    """One row per input row: doc, part (null: empty), mask (bit k: it fails the k-th filter).

    `repeated` in a filter is whether a row of smaller id anywhere in the table has the same text, removed or not. Texts
    are compared by SHA-256. The smallest id of each text is found with partial minima, and rows meet it on text and id
    together, so that a text that a third of all rows share is not one join key. A row with a null id repeats nothing and
    is repeated by nothing; rows that share the smallest id of their text are none of them repeated. Null text is empty.
    An empty table gives no rows; other columns are ignored.
    """
    if not set("".join(filters)) or any(len(k) != 1 for k in filters):
        raise ValueError("filters are named by one letter each")
    site = F.col(part) if isinstance(part, str) else part
    read = docs.select(F.col(key).alias("doc"), F.coalesce(site.cast("string"), F.lit("")).alias("part"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("digest"), F.col(text).alias("text"))
    found = saved(measured(read), "filter-measures")
    first = found.where("doc is not null").groupBy("digest").agg(F.min("doc").alias("doc")).withColumn("__first", F.lit(True))
    rows = found.join(first, ["doc", "digest"], "left").withColumn("repeated", F.col("doc").isNotNull() & F.col("__first").isNull())
    mask = F.lit(0)
    for k, fails in enumerate(filters.values()):
        mask = mask + F.when(F.expr(fails), 1 << k).otherwise(0)
    return rows.select("doc", "part", mask.alias("mask"))


def every_order(masks: DataFrame, letters: str = "".join(FILTERS), notes: tuple[str, ...] = ()) -> DataFrame:
    """From rows (part, mask, one boolean column per note): a row per part, order of the filters and step.

    Columns: part, filter_order, step (its filter is that letter), kept (rows left after it), removed (here), redundant
    (failing it, removed earlier), unique_fails (failing nothing else), <note>_lost (removed here with the note), and
    shapley: what the filter removes, summed over all orders. Of the k! orders those in which it comes first among the
    filters that a row fails are k! divided by their number. Parts without rows do not exist; a part has k! * k rows.
    """
    counts = [F.count(F.lit(1)).alias("n"), *[F.sum(F.col(c).cast("long")).alias(c) for c in notes]]
    per_part = masks.groupBy("part", "mask").agg(*counts).groupBy("part").agg(F.collect_list(F.struct("mask", "n", *notes)).alias("masks"))
    bit = {x: 1 << k for k, x in enumerate(letters)}
    steps = [(o, s + 1, bit[x], sum(bit[y] for y in o[:s])) for o in map("".join, permutations(letters)) for s, x in enumerate(o)]
    listed = ", ".join(f"named_struct('filter_order', '{o}', 'step', {s}, 'own', {own}, 'before', {before})" for o, s, own, before in steps)
    rows = per_part.select("part", "masks", F.explode(F.expr(f"array({listed})")).alias("s")).select("part", "masks", "s.*")
    has = lambda m, bits: m["mask"].bitwiseAND(bits) != 0
    own, before = F.col("own"), F.col("before")

    def total(which, value=lambda m: m["n"]) -> Column:
        return F.aggregate(F.filter("masks", which), F.lit(0).cast("long"), lambda a, m: a + value(m))

    here = lambda m: has(m, own) & ~has(m, before)
    share = lambda m: m["n"] * F.expr(f"{factorial(len(letters))}L") / F.bit_count(m["mask"])
    return rows.select(
        "part",
        "filter_order",
        "step",
        total(lambda m: ~has(m, own.bitwiseOR(before))).alias("kept"),
        total(here).alias("removed"),
        total(lambda m: has(m, own) & has(m, before)).alias("redundant"),
        total(lambda m: m["mask"] == own).alias("unique_fails"),
        *[total(here, lambda m, c=c: F.coalesce(m[c], F.lit(0).cast("long"))).alias(f"{c}_lost") for c in notes],
        total(lambda m: has(m, own), lambda m: share(m).cast("long")).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str | Column = "lang", filters: Mapping[str, str] = FILTERS) -> DataFrame:
    """every_order of the filters over docs, with what of quality 1 (good) and toxic 1 (toxic) is lost at each step.

    labels: (key, quality, toxic); a document without a row has neither, repeated rows count if one of them says so.
    """
    marked = labels.groupBy(F.col(key).alias("doc")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    rows = failures(docs, key, text, part, filters).join(small(saved(marked.where("good or toxic"), "filter-labels")), "doc", "left")
    return every_order(rows.select("part", "mask", "good", "toxic"), "".join(filters), ("good", "toxic"))


ship(__name__)
