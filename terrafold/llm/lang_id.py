"""Language ID by hierarchical discrimination: family first, then one-versus-one linear SVMs within the family."""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, small_batches

# Language families by ISO 639 code. A language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "fy", "yi"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz", "ky", "tk"),
    "indic": ("hi", "bn", "mr", "ne", "pa", "gu", "ur", "si"),
}

#: Labelled rows that the models learn from, about: so many of each language, and of all together (many languages share
#: these alike, one row each at least). The driver holds 4 KB for each.
TRAIN_ROWS_PER_LANG, TRAIN_ROWS = 1200, 16_000
#: Labels that a model learns at most; more are an error. A label outside FAMILIES makes a family, 16 KB of the model and
#: one pass over the sample, of its own.
MAX_LABELS = 1000
#: Hashed character n-grams (of UTF-8 bytes) make so many features.
N_FEATURES = 4096
ORDERS = (1, 2, 3, 4)
#: Bytes of a text that are hashed at a time; every byte counts, whatever the length.
CHUNK = 1 << 20
UNKNOWN = "und"


def features(text: str) -> np.ndarray:
    """Square roots of n-gram frequencies over the whole text, of length 1."""
    raw = np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), dtype=np.uint8)
    # Controls, digits and ASCII punctuation count as one kind of gap.
    raw = GAPS[raw]
    counts = np.zeros(N_FEATURES, dtype=np.int64)
    for at in range(0, len(raw), CHUNK):
        part = raw[at : at + CHUNK + max(ORDERS) - 1].astype(np.uint32)
        hashed = np.zeros(len(part), dtype=np.uint32)
        for n in range(1, max(ORDERS) + 1):
            starts = min(CHUNK, len(part) - n + 1)
            if starts <= 0:
                break
            hashed = hashed[:starts] * np.uint32(257) + part[n - 1 : n - 1 + starts]
            if n in ORDERS:
                mixed = (hashed + np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(2654435761)
                counts += np.bincount(mixed >> np.uint32(20), minlength=N_FEATURES)
    out = np.sqrt(counts.astype(np.float32))
    return out / max(float(np.sqrt((out * out).sum())), 1e-9)


GAPS = np.arange(256, dtype=np.uint8)
GAPS[:65] = 32
GAPS[91:97] = 32
GAPS[123:128] = 32


class Rows:
    """Rows of features in a byte each, decoded to length 1 one at a time: the driver holds neither decoded rows nor copies of parts."""

    def __init__(self, codes: np.ndarray, norms: np.ndarray | None = None, at: np.ndarray | None = None) -> None:
        self.codes, self.at = codes, np.arange(len(codes)) if at is None else at
        self.norms = np.array([max(float(np.sqrt((r * r).sum())), 1e-9) for r in (c.astype(np.float32) for c in codes)], np.float32) if norms is None else norms
        self.shape = (len(self.at), codes.shape[1])

    def __len__(self) -> int:
        return len(self.at)

    def __getitem__(self, i: int) -> np.ndarray:
        return self.codes[self.at[i]].astype(np.float32) / self.norms[self.at[i]]

    def where(self, mask: np.ndarray) -> Rows:
        return Rows(self.codes, self.norms, self.at[mask])


def train_svm(x: Rows, y: np.ndarray, c: float = 1.0, epochs: int = 12) -> tuple[np.ndarray, float]:
    """Linear SVM (squared hinge) by dual coordinate descent; y is +1 or -1. Deterministic."""
    w, bias, alpha, rng = np.zeros(x.shape[1]), 0.0, np.zeros(len(x)), np.random.default_rng(0)
    diag = np.array([np.einsum("d,d->", r, r) for r in map(x.__getitem__, range(len(x)))], np.float32) + 1 + 0.5 / c
    for _ in range(epochs):
        for i in rng.permutation(len(x)):
            row = x[i]
            step = max(alpha[i] - (y[i] * (row @ w + bias) - 1 + 0.5 / c * alpha[i]) / diag[i], 0.0) - alpha[i]
            if step:
                alpha[i] += step
                w += step * y[i] * row
                bias += step * y[i]
    return w.astype(np.float32), float(bias)


@dataclass
class Model:
    """weights, bias: one column per binary model. family_of names the rows; pairs name the one-versus-one models."""

    families: list[str] = field(default_factory=list)
    members: Mapping[str, list[str]] = field(default_factory=dict)
    pairs: Mapping[str, list[tuple[int, int]]] = field(default_factory=dict)
    weights: np.ndarray | None = None
    bias: np.ndarray | None = None

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        """The language and a score: confidence in the family times that in the language within it."""
        if not self.families:
            return UNKNOWN, 0.0
        margins = x @ self.weights + self.bias
        sure = lambda m: 1 / (1 + np.exp(-4 * float(m)))
        family, score = self.families[0], 1.0
        if (n := len(self.families) if len(self.families) > 1 else 0):
            best = int(np.argmax(margins[:n]))
            family, score = self.families[best], sure(margins[best])
        langs, at = self.members[family], n + sum(len(self.pairs[f]) for f in self.families[: self.families.index(family)])
        votes, won = np.zeros(len(langs)), np.zeros(len(langs))
        for k, (a, b) in enumerate(self.pairs[family]):
            m = margins[at + k]
            winner = a if m >= 0 else b
            votes[winner] += 1
            won[a] += m
            won[b] -= m
        best = int(np.lexsort((np.arange(len(langs))[::-1], won, votes))[-1])
        if len(langs) > 1:
            score *= sure(won[best] / (len(langs) - 1))
        return langs[best], min(1.0, max(0.0, score))


def fit(x: Rows, lang: list[str], families: Mapping[str, tuple[str, ...]] = FAMILIES) -> Model:
    known = {code: name for name, codes in families.items() for code in codes}
    lang_arr, names = np.array(lang, dtype=object), sorted(set(lang))
    members: dict[str, list[str]] = {}
    for code in names:
        members.setdefault(known.get(code, f"={code}"), []).append(code)
    model = Model(sorted(members), members)
    columns = []
    if len(members) > 1:
        for f in model.families:
            columns.append(train_svm(x, np.where(np.isin(lang_arr, members[f]), 1.0, -1.0)))
    model.pairs = {f: [(a, b) for a in range(len(m)) for b in range(a + 1, len(m))] for f, m in members.items()}
    for f in model.families:
        for a, b in model.pairs[f]:
            rows = np.isin(lang_arr, [members[f][a], members[f][b]])
            columns.append(train_svm(x.where(rows), np.where(lang_arr[rows] == members[f][a], 1.0, -1.0)))
    model.weights = np.stack([w for w, _ in columns], 1) if columns else np.zeros((N_FEATURES, 0), np.float32)
    model.bias = np.array([b for _, b in columns], np.float32)
    return model


def train(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", rows_per_lang: int = TRAIN_ROWS_PER_LANG, rows_in_all: int = TRAIN_ROWS) -> Model:
    """Fit on a bounded sample of labelled rows: about rows_per_lang distinct rows of each language, fewer if that makes
    more than rows_in_all, those with the lowest hash of key and text (a null key is one like others; repeated rows teach
    once). No language is left out.

    More than MAX_LABELS labels are an error. Rows with null text or label, or without a letter, teach nothing. Only the languages' counts and the sample's features
    reach the driver (4 KB a row, twice that while it sorts them). Without any row the model predicts und.
    """
    small_batches(labelled.sparkSession)
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    most = 1 << 40
    draw = F.pmod(F.xxhash64(F.col(key).cast("string"), F.col(text)), F.lit(most))
    counts = rows.groupBy(lang).agg(F.count(F.lit(1)), F.min(draw)).limit(MAX_LABELS + 1).collect()
    if not counts:
        return Model()
    if len(counts) > MAX_LABELS:
        raise ValueError(f"column {lang} has over {MAX_LABELS} labels: it holds something else than languages")
    wanted = max(1, min(rows_per_lang, rows_in_all // len(counts)))
    shares = [(name, max(least + 1, min(most, -(-most * wanted // n)))) for name, n, least in counts]
    shares = F.broadcast(labelled.sparkSession.createDataFrame(shares, "__lang string, __share long"))  # a row a language

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [(features(t.as_py()) * 255).round().astype(np.uint8).tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(x, pa.binary())], ["key", "lang", "x"])

    drawn = rows.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"), draw.alias("__draw"))
    drawn = drawn.join(shares, F.col("lang") == F.col("__lang")).where("__draw < __share").select("key", "text", "lang").distinct()
    # As Arrow the batches pass through the driver's JVM; for collect() it would hold all of them, and then all as rows.
    got = drawn.mapInArrow(encode, "key string, lang string, x binary").toArrow()
    order = pc.sort_indices(got, sort_keys=[(c, "ascending") for c in ("lang", "key", "x")], null_placement="at_start")
    codes, langs = np.empty((len(got), N_FEATURES), np.uint8), got.column("lang").take(order).to_pylist()
    for k, i in enumerate(order.to_pylist()):
        codes[k] = np.frombuffer(got.column("x")[i].as_buffer(), np.uint8)
    del got
    return fit(Rows(codes), langs)


def identify(spark: SparkSession, docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add lang_pred and score to every row; nothing is shuffled.

    Texts are read whole. Null texts and texts without a letter (empty ones too) get und and score 0. Only the text is
    looked at, so repeated rows agree. Columns lang_pred and score of the input are replaced; others pass through.
    """
    small_batches(spark)
    # 16 KB a family and a pair of languages of one family, pickled by value: executors need no copy of this package.
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(model))

    @F.pandas_udf("lang_pred string, score double")
    def udf(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = pickle.loads(sent.value)
        for texts in parts:
            yield pd.DataFrame([m.predict(features(t)) for t in texts], columns=["lang_pred", "score"])

    lettered = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    out = docs.drop("lang_pred", "score").withColumn("__p", udf(F.when(lettered, F.col(text)).otherwise("")))
    return out.withColumns({"lang_pred": F.when(lettered, F.col("__p.lang_pred")).otherwise(UNKNOWN), "score": F.when(lettered, F.col("__p.score")).otherwise(0.0)}).drop("__p")


def held_out(key: str = "doc_id"):
    """True for rows that must not teach: crc32 of the key as text, modulo 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


ship(__name__)
