"""Corpus pipeline: five stages from raw documents to a mixed training order.

Each stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet and read again as the next one's
docs. All but the last return the columns of documents. Rows with a null doc_id pass every stage; rows that share a doc_id
are one document to the stages that decide by id, and share its fate. Empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.llm import decontaminate, lang_id, line_dedup, mixing, near_dedup
from terrafold.llm.common import saved

#: Below this confidence, and without any letter, a document's language is rejected. Of two families with two languages
#: each a score is 0.25 at least, so there only texts without letters go.
MIN_SCORE = 0.2

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language can be told; lang stays as it came."""
    model = lang_id.train(docs)
    scored = lang_id.identify(spark, docs.select(*COLUMNS), model)
    return scored.where((F.col("lang_pred") != lang_id.UNKNOWN) & (F.col("score") >= MIN_SCORE)).select(*COLUMNS)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop each source's boilerplate lines; every document stays, n_chars follows its text.

    A group of near copies counts as one page here: it is the next stage's to find, and the lines that it shares are its
    text and no boilerplate."""
    near = lambda pages: near_dedup.near_duplicates(pages, "page").select(F.col("doc").alias("page"), F.col("component_id").alias("group"))
    kept = line_dedup.dedup_lines(docs.select(*COLUMNS), alike=near)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, that of the smallest id, of each group of near copies."""
    found = near_dedup.near_duplicates(docs)
    gone = saved(found.where("not kept").select(F.col("doc").alias("__gone")).distinct(), "near-copies")
    return docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti").select(*COLUMNS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that repeat a benchmark item."""
    return decontaminate.decontaminate(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All remaining documents in training order, with what the mix takes of each and the positions of its copies."""
    return mixing.mix(docs.select(*COLUMNS))


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_deduplication),
    ("MinHash near-dedup", near_deduplication),
    ("benchmark decontamination", benchmark_decontamination),
    ("source mixing", source_mixing),
]

#: SQL can't express the language stage; tests/llm/test_pipeline_brute.py holds the whole against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)
