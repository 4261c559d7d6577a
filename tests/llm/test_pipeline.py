"""The stages on planted rows, and the registered queries on the smallest tables."""

import os
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from terrafold.llm import line_dedup, queries

from .test_operators import prose

SF = "/root/testdata/sf0.001"


def test_stages_on_planted_rows(spark, tmp_path):
    clean = [f"the house number {k} is by the water and the old mill of {k * 7} with its {k * 13} wheels and the road {k * 31} to it" for k in range(30)]
    bench = "which of these seventeen rivers flows through the capital of the northern kingdom before it reaches the sea"
    rows = [(k, t, "en", "a", len(t)) for k, t in enumerate(clean)]
    rows += [(100, clean[0], "en", "b", 1), (101, clean[1] + " again", "en", "b", 1), (102, f"{clean[2]} {bench}", "en", "a", 1), (103, "123 456", "en", "a", 7), (104, None, "en", "a", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in out) == list(range(30))
    assert sum(r.taken for r in out) == pytest.approx(sum(r.size for r in out), rel=0.1)


def test_one_of_a_large_group_of_copies_keeps_its_text(spark):
    texts = [f"the house number {k} is by the water of {k * 7}\nits {k * 13} wheels and the road {k * 31} to it\nall rights are reserved" for k in range(60)]
    copied = "a text that many pages repeat in full\nand that has a second line of its own"
    rows = [(k, t, "en", "a", len(t)) for k, t in enumerate(texts)] + [(k, copied, "en", "a", len(copied)) for k in range(100, 130)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    lined = corpus_pipeline.line_deduplication(spark, docs, SF)
    got = {r.doc_id: r.text for r in corpus_pipeline.near_deduplication(spark, lined, SF).collect()}
    assert got == {k: t.rsplit("\n", 1)[0] for k, t in enumerate(texts)} | {100: copied}


def test_near_copies_keep_a_whole_body_and_lose_their_footer(spark):
    rng = random.Random(60)
    foot = "all rights are reserved by the owner of this site"
    clean = {k: f"{prose(rng, 40)}\n{prose(rng, 20)}" for k in range(240)}
    body = "\n".join(prose(rng, 12) for _ in range(10))
    rows = [(k, f"{t}\n{foot}", "en", "a", 1) for k, t in clean.items()] + [(k, f"{body}\nnote number {k}\n{foot}", "en", "a", 1) for k in range(300, 360)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    lined = corpus_pipeline.line_deduplication(spark, docs, SF)
    got = {r.doc_id: r.text for r in corpus_pipeline.near_deduplication(spark, lined, SF).collect()}
    assert got == clean | {300: f"{body}\nnote number 300"}


def test_lines_of_copies_stay_in_the_query_too(spark):
    rng = random.Random(61)
    copied = "\n".join(prose(rng, 8) for _ in range(5))
    rows = [(k, prose(rng, 30), "a") for k in range(240)] + [(k, copied, "a") for k in range(300, 320)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {(r.doc_id, r.text, r.n_removed) for r in got} == {(k, t, 0) for k, t, _ in rows}


def test_stages_return_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns and got.count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_match_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    shown = lambda rows: sorted(str([float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in r]) for r in rows)
    a, b = shown(queries.QUERIES[name](spark, SF).select(*names).collect()), shown(cur.fetchall())
    assert a == b


def test_language_accuracy_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = queries.op1_language_id(spark, SF).join(docs, "doc_id").where("held_out and lang is not null")
    right = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).head()[0]
    assert right > 0.95
