"""The whole pipeline against a plain version of its stages, on a fixture with every kind of case."""

import collections
import random
import re

from pyspark.sql import functions as F

import corpus_pipeline
from terrafold.llm import line_dedup

from .test_operators import DOCS, brute_contamination, brute_near, prose

NAMES = ("doc_id", "text", "lang", "source", "n_chars")


def fixture():
    rng = random.Random(40)
    bench = [(k, prose(rng, n)) for k, n in enumerate((6, 20, 60))]
    rows, footer = [], {s: f"all rights of {s} are reserved" for s in ("a", "b", None)}
    for k in range(120):
        source = ("a", "a", "a", "b", None)[k % 5]
        text = f"{prose(rng, rng.randint(12, 60))}\n\n{footer[source]}\n{prose(rng, 9)}"
        if k % 12 == 0:
            text += " " + bench[k // 12 % 3][1].upper()
        rows.append((k, text, "en", source, len(text)))
    for k in range(40):  # copies, near copies, and a group of a third of a source
        _, text, lang, source, _ = rows[3 * k] if k < 15 else rows[1]
        rows.append((200 + k, text if k % 2 else text + " end", lang, source, 0))
    rows += [(300, None, "en", "a", None), (301, "", None, "a", 0), (302, "12 34 56", "en", "b", 8), (None, prose(rng, 30), "en", "a", 1), (None, prose(rng, 30), None, None, 1)]
    body = "\n".join(prose(rng, 14) for _ in range(10))
    rows += [(400 + k, f"{body}\nnote number {k}", "en", "a", 1) for k in range(30)]  # near copies that share ten lines
    rows += [(303, "words " * 3000, "en", "b", 1), (304, footer["a"], "en", "a", 1)]
    rng.shuffle(rows)
    return rows, bench


def plain(rows, bench):
    rows = [r for r in rows if re.search(r"[^\W\d_]", r[1] or "")]
    texts = {(r[3], r[1]) for r in rows}
    number = {t: k for k, t in enumerate(sorted({t for _, t in texts}))}
    pages = collections.Counter(s for s, _ in texts)

    def repeated(group):
        seen = collections.defaultdict(set)
        for source, text in texts:
            for line in {x for x in text.split("\n") if x.strip(" ")}:
                seen[source, line].add(group.get(text, text))
        return {at for at, found in seen.items() if 1 < len(found) > line_dedup.RATIO * pages[at[0]]}

    first = repeated({})
    holders = {t for s, t in texts if any((s, x) in first for x in t.split("\n"))}
    near = brute_near([(number[t], t) for t in holders], 5)
    boiler = first & repeated({t: near[number[t]][1] for t in holders})
    rows = [(r[0], "\n".join(x for x in r[1].split("\n") if (r[3], x) not in boiler), r[2], r[3]) for r in rows]
    near = brute_near([r[:2] for r in rows], 5)
    rows = [r for r in rows if r[0] is None or near[r[0]][1] == r[0]]
    bad = {d for d, _ in brute_contamination([r[:2] for r in rows], bench)}
    return boiler, [r for r in rows if r[0] is None or r[0] not in bad]


def test_pipeline_against_its_plain_version(spark, tmp_path):
    rows, bench = fixture()
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    boiler, want = plain(rows, bench)
    assert len(boiler) == 3 and 80 < len(want) < 130
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.text, r.lang, r.source) for r in got), key=str) == sorted(want, key=str)
    assert all(r.n_chars == len(r.text) and r.size == len(r.text.split()) for r in got)
    order = [r.position for r in got if r.position is not None]
    assert order == sorted(order) and all(r.copies <= 3 for r in got)


def test_stages_with_null_and_repeated_ids_and_other_columns(spark, tmp_path):
    rows, bench = fixture()
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = rows[:60] + rows[:5] + [(None, None, None, None, None)] * 2
    docs = spark.createDataFrame(rows, DOCS).withColumns({"kept": F.lit("x"), "lines": F.lit(1), "doc": F.lit("y"), "score": F.lit(2), "size": F.lit("z")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == list(NAMES), name
        nulls = got.where("doc_id is null").count()
        assert nulls == sum(r[0] is None and (r[1] is not None or name != "language ID") for r in rows), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == len(rows)
