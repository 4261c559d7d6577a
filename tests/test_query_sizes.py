"""Registered queries against their SQL on tables of sizes and values that the smallest tables lack."""

import random
import re

import pytest
from pyspark.sql import functions as F

from terrafold.operators import relations
from terrafold.plans import canonical, evidence, queries  # noqa: F401

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")


def same_as_sql(spark, folder, name):
    con = duckdb.connect()
    for t in canonical.BASE:
        if (folder / f"{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet{'/*.parquet' if (folder / f'{t}.parquet').is_dir() else ''}'")
    cur = con.execute(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, str(folder)).select(*[d[0] for d in cur.description])
    key = lambda r: tuple((v is not None, v if v is not None else 0) for v in r)
    got, want = sorted(map(tuple, got.collect()), key=key), sorted(cur.fetchall(), key=key)
    assert got == want
    return got


@pytest.mark.parametrize("n", [15, 52])
def test_first_across_bundles_of_any_count(spark, tmp_path, n):
    """Nine tenths of the rows are no whole number; a null text is one body over all bundles; ids may be null or negative."""
    rows = [(k if k != 3 else -k, None if k % 6 == 4 else f"text {k % 11}") for k in range(n - 1)] + [(None, "text 2")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = same_as_sql(spark, tmp_path, "q_first_across_bundles")
    assert len(got) == n and {None, "duplicate_body"} <= {r[2] for r in got}


def test_district_fallback_is_cut_before_places_meet(spark):
    """The first of a district by brute force, for selected places of several kinds; no join of all places of a district."""
    rng = random.Random(7)
    kinds = ("school", "residential", "school_group")
    places = [(f"p{k:03}", rng.choice(kinds), rng.choice("ABC") + "x", rng.choice(["N", "E", None]), rng.choice([None, 30.0]), 120.0, rng.choice([None, 0, 1, 2])) for k in range(300)]
    entities = spark.createDataFrame(places, "id string, kind string, name string, district string, lat double, lng double, post_count long")
    candidates, selected = {p[0] for p in places if rng.random() < 0.7}, {p[0] for p in places if rng.random() < 0.3}
    ids = lambda x: spark.createDataFrame([(i,) for i in sorted(x)], "id string")
    found = relations.district_fallback(entities, ids(candidates), ids(selected))
    want = []
    for s in (p for p in places if p[0] in selected):
        pool = [p for p in places if p[0] in candidates and p[3] and p[3] == s[3] and p[1] != s[1]]
        pool.sort(key=lambda p: (p[4] is None, p[6] is None, -(p[6] or 0), p[2], p[0]))
        want += [(s[0], k + 1, p[0], p[4] is not None) for k, p in enumerate(pool[:8])]
    assert sorted(map(tuple, found.collect())) == sorted(want) and len(want) > 300
    # What meets the selected places is a few of each district and kind, cut in every task.
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"WindowGroupLimit \[district#\d+, kind#\d+\].* Partial", plan)
