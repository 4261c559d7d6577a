"""Registered queries give the rows of their SQL on the smallest tables."""

import os

import pytest

from terrafold.plans import canonical, evidence, queries  # noqa: F401

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in canonical.BASE:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, con, name):
    got = queries.QUERIES[name](spark, SF)
    if name not in queries.ORACLE_SQL:
        assert got.collect() is not None
        return
    cur = con.execute(queries.ORACLE_SQL[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(got.columns)
    norm = lambda rows: sorted(str(tuple(round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in r)) for r in rows)
    assert norm(got.select(*cols).collect()) == norm(cur.fetchall())
