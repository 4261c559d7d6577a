"""Digests of files of any size, and tables in SQLite files."""

import hashlib
import json
import random
import sqlite3

import pytest

from terrafold.sources import files, publish, readers, sqlite


def test_digests_do_not_depend_on_the_way_of_reading(spark, tmp_path):
    rng = random.Random(1)
    folder = tmp_path / "a folder with % and é"
    (folder / "deep").mkdir(parents=True)
    want = {}
    for k, size in enumerate((0, 1, 99, 100, 101, 5000, files.PIECE, 2 * files.PIECE + 3)):
        at = folder / "deep" / f"f {k}.bin" if k % 2 else folder / f"f{k}.bin"
        at.write_bytes(data := rng.randbytes(size))
        want[at.name] = (size, hashlib.sha256(data).hexdigest())
    for whole in (files.WHOLE, 100, -1):
        got = files.file_digests(spark, str(folder), whole).collect()
        assert {r.path.rsplit("/", 1)[-1]: (r.length, r.sha256) for r in got} == want and len(got) == len(want)
    plan = files.file_digests(spark, str(folder), 100)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [LessThanOrEqual(length,100)]" in plan.replace("IsNotNull(length), ", "")


def test_a_file_too_large_for_a_row(spark, tmp_path):
    size = (1 << 31) + 5
    with open(tmp_path / "large.bin", "wb") as f:
        f.truncate(size)  # a sparse file: zeros that take no room
    digest = hashlib.sha256()
    for _ in range(size >> 20):
        digest.update(bytes(1 << 20))
    digest.update(bytes(size % (1 << 20)))
    (tmp_path / "small.txt").write_text("one")
    got = {r.path.rsplit("/", 1)[-1]: (r.length, r.sha256) for r in readers.file_hashes(spark, str(tmp_path), str(tmp_path)).collect()}
    assert got == {"large.bin": (size, digest.hexdigest()), "small.txt": (3, hashlib.sha256(b"one").hexdigest())}
    listed = json.loads(publish.manifest(spark, str(tmp_path)))["files"]
    assert [(x["path"], x["bytes"], x["sha256"]) for x in listed] == [(n, *got[n]) for n in sorted(got)]


@pytest.fixture
def base(tmp_path):
    path = str(tmp_path / "places %41.sqlite")
    db = sqlite3.connect(path)
    db.execute('CREATE TABLE places (id INTEGER PRIMARY KEY, name TEXT COLLATE NOCASE, "lat ""x""" REAL, area NUMERIC, raw BLOB, note VARCHAR(9))')
    rows = [(k * k - 50, f"Name {k}" if k % 5 else None, k / 3 if k % 7 else None, k, bytes([k % 256]) if k % 3 else None, ["", "a", "A", "é\U0001f600"][k % 4]) for k in range(300)]
    db.executemany("INSERT INTO places VALUES (?, ?, ?, ?, ?, ?)", rows)
    db.execute("CREATE TABLE keyed (k TEXT PRIMARY KEY, v INT) WITHOUT ROWID")
    db.executemany("INSERT INTO keyed VALUES (?, ?)", [(f"k{k}", 2**62 + k) for k in range(20)])
    db.execute("CREATE TABLE bare (k TEXT)")
    db.execute("CREATE VIEW some AS SELECT id, note FROM places WHERE id > 100")
    db.execute("CREATE TABLE loose (n INT)")
    db.executemany("INSERT INTO loose VALUES (?)", [(1,), ("text",)])
    db.execute("CREATE TABLE hidden (_RowId_ INT)")
    db.executemany("INSERT INTO hidden VALUES (?)", [(None,), (3,), (3,), (9,)])
    db.commit()
    db.close()
    return path, rows


def test_tables_of_a_file(spark, base, tmp_path):
    path, rows = base
    sqlite.register(spark)
    read = lambda table, **more: spark.read.format("sqlite_table").options(table=table, **more).load(path)
    assert sqlite.tables(path) == ["bare", "hidden", "keyed", "loose", "places", "some"]
    key = lambda r: r[0]
    for n in (1, 7, 1000):
        df = read("places", partitions=n)
        got = sorted((tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in df.collect()), key=key)
        assert got == sorted(((*r[:3], float(r[3]), *r[4:]) for r in rows), key=key)
    assert [t for _, t in read("places").dtypes] == ["bigint", "string", "double", "double", "binary", "string"]
    assert read("places", partitions=7).rdd.getNumPartitions() == 7
    assert sorted(r.v for r in read("keyed").collect()) == [2**62 + k for k in range(20)]
    assert read("bare").count() == 0 and read("some").count() == sum(r[0] > 100 for r in rows)
    assert read("places").count() == len(rows) and read("hidden").count() == 4
    few = spark.read.format("sqlite_table").schema("note string, id long").option("table", "places").load(path)
    assert sorted(map(tuple, few.collect())) == sorted((r[5], r[0]) for r in rows)
    with pytest.raises(Exception, match="loose.n holds a value of type str"):
        read("loose").collect()
    with pytest.raises(Exception, match="no table absent"):
        read("absent").collect()
    with pytest.raises(Exception, match="unable to open"):
        spark.read.format("sqlite_table").option("table", "t").load(str(tmp_path / "none.sqlite")).collect()
    assert not (tmp_path / "none.sqlite").exists()


def test_rows_are_left_out_where_they_lie(spark, base):
    path, rows = base
    sqlite.register(spark)
    for where, holds in (("id > 5000 AND note = 'A'", lambda r: r[0] > 5000 and r[5] == "A"), ("name IS NULL OR id < 0", lambda r: r[1] is None or r[0] < 0), ("area <= 10", lambda r: r[3] <= 10)):
        df = spark.read.format("sqlite_table").options(table="places", where=where, partitions=5).load(path)
        want = sorted(r[0] for r in rows if holds(r))
        assert sorted(r.id for r in df.collect()) == want and want
        # Filters of Spark's own are right one after the other over the same DataFrame.
        assert df.where("id > 100").count() == sum(i > 100 for i in want) and df.where("id < 100").count() == sum(i < 100 for i in want)
    reader = sqlite.SqliteTable({"path": path, "table": "places", "where": "id = -34"}).reader(sqlite.SqliteTable({"path": path, "table": "places"}).schema())
    assert [r[1] for p in reader.partitions() for r in reader.read(p)] == ["Name 4"]
