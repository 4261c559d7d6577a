"""A SQLite table as a Spark data source: opened read-only, in ranges of row numbers."""

from __future__ import annotations

import sqlite3
import sys
from collections.abc import Iterator
from urllib.parse import quote

from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Partitions of a table unless the option `partitions` says otherwise.
PARTITIONS = 8

# Executors get this module's classes by value, so they need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def connected(path: str) -> sqlite3.Connection:
    """Read-only: a missing file is an error and is not created."""
    return sqlite3.connect(f"file:{quote(path)}?mode=ro", uri=True)


def tables(path: str) -> list[str]:
    """The names of a file's tables and views."""
    db = connected(path)
    try:
        return [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type IN ('table', 'view') AND name NOT LIKE 'sqlite!_%' ESCAPE '!' ORDER BY name")]
    finally:
        db.close()


def type_of(declared: str) -> T.DataType:
    """The Spark type of a declared one, by the rules for a column's affinity; numeric columns are doubles."""
    declared = declared.upper()
    if "INT" in declared:
        return T.LongType()
    if any(x in declared for x in ("CHAR", "CLOB", "TEXT")):
        return T.StringType()
    return T.BinaryType() if "BLOB" in declared or not declared else T.DoubleType()


class Rows(InputPartition):
    """Rows whose numbers are from low up to high, or all of them."""

    def __init__(self, low: int | None = None, high: int | None = None) -> None:
        self.low, self.high = low, high


class _Reader(DataSourceReader):
    def __init__(self, path: str, table: str, schema: T.StructType, partitions: int, where: str | None) -> None:
        self.path, self.table, self.fields, self.n, self.where = path, table, [(f.name, f.dataType) for f in schema.fields], partitions, where

    def partitions(self) -> list[Rows]:
        db = connected(self.path)
        try:
            if any(c[1].lower() == "_rowid_" for c in db.execute(f"PRAGMA table_info({_quoted(self.table)})")):
                return [Rows()]  # a column of that name hides the row numbers
            low, high = db.execute(f"SELECT min(_rowid_), max(_rowid_) FROM {_quoted(self.table)}").fetchone()
        except sqlite3.OperationalError as e:
            if "_rowid_" not in str(e):
                raise
            return [Rows()]  # a view, or a table without row numbers
        finally:
            db.close()
        if not isinstance(low, int) or not isinstance(high, int):
            return [Rows()]
        step = -(-(high - low + 1) // self.n)
        return [Rows(at, min(at + step, high + 1)) for at in range(low, high + 1, step)]

    def read(self, partition: Rows) -> Iterator[tuple]:
        where, values = [f"({self.where})"] if self.where else [], []
        if partition.low is not None:
            where.append("_rowid_ >= ? AND _rowid_ <= ?")
            values = [partition.low, partition.high - 1]
        query = f"SELECT {', '.join(_quoted(n) for n, _ in self.fields) or '1'} FROM {_quoted(self.table)}" + f" WHERE {' AND '.join(where)}" * bool(where)
        wanted = {T.LongType: int, T.DoubleType: (int, float), T.StringType: str, T.BinaryType: bytes}
        kinds = [(name, wanted.get(type(kind)), isinstance(kind, T.DoubleType)) for name, kind in self.fields]
        db = connected(self.path)
        try:
            for row in db.execute(query, values):
                out = []
                for x, (name, kind, double) in zip(row, kinds, strict=False):
                    if x is not None and (kind is None or not isinstance(x, kind)):
                        raise ValueError(f"{self.table}.{name} holds a value of type {type(x).__name__}")
                    out.append(float(x) if double and x is not None else x)
                yield tuple(out)
        finally:
            db.close()


class SqliteTable(DataSource):
    """spark.read.format("sqlite_table").option("table", name).load(path): a table or view of a file that all executors see.

    Columns get types by their declared ones (type_of), or by a schema of long, double, string and binary columns, which may
    name fewer columns. A value of another type is an error. Tables are read in ranges of row numbers, option `partitions` of
    them; views and tables without row numbers in one. A reader streams and holds one row. The option `where`, a condition in
    the file's own SQL, leaves rows out where they lie, by an index if there is one; Spark's filters are not handed on, as
    Spark 4.1 keeps those of one query for the next one over the same DataFrame. An empty table gives no rows."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> T.StructType:
        db = connected(self.options["path"])
        try:
            columns = db.execute(f"PRAGMA table_info({_quoted(self.options['table'])})").fetchall()
        finally:
            db.close()
        if not columns:
            raise ValueError(f"there is no table {self.options['table']}")
        return T.StructType([T.StructField(c[1], type_of(c[2] or "")) for c in columns])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        n = int(self.options.get("partitions", PARTITIONS))
        if n < 1:
            raise ValueError("partitions must be positive")
        return _Reader(self.options["path"], self.options["table"], schema, n, self.options.get("where"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SqliteTable)
