"""A paginated source as a Spark data source: cached receipts of queries, read page by page, resumed where it stopped."""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Receipts lie as query=<name>/page=<number>/<file>: JSON with total and a list of items.
PLACE = re.compile(r"/query=([^/]+)/page=([0-9]+)/([^/._][^/]*)$")
SCHEMA = "query string, page int, ord long, total long, item string"

# Executors get this module's classes by value, so they need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Pages(InputPartition):
    """The pages of one query from one number on up to another; where its receipts lie."""

    def __init__(self, query: str, files: list[str], items_before: int = 0) -> None:
        self.query, self.files, self.before = query, files, items_before


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def receipts(path: str) -> dict[str, list[str]]:
    """Each query's receipts, in order, from page 0 on without a gap: what comes after a missing page has to wait."""
    from urllib.parse import unquote

    from pyarrow import fs

    system, root = _filesystem(path)
    found: dict[str, dict[int, str]] = {}
    for f in system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
        if f.type == fs.FileType.File and (m := PLACE.search(f.path)) and f.size:
            pages = found.setdefault(unquote(m[1]), {})
            pages[int(m[2])] = min(f.path, pages.get(int(m[2]), f.path))  # a page that was fetched twice counts once
    out = {}
    for query, pages in found.items():
        n = 0
        while n in pages:
            n += 1
        out[query] = [pages[k] for k in range(n)]
    return out


def rows_of(path: str, part: Pages) -> Iterator[tuple]:
    """A row per item of the pages; ord counts a query's items from its first page on."""
    system, _ = _filesystem(path)
    for page, name in enumerate(part.files):
        with system.open_input_stream(name) as f:
            receipt = json.loads(f.read())
        start = int(receipt.get("start", 0))
        for k, item in enumerate(receipt["items"]):
            yield part.query, part.before + page, start + k, int(receipt["total"]), json.dumps(item, ensure_ascii=False)


class _Batch(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[Pages]:
        return [Pages(q, files) for q, files in sorted(receipts(self.path).items()) if files] or [Pages("", [])]

    def read(self, partition: Pages) -> Iterator[tuple]:
        return rows_of(self.path, partition)


class _Stream(DataSourceStreamReader):
    """Offsets are how many pages of each query have been read; a partition is a query's new pages."""

    def __init__(self, path: str) -> None:
        self.path = path

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {q: len(files) for q, files in sorted(receipts(self.path).items())}

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        found = receipts(self.path)
        return [Pages(q, found[q][start.get(q, 0) : n], start.get(q, 0)) for q, n in sorted(end.items()) if n > start.get(q, 0)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        return rows_of(self.path, partition)

    def commit(self, end: dict) -> None:
        pass


class PagedReceipts(DataSource):
    """spark.read or readStream .format("paged_receipts").load(folder); see SCHEMA and PLACE."""

    @classmethod
    def name(cls) -> str:
        return "paged_receipts"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedReceipts)
