"""A data source of numbered pages, as services answer with: pages are read, and merged, by the tasks that planned partitions name."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

#: What a filter that the reader takes asks of a value that isn't null.
TESTS = {
    EqualTo: lambda x, y: x == y, GreaterThan: lambda x, y: x > y, GreaterThanOrEqual: lambda x, y: x >= y, LessThan: lambda x, y: x < y, LessThanOrEqual: lambda x, y: x <= y, In: lambda x, y: x in y,
    IsNotNull: lambda x, y: True,
}
PLAIN = ("string", "int", "bigint", "smallint", "tinyint", "boolean")


class PageRange(InputPartition):
    """Pages that one task reads."""

    def __init__(self, pages: Sequence[int]):
        self.pages = tuple(pages)


def _answers(place: str) -> Iterator[dict]:
    """The JSON answers at a place: a file, or the files of a folder."""
    from pyarrow.fs import FileSelector, FileSystem, FileType

    system, path = FileSystem.from_uri(place) if "://" in place or place.startswith("file:") else FileSystem.from_uri(f"file://{place}")
    info = system.get_file_info(path)
    files = [info] if info.type == FileType.File else sorted(system.get_file_info(FileSelector(path)), key=lambda f: f.path)
    for f in files:
        if f.type == FileType.File and not f.base_name.startswith(("_", ".")):
            with system.open_input_stream(f.path) as stream:
                yield json.loads(stream.read())


class PageReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.names, self.kinds = schema.names, {f.name: f.dataType.simpleString() for f in schema.fields}
        self.place, self.items, self.count = options["place"], options.get("items", "result"), options.get("count", "pageCount")
        self.first, self.per_task = int(options.get("first", "1")), int(options.get("perTask", "8"))
        self.filters: list[tuple[type, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes the tests of plain columns; those of the page number leave pages unread, others rows unsent."""
        for f in filters:
            name = f.attribute[0] if len(f.attribute) == 1 else None
            if type(f) in TESTS and self.kinds.get(name) in PLAIN:
                self.filters.append((type(f), name, getattr(f, "value", None)))
            else:
                yield f

    def _fits(self, name: str, value) -> bool:
        return all(value is not None and TESTS[kind](value, asked) for kind, of, asked in self.filters if of == name)

    def partitions(self) -> list[InputPartition]:
        """Ranges of pages; the first page tells how many there are."""
        n = max(int(a[self.count]) for a in _answers(self.place % self.first))
        wanted = [p for p in range(self.first, self.first + n) if "page" not in self.names or self._fits("page", p)]
        return [PageRange(wanted[i : i + self.per_task]) for i in range(0, len(wanted), self.per_task)] or [PageRange(())]

    def read(self, partition: PageRange) -> Iterator[tuple]:
        tested = [n for n in self.names if n != "page" and any(of == n for _, of, _ in self.filters)]
        for page in partition.pages:
            for answer in _answers(self.place % page):
                for item in answer.get(self.items) or ():
                    if all(self._fits(n, item.get(n)) for n in tested):
                        yield tuple(page if n == "page" else item.get(n) for n in self.names)


class PageSource(DataSource):
    """Options: place (a path or URI with %d for the page number: a file, or a folder of files), items and count (the keys of a page's rows
    and of the number of pages: result, pageCount), first (the first page's number: 1), perTask (pages a task: 8)."""

    @classmethod
    def name(cls) -> str:
        return "numbered_pages"

    def reader(self, schema: StructType) -> DataSourceReader:
        return PageReader(schema, self.options)


def numbered_pages(spark: SparkSession, place: str, schema: str, **options: str | int) -> DataFrame:
    """The rows of all numbered pages, by a schema; a column `page` holds the page's number. A key that a row lacks is null; a page without rows adds none.

    Only the first page is read where the query is planned. Filters of plain columns reach the reader: one of `page` prunes pages. See PageSource for options.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PageSource)
    return spark.read.format(PageSource.name()).schema(schema).options(place=place, **options).load()
