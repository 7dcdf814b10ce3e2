"""A Spark data source over a paginated listing: one partition per page.

The listing is any callable page(offset, limit) -> list of dicts, named by import path (module:function), so that executors
find it. Pages are asked for up to the offset cap; a page at or beyond the listing's end is empty. The options yearFrom
and yearTo are handed to the callable as year_from and year_to, so that the listing itself is narrowed; so are filters on the
column year with the option pushYears, which needs spark.sql.python.filterPushdown.enabled.

    spark.dataSource.register(PagedSource)
    spark.read.format("paged").schema("from_id string, to_id string, year int").option("page", "my.client:citations").load()

As a stream, the option size names a callable that gives the listing's length; each batch reads from the committed offset on, in pages, and
a query that starts again with its checkpoint goes on there. A growing listing adds at its end.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

PAGE_ROWS = 1000
OFFSET_CAP = 9000
#: For each kind of filter on the year: which bounds it sets, and what is added to its value.
BOUNDS = {EqualTo: {"year_from": 0, "year_to": 0}, GreaterThan: {"year_from": 1}, GreaterThanOrEqual: {"year_from": 0}, LessThan: {"year_to": -1}, LessThanOrEqual: {"year_to": 0}}


def _callable(name: str) -> Callable:
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        raise ValueError("the reader gives the schema")

    def reader(self, schema: StructType) -> PagedReader:
        return (PushingReader if self.options.get("pushYears", "false").lower() == "true" else PagedReader)(schema, self.options)

    def streamReader(self, schema: StructType) -> PagedStream:
        return PagedStream(schema, self.options)


class PagedReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.names, self.options = schema.names, options
        self.page_rows = int(options.get("pageRows", PAGE_ROWS))
        self.cap = int(options.get("offsetCap", OFFSET_CAP))
        self.years = {k: int(options[o]) for k, o in (("year_from", "yearFrom"), ("year_to", "yearTo")) if o in options}

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(offset) for offset in range(0, self.cap, self.page_rows)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        offset = partition.value
        for row in _callable(self.options["page"])(offset, min(self.page_rows, self.cap - offset), **self.years):
            yield tuple(row.get(n) for n in self.names)


class PushingReader(PagedReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes the filters on the year by whole numbers; the others are left to Spark."""
        for f in filters:
            bounds = BOUNDS.get(type(f))
            if bounds is None or f.attribute != ("year",) or type(f.value) is not int:
                yield f
                continue
            for name, more in bounds.items():
                narrower = max if name == "year_from" else min
                self.years[name] = narrower(self.years.get(name, f.value + more), f.value + more)


class PagedStream(DataSourceStreamReader):
    """Offsets are row numbers of the listing."""

    def __init__(self, schema: StructType, options: dict[str, str]):
        self.names, self.options = schema.names, options
        self.page_rows = int(options.get("pageRows", PAGE_ROWS))

    def initialOffset(self) -> dict:
        return {"row": 0}

    def latestOffset(self) -> dict:
        return {"row": int(_callable(self.options["size"])())}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [InputPartition((at, min(self.page_rows, end["row"] - at))) for at in range(start["row"], end["row"], self.page_rows)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        offset, rows = partition.value
        for row in _callable(self.options["page"])(offset, rows):
            yield tuple(row.get(n) for n in self.names)
