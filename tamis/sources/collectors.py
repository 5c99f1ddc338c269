"""Collectors as Spark data sources: batch with partitions and pushed filters, streams with offsets.

A collector says how many records there are and gives those of a range that may pass some filters. Any collector is read by

    spark.dataSource.register(Collected)
    spark.read.format("collected").option("collector", "package.module:Class").option(...).load()

and by readStream in the same way, where the offset is the number of records read: a query that starts again goes on from the
offset in its checkpoint. Options go to the collector; `rows` (records of a partition) and `from` (the record a new stream
begins with) are the source's own. Filters are pushed where spark.sql.python.filterPushdown.enabled is true; Spark keeps what
it has pushed with the frame that was loaded, so load again for other filters then.
"""

from __future__ import annotations

import importlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any, Protocol

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.parquet as pq
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

#: Comparisons that are handed to collectors, by Spark's filter.
PUSHED = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
Test = tuple[str, str, Any]


class Collector(Protocol):
    """Records in an order that doesn't change: what is new comes last."""

    def __init__(self, options: dict[str, str]): ...

    def schema(self) -> str: ...

    def count(self) -> int:
        """Records there are by now."""

    def ranges(self, start: int, end: int, rows: int) -> list[tuple[int, int]]:
        """start to end in parts that are read on their own, of about `rows` records."""

    def read(self, start: int, end: int, tests: list[Test]) -> Iterator[pa.RecordBatch]:
        """The records of a part, at least those that pass all tests (column, comparison, value)."""


class Files:
    """Records of Parquet files at `path` (a file or a folder, read in the order of names), by row groups: a group is left out
    where its statistics say that no record passes. Files are opened where tasks run, so all machines have to see them."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.columns = [c for c in options.get("columns", "").split(",") if c] or None

    def _groups(self) -> list[tuple[str, int, int, int]]:
        """(file, row group, first record, records)."""
        found, at = [], 0
        for file in sorted(ds.dataset(self.path, format="parquet").files):
            meta = pq.ParquetFile(file).metadata
            for g in range(meta.num_row_groups):
                found.append((file, g, at, meta.row_group(g).num_rows))
                at += meta.row_group(g).num_rows
        return found

    def schema(self) -> str:
        from pyspark.sql.pandas.types import from_arrow_schema

        whole = ds.dataset(self.path, format="parquet").schema
        names = self.columns or whole.names
        made = from_arrow_schema(pa.schema([whole.field(n) for n in names]))
        return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in made.fields)

    def count(self) -> int:
        return sum(n for *_, n in self._groups())

    def ranges(self, start: int, end: int, rows: int) -> list[tuple[int, int]]:
        return [(at, min(at + rows, end)) for at in range(start, end, rows)]

    def read(self, start: int, end: int, tests: list[Test]) -> Iterator[pa.RecordBatch]:
        for name, group, at, n in self._groups():
            lo, hi = max(start, at), min(end, at + n)
            if lo >= hi:
                continue
            file = pq.ParquetFile(name)
            if any(self._apart(file, group, test) for test in tests):
                continue
            table = file.read_row_group(group, columns=self.columns).slice(lo - at, hi - lo)
            for test in tests:
                table = table.filter(_passes(table.column(test[0]), test))
            yield from table.to_batches(max_chunksize=10_000)

    @staticmethod
    def _apart(file: pq.ParquetFile, group: int, test: Test) -> bool:
        """Whether the group's least and greatest value say that nothing passes."""
        name, how, value = test
        at = file.schema_arrow.get_field_index(name)
        held = file.metadata.row_group(group).column(at).statistics if at >= 0 else None
        if held is None or not held.has_min_max:
            return False
        try:
            if how == "=":
                return not held.min <= value <= held.max
            return held.max <= value if how == ">" else held.max < value if how == ">=" else held.min >= value if how == "<" else held.min > value
        except TypeError:  # a value of another kind: Spark compares the rows
            return False


def _passes(column: pa.ChunkedArray, test: Test) -> pa.ChunkedArray:
    _, how, value = test
    compare = {"=": pc.equal, ">": pc.greater, ">=": pc.greater_equal, "<": pc.less, "<=": pc.less_equal}[how]
    return pc.fill_null(compare(column, pa.scalar(value).cast(column.type)), False)


@dataclass
class Part(InputPartition):
    start: int
    end: int


def _made(options: dict[str, str]) -> Collector:
    module, name = options["collector"].split(":")
    return getattr(importlib.import_module(module), name)(options)


def _records(options: dict[str, str], part: Part, tests: list[Test]) -> Iterator[pa.RecordBatch]:
    yield from _made(options).read(part.start, part.end, tests)


class _Batch(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options, self.tests = options, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Comparisons of a column with a value go to the collector; Spark checks them again, and all others."""
        for f in filters:
            if type(f) in PUSHED and len(f.attribute) == 1:
                self.tests.append((f.attribute[0], PUSHED[type(f)], f.value))
            yield f

    def partitions(self) -> list[Part]:
        held = _made(self.options)
        return [Part(a, b) for a, b in held.ranges(0, held.count(), int(self.options.get("rows", 100_000)))]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        yield from _records(self.options, partition, self.tests)


class _Stream(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def initialOffset(self) -> dict:
        return {"records": int(self.options.get("from", 0))}

    def latestOffset(self) -> dict:
        return {"records": _made(self.options).count()}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return [Part(a, b) for a, b in _made(self.options).ranges(start["records"], end["records"], int(self.options.get("rows", 100_000)))]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        yield from _records(self.options, partition, [])

    def commit(self, end: dict) -> None:
        """A collector keeps what it has handed out; there is nothing to release."""


class Collected(DataSource):
    """Records of the collector that the option `collector` names."""

    @classmethod
    def name(cls) -> str:
        return "collected"

    def schema(self) -> str:
        return _made(dict(self.options)).schema()

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Batch(dict(self.options))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(dict(self.options))
