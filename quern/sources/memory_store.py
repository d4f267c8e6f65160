"""A store of memories in one SQLite file as a Spark data source: ranges of rows as partitions, and filters that the store itself applies."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, IsNotNull, LessThan, LessThanOrEqual

#: The columns of a memory; those that the store is asked to filter by.
SCHEMA = "id string, type string, content string, timestamp double, importance double, access_count long, last_access double, metadata string"
_COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
_PUSHED = {"id", "type", "importance", "access_count", "timestamp", "last_access"}
_SIGN = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


class _Rows(InputPartition):
    def __init__(self, first: int, last: int) -> None:
        self.first, self.last = first, last


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.table, self.parts = options["path"], options.get("table", "memories"), int(options.get("parts", 8))
        if not self.table.isidentifier():
            raise ValueError(f"not a table's name: {self.table}")
        self.where: list[str] = []
        self.values: list = []

    def _open(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) in _SIGN and len(f.attribute) == 1 and f.attribute[0] in _PUSHED and f.value is not None:
                self.where.append(f'"{f.attribute[0]}" {_SIGN[type(f)]} ?')
                self.values.append(f.value)
            elif isinstance(f, IsNotNull) and len(f.attribute) == 1 and f.attribute[0] in _PUSHED:
                self.where.append(f'"{f.attribute[0]}" IS NOT NULL')
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        with self._open() as store:
            low, high = store.execute(f"SELECT min(rowid), max(rowid) FROM {self.table}").fetchone()  # noqa: S608
        if low is None:
            return [_Rows(0, 0)]
        each = -(-(high + 1 - low) // self.parts)
        return [_Rows(at, min(at + each, high + 1)) for at in range(low, high + 1, each)]

    def read(self, partition: _Rows) -> Iterator[tuple]:
        tests = " AND ".join(["rowid >= ?", "rowid < ?", *self.where])
        with self._open() as store:
            yield from store.execute(f"SELECT {', '.join(_COLUMNS)} FROM {self.table} WHERE {tests}", [partition.first, partition.last, *self.values])  # noqa: S608


class _Store(DataSource):
    @classmethod
    def name(cls) -> str:
        return "memory_store"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    """Makes ``spark.read.format("memory_store")`` with path, and optionally table and parts, read such a file, which all machines must mount.

    Comparisons of ids, types, importance, counts and times with a value go to the store.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(_Store)


def memories(spark: SparkSession, path: str, parts: int = 8) -> DataFrame:
    register(spark)
    return spark.read.format("memory_store").option("path", path).option("parts", parts).load()


def save(rows: DataFrame, path: str) -> int:
    """Write memories as such a file (one writer, row by row: a store is one file on one machine); gives their number."""
    n = 0
    with sqlite3.connect(path) as store:
        store.execute(f"CREATE TABLE IF NOT EXISTS memories ({', '.join(_COLUMNS)}, PRIMARY KEY (id))")
        for r in rows.select(*_COLUMNS).toLocalIterator(prefetchPartitions=True):
            store.execute(f"INSERT OR REPLACE INTO memories VALUES ({', '.join('?' * len(_COLUMNS))})", tuple(r))  # noqa: S608
            n += 1
    return n
