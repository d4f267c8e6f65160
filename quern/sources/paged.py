"""A paged service as a Spark data source, as a table or as a stream: one input partition for each run of pages."""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition


def fetch_http(url: str) -> dict:
    with urllib.request.urlopen(url, timeout=30) as r:  # noqa: S310
        return json.load(r)


class _Pages(InputPartition):
    """Rows from ``first`` up to, not including, ``last`` (null: up to a short page)."""

    def __init__(self, first: int, last: int | None) -> None:
        self.first, self.last = first, last


class _Service:
    """What both readers share: the service, its pages, and how many rows it has."""

    def __init__(self, options: dict, fetch: Callable[[str], dict]) -> None:
        self.url, self.fetch = options["url"], fetch
        self.page, self.start = int(options.get("page", 100)), int(options.get("start", 0))
        self.parts, self.pause = int(options.get("parts", 8)), float(options.get("pause", 0.2))

    def ask(self, at: int, size: int) -> dict:
        return self.fetch(f"{self.url}{'&' if '?' in self.url else '?'}offset={at}&length={size}")

    def total(self, known: int) -> int:
        """Rows in all, as the service says (``num_rows_total``), or else found by doubling and halving from a row number that is known to be there."""
        first = self.ask(known, 1)
        if first.get("num_rows_total") is not None:
            return int(first["num_rows_total"])
        if not first.get("rows"):
            return known
        low, step = known, self.page  # the row ``low`` is there
        while self.ask(low + step, 1).get("rows"):
            low, step = low + step, 2 * step
        high = low + step  # the row ``high`` is not
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if self.ask(middle, 1).get("rows") else (low, middle)
        return high

    def split(self, first: int, last: int) -> list[_Pages]:
        pages = -(-(last - first) // self.page)
        each = max(1, -(-pages // self.parts)) * self.page
        return [_Pages(at, min(at + each, last)) for at in range(first, last, each)]

    def rows(self, part: _Pages, whole: bool) -> Iterator[tuple]:
        """Row numbers and records; a short page ends them, or, where ``whole``, is an error."""
        at = part.first
        while part.last is None or at < part.last:
            size = self.page if part.last is None else min(self.page, part.last - at)
            rows = self.ask(at, size).get("rows", [])
            for k, r in enumerate(rows):
                yield (at + k, json.dumps(r.get("row", r), ensure_ascii=False, sort_keys=True))
            if len(rows) < size:  # a short page is the last
                if whole:
                    raise ValueError(f"the service gave {len(rows)} of {size} rows from {at}, which it had said to hold")
                return
            at += size
            time.sleep(self.pause)


class _Reader(_Service, DataSourceReader):
    """All rows from ``start``, or the first ``rows`` of them."""

    def __init__(self, options: dict, fetch: Callable[[str], dict]) -> None:
        super().__init__(options, fetch)
        self.most = int(options["rows"]) if "rows" in options else None

    def partitions(self) -> list[InputPartition]:
        last = self.start + self.most if self.most is not None else self.total(self.start)
        return self.split(self.start, last) or [_Pages(self.start, self.start)]

    def read(self, partition: _Pages) -> Iterator[tuple]:
        return self.rows(partition, whole=False)


class _Stream(_Service, DataSourceStreamReader):
    """Offsets are row numbers: a batch holds what has come since the last one, from ``start`` on, and is read again whole if it fails.

    Spark keeps the offsets in the stream's checkpoint, so a run that was killed
    goes on where its last whole batch ended; one that finds nothing new has no
    batch at all.
    """

    def __init__(self, options: dict, fetch: Callable[[str], dict]) -> None:
        super().__init__(options, fetch)
        self.known = self.start

    def initialOffset(self) -> dict:
        return {"row": self.start}

    def latestOffset(self) -> dict:
        self.known = max(self.known, self.total(self.known))
        return {"row": self.known}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.known = max(self.known, end["row"])
        return self.split(start["row"], end["row"])

    def read(self, partition: _Pages) -> Iterator[tuple]:
        return self.rows(partition, whole=True)

    def commit(self, end: dict) -> None:
        self.known = max(self.known, end["row"])


def register(spark: SparkSession, fetch: Callable[[str], dict] = fetch_http, name: str = "paged_rows") -> None:
    """Makes ``spark.read.format(name)`` and ``spark.readStream.format(name)`` with url, and optionally page, start, parts, pause and (for tables) rows give (row_number, record)."""

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "row_number long, record string"

        def reader(self, schema) -> DataSourceReader:
            return _Reader(self.options, fetch)

        def streamReader(self, schema) -> DataSourceStreamReader:
            return _Stream(self.options, fetch)

    spark.dataSource.register(Paged)
