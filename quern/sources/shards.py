"""A sink that commits: each task writes shards of its own, and one commit gives them the next free names."""

from __future__ import annotations

import os
import re
import shutil
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

_NAME = re.compile(r"shard-(\d+)\.jsonl")


def claim(written: str, folder: str, at: int) -> tuple[str, int]:
    """Give a written file the first free name shard-00000.jsonl, shard-00001.jsonl ... from ``at`` on; (path, its number).

    A link fails if its name is there, whoever made it, so two writers never share a name.
    """
    while True:
        to = f"{folder}/shard-{at:05d}.jsonl"
        try:
            os.link(written, to)
            return to, at
        except FileExistsError:
            at += 1


class Lock:
    """A file that only one holder can make; one that is older than ``stale`` seconds, whose holder was broken off, is taken over by one of those who wait."""

    def __init__(self, path: str, stale: float = 86_400) -> None:
        self.path, self.stale = path, stale

    def __enter__(self) -> Lock:
        for _ in range(2):
            try:
                os.close(os.open(self.path, os.O_CREAT | os.O_EXCL | os.O_WRONLY))
                return self
            except FileExistsError:
                self._drop_stale()
        raise RuntimeError(f"another run is at work: {self.path}")

    def _drop_stale(self) -> None:
        try:
            if time.time() - os.stat(self.path).st_mtime > self.stale:
                mine = f"{self.path}.{uuid.uuid4().hex}"
                os.rename(self.path, mine)  # of those who try, one succeeds
                if time.time() - os.stat(mine).st_mtime <= self.stale:  # another had taken it over in between: put it back
                    os.link(mine, self.path)
                os.unlink(mine)
        except FileNotFoundError:
            pass

    def __exit__(self, *_: object) -> None:
        os.unlink(self.path)


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[int, str, int, int]] = field(default_factory=list)  # shard, path, records, bytes


class _Writer(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool) -> None:
        if overwrite:
            raise ValueError("shards are only added: use mode('append')")
        self.folder, self.first = options["path"].removeprefix("file://").rstrip("/"), int(options.get("first", 0))
        self.staging = f"{self.folder}/.staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        out, f = _Written(), None
        os.makedirs(self.staging, exist_ok=True)
        try:
            shard = None
            for r in iterator:
                if f is None or r["shard"] != shard:
                    if f is not None:
                        f.close()
                    shard = r["shard"]
                    out.files.append((shard, f"{self.staging}/{uuid.uuid4().hex}", 0, 0))
                    f = open(out.files[-1][1], "wb")  # noqa: SIM115
                line = r["value"].encode("utf-8") + b"\n"
                f.write(line)
                s, path, n, size = out.files[-1]
                out.files[-1] = (s, path, n + 1, size + len(line))
        finally:
            if f is not None:
                f.close()
        return out

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        at = self.first
        for _, path, *_ in sorted(f for m in messages if m is not None for f in m.files):
            at = claim(path, self.folder, at)[1] + 1
        shutil.rmtree(self.staging, ignore_errors=True)  # tasks that failed, or ran twice, may have left files

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


class _Shards(DataSource):
    @classmethod
    def name(cls) -> str:
        return "jsonl_shards"

    def schema(self) -> str:
        return "shard long, value string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Makes ``df.write.format("jsonl_shards").mode("append").option("path", folder)`` (and optionally first) write rows (shard, value).

    The folder must be one that all machines mount.  A shard's rows must lie
    together in one partition (``add``).  Readers see a shard's name only once it
    is whole; a job that fails leaves no name.
    """
    spark.dataSource.register(_Shards)


def add(rows: DataFrame, folder: str, shard: Column, order: list[str], value: Column, first: int = 0) -> None:
    """Write rows as shards, each in the given order, under the next free names from ``first`` on; shards keep their order."""
    register(rows.sparkSession)
    placed = rows.select(shard.cast("long").alias("shard"), value.alias("value"), *[F.col(c).alias(f"_by_{k}") for k, c in enumerate(order)])
    placed = placed.repartition("shard").sortWithinPartitions("shard", *[f"_by_{k}" for k in range(len(order))]).select("shard", "value")
    placed.write.format("jsonl_shards").mode("append").option("path", folder).option("first", first).save()


def names(folder: str) -> list[str]:
    """The shards of a folder, in order."""
    return sorted((n for n in os.listdir(folder) if _NAME.fullmatch(n)), key=lambda n: int(_NAME.fullmatch(n)[1]))
