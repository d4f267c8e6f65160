"""Helpers shared by the operators of this sub-package."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from typing import BinaryIO

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; ``sf_dir`` may be any path that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder that driver and executors share (``spark.checkpoint.dir``).

    Where the session names no such folder, a folder under the warehouse takes
    its place, but only on one machine (a local master): a cluster's executors
    could not read what others wrote there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_quern"
    return f"{base.rstrip('/')}/quern-{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quern_path = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def unstage(*staged: DataFrame) -> None:
    """Delete staged tables that nothing reads any more (all that was made of them is staged itself)."""
    for df in staged:
        delete(df.sparkSession, df._quern_path)


def file(path: str, write: bool) -> BinaryIO:
    """A file of the shared folder, from the driver or an executor."""
    from pyarrow import fs

    if ":" in path.split("/")[0]:
        system, own = fs.FileSystem.from_uri(path)
    else:
        system, own = fs.LocalFileSystem(), path
    if write:
        system.create_dir(own.rpartition("/")[0], recursive=True)
        return system.open_output_stream(own)
    return system.open_input_file(own)


#: A key that holds more than 1 / MOST_HEAVY of all rows (and more than LEAST_HEAVY) is heavy; there can't be more than MOST_HEAVY of them.
MOST_HEAVY, LEAST_HEAVY = 2000, 1000


def heavy_keys(counts: DataFrame, total: int, n: str = "n") -> DataFrame:
    """Of one row per key with its number of rows ``n``, the heavy ones: at most MOST_HEAVY rows, as their sizes add up to ``total``."""
    return counts.where(F.col(n) > max(LEAST_HEAVY, total / MOST_HEAVY)).drop(n)


def lookup(rows: DataFrame, key: str, known: DataFrame, heavy: DataFrame) -> DataFrame:
    """``rows`` joined with ``known`` (one row per key); rows of a heavy key stay where they are and meet a broadcast row.

    ``rows`` is read twice, so it should be a staged table.  ``heavy`` holds at
    most MOST_HEAVY keys, in a column named as ``key``.
    """
    few = F.broadcast(heavy.select(key))
    hot = rows.join(few, key, "left_semi").join(F.broadcast(known.join(few, key, "left_semi")), key)
    return hot.unionByName(rows.join(few, key, "left_anti").join(known.hint("merge"), key))


#: A filter has at most so many words of 64 bits, whatever the number of its members.
MOST_WORDS = 1 << 20


class MemberFilter:
    """A one-hash Bloom filter of ids as a table (word, bits) of at most MOST_WORDS rows: small enough to broadcast at any size.

    It never misses a member; of others it lets some pass, all of them once
    there are far more members than bits, so that what passes needs an exact
    join.
    """

    def __init__(self, ids: DataFrame, id_col: str) -> None:
        n = ids.count()
        self.words = min(MOST_WORDS, max(1 << 10, 1 << max(0, (n // 4).bit_length())))
        word, bit = self._place(id_col)
        self.table = ids.select(word.alias("__q_word"), bit.alias("__q_bit")).groupBy("__q_word").agg(F.bit_or("__q_bit").alias("__q_bits"))

    def _place(self, id_col: str) -> tuple[Column, Column]:
        h = F.xxhash64(F.col(f"`{id_col}`"))
        return F.pmod(h, F.lit(self.words)), F.expr(f"shiftleft(1L, cast(pmod(shiftrightunsigned(xxhash64(`{id_col}`), 40), 64) as int))")

    def split(self, rows: DataFrame, id_col: str) -> DataFrame:
        """``rows`` with the column ``__q_may``: whether the id may be a member."""
        word, bit = self._place(id_col)
        out = rows.withColumn("__q_word", word).join(F.broadcast(self.table), "__q_word", "left")
        return out.withColumn("__q_may", F.coalesce(F.col("__q_bits").bitwiseAND(bit) != 0, F.lit(False))).drop("__q_word", "__q_bits")


def freeing(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over batches; at its end the Python worker, which goes on to other tasks, gives back what it holds unused."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            import pyarrow

            pyarrow.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's own
            if trim is not None:
                trim(0)

    return wrapped


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def in_fold(doc_id: str, modulus: int, remainder: int) -> Column:
    """Whether crc32 of ``doc_id`` as text leaves ``remainder``; a null id is in no fold."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % modulus == remainder, F.lit(False))
