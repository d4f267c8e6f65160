"""Vectors in blocks: a stated set of queries against all rows, block by block."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A block, of rows or of queries, has at most so many vectors and about so many bytes.
BLOCK_ROWS, BLOCK_BYTES = 16_384, 1 << 24


def valid(vectors: DataFrame, *, nonzero: bool) -> DataFrame:
    """(vec_id, v array<double>, dim) of the vectors that take part; of rows that share an id the least vector."""
    v = F.col("embedding").cast("array<double>")
    ok = F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    if nonzero:
        ok = ok & F.exists(v, lambda x: x != 0)
    out = vectors.where(F.coalesce(ok, F.lit(False))).groupBy("vec_id").agg(F.min(v).alias("v"))
    return out.withColumn("dim", F.size("v"))


@dataclass(frozen=True)
class Blocks:
    """Vectors dealt to ``rows`` blocks and queries (ids divisible by ``every``) to ``queries`` blocks, by hash; every pair of blocks (d, q) meets."""

    every: int
    rows: int
    queries: int

    @staticmethod
    def of(data: DataFrame, every: int) -> Blocks:
        n = data.select(F.count("*").alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("q"), F.max("dim").alias("dim")).first()
        size = max(256, min(BLOCK_ROWS, BLOCK_BYTES // (8 * (n["dim"] or 1))))
        return Blocks(every, max(1, -(-n["n"] // size)), max(1, -(-n["q"] // size)))

    def place_of_row(self, col: str = "vec_id") -> Column:
        return F.pmod(F.xxhash64(col), F.lit(self.rows)).cast("int")

    def place_of_query(self, col: str = "vec_id") -> Column:
        return F.pmod(F.xxhash64(col), F.lit(self.queries)).cast("int")

    def as_rows(self, data: DataFrame) -> DataFrame:
        """Each row once for every block of queries, with the columns d and q."""
        return data.withColumn("d", self.place_of_row()).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(self.queries - 1))))

    def as_queries(self, data: DataFrame) -> DataFrame:
        """Each query once for every block of rows, with the columns d and q."""
        again = data.select(*[F.col(c).alias(c) for c in data.columns])  # columns of their own, so that both sides can meet
        return again.where(F.col("vec_id") % self.every == 0).withColumn("q", self.place_of_query()).withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(self.rows - 1))))


def matrix(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids, rising, and their vectors."""
    order = np.argsort(pdf["vec_id"].to_numpy(np.int64), kind="stable")
    return pdf["vec_id"].to_numpy(np.int64)[order], np.stack([pdf["v"].iat[k] for k in order]).astype(float) if len(order) else np.zeros((0, 0))


def ranked(scores: DataFrame, k: int, by: str = "score") -> DataFrame:
    """The k best rows of each query_id by the column ``by``, with their rank; ties go to the smaller vec_id."""
    order: list[Column] = [F.desc(by), F.asc("vec_id")]
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)).cast("int")).where(F.col("rank") <= k)
