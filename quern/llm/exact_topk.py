"""Exact top-k search by integer inner product: three phases with a uniform threshold.

A vector's components are cut into ``slices``.  A list server is a task that
holds one slice of a block of rows and knows these rows' partial scores, and
no others.

1. Every server gives, for each query, its list of the best partial scores.
   The listed rows' missing partial scores are asked of the other servers, and
   the k-th best of these few totals is a safe bar: no row below it can be
   among the k best.
2. The cutoff bar / slices goes to all servers with the query.  A row that
   reaches the bar reaches the cutoff in some slice, so the entries at or above
   it are sufficient.  Totals that are wholly known raise the bar.
3. Of a row with slices unseen, each below the cutoff, the most it can reach is
   known.  Where that reaches the bar, the missing partial scores are asked of
   their servers, so the total is exact.

Queries are the rows whose vec_id is divisible by 50.

Defined results: vectors that are null, empty or hold null or non-finite
components take no part; a query sees rows of its own dimension only; rows that
repeat a vec_id count once, with the least vector; a query's own vec_id is no
candidate.  Ties go to the smaller vec_id; an empty table gives no rows; extra
columns aren't read.  Scores are exact whole numbers of any size, but those
beyond a long are given, and ranked, as the nearest long.  Components of a
magnitude of 2^1000 or more count as 2^1000.  Where scores may pass 2^53, the
search uses one slice, so that no sum is made of clipped parts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage, unstage
from .vectors import Blocks, matrix, ranked, valid

K, EVERY, SLICES, SCALE = 5, 50, 2, 256
#: A local list is so many times k: the more rows are looked at, the higher the bar and the fewer the entries above the cutoff.
LISTED = 8
_STEP = 256
_HUGE = 2.0**1000


def _floor(x: Column) -> Column:
    """floor(256 x) as a whole-numbered double, for any finite double (a cast to long would overflow)."""
    y = F.greatest(F.least(x, F.lit(_HUGE)), F.lit(-_HUGE)) * F.lit(float(SCALE))
    return F.when(F.abs(y) < F.lit(2.0**53), F.floor(y).cast("double")).otherwise(y)


def _clipped(x: np.ndarray) -> np.ndarray:
    most = np.iinfo(np.int64)
    return np.array([min(max(v, most.min), most.max) for v in x.reshape(-1)], np.int64).reshape(x.shape)


def _fits(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether every sum on the way of an inner product is a whole number that doubles hold."""
    return not x.size or not y.size or float(np.abs(x).max()) < 2.0**53 / float(max(np.abs(y).max(), 1)) / x.shape[1]


def _whole(x: np.ndarray) -> np.ndarray:
    return np.array([[int(v) for v in row] for row in x], object).reshape(x.shape)


def _partials(q: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-numbered rows: (queries, rows)."""
    if _fits(q, d):
        return (q @ d.T).astype(np.int64)
    return _clipped(_whole(q).dot(_whole(d).T))


def _sliced(data: DataFrame, slices: int) -> DataFrame:
    """A row per vector and slice: vec_id, dim, slice and the slice's components as v."""
    cut = lambda s: F.floor(F.lit(s) * F.col("dim") / F.lit(slices)).cast("int")
    parts = F.array(*[F.struct(F.lit(s).alias("slice"), F.slice("v", cut(s) + 1, cut(s + 1) - cut(s)).alias("v")) for s in range(slices)])
    return data.select("vec_id", "dim", F.explode(parts).alias("s")).select("vec_id", "dim", "s.slice", "s.v")


def _frame(rows: list[dict], *columns: str) -> pd.DataFrame:
    return pd.concat([pd.DataFrame(r) for r in rows]) if rows else pd.DataFrame({c: np.zeros(0, np.int64) for c in columns})


def _lists(k: int):
    """Phase 1 on one server: each query's k best partial scores."""

    def run(d: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(d) and len(q):
            (ids, x), (asked, y), s = matrix(d), matrix(q), int(d["slice"].iat[0])
            for at in range(0, len(asked), _STEP):
                p = _partials(y[at : at + _STEP], x)
                for i, own in enumerate(asked[at : at + _STEP]):
                    n = min(k + 1, len(ids))
                    least = np.partition(p[i], len(ids) - n)[len(ids) - n]
                    best = np.flatnonzero(p[i] >= least)
                    best = best[ids[best] != own]
                    best = best[np.lexsort((ids[best], -p[i, best].astype(float)))][:k]
                    out.append({"query_id": np.full(len(best), own), "slice": s, "vec_id": ids[best], "part": p[i, best]})
        return _frame(out, "query_id", "slice", "vec_id", "part")

    return run


def _entries(slices: int):
    """Phase 2 on one server: the rows at or above the cutoff, all rows for a query without one."""

    def run(d: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(d) and len(q):
            (ids, x), (asked, y), s = matrix(d), matrix(q), int(d["slice"].iat[0])
            bars = q.set_index("vec_id")["bar"].reindex(asked)
            free = bars.isna().to_numpy()
            bar = bars.fillna(0).to_numpy(np.int64)
            cutoff = -(-bar // slices)  # the least whole number at or above bar / slices
            for at in range(0, len(asked), _STEP):
                p = _partials(y[at : at + _STEP], x)
                own = asked[at : at + _STEP, None]
                rows, cols = np.nonzero(((p >= cutoff[at : at + _STEP, None]) | free[at : at + _STEP, None]) & (own != ids[None, :]))
                out.append({"query_id": asked[at + rows], "slice": s, "vec_id": ids[cols], "part": p[rows, cols]})
        return _frame(out, "query_id", "slice", "vec_id", "part")

    return run


def _answers(d: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
    """Random access on one server: the partial scores of the pairs asked for (rows of ``d`` that name a query)."""
    named = d["query_id"].notna().to_numpy()
    if not named.any() or not len(q):
        return _frame([], "query_id", "slice", "vec_id", "part")
    (ids, x), (asked, y) = matrix(d[~named]), matrix(q)
    pairs = d[named]
    of, vec = pairs["query_id"].to_numpy(np.int64), pairs["vec_id"].to_numpy(np.int64)
    rows, cols, out = np.searchsorted(asked, of), np.searchsorted(ids, vec), np.empty(len(of), np.int64)
    for at in range(0, len(of), 8192):
        a, b = y[rows[at : at + 8192]], x[cols[at : at + 8192]]
        out[at : at + 8192] = np.einsum("ij,ij->i", a, b).astype(np.int64) if _fits(a, b) else _clipped((_whole(a) * _whole(b)).sum(axis=1))
    return pd.DataFrame({"query_id": of, "slice": int(d["slice"].iat[0]), "vec_id": vec, "part": out})


def search(vectors: DataFrame, *, k: int = K, every: int = EVERY, slices: int = SLICES) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k best rows."""
    data = stage(valid(vectors, nonzero=False).withColumn("v", F.transform("v", _floor)), "topk-vectors")
    blocks = Blocks.of(data, every)
    size = data.select(F.max(F.array_max(F.transform("v", F.abs))).alias("v"), F.max("dim").alias("dim")).first()
    if size["v"] and size["v"] >= 2.0**53 / size["v"] / size["dim"]:
        slices = 1
    parts = stage(_sliced(data, slices), "topk-slices")
    rows, asked = blocks.as_rows(parts), blocks.as_queries(parts)
    on, entry = ["dim", "slice", "d", "q"], "query_id long, slice int, vec_id long, part long"
    dims = data.select("vec_id", "dim")

    def answered(missing: DataFrame) -> DataFrame:
        """The partial scores (query_id, slice, vec_id, part) of the (query_id, slice, vec_id) asked for, each from its server."""
        of = dims.select(F.col("vec_id").alias("query_id"), "dim").where(F.col("query_id") % every == 0)
        to = missing.join(of, "query_id").select(
            "vec_id", "dim", "slice", F.lit(None).cast("array<double>").alias("v"), blocks.place_of_row().alias("d"), blocks.place_of_query("query_id").alias("q"), "query_id"
        )
        both = rows.select("vec_id", "dim", "slice", "v", "d", "q", F.lit(None).cast("long").alias("query_id")).unionByName(to)
        return both.groupBy(*on).cogroup(asked.groupBy(*on)).applyInPandas(_answers, entry)

    def with_seen(entries: DataFrame) -> DataFrame:
        """Per pair: the sum of its partial scores in ``entries`` and the slices they are of."""
        return entries.groupBy("query_id", "vec_id").agg(F.sum("part").alias("seen"), F.collect_set("slice").alias("of"))

    def unseen(pairs: DataFrame) -> DataFrame:
        every_slice = F.array(*[F.lit(s) for s in range(slices)])
        return pairs.select("query_id", F.explode(F.array_except(every_slice, "of")).alias("slice"), "vec_id")

    def total(pairs: DataFrame) -> DataFrame:
        """Exact (query_id, vec_id, score) of pairs of which some slices were seen."""
        each = pairs.select("query_id", "vec_id", F.col("seen").alias("part")).unionByName(answered(unseen(pairs)).select("query_id", "vec_id", "part"))
        return each.groupBy("query_id", "vec_id").agg(F.sum("part").alias("score"))

    def kth(scores: DataFrame, name: str) -> DataFrame:
        return ranked(scores, k).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias(name))

    # 1: local lists; the listed rows' totals give the bar (none where a query has fewer candidates than k)
    lists = rows.groupBy(*on).cogroup(asked.groupBy(*on)).applyInPandas(_lists(LISTED * k), entry)
    best = F.row_number().over(Window.partitionBy("query_id", "slice").orderBy(F.desc("part"), "vec_id"))
    listed = stage(with_seen(lists.withColumn("place", best).where(F.col("place") <= LISTED * k)), "topk-lists")
    bar = stage(kth(total(listed), "bar"), "topk-bars")

    # 2: the cutoff goes out with each query; sufficient entries come in
    told = asked.join(bar, "vec_id", "left")
    seen = stage(with_seen(rows.groupBy(*on).cogroup(told.groupBy(*on)).applyInPandas(_entries(slices), entry)), "topk-entries")
    whole = seen.where(F.size("of") == slices).select("query_id", "vec_id", F.col("seen").alias("score"))
    raised = stage(bar.join(kth(whole, "better"), "vec_id", "left").select(F.col("vec_id").alias("query_id"), "bar", F.greatest("bar", "better").alias("raised")), "topk-raised")

    # 3: what may still be among the best is resolved exactly; an unseen partial score is below the cutoff
    below = F.ceil(F.col("bar") / F.lit(slices)) - 1
    open_pairs = seen.where(F.size("of") < slices).join(raised, "query_id").where(F.col("seen") + (F.lit(slices) - F.size("of")) * below >= F.col("raised"))
    resolved = total(open_pairs.select("query_id", "vec_id", "seen", "of"))
    out = stage(ranked(whole.unionByName(resolved), k).select("query_id", "rank", "vec_id", "score"), "topk-result")
    unstage(data, parts, listed, bar, seen, raised)
    return out
