"""Approximate nearest neighbours by collision-counting hashing, for the largest inner product.

Vectors get one more component, so that all are equally long and the largest
inner product is the smallest distance.  Each of ``projections`` random lines
keeps the rows of a block in an array sorted by their place on it.  A query
opens a window around its own place on every line; a row collides where it lies
in the window.  At radius R a row at distance R collides on a known share of
the lines, and the collision threshold lies below that share, so that such a
row is missed with probability ``miss`` (a nearer one with less).  Rows at the
threshold are verified by their exact inner product.  A query is done once k
verified rows of all blocks lie within R; for the others the radius grows
(virtual rehashing: the same lines, wider windows), and in the last round
everything collides.  Collisions are counted as rows outside of the windows
where those are fewer.

Every row is indexed.  Nothing is fitted but the first radius: that of the k-th
nearest row of a few sampled rows (``SAMPLE``), each compared with all rows.
Queries are the rows whose vec_id is divisible by 20.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components take no part; a query sees rows of its own dimension; rows that
repeat a vec_id count once, with the least vector; a query's own vec_id is no
candidate; ties go to the smaller vec_id; an empty table gives no rows; extra
columns aren't read.  Vectors are scaled by powers of two inside, so that huge
or tiny components neither overflow nor vanish in the search; the score is the
inner product of the vectors as they are, and infinite where that is beyond a
double.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, unstage
from .vectors import Blocks, matrix, ranked, valid

K, EVERY = 20, 20
PROJECTIONS, HALF_WIDTH, MISS = 160, 1.2, 0.12
#: The first radius is this quantile of the distances to the k-th nearest row of so many sampled rows.
SAMPLE, QUANTILE = 48, 0.8
#: The radius of each round, as a multiple of the first; in the last one everything is verified.
GROWTH = (1.0, 1.05, 1.12, 1.3, math.inf)
_STEP = 128


def _halved(v: np.ndarray, by: int) -> np.ndarray:
    return np.ldexp(v, -by)


class Lines:
    """The sorted lines of one block of vectors, none longer than ``longest``."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, longest: float, *, projections: int = PROJECTIONS, half_width: float = HALF_WIDTH, miss: float = MISS, seed: int = 5) -> None:
        self.ids, self.x, self.longest, self.half_width = ids, x, longest, half_width
        extra = np.sqrt(np.maximum(longest**2 - np.einsum("ij,ij->i", x, x), 0))
        self.lines = np.random.default_rng(seed).normal(size=(projections, x.shape[1] + 1))
        place = self.lines @ np.hstack([x, extra[:, None]]).T
        self.order = np.argsort(place, axis=1, kind="stable")
        self.sorted = np.take_along_axis(place, self.order, axis=1)
        hit = 2 * NormalDist().cdf(half_width) - 1
        least = hit * projections - NormalDist().inv_cdf(1 - miss) * (hit * (1 - hit) * projections) ** 0.5
        self.least = max(1, int(np.floor(least)))

    def colliding(self, y: np.ndarray, radius: float) -> list[np.ndarray]:
        """Of each query in ``y`` (of length ``longest``) the rows that reach the collision threshold at ``radius``."""
        n, m = len(self.ids), len(self.lines)
        at = self.lines[:, :-1] @ y.T
        wide = self.half_width * radius
        low = np.stack([np.searchsorted(s, a - wide, "left") for s, a in zip(self.sorted, at, strict=True)])
        high = np.stack([np.searchsorted(s, a + wide, "right") for s, a in zip(self.sorted, at, strict=True)])
        out = []
        for a, b in zip(low.T, high.T, strict=True):
            if int((b - a).sum()) * 2 <= n * m:
                count = np.bincount(np.concatenate([o[i:j] for o, i, j in zip(self.order, a, b, strict=True)]), minlength=n)
            else:
                count = m - np.bincount(np.concatenate([o[p] for o, i, j in zip(self.order, a, b, strict=True) for p in (slice(i), slice(j, n))]), minlength=n)
            out.append(np.flatnonzero(count >= self.least))
        return out


def _products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.einsum("ij,j->i", x, y)  # the same sum for equal rows, wherever they are


def _best(ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, ties to the smaller id."""
    if len(score) > k:
        some = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
        return some[np.lexsort((ids[some], -score[some]))][:k]
    return np.lexsort((ids, -score))


def _unit(y: np.ndarray) -> tuple[np.ndarray, float, int]:
    """A query scaled to components of at most 1, its length then, and the power of two that was taken out."""
    power = int(np.frexp(np.abs(y).max())[1])
    y = _halved(y, power)
    return y, float(np.linalg.norm(y)), power


def _round(k: int, longest: float, power: int, radius: float, options: dict):
    def run(d: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(d) and len(q):
            ids, x = matrix(d)
            x = _halved(x, power)
            block = Lines(ids, x, longest, **options) if math.isfinite(radius) else None
            asked, y = matrix(q)
            units = [_unit(v) for v in y]
            for at in range(0, len(asked), _STEP):
                part = units[at : at + _STEP]
                tests = block.colliding(np.stack([u * (longest / length) for u, length, _ in part]), radius) if block else [np.arange(len(ids))] * len(part)
                for own, (u, length, own_power), test in zip(asked[at : at + _STEP], part, tests, strict=True):
                    test = test[ids[test] != own]
                    score = _products(x[test], u)
                    best = _best(ids[test], score, k)
                    # distance^2 = 2 longest^2 - 2 (longest / length) score
                    bar = (longest - radius * (radius / (2 * longest))) * length if block else -math.inf
                    near = score[best] >= bar
                    tested = np.zeros(len(best), np.int64)
                    tested[:1] = len(test)
                    out.append(pd.DataFrame({"query_id": np.full(len(best), own), "vec_id": ids[test[best]], "scaled": score[best], "score": np.ldexp(score[best], own_power + power), "near": near, "tested": tested}))
        none = {"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "scaled": np.zeros(0), "score": np.zeros(0), "near": np.zeros(0, bool), "tested": np.zeros(0, np.int64)}
        return pd.concat(out) if out else pd.DataFrame(none)

    return run


def _first_radius(data: DataFrame, k: int, longest: float, power: int) -> float:
    """From the k-th best of all rows for each of at most SAMPLE rows (those of smallest hash)."""
    picked = data.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vec_id", "v").collect()
    units = [(r["vec_id"], *_unit(np.array(r["v"]))) for r in picked]

    def run(batches):
        for pdf in batches:
            for dim, part in pdf.groupby("dim"):
                ids, x = matrix(part)
                x = _halved(x, power)
                for own, u, length, _ in units:
                    if len(u) == dim:
                        score = _products(x, u)[ids != own] / length
                        yield pd.DataFrame({"query_id": own, "vec_id": 0, "score": np.sort(score)[::-1][: k + 1]})

    best = ranked(data.select("vec_id", "dim", "v").mapInPandas(run, "query_id long, vec_id long, score double"), k)
    kth = [r["s"] for r in best.groupBy("query_id").agg(F.min("score").alias("s"), F.count("*").alias("n")).where(F.col("n") == k).collect()]
    if not kth:
        return math.inf
    far = np.sqrt(np.maximum(0.0, 2 * longest**2 - 2 * longest * np.array(kth)))
    return float(np.quantile(far, QUANTILE)) + 1e-6 * longest


def search(vectors: DataFrame, *, k: int = K, every: int = EVERY, **options) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k nearest rows found, and how many rows were verified for the query."""
    data = stage(valid(vectors, nonzero=True), "ann-vectors")
    most = data.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0] or 1.0
    power = math.frexp(most)[1]
    half = F.lit(2.0 ** (-power // 2)), F.lit(2.0 ** (-power - (-power // 2)))  # two factors, as one may be beyond a double
    longest = data.agg(F.max(F.sqrt(F.aggregate(F.transform("v", lambda x: x * half[0] * half[1]), F.lit(0.0), lambda s, x: s + x * x)))).first()[0] or 1.0
    longest *= 1 + 1e-12
    blocks, first = Blocks.of(data, every), _first_radius(data, k, longest, power)
    rows, asked, on, found, used = blocks.as_rows(data), blocks.as_queries(data), ["dim", "d", "q"], None, []
    for grown in GROWTH:
        radius = first * grown
        if radius >= 2 * longest:
            radius = math.inf
        out = rows.groupBy(*on).cogroup(asked.groupBy(*on)).applyInPandas(_round(k, longest, power, radius, options), "query_id long, vec_id long, scaled double, score double, near boolean, tested long")
        out = stage(out, "ann-round")
        used.append(out)
        per = out.groupBy("query_id").agg(F.count_if("near").alias("n"), F.sum("tested").alias("verified"))
        done = stage(per.where(F.lit(math.isinf(radius)) | (F.col("n") >= k)).select("query_id", "verified"), "ann-done")
        used.append(done)
        own = out.join(done, "query_id")
        found = own if found is None else found.unionByName(own)
        if math.isinf(radius):
            break
        asked = asked.join(done.select(F.col("query_id").alias("vec_id")), "vec_id", "left_anti")
        if not asked.limit(1).count():
            break
    out = stage(ranked(found, k, "scaled").select("query_id", "rank", "vec_id", "score", "verified"), "ann-result")
    unstage(data, *used)
    return out
