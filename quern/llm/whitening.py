"""Whitening of embeddings by an exact scatter matrix in residue numbers.

Entries become integers x.  One pass counts the vectors and adds up x for each
dimension, exactly.  A second pass centres each vector, n * x - S, modulo a few
primes, multiplies each partition's residues by themselves as float matrices
(short enough blocks of rows that every sum is exact), and gives one residue
matrix for each prime.  Spark adds these up, and Chinese remaindering gives the
exact scatter matrix of the centred vectors; its primes are as many as its
largest entry may need.  Its eigenvectors come from a double eigh on the
driver, which holds matrices of the dimension's square, never rows.  A third
pass whitens all vectors and merges the partitions' means and centred scatters
into the whitened covariance, whose distance from the identity is reported.

Defined results: vectors that are null, empty, or hold null or non-finite
entries take no part, nor do those of another length than most have (of equally
common lengths the longer counts); 64 times an entry beyond 2^62 counts as 2^62
(``LIMIT``); rows that repeat, or share or lack a vec_id, count each; a
deviation beyond a long is null; a component without variance (its eigenvalue
is below rounding) has null as ``whitened``, and takes no part in the identity
error; an eigenvector's largest entry is positive, so reruns agree; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freeing

#: Components that a row is projected on at most.
COMPONENTS = 32
#: An entry c counts as floor(SCALE * c) + OFFSET, cut to LIMIT.
SCALE, OFFSET, LIMIT = 64, 1_000_000, 1 << 62
#: Primes lie below 2^PRIME_BITS; centred residues are below half of that, so that products of EXACT_ROWS rows sum up exactly in a double.
PRIME_BITS = 22
EXACT_ROWS = 1 << (53 - 2 * (PRIME_BITS - 1))
#: Vectors of a block of at most so many entries are taken at a time.
ENTRIES = 1 << 20
#: The scatter matrix has at most so many rows, as the driver solves it.
MOST_DIMENSIONS = 4096


def primes(product: int) -> list[int]:
    """The largest primes below 2^PRIME_BITS whose product passes ``product``."""
    out, whole, p = [], 1, (1 << PRIME_BITS) - 1
    while whole <= product:
        if all(p % d for d in range(3, int(p**0.5) + 1, 2)):
            out.append(p)
            whole *= p
        p -= 2
    return out


def integers(values: np.ndarray) -> np.ndarray:
    """x of each entry, as long."""
    scaled = np.floor(SCALE * values)
    big = np.abs(scaled) >= float(LIMIT)
    return np.where(big, np.where(scaled > 0, LIMIT, -LIMIT), np.where(big, 0.0, scaled).astype(np.int64)) + OFFSET


def usable(vectors: DataFrame, *keep: str) -> DataFrame:
    """The vectors that take part as ``v`` array<double>, with the columns ``keep``."""
    v = F.col("embedding").cast("array<double>")
    ok = (F.size("embedding") > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.where(F.coalesce(ok, F.lit(False))).select(*keep, v.alias("v"))


def _blocks(batches: Iterator[pa.RecordBatch], column: int, dim: int | None = None) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows of equal length and their matrix of x, in blocks; of all lengths, or of one."""
    for batch in batches:
        lists = batch.column(column)
        sizes = np.diff(lists.offsets.to_numpy())
        for d in [dim] if dim else np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == d)
            step = max(1, ENTRIES // d)
            for k in range(0, len(rows), step):
                part = batch.take(pa.array(rows[k : k + step]))
                yield part, integers(part.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, d))


def sums(vectors: DataFrame) -> DataFrame:
    """(dim, place, n, high, low, least, most): for each length and dimension the count, the sum of x as high * 2^32 + low, and x's range.  Each task gives a row for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for _, x in _blocks(batches, 0):
            new = [len(x), (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0), x.min(axis=0), x.max(axis=0)]
            old = held.get(x.shape[1])
            held[x.shape[1]] = new if old is None else [old[0] + new[0], old[1] + new[1], old[2] + new[2], np.minimum(old[3], new[3]), np.maximum(old[4], new[4])]
        for d, (n, *rest) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d, d)), pa.array(np.arange(d)), pa.array(np.full(d, n)), *map(pa.array, rest)], names=["dim", "place", "n", "high", "low", "least", "most"])

    parts = vectors.select("v").mapInArrow(freeing(run), "dim long, place long, n long, high long, low long, least long, most long")
    whole = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).alias(c)
    return parts.groupBy("dim", "place").agg(F.sum("n").alias("n"), whole("high"), whole("low"), F.min("least").alias("least"), F.max("most").alias("most"))


@dataclass(frozen=True)
class Fit:
    """What the first pass tells: ``n`` vectors with the sums ``total`` of each dimension, and a bound of a scatter entry."""

    n: int
    total: list[int]
    bound: int

    @staticmethod
    def of(vectors: DataFrame) -> Fit | None:
        found = sums(vectors)
        by_dim = found.where("place = 0").orderBy(F.desc("n"), F.desc("dim")).select("dim").limit(1).collect()  # the commonest length
        if not by_dim:
            return None
        d = by_dim[0]["dim"]
        if d > MOST_DIMENSIONS:
            raise ValueError(f"vectors of {d} entries; whitening takes at most {MOST_DIMENSIONS}")
        rows = sorted(found.where(F.col("dim") == d).collect(), key=lambda r: r["place"])  # one row a dimension
        n = rows[0]["n"]
        total = [int(r["high"]) * (1 << 32) + int(r["low"]) for r in rows]
        widest = max(max(abs(n * r["least"] - s), abs(n * r["most"] - s)) for r, s in zip(rows, total, strict=True))
        return Fit(n, total, n * widest * widest)


def scatter(vectors: DataFrame, fit: Fit) -> list[list[int]]:
    """The exact sum of y * y^T over all vectors, y = n * x - S."""
    d, moduli = len(fit.total), primes(2 * fit.bound)
    n_mod, s_mod = [fit.n % p for p in moduli], [np.array([s % p for s in fit.total], np.int64) for p in moduli]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((len(moduli), d, d), np.int64)
        any_rows = False
        for _, x in _blocks(batches, 0, d):
            any_rows = True
            for k, p in enumerate(moduli):
                y = (x % p * n_mod[k] - s_mod[k]) % p
                y = np.where(y > p // 2, y - p, y).astype(np.float64)
                for at in range(0, len(y), EXACT_ROWS):
                    block = y[at : at + EXACT_ROWS]
                    held[k] = (held[k] + (block.T @ block).astype(np.int64)) % p
        if any_rows:
            for k in range(len(moduli)):
                for i in range(d):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(d - i, k)), pa.array(np.full(d - i, i)), pa.array(np.arange(i, d)), pa.array(held[k, i, i:])], names=["modulus", "i", "j", "residue"])

    parts = vectors.select("v").mapInArrow(freeing(run), "modulus long, i long, j long, residue long")
    whole = [[0] * d for _ in range(d)]
    product = 1
    for p in moduli:
        product *= p
    factors = [product // p * pow(product // p, -1, p) for p in moduli]
    for r in parts.groupBy("modulus", "i", "j").agg(F.sum("residue").alias("residue")).collect():  # a few numbers for each pair of dimensions
        whole[r["i"]][r["j"]] += r["residue"] * factors[r["modulus"]]
    for i in range(d):
        for j in range(i, d):
            value = whole[i][j] % product
            whole[i][j] = whole[j][i] = value - product if value > product // 2 else value
    return whole


@dataclass(frozen=True)
class Whitening:
    """Components of a fit: x's mean as whole and rest over n, unit vectors in rows, roots of eigenvalues, and their shares."""

    n: int
    total: list[int]
    floor: np.ndarray
    rest: np.ndarray
    components: np.ndarray
    roots: np.ndarray
    explained: np.ndarray

    @staticmethod
    def of(fit: Fit, exact: list[list[int]]) -> Whitening:
        d, cube = len(fit.total), fit.n**3
        covariance = np.array([[v / cube for v in row] for row in exact])  # of whole numbers, so each entry is rounded once
        trace = sum(exact[k][k] for k in range(d)) / cube
        values, vectors = np.linalg.eigh(covariance)
        k = min(COMPONENTS, d)
        values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k].T
        vectors = vectors * np.sign(np.take_along_axis(vectors, np.abs(vectors).argmax(axis=1)[:, None], axis=1))
        flat = values <= d * np.finfo(float).eps * max(values[0], 0.0)
        roots = np.where(flat, np.nan, np.sqrt(np.where(flat, 1.0, values)))
        explained = np.maximum(values, 0.0) / trace if trace else np.zeros(k)
        return Whitening(fit.n, fit.total, np.array([s // fit.n for s in fit.total], np.int64), np.array([s % fit.n / fit.n for s in fit.total]), vectors, roots, explained)

    def apply(self, x: np.ndarray) -> np.ndarray:
        """Each row's whitened components; NaN where a component has no variance."""
        return ((x - self.floor) - self.rest) @ self.components.T / self.roots

    def deviations(self, x: np.ndarray) -> pa.Array:
        """The sum over dimensions of (n * x - S)^2; null beyond a long."""
        about = ((((x - self.floor) - self.rest) * self.n) ** 2).sum(axis=1)
        wrapped = x.astype(np.uint64) * np.uint64(self.n) - np.array([s % (1 << 64) for s in self.total], np.uint64)  # modulo 2^64, which is exact where the sum is a long
        out = (wrapped * wrapped).sum(axis=1, dtype=np.uint64).astype(np.int64)
        unsure = about > 9.2e18
        for k in np.flatnonzero(unsure & (about < 9.3e18)):
            value = sum((self.n * int(v) - s) ** 2 for v, s in zip(x[k], self.total, strict=True))
            unsure[k], out[k] = value >= 1 << 63, value if value < 1 << 63 else 0
        return pa.array(out, mask=unsure)


def identity_error(vectors: DataFrame, white: Whitening) -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity, from the partitions' counts, means and centred scatters."""
    d, keep = len(white.total), np.isfinite(white.roots)
    k = int(keep.sum())
    if not k:
        return 0.0
    shipped = vectors.sparkSession.sparkContext.broadcast(white)

    def merged(a: tuple | None, b: tuple) -> tuple:
        if a is None:
            return b
        n, gap = a[0] + b[0], b[1] - a[1]
        return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for _, x in _blocks(batches, 0, d):
            w = shipped.value.apply(x)[:, keep]
            mean = w.mean(axis=0)
            held = merged(held, (len(w), mean, (w - mean).T @ (w - mean)))
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held[0]]), pa.array([held[1].tolist()]), pa.array([held[2].ravel().tolist()])], names=["n", "mean", "scatter"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for n, mean, spread in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                held = merged(held, (n, np.array(mean), np.array(spread).reshape(k, k)))
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held[0]]), pa.array([held[1].tolist()]), pa.array([held[2].ravel().tolist()])], names=["n", "mean", "scatter"])

    schema = "n long, mean array<double>, scatter array<double>"
    parts = vectors.select("v").mapInArrow(freeing(run), schema)
    parts = parts.repartition(64).mapInArrow(merge, schema)  # at most 64 small matrices come to the driver
    held = None
    for r in parts.collect():
        held = merged(held, (r["n"], np.array(r["mean"]), np.array(r["scatter"]).reshape(k, k)))
    return float(np.abs(held[2] / held[0] - np.eye(k)).max())


def whiten(embeddings: DataFrame) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every vector that takes part and each of the first components."""
    vectors = usable(embeddings, "vec_id")
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    fit = Fit.of(vectors)
    if fit is None:
        return embeddings.sparkSession.createDataFrame([], schema)
    white = Whitening.of(fit, scatter(vectors, fit))
    error = identity_error(vectors, white)
    shipped = embeddings.sparkSession.sparkContext.broadcast(white)
    d, k = len(fit.total), len(white.roots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for part, x in _blocks(batches, 1, d):
            w, m = model.apply(x).ravel(), len(x)
            each = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)), model.deviations(x).take(each),
                    pa.array(w, mask=np.isnan(w)), pa.array(np.tile(model.explained, m)), pa.array(np.full(m * k, error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return vectors.select(F.col("vec_id").cast("long"), "v").mapInArrow(freeing(run), schema)
