"""Retrieval: lexical overlap by equi-joins on tokens, hashed embeddings, vector search, and upkeep of memory tables."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import selection
from .quota import running_total
from .tokens import fnv1a

#: Rows of a block, and queries of a block, when every row meets every query.
ROWS, QUERIES = 1024, 4096
#: A pass over the rows takes at most so many queries, of about so many tokens; so many are scored at a time.
MOST_QUERIES, MOST_TOKENS, QUERY_BLOCK = 4096, 1 << 20, 256


def tokens(text: Column) -> Column:
    """ASCII runs in lower case; one longer than three that ends in s is preceded by its stem."""
    plain = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9_]+"), F.lit(0))
    return F.flatten(F.transform(plain, lambda t: F.when((F.length(t) > 3) & t.endswith("s"), F.array(F.substring(t, F.lit(1), F.length(t) - 1), t)).otherwise(F.array(t))))


def top(scores: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def fnv_cells(dim: int = 128):
    """What hashes tokens: (cell, sign) of each, by FNV-1a's low half and its highest bit."""

    def run(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        h = fnv1a(words)
        return ((h & np.uint64(0xFFFFFFFF)) % np.uint64(dim)).astype(np.int64), np.where(h >> np.uint64(63), -1.0, 1.0)

    return run


def _vectors(docs: np.ndarray, cells: np.ndarray, signs: np.ndarray, n: int, dim: int) -> np.ndarray:
    """Signed hashing embeddings of n token lists, of unit length; a list without tokens has none."""
    v = np.zeros((n, dim))
    np.add.at(v, (docs, cells), signs)
    length = np.sqrt(np.einsum("ij,ij->i", v, v))
    return v / np.where(length > 0, length, 1.0)[:, None]


def _passes(asked: DataFrame) -> Iterator[list[tuple]]:
    """The queries (query_id, t) in groups of at most MOST_QUERIES and about MOST_TOKENS tokens, for which a broadcast is small."""
    group, size = [], 0
    for r in asked.select("query_id", "t").toLocalIterator():
        if group and (len(group) >= MOST_QUERIES or size + len(r["t"]) > MOST_TOKENS):
            yield group
            group, size = [], 0
        group.append((r["query_id"], r["t"]))
        size += len(r["t"])
    if group:
        yield group


def best_by_tokens(rows: DataFrame, asked: DataFrame, k: int, *, overlap: float, dense: float = 0.0, cells=None, dim: int = 128, repeats: bool = True, only_met: bool = False) -> DataFrame:
    """(query_id, id, score, rank): the k rows of largest score for each query; ties, at six places, go to the smaller id.

    rows: (id, t, more), asked: (query_id, t), with t their tokens.  A score is
    ``overlap`` times the share of the query's tokens (each as often as it
    stands there, if ``repeats``) that the row has, plus ``dense`` times the
    cosine of both lists' hashed embeddings, plus ``more``.  ``only_met`` leaves
    out rows without a common token.

    The queries go to the rows, a bounded group at a time; each task scores its
    rows in batches and gives only the k best of all of them, so that no token,
    however common, gathers rows in one place.
    """
    kinds = dict(rows.dtypes)["id"], dict(asked.dtypes)["query_id"]

    def searched(group: list[tuple]) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            lists = [list(t) if repeats else list(dict.fromkeys(t)) for _, t in group]
            names = np.array([q for q, _ in group], object)
            place = {w: i for i, w in enumerate(dict.fromkeys(chain.from_iterable(lists)))}
            blocks = []
            for at in range(0, len(lists), QUERY_BLOCK):
                part = lists[at : at + QUERY_BLOCK]
                weight = np.zeros((len(place), len(part)), np.float32)
                for q, t in enumerate(part):
                    np.add.at(weight, ([place[w] for w in t], q), 1.0)
                blocks.append((at, weight, np.array([max(len(t), 1) for t in part])))
            if dense:
                at, flat = np.repeat(np.arange(len(group)), [len(t) for _, t in group]), list(chain.from_iterable(t for _, t in group))
                asked_v = _vectors(at, *cells(flat), len(group), dim)
            held: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}  # of each query the best so far: ids, rounded and plain scores
            for batch in batches:
                for lo in range(0, len(batch), 1000):
                    pdf = batch.iloc[lo : lo + 1000]
                    n = np.array([len(t) for t in pdf["t"]], np.int64)
                    doc, flat = np.repeat(np.arange(len(pdf)), n), np.empty(int(n.sum()), object)
                    flat[:] = list(chain.from_iterable(pdf["t"]))
                    codes, words = pd.factorize(flat)
                    known = np.array([place.get(w, -1) for w in words], np.int64)[codes] if len(words) else np.zeros(0, np.int64)
                    pairs = np.unique(doc[known >= 0] * len(place) + known[known >= 0])
                    of, word = pairs // max(len(place), 1), pairs % max(len(place), 1)
                    first = np.searchsorted(of, np.arange(len(pdf)))
                    some = np.flatnonzero(np.diff(np.append(first, len(of))) > 0)
                    own_v = None
                    if dense:
                        cell, sign = cells(list(words))
                        own_v = _vectors(doc, cell[codes], sign[codes], len(pdf), dim) if len(words) else np.zeros((len(pdf), dim))
                    ids, more = pdf["id"].to_numpy(), pdf["more"].to_numpy(float)
                    for at, weight, size in blocks:
                        hits = np.zeros((len(pdf), weight.shape[1]))
                        if len(some):
                            hits[some] = np.add.reduceat(weight[word], first[some], axis=0)
                        score = overlap * (hits / size) + more[:, None]
                        if dense:
                            score += dense * (own_v @ asked_v[at : at + weight.shape[1]].T)
                        rounded = np.floor(score * 1e6 + 0.5)
                        if only_met:
                            rounded[hits == 0] = -np.inf
                        most = rounded.max(axis=0)
                        for q in np.flatnonzero(np.isfinite(most)):
                            r, old = rounded[:, q], held.get(at + q)
                            if old is not None and len(old[0]) == k and most[q] < old[1][-1]:
                                continue
                            best = np.flatnonzero(r >= np.partition(r, len(r) - min(k, len(r)))[len(r) - min(k, len(r))])
                            best = best[np.isfinite(r[best])]
                            new = ids[best], r[best], score[best, q]
                            if old is not None:
                                new = tuple(np.concatenate(x) for x in zip(old, new, strict=True))
                            order = np.lexsort((new[0], -new[1]))[:k]
                            held[at + q] = new[0][order], new[1][order], new[2][order]
            for q, (i, _, s) in held.items():
                yield pd.DataFrame({"query_id": names[q], "id": i, "score": s})

        return rows.select("id", "t", "more").mapInPandas(run, f"query_id {kinds[1]}, id {kinds[0]}, score double")

    parts = [searched(group) for group in _passes(asked)]
    found = reduce(DataFrame.union, parts) if parts else rows.select(F.lit(None).cast(kinds[1]).alias("query_id"), "id", F.lit(0.0).alias("score")).limit(0)
    return top(found.select("query_id", "id", F.round("score", 6).alias("score")), k)


def lexical(queries: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank): hits of the query's token multiset in the text's token set, of texts with a hit."""
    rows = texts.select("id", F.array_distinct(tokens(F.col("text"))).alias("t"), F.lit(0.0).alias("more"))
    return best_by_tokens(rows, queries.select("query_id", tokens(F.col("text")).alias("t")), k, overlap=1.0, only_met=True)


def hybrid(queries: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """0.7 dense + 0.3 overlap, the k best of each query; ties by id."""
    rows = texts.select("id", tokens(F.col("text")).alias("t"), F.lit(0.0).alias("more"))
    asked = queries.select("query_id", tokens(F.col("text")).alias("t"))
    return best_by_tokens(rows, asked, k, overlap=0.3, dense=0.7, cells=fnv_cells()).select("query_id", "id", "score", "rank")


def met(rows: DataFrame, queries: DataFrame, run, kinds: str, most_rows: int = ROWS, most_queries: int = QUERIES) -> DataFrame:
    """``run`` (two Arrow tables to one of ``kinds``) over every pair of a block of rows (id, ...) and one of queries (query_id, ...), so that no task or broadcast holds a whole side."""
    row_blocks, query_blocks = max(1, -(-rows.select("id").count() // most_rows)), max(1, -(-queries.select("query_id").count() // most_queries))
    place = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
    all_of = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    dealt = rows.withColumn("_r", place("id", row_blocks)).withColumn("_q", all_of(query_blocks))
    asked = queries.withColumn("_q", place("query_id", query_blocks)).withColumn("_r", all_of(row_blocks))
    # a number of parts that is given is not merged by size: the work of a pair of blocks is far larger than its rows
    pairs = lambda side: side.repartition(row_blocks * query_blocks, "_r", "_q").groupBy("_r", "_q")
    return pairs(dealt).cogroup(pairs(asked)).applyInArrow(lambda r, q: run(r.drop_columns(["_r", "_q"]), q.drop_columns(["_r", "_q"])), kinds)


def _by_length(column: pa.ChunkedArray) -> list[tuple[np.ndarray, np.ndarray | None, np.ndarray | None]]:
    """Of a column of vectors, for each length: places, vectors as doubles, and where they hold nulls; null vectors have none."""
    lists = column.combine_chunks()
    size = np.asarray(lists.value_lengths().fill_null(-1))
    out = []
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        flat = lists.take(pa.array(at)).flatten()
        out.append((at, None, None) if n < 0 else (at, np.asarray(flat.cast(pa.float64()).fill_null(0.0)).reshape(len(at), n), np.asarray(flat.is_null()).reshape(len(at), n)))
    return out


def _cosines(rows: list, queries: list, n_rows: int, lo: int, hi: int) -> np.ndarray:
    """Cosines of all rows and the queries lo to hi over their common length, at six places; norms count as 1e-8 at least.  A null, below all others, is -9, and NaN, above them, 9."""
    out = np.full((n_rows, hi - lo), -9.0)
    for at, x, null in rows:
        for asked, y, gone in queries:
            some = (asked >= lo) & (asked < hi)
            if x is None or y is None or not some.any():
                continue
            n = min(x.shape[1], y.shape[1])
            a, b = x[:, :n], y[some][:, :n]
            with np.errstate(all="ignore"):
                length = lambda v: np.maximum(np.sqrt(np.einsum("ij,ij->i", v, v)), 1e-8)
                c = (a @ b.T) / (length(a)[:, None] * length(b)[None, :])
                c = np.where(np.isnan(c), 9.0, np.copysign(np.floor(np.abs(c) * 1e6 + 0.5) / 1e6, c))
            c[null[:, :n].any(axis=1)] = -9.0
            c[:, gone[some][:, :n].any(axis=1)] = -9.0
            out[np.ix_(at, asked[some] - lo)] = c
    return out


def _nearest(k: int):
    """What gives, of a block of rows (id, v) and one of queries (query_id, qv), the k rows of largest cosine for each query; ties to the smaller id."""

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        rows = rows.sort_by("id")
        ids, names = rows["id"].to_numpy(), asked["query_id"].to_numpy()
        vectors, queries = _by_length(rows["v"]), _by_length(asked["qv"])
        r, q, s = [], [], []
        for lo in range(0, len(names) if len(ids) else 0, QUERY_BLOCK):
            hi = min(lo + QUERY_BLOCK, len(names))
            score = _cosines(vectors, queries, len(ids), lo, hi).T
            score[ids[None, :] == names[lo:hi, None]] = -np.inf  # a query doesn't find itself
            most = min(k, score.shape[1])
            which, row = np.nonzero(score >= np.partition(score, score.shape[1] - most, axis=1)[:, score.shape[1] - most, None])
            order = np.lexsort((row, -score[which, row], which))
            which, row = which[order], row[order]
            best = (np.arange(len(which)) - np.searchsorted(which, which) < most) & np.isfinite(score[which, row])
            r.append(row[best])
            q.append(which[best] + lo)
            s.append(score[which[best], row[best]])
        r, q, s = (np.concatenate(x) if x else np.zeros(0, kind) for x, kind in ((r, np.int64), (q, np.int64), (s, float)))
        score = pa.array(np.where(s == 9.0, np.nan, s), mask=s == -9.0)
        return pa.table({"query_id": asked["query_id"].take(pa.array(q)), "id": rows["id"].take(pa.array(r)), "score": score})

    return run


def cosine_top(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k rows of largest cosine for each query, of any number of queries."""
    v = vectors.where("id is not null").select("id", "v")
    q = queries.where("id is not null").select(F.col("id").alias("query_id"), F.col("v").alias("qv"))
    kinds = f"query_id {dict(q.dtypes)['query_id']}, id {dict(v.dtypes)['id']}, score double"
    return top(met(v, q, _nearest(k), kinds), k)


def prune_to_budget(memories: DataFrame, budget: int, now: float, gamma: float = 0.995, tau: float = 86400.0) -> DataFrame:
    """What stays when the lowest scores go until the payload fits; at least one stays."""
    score = F.col("importance") * F.pow(F.lit(gamma), (F.lit(now) - F.col("last_access")) / F.lit(tau)) + F.lit(0.01) * F.col("access_count")
    ranked = running_total(memories.withColumn("score", score).select("id", "payload_bytes", "score"), ["score", "id"], "payload_bytes")
    last = memories.select(F.max(F.struct(score.alias("score"), "id")).alias("last"), F.sum("payload_bytes").alias("all")).first()
    # what is left before a row goes is all but the rows below it; the best row stays
    beyond = F.lit(last["all"] or 0) - (F.col("total") - F.col("payload_bytes")) > budget
    best = F.col("id") == F.lit(last["last"]["id"] if last["last"] else None)
    return ranked.where(~beyond | best).select("id", F.round("score", 6).alias("score"))


def prune_to_count(points: DataFrame, most: int, order: list) -> DataFrame:
    """All but the first rows in ``order``, so that ``most`` stay."""
    order = [*[F.col(c) if isinstance(c, str) else c for c in order], F.col("id")]
    return points.where(~selection.first_rows(points, order, points.count() - most))
