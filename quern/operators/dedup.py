"""Order-aware deduplication: the first row of each key, one key or two."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from . import selection


def fingerprint(text, compose: bool = True):
    """Equal for texts that count as equal."""
    return F.sha2(X.normalize_for_hash(text, compose), 256)


def fast_key(text):
    """What the fast rules compare texts by: a 64-bit hash and the length of their form in ASCII lower case with single blanks."""
    t = X.ascii_lower(F.trim(F.regexp_replace(text, r"\s+", " ")))
    return F.struct(F.xxhash64(t).alias("hash"), F.octet_length(t).alias("size"))


def digest(text, compose: bool = True):
    """A 16-byte fingerprint, for state that holds one for each row."""
    return F.unhex(F.md5(X.normalize_for_hash(text, compose)))


def first_by_key(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """The row of least ``seq`` of each key (one of them, if several share it).

    One aggregate over the whole rows: they are computed once, and those of a
    hot key meet before the shuffle.
    """
    rest = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    return rows.groupBy(key).agg(F.min_by(rest, seq).alias("_row")).select("_row.*")


def seeded(rows: DataFrame, prior: DataFrame, key: str) -> DataFrame:
    """Rows whose key no earlier output has."""
    return rows.join(prior.select(key).distinct(), key, "left_anti")


#: So many different pairs of keys at most are decided in one task, of three narrow columns: all of them, or those of a component.
FOLD_ALL, FOLD_PAIRS = 1_000_000, 1_000_000


def components(edges: DataFrame, keep) -> DataFrame:
    """(a, b) of numbered vertices to (vertex, least): the least vertex that each is connected with.

    Every vertex hands its least neighbour to the others around it, in turn to
    the larger and to the smaller ones, until all point at their least; the
    rounds grow with the logarithm of the longest path.
    """
    pairs = keep(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = keep(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small = keep(small)
        if small.exceptAll(pairs).isEmpty() and pairs.exceptAll(small).isEmpty():
            break
        pairs = small
    roots = pairs.select("b").distinct()
    return pairs.select(F.col("a").alias("vertex"), F.col("b").alias("least")).union(roots.select("b", "b"))


def _fold(pdf):
    """The accepted rows of one component, in order of seq."""
    prints, threads, won = set(), set(), []
    ordered = pdf.sort_values("seq")
    for seq, fp, thread in zip(ordered["seq"], ordered["fp"], ordered["thread"], strict=True):
        thread = None if thread != thread else thread  # a missing thread may come as NaN
        if fp not in prints and (thread is None or thread not in threads):
            prints.add(fp)
            threads |= {thread} - {None}
            won.append(seq)
    return ordered.loc[ordered["seq"].isin(won), ["seq", "fp", "thread"]]


def _by_rounds(undecided: DataFrame, keep) -> DataFrame:
    """The accepted rows, by rounds: each accepts the least undecided row of every pair of keys and lets go what shares a key with it."""
    won = [undecided.limit(0)]
    while not undecided.isEmpty():
        by_fp, by_thread = undecided.groupBy("fp").agg(F.min("seq").alias("fp_least")), undecided.where("thread is not null").groupBy("thread").agg(F.min("seq").alias("thread_least"))
        state = undecided.join(by_fp, "fp").join(by_thread, "thread", "left")
        accepted = state.where((F.col("seq") == F.col("fp_least")) & (F.col("thread").isNull() | (F.col("seq") == F.col("thread_least"))))
        accepted = keep(accepted.select("seq", "fp", "thread"))
        won.append(accepted)
        undecided = keep(undecided.join(accepted.select("fp"), "fp", "left_anti").join(accepted.select("thread"), "thread", "left_anti").select("seq", "fp", "thread"))
    return reduce(DataFrame.union, won)


def first_wins(rows: DataFrame, keep) -> DataFrame:
    """(seq, fp, thread) to (seq, reason): what one pass in order of seq decides, if only accepted rows register their keys.

    Of the rows of one text and thread only the first can be accepted, so only
    firsts are looked at.  Texts and threads are the vertices of a graph whose
    edges are those rows; what happens in one of its components doesn't touch
    the others, so each is folded in order in one task (few rows, up to
    ``FOLD_ALL``, are folded at once).  A component of more than ``FOLD_PAIRS`` rows is decided by rounds instead, as many as its longest
    chain of rows that wait for each other.  ``keep`` cuts the lineage
    (checkpoint or written table).
    """
    rows = keep(rows.select("seq", "fp", "thread"))
    pairs = keep(rows.groupBy("fp", "thread").agg(F.min("seq").alias("seq")).select("seq", "fp", "thread").withColumn("vertex", F.xxhash64(F.lit("f"), "fp")))
    if pairs.count() <= FOLD_ALL:
        return _reasons(rows, keep(pairs.withColumn("part", F.lit(0)).groupBy("part").applyInPandas(_fold, pairs.drop("vertex").schema)))
    linked = pairs.where("thread is not null").select(F.col("vertex").alias("a"), F.xxhash64(F.lit("t"), "thread").alias("b"))
    of = pairs.join(components(linked, keep), "vertex", "left").withColumn("part", F.coalesce("least", "vertex"))
    of = keep(of.select("seq", "fp", "thread", "part"))
    giant = of.groupBy("part").agg(F.count("*").alias("n")).where(F.col("n") > FOLD_PAIRS).select("part")
    giant = keep(giant)  # at most one for each FOLD_PAIRS rows
    schema = of.select("seq", "fp", "thread").schema
    folded = of.join(F.broadcast(giant), "part", "left_anti").groupBy("part").applyInPandas(_fold, schema)
    rest = _by_rounds(of.join(F.broadcast(giant), "part", "left_semi").select("seq", "fp", "thread"), keep)
    return _reasons(rows, keep(folded.union(rest)))


def _reasons(rows: DataFrame, winners: DataFrame) -> DataFrame:
    # the reason needs all accepted rows: a thread's may have been found after the row was out by its text
    threads = winners.where("thread is not null").select("thread", F.col("seq").alias("thread_seq"))
    out = rows.join(winners.select("seq", F.lit(True).alias("won")), "seq", "left").join(threads, "thread", "left")
    return out.select("seq", F.when(F.col("won").isNull(), F.when(F.col("thread_seq") < F.col("seq"), "duplicate_thread").otherwise("duplicate")).alias("reason"))


def split(rows: DataFrame, key: str, ratio: float, seed: int = 0) -> DataFrame:
    """Adds ``part`` (train or valid): a hash order chooses int(n ratio) rows, one at least if ratio > 0 and n > 1, and never all."""
    n = rows.count()
    k = min(max(1, int(n * ratio)) if ratio > 0 and n > 1 else 0, max(n - 1, 0))
    return rows.withColumn("part", F.when(in_hash_order(rows, key, seed, k), "valid").otherwise("train"))


def in_hash_order(rows: DataFrame, key: str, seed: int, k: int) -> Column:
    """Whether a row is one of the first k by the MD5 of key and seed; rows of one key are together."""
    mark = F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))
    return selection.first_rows(rows, [F.conv(F.substring(mark, 1, 13), 16, 10).cast("long"), mark, F.col(key)], k)


def ranked_first(rows: DataFrame, keys: list[str], order: list, n: int = 1) -> DataFrame:
    """The first n rows of each key in the given order."""
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_place") <= n).drop("_place")
