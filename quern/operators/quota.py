"""Byte budgets in arrival order: a row that doesn't fit its language's budget is skipped, one beyond the whole budget ends the run."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.lineage import cut


#: So many rows, of three narrow columns, are folded in one task; of more, all but the last so many are decided by running sums.
FOLD_ROWS = 1_000_000


def running_total(rows: DataFrame, order: list[str], value: str, by: list[str] | None = None) -> DataFrame:
    """Adds ``total``: the sum of ``value`` up to and including each row in the order, of each group ``by``.

    Range partitions add up on their own, then each adds what comes before it,
    so that no task sees more than its partition, however large a group is.
    """
    by = by or []
    ranged = cut(rows.repartitionByRange(*by, *order).withColumn("_slice", F.spark_partition_id()))
    sums = ranged.groupBy(*by, "_slice").agg(F.sum(value).alias("_sum"))  # one row a partition, and one more where a group ends
    prior = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*by, "_slice", F.coalesce(F.sum("_sum").over(prior), F.lit(0)).alias("_before"))
    within = Window.partitionBy(*by, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return ranged.join(before, [*by, "_slice"]).withColumn("total", F.col("_before") + F.sum(value).over(within)).drop("_slice", "_before")


def _folded(batches: Iterator[pd.DataFrame], room: dict[str, int]) -> Iterator[pd.DataFrame]:
    left = dict(room)
    for pdf in batches:
        out = []
        for lang, n in zip(pdf["lang"], pdf["n"], strict=True):
            if lang not in left:
                out.append("language_not_target")
            elif n > left[lang]:
                out.append("language_quota_full")
            else:
                left[lang] -= n
                out.append("")
        yield pdf.assign(verdict=out)


def _in_one_task(rows: DataFrame) -> DataFrame:
    return rows.select("seq", "lang", "n").repartitionByRange(1, "seq").sortWithinPartitions("seq")


_VERDICTS = "seq long, lang string, n long, verdict string"


def per_language(rows: DataFrame, budget: dict[str, int], used: dict[str, int] | None = None) -> DataFrame:
    """(seq, lang, n) with a verdict ('' for kept): a row that doesn't fit its language's budget is skipped, and smaller ones after it may fit.

    All rows fit up to the first that the running sum shows not to; of those
    after it, only rows within what is then left can fit, and so on: each pass
    leaves less than the row that ended it.  Once few rows are undecided one
    task folds them.
    """
    room = {lang: n - (used or {}).get(lang, 0) for lang, n in budget.items()}
    rows = rows.select("seq", "lang", "n")
    spark, passes, left = rows.sparkSession, [], rows.where(F.col("lang").isin(*room)) if room else rows.limit(0)
    if left.count() > FOLD_ROWS:
        rows = cut(rows)
        after: dict[str, int | None] = dict.fromkeys(room)
        while True:
            undecided = F.lit(False)
            for lang, n in room.items():
                mine = (F.col("lang") == lang) & (F.col("n") <= n)
                undecided = undecided | (mine if after[lang] is None else mine & (F.col("seq") > after[lang]))
            left = cut(rows.where(undecided))
            if left.count() <= FOLD_ROWS:
                break
            total = cut(running_total(left, ["seq"], "n", ["lang"]))
            over = F.lit(False)
            for lang, n in room.items():
                over = over | ((F.col("lang") == lang) & (F.col("total") > n))
            first = {r["lang"]: r["s"] for r in total.where(over).groupBy("lang").agg(F.min("seq").alias("s")).collect()}
            spent = total.where(~over).groupBy("lang").agg(F.max("total").alias("t"))
            spent = {r["lang"]: r["t"] for r in spent.collect()}
            for lang, n in list(room.items()):
                passes.append((lang, after[lang], first.get(lang), n))
                room[lang] = n - spent.get(lang, 0) if lang in first else -1  # without a row beyond it the language is done
                after[lang] = first.get(lang, after[lang])
    kept = F.lit(False)
    for lang, low, high, n in passes:  # a few for each language
        mine = (F.col("lang") == lang) & (F.col("n") <= n)
        mine = mine if low is None else mine & (F.col("seq") > low)
        kept = kept | (mine if high is None else mine & (F.col("seq") < high))
    last = {lang: n for lang, n in room.items() if n >= 0}
    tail = _in_one_task(left).mapInPandas(lambda b: _folded(b, last), _VERDICTS)
    if not passes:
        rest = rows.where(~F.col("lang").isin(*room) | F.col("lang").isNull()) if room else rows
        return tail.unionByName(rest.withColumn("verdict", F.lit("language_not_target")))
    tail = tail.select(F.col("seq").alias("_seq"), F.col("verdict").alias("_verdict"))
    verdict = F.when(~F.coalesce(F.col("lang").isin(*budget), F.lit(False)), "language_not_target").when(kept, "").otherwise(F.coalesce("_verdict", F.lit("language_quota_full")))
    return rows.join(tail, F.col("seq") == F.col("_seq"), "left").select("seq", "lang", "n", verdict.alias("verdict"))


def with_total(rows: DataFrame, budget: dict[str, int], whole: int, total_first: bool, used: dict[str, int] | None = None) -> DataFrame:
    """Both budgets, in order of seq.

    ``total_first`` is the batch writer's order of the two tests; the stream
    writer asks for the language first.  Once a row exceeds the whole budget,
    it and all later rows are ``stopped``.  ``used`` is what earlier runs wrote
    of each language.

    Up to the stop the languages don't depend on each other, so the running sum
    of what they keep finds it.
    """
    verdicts = cut(per_language(rows, budget, used))
    spent = running_total(verdicts.withColumn("taken", F.when(F.col("verdict") == "", F.col("n")).otherwise(F.lit(0))), ["seq"], "taken")
    beyond = F.col("total") - F.col("taken") + F.col("n") > whole - sum((used or {}).values())
    stop = spent.where(beyond if total_first else beyond & (F.col("verdict") == "")).agg(F.min("seq")).first()[0]
    return verdicts if stop is None else verdicts.withColumn("verdict", F.when(F.col("seq") >= stop, "stopped").otherwise(F.col("verdict")))


#: So many neighbouring ranges of rows are composed at a time.
FAN = 16


_BEYOND = 1 << 62


class _Steps:
    """What a range of rows does to the shards, for any place where the shard before it began.

    Places are running sums of bytes.  Entering with a shard that began at
    ``x - limit``, the next begins at the first row that ends beyond x.  ``high``
    holds rising bounds: up to high[k] (exclusive) of x, ``count[k]`` shards
    begin in the range, the last of them at ``last[k]``; beyond all bounds none
    does.
    """

    def __init__(self, high: np.ndarray, count: np.ndarray, last: np.ndarray) -> None:
        self.high, self.count, self.last = high, count, last

    def enter(self, began: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """(where the last shard began, how many began) for shards that began at ``began``."""
        k = np.searchsorted(self.high, began + limit, side="right")
        inside = k < len(self.high)
        k = np.minimum(k, max(len(self.high) - 1, 0))
        if not len(self.high):
            return began, np.zeros(len(began), np.int64)
        return np.where(inside, self.last[k], began), np.where(inside, self.count[k], 0)

    @staticmethod
    def of(ends: np.ndarray, starts: np.ndarray, limit: int) -> _Steps:
        """Of rows by their running sums; a row that is larger than the limit has a shard of its own."""
        n = len(ends)
        # the row at which the shard after one that begins at row i begins: the first that ends beyond, and doesn't begin where that one does
        after = np.maximum(np.searchsorted(ends, starts + limit, side="right"), np.searchsorted(starts, starts, side="right"))
        count, last = np.empty(n + 1, np.int64), np.empty(n + 1, np.int64)
        for i in range(n - 1, -1, -1):
            j = after[i]
            count[i], last[i] = (1, starts[i]) if j >= n else (count[j] + 1, last[j])
        reached = starts <= starts[0] + limit if n else np.zeros(0, bool)  # no shard from before can go on for longer
        high = ends[reached]
        if n and high[-1] > starts[0] + limit:
            high[-1] = _BEYOND  # however it is entered, a shard begins here
        return _Steps(*_joined(high, count[:n][reached], last[:n][reached]))

    def then(self, other: _Steps, limit: int) -> _Steps:
        """This range and the next one as one."""
        last, more = other.enter(self.last, limit)
        beyond = other.high > (self.high[-1] if len(self.high) else -1)  # entered without a shard in this range
        return _Steps(*_joined(np.concatenate([self.high, other.high[beyond]]), np.concatenate([self.count + more, other.count[beyond]]), np.concatenate([last, other.last[beyond]])))


def _joined(high: np.ndarray, count: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring steps that do the same, as one; chains of shards meet soon, so few are left."""
    keep = np.ones(len(high), bool)
    if len(high):
        keep[:-1] = (np.diff(count) != 0) | (np.diff(last) != 0)
    return high[keep], count[keep], last[keep]


def shards(rows: DataFrame, limit: int) -> DataFrame:
    """(seq, n) with ``shard``: a new one begins where the current one would exceed ``limit`` (a first row always fits); sizes are above 0.

    Where a shard ends depends on where it began.  So each range of rows first
    says what it does for every place where a shard may have begun before it (a
    step function), neighbouring ranges are composed ``FAN`` at a time up to the
    whole, and the places are handed down again; then every range numbers its
    own rows.  No task holds more than a range, or ``FAN`` step functions, of
    at most the rows of one shard each.  Up to ``FOLD_ROWS`` rows are one range.
    """
    rows = rows.select("seq", "n")
    if rows.count() <= FOLD_ROWS:
        return rows.repartitionByRange(1, "seq").mapInPandas(lambda b: (_numbered(p.sort_values("seq"), -limit - 1, -1, limit) for p in _whole(b)), _PLACED)
    placed = cut(running_total(rows, ["seq"], "n").select("seq", "n", "total").repartitionByRange("seq").withColumn("part", F.spark_partition_id().cast("long")))
    schema = "part long, high array<long>, count array<long>, last array<long>"
    packed = lambda part, s: pd.DataFrame({"part": [part], "high": [s.high.tolist()], "count": [s.count.tolist()], "last": [s.last.tolist()]})
    steps = lambda r: _Steps(*(np.array(r[c], np.int64) for c in ("high", "count", "last")))

    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches) or [pd.DataFrame({"n": [], "total": [], "part": []})])
        for part, of in pdf.groupby("part"):
            of = of.sort_values("seq")
            ends = of["total"].to_numpy(np.int64)
            yield packed(part, _Steps.of(ends, ends - of["n"].to_numpy(np.int64), limit))

    def composed(pdf: pd.DataFrame) -> pd.DataFrame:
        ordered = [r for _, r in pdf.sort_values("part").iterrows()]
        whole = steps(ordered[0])
        for r in ordered[1:]:
            whole = whole.then(steps(r), limit)
        return packed(int(ordered[0]["part"]) // FAN, whole)

    levels = [cut(placed.mapInPandas(own, schema))]
    while levels[-1].count() > 1:
        levels.append(cut(levels[-1].groupBy(F.floor(F.col("part") / FAN)).applyInPandas(composed, schema)))

    def handed(pdf: pd.DataFrame) -> pd.DataFrame:
        began, shard, out = int(pdf["began"].iloc[0]), int(pdf["shard"].iloc[0]), []
        for _, r in pdf.sort_values("part").iterrows():
            out.append((int(r["part"]), began, shard))
            last, more = steps(r).enter(np.array([began]), limit)
            began, shard = int(last[0]), shard + int(more[0])
        return pd.DataFrame(out, columns=["part", "began", "shard"])

    # before the first row, as if the shard before had just been filled
    entered = levels[-1].select("part", F.lit(-limit - 1).cast("long").alias("began"), F.lit(-1).cast("long").alias("shard"))
    for level in reversed(levels[:-1]):
        up = entered.withColumnRenamed("part", "up")
        entered = cut(level.withColumn("up", F.floor(F.col("part") / FAN)).join(up, "up").groupBy("up").applyInPandas(handed, "part long, began long, shard long"))

    def numbered(key: tuple, pdf: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        return _numbered(pdf.sort_values("seq"), int(state["began"].iloc[0]), int(state["shard"].iloc[0]), limit)

    return placed.groupBy("part").cogroup(entered.groupBy("part")).applyInPandas(numbered, _PLACED)


_PLACED = "seq long, n long, shard int"


def _whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """All rows of a partition at once, with their running sums; nothing for an empty one."""
    parts = list(batches)
    if parts:
        pdf = pd.concat(parts).sort_values("seq")
        yield pdf.assign(total=np.cumsum(pdf["n"].to_numpy(np.int64)))


def _numbered(pdf: pd.DataFrame, base: int, shard: int, limit: int) -> pd.DataFrame:
    """Sorted rows (seq, n, total) with their shard, after a shard that began at ``base``."""
    ends, size = pdf["total"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
    starts, at, out = ends - size, 0, np.empty(len(pdf), np.int32)
    while at < len(pdf):
        end = max(int(np.searchsorted(ends, base + limit, side="right")), int(np.searchsorted(starts, base, side="right")), at)
        out[at:end] = shard
        at = end
        if at < len(pdf):
            base, shard = int(starts[at]), shard + 1
    return pd.DataFrame({"seq": pdf["seq"], "n": pdf["n"], "shard": out})


def ratios(values: dict[str, float], whole: int) -> dict[str, int]:
    """Shares normalised to one, as whole numbers; what rounding leaves goes to the first language by name."""
    s = sum(values.values())
    if s <= 0:
        raise ValueError("ratios must add up to more than zero")
    out = {k: int(whole * v / s) for k, v in values.items()}
    out[min(out)] += whole - sum(out.values())
    return out


def shard_report(rows: DataFrame) -> DataFrame:
    return rows.groupBy("lang", "verdict").agg(F.count("*").alias("records"), F.sum("n").alias("bytes"))
