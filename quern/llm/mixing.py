"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are put in a shuffled (hash) order; a document's
virtual finish time is the source's words up to and including it, divided by
the source's target.  A second pass over the source goes on where the first
ended.  All documents of all sources are then taken by finish time until the
budget is spent, which happens near time 1 for every source at once.

The running sums are made in two levels, so that a source that holds a third
of all rows isn't sorted in one task: sums of (source, hash bucket), which are
few, and running sums within each bucket.  The cut is found in the same way,
from sums by bucket of finish time: the driver sees at most ``BUCKETS`` sums
at a time, and one number per source.

Defined results: a null text has size 0, and documents of size 0 are never
taken (taken 0); null is a source of its own, the last one; entries of equal
finish time are taken all or none; rows that repeat a doc_id count each, in
the order of (hash, doc_id, size).  Without any words every target is 0; an
empty table gives no rows.  A very long text is taken or left whole, so that a
source's words may miss its target by one document.  Extra columns are not
read by ``mix``, and kept by ``take``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import heavy_keys, lookup, stage

#: The weights of the sources in order, repeating; the budget as a share of all sizes; the most passes over a source.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_PASSES = 2
BUCKETS = 4096
#: The last keys of at most so many sources are broadcast; those of more are joined.
MOST_BROADCAST = 50_000


def size_of(text: str = "text") -> Column:
    """Words: maximal runs without ASCII white space."""
    return F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).cast("long")


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, passes: int = MOST_PASSES) -> dict[str | None, float]:
    """Words to take of each source: by weight, at most ``passes`` times its size; what is above goes to the others by weight."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    budget, full = share * sum(sizes.values()), set()
    while True:
        rest = budget - sum(passes * sizes[s] for s in full)
        whole = sum(weight[s] for s in names if s not in full)
        over = {s for s in names if s not in full and weight[s] * rest / whole > passes * sizes[s]}
        if not over:
            return {s: float(passes * sizes[s]) if s in full else weight[s] * rest / whole for s in names}
        full |= over


def _key(source: str) -> Column:
    return F.when(F.col(source).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(source)))


def _order() -> Column:
    """The hash by which a source's documents are shuffled."""
    return F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))


def schedule(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, first (its finish time in the first pass) and second."""
    spark = docs.sparkSession
    base = stage(
        docs.select("doc_id", "source", size_of().alias("size"), _order().alias("h"))
        .withColumns({"key": _key("source"), "bucket": F.conv(F.substring("h", 1, 3), 16, 10).cast("int")}), "mix-sizes",
    )
    sums = base.groupBy("key", "bucket").agg(F.sum("size").alias("in_bucket"))
    totals = {r["key"]: r["n"] for r in sums.groupBy("key").agg(F.sum("in_bucket").alias("n")).collect()}
    goal = targets({(k[1:] if k else None): n for k, n in totals.items()})
    plan = spark.createDataFrame([(("=" + s) if s is not None else "", totals[("=" + s) if s is not None else ""], t) for s, t in goal.items()], "key string, source_size long, target double")
    before = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("offset", F.coalesce(F.sum("in_bucket").over(before), F.lit(0))).drop("in_bucket").join(plan, "key")
    within = Window.partitionBy("key", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    done = F.col("offset") + F.sum("size").over(within)
    return (
        base.join(offsets, ["key", "bucket"]).withColumn("done", done)
        .select("doc_id", "source", "size", "source_size", "target", (F.col("done") / F.nullif("target", F.lit(0.0))).alias("first"),
                ((F.col("done") + F.col("source_size")) / F.nullif("target", F.lit(0.0))).alias("second"))
    )


def _cut(entries: DataFrame, budget: float) -> float | None:
    """The largest finish time up to which the entries' sizes stay within the budget (None: all do)."""
    low, width, spent = 0.0, 2.0, 0.0
    rows = entries
    for _ in range(3):
        index = F.least(F.floor((F.col("finish") - low) / width * BUCKETS), F.lit(BUCKETS))
        sums = sorted((r["i"], r["n"]) for r in rows.groupBy(index.alias("i")).agg(F.sum("size").alias("n")).collect())  # at most BUCKETS + 1
        for at, n in sums:
            if spent + n > budget:
                break
            spent += n
        else:
            return None
        rows = rows.where(index == at)
        if at == BUCKETS:  # far behind all the others: documents of many times their source's target
            break
        low, width = low + at * width / BUCKETS, width / BUCKETS
    exact = rows.groupBy("finish").agg(F.sum("size").alias("n")).withColumn("n", F.sum("n").over(Window.orderBy("finish")) + F.lit(spent))
    last = exact.agg(F.max(F.when(F.col("n") <= budget, F.col("finish"))).alias("yes"), F.min("finish").alias("least")).first()
    return last["yes"] if last["yes"] is not None else float(_below(last["least"]))


def _below(x: float) -> float:
    import math

    return math.nextafter(x, -math.inf)


def _passes(plan: DataFrame) -> Column:
    """How often each row of a schedule is taken."""
    sized = plan.where((F.col("size") > 0) & F.col("first").isNotNull())
    entries = sized.select("size", F.explode(F.array("first", "second")).alias("finish"))
    budget = plan.groupBy("source").agg(F.first("target").alias("t")).agg(F.sum("t")).first()[0] or 0.0
    cut = _cut(entries, budget)
    if cut is None:
        return F.when((F.col("size") > 0) & F.col("first").isNotNull(), F.lit(MOST_PASSES)).otherwise(F.lit(0))
    return F.coalesce((F.col("first") <= cut).cast("int") + (F.col("second") <= cut).cast("int"), F.lit(0))


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken (words that the mix takes, repeats counted) of every document."""
    plan = stage(schedule(docs), "mix-plan")
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * _passes(plan)).cast("long").alias("taken"))


def take(docs: DataFrame) -> DataFrame:
    """The documents of the mix with their own columns, each as many times as it is taken; rows that repeat a doc_id with one size share one decision.

    A source's documents are taken in one order, so that its share of the mix
    is all up to a last document of each pass.  These last keys, two a source,
    go to the documents, which stay where they are.
    """
    plan = stage(schedule(docs), "mix-plan")
    order = lambda size: F.struct(_order().alias("h"), F.col("doc_id").alias("i"), size.alias("n"))
    chosen = plan.where("size > 0").withColumn("__q_times", _passes(plan)).withColumn("__q_key", _key("source"))
    last = lambda k: F.max(F.when(F.col("__q_times") >= k, order(F.col("size"))))
    cuts = stage(chosen.groupBy("__q_key").agg(F.count("*").alias("n"), *[last(k).alias(f"__q_last{k}") for k in range(1, MOST_PASSES + 1)]), "mix-cuts")
    rows = docs.withColumn("__q_key", _key("source"))
    if cuts.count() <= MOST_BROADCAST:
        met = rows.join(F.broadcast(cuts.drop("n")), "__q_key")
    else:
        met = lookup(rows, "__q_key", cuts.drop("n"), heavy_keys(cuts.select("__q_key", "n"), docs.count()))

    def within(k: int) -> Column:
        to = F.col(f"__q_last{k}")  # the words are counted for documents that share the last one's hash only
        return F.when(to.isNull() | (_order() > to["h"]), 0).when(_order() < to["h"], 1).otherwise((order(size_of()) <= to).cast("int"))

    times = F.when(F.col("text").rlike(r"[^\x20\x09-\x0D]"), sum((within(k) for k in range(2, MOST_PASSES + 1)), within(1))).otherwise(F.lit(0))
    out = met.withColumn("__q_times", times).where("__q_times > 0")
    return out.withColumn("__q_copy", F.explode(F.sequence(F.lit(1), F.col("__q_times")))).select(*[F.col(f"`{c}`") for c in docs.columns])


#: The same mix in DuckDB's SQL.
SQL = r"""
WITH base AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM base GROUP BY source),
ranked AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1)::INT] AS weight FROM totals),
tried AS (  -- sources in the order in which they reach twice their size; the first k of them are full
  SELECT *, coalesce(sum(source_size) OVER o, 0) * 2 AS full_words, coalesce(sum(weight) OVER o, 0) AS full_weight,
    sum(source_size) OVER () * 1.5::DOUBLE AS budget, sum(weight) OVER () AS all_weight
  FROM ranked WINDOW o AS (ORDER BY 2.0 * source_size / weight, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
first_free AS (
  SELECT full_words, full_weight, budget, all_weight FROM tried
  WHERE weight * (budget - full_words) <= 2.0 * source_size * (all_weight - full_weight) ORDER BY full_weight LIMIT 1),
goal AS (
  SELECT r.source, r.source_size,
    CASE WHEN r.weight * (f.budget - f.full_words)::DOUBLE / (f.all_weight - f.full_weight)::DOUBLE > 2.0 * r.source_size THEN (2 * r.source_size)::DOUBLE
         ELSE r.weight * (f.budget - f.full_words)::DOUBLE / (f.all_weight - f.full_weight)::DOUBLE END AS target
  FROM ranked r, first_free f),
timed AS (
  SELECT b.doc_id, b.size, g.source_size, g.target,
    sum(b.size) OVER (PARTITION BY b.source ORDER BY b.h, b.doc_id, b.size ROWS UNBOUNDED PRECEDING)::BIGINT AS done
  FROM base b JOIN goal g ON b.source IS NOT DISTINCT FROM g.source),
entries AS (
  SELECT size, done / nullif(target, 0) AS finish FROM timed WHERE size > 0
  UNION ALL SELECT size, (done + source_size) / nullif(target, 0) FROM timed WHERE size > 0),
cut AS (
  SELECT max(finish) AS last FROM (
    SELECT finish, sum(sum(size)) OVER (ORDER BY finish) AS spent FROM entries GROUP BY finish)
  WHERE spent <= (SELECT sum(target) FROM goal))
SELECT doc_id, size, source_size, target,
  (size * (CASE WHEN done / nullif(target, 0) <= last THEN 1 ELSE 0 END + CASE WHEN (done + source_size) / nullif(target, 0) <= last THEN 1 ELSE 0 END))::BIGINT AS taken
FROM timed LEFT JOIN cut ON true
"""
