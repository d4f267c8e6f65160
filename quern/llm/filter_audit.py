"""What each of five filters removes, in every order of application.

Every document gets the five flags of its failing filters.  The documents'
flags are then replayed: crossed with the broadcast 120 orders, exploded to
their five steps, and aggregated by part, order and step, where a document
counts as removed at the first step whose filter it fails.  The aggregation
combines on the map side, so only 600 rows a part leave each task.

The fifth filter (a text that a smaller doc_id has as well) needs the whole
table.  Documents are first counted by the digest of their text and what else
the result depends on, so that the copies of a text, however many, are a few
rows before they meet in one place; these rows, with their counts, are what is
replayed.

Defined results: a null text counts as empty (and repeats an empty one); a null
language is the part of the empty string; a row with a null doc_id repeats
nothing and has no labels, but is counted; rows that share a doc_id are counted
each, and none of them repeats the others; a document is good or toxic if any
of its labels says so; a very long text is judged whole; an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import text_or_empty

#: The filters, and the characters that part words.
FILTERS = "ABCDE"
_WHITE = "[\\x20\\x09-\\x0D]+"
#: Rows without a doc_id have no labels; they are dealt to so many places for the join.
_SALTS = 4096


def _bits() -> Column:
    return F.lit([1 << k for k in range(len(FILTERS))])


def _text_flags(text: Column) -> Column:
    """The failing ones of the filters A to D as bits 0 to 3."""
    upper = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    words = F.array_remove(F.split(text, _WHITE), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    fails = [n < 200, 100 * distinct.cast("long") < 50 * n.cast("long"), 100 * upper.cast("long") > 3 * F.length(text), text.rlike("[#$%&*|]")]
    out = F.lit(0)
    for k, fail in enumerate(fails):
        out = out + F.when(fail, 1 << k).otherwise(0)
    return out


def flags(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, fails, good, toxic, n): documents by part, failing filters (bits 0 to 4) and labels; equal texts of a part in one row or two."""
    text = text_or_empty()
    salt = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(_SALTS)) + 1).otherwise(F.lit(0)).alias("salt")
    slim = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), _text_flags(text).alias("fails"))
    by_id = slim.groupBy("doc_id", "part", "digest", "fails").agg(F.count("*").alias("n")).select("*", salt)
    says = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False))
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("label_id")).agg(says("quality").alias("good"), says("toxic").alias("toxic"))
    labelled = by_id.join(known, (F.col("doc_id") == F.col("label_id")) & (F.col("salt") == 0), "left")
    labelled = labelled.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    # of each kind of row the number of all, of those without an id, and the least id with its number of rows
    kinds = labelled.groupBy("digest", "fails", "part", "good", "toxic").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("n_null"), first.alias("first"))
    least = F.min("first.doc_id").over(Window.partitionBy("digest"))
    single = F.col("n_null") + F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    parted = kinds.withColumn("least", least).withColumn("single", single)
    both = F.array(F.struct(F.col("fails"), F.col("single").alias("n")), F.struct((F.col("fails") + 16).alias("fails"), (F.col("n") - F.col("single")).alias("n")))
    return parted.select("part", "good", "toxic", F.explode(F.filter(both, lambda x: x["n"] > 0)).alias("of")).select("part", "of.fails", "good", "toxic", "of.n")


def replay(flagged: DataFrame) -> DataFrame:
    """The counts of each part, order and step, from rows (part, fails, good, toxic, n)."""
    spark = flagged.sparkSession
    orders = spark.createDataFrame([("".join(o), [FILTERS.index(f) for f in o]) for o in permutations(FILTERS)], "filter_order string, filters array<int>")
    fails = lambda f: F.col("fails").bitwiseAND(F.element_at(_bits(), f + 1)) != 0
    at = lambda k: F.col("filters")[k]
    first = F.lit(len(FILTERS) + 1)
    for k in reversed(range(len(FILTERS))):
        first = F.when(fails(at(k)), k + 1).otherwise(first)
    crossed = flagged.crossJoin(F.broadcast(orders)).withColumn("first", first)
    steps = crossed.select("part", "filter_order", "fails", "good", "toxic", "n", "first", F.posexplode("filters").alias("place", "filter")).withColumn("step", F.col("place") + 1)
    count = lambda c, name: F.sum(F.when(c, F.col("n")).otherwise(0)).alias(name)
    removed = F.col("first") == F.col("step")
    alone = F.col("fails") == F.element_at(_bits(), F.col("filter") + 1)
    out = steps.groupBy("part", "filter_order", "step").agg(
        count(F.col("first") > F.col("step"), "kept"), count(removed, "removed"), count(fails(F.col("filter")) & (F.col("first") < F.col("step")), "redundant"),
        count(alone, "unique_fails"), count(removed & F.col("good"), "good_lost"), count(removed & F.col("toxic"), "toxic_lost"),
    )
    of_filter = Window.partitionBy("part", F.substring("filter_order", F.col("step"), F.lit(1)))
    return out.withColumn("shapley", F.sum("removed").over(of_filter))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the five filters, and step."""
    return replay(flags(docs, labels))


SQL = r"""
WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
worded AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM texts),
firsts AS (SELECT t AS ft, min(doc_id) AS least FROM texts GROUP BY t),
said AS (SELECT doc_id AS label_id, bool_or(quality = 1) AS g, bool_or(toxic = 1) AS x FROM labels GROUP BY doc_id),
flagged AS (
  SELECT part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t),
    regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > least, false)] AS fails, coalesce(g, false) AS good, coalesce(x, false) AS toxic
  FROM worded JOIN firsts ON t = ft LEFT JOIN said ON doc_id = label_id),
letters AS (SELECT unnest([1, 2, 3, 4, 5]) AS f),
orders AS (
  SELECT [a.f, b.f, c.f, d.f, e.f] AS o, array_to_string(list_transform(o, lambda k: chr((64 + k)::INT)), '') AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
crossed AS (SELECT part, fails, good, toxic, o, filter_order, coalesce(list_position(list_transform(o, lambda k: fails[k]), true), 6) AS first FROM flagged, orders),
steps AS (SELECT *, unnest([1, 2, 3, 4, 5]) AS step FROM crossed),
counted AS (
  SELECT part, filter_order, step, count(*) FILTER (first > step) AS kept, count(*) FILTER (first = step) AS removed,
    count(*) FILTER (fails[o[step]] AND first < step) AS redundant, count(*) FILTER (fails[o[step]] AND len(list_filter(fails, lambda x: x)) = 1) AS unique_fails,
    count(*) FILTER (first = step AND good) AS good_lost, count(*) FILTER (first = step AND toxic) AS toxic_lost
  FROM steps GROUP BY part, filter_order, step)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, filter_order[step]))::BIGINT AS shapley
FROM counted
"""
