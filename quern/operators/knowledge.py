"""Knowledge points and memories as tables: search, merge, learning from failures, saving within a size."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import retrieval

# Weights of the search, and the limits of a saved point.
OVERLAP, DENSE, IMPORTANCE = 0.70, 0.25, 0.05
POINT_BYTES, KEPT_EXAMPLES, RULE_CHARS = 20 * 1024, 8, 4096


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9_+#]+"), F.lit(0))


def blake_cells(dim: int = 128):
    """What hashes tokens: (cell, sign) of each, by the low bits of a 64-bit BLAKE2b and the bit above its first byte."""

    def run(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        h = np.array([int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little") for w in words], np.uint64)
        return (h % np.uint64(dim)).astype(np.int64), np.where((h >> np.uint64(8)) & np.uint64(1), 1.0, -1.0)

    return run


def point_text(domain: Column, rule: Column, examples: Column) -> Column:
    return F.concat_ws(" ", domain, rule, F.array_join(examples, " "))


def search(points: DataFrame, queries: DataFrame, k: int = 3) -> DataFrame:
    """(query_id, rank, id, score) for queries (query_id, text) over points with id, domain, rule, positive_examples, importance.

    Every point counts, also without a common word, so each query meets each
    point: see ``retrieval.best_by_tokens``.
    """
    p = points.select("id", words(point_text(F.col("domain"), F.col("rule"), F.col("positive_examples"))).alias("t"), (IMPORTANCE * F.col("importance")).alias("more"))
    q = queries.select("query_id", words(F.col("text")).alias("t"))
    return retrieval.best_by_tokens(p, q, k, overlap=OVERLAP, dense=DENSE, cells=blake_cells(), repeats=False).select("query_id", "rank", "id", "score")


def touched(table: DataFrame, hits: DataFrame, now: Column) -> DataFrame:
    """One access more, at ``now``, for the rows whose id was hit."""
    n = hits.groupBy("id").agg(F.count("*").alias("_hits"))
    out = table.join(n, "id", "left")
    return out.withColumns({"access_count": F.col("access_count") + F.coalesce("_hits", F.lit(0)), "last_access": F.when(F.col("_hits").isNotNull(), now).otherwise(F.col("last_access"))}).drop("_hits")


def merged(points: DataFrame, pairs: DataFrame) -> DataFrame:
    """Points after each (kept, absorbed) pair: the absorbed one goes, what it knows stays.  An id stands in one pair only."""
    gone = points.select(*[F.col(c).alias(f"_{c}") for c in ("id", "rule", "importance", "positive_examples", "negative_examples", "dependencies")])
    taken = pairs.join(gone, F.col("absorbed") == F.col("_id")).drop("absorbed").withColumnRenamed("kept", "id")
    out = points.join(pairs.select(F.col("absorbed").alias("id")), "id", "left_anti").join(taken, "id", "left")
    got, none = F.col("_id").isNotNull(), F.array().cast("array<string>")
    more = F.array_union(F.array_append("dependencies", F.col("_id")), F.coalesce("_dependencies", none))
    said = got & (F.coalesce("_rule", F.lit("")) != "") & ~F.contains("rule", F.coalesce("_rule", F.lit("")))
    return out.withColumns({
        "dependencies": F.when(got, more).otherwise(F.col("dependencies")), "importance": F.greatest("importance", "_importance"),
        "rule": F.when(said, F.concat("rule", F.lit(" Related rule: "), "_rule")).otherwise(F.col("rule")),
        "positive_examples": F.concat("positive_examples", F.coalesce("_positive_examples", none)), "negative_examples": F.concat("negative_examples", F.coalesce("_negative_examples", none)),
    }).select(*points.columns)


def domain_of(text: Column) -> Column:
    t = F.lower(text)
    return F.when(F.contains(t, F.lit("c++")) | F.contains(t, F.lit("std::")) | F.contains(t, F.lit("vector")), "C++").when(F.contains(t, F.lit("python")), "Python").when(F.contains(t, F.lit("rust")), "Rust").otherwise("general")


def learned(failures: DataFrame) -> DataFrame:
    """(id, requirement, failed, corrected) to points that prefer what was corrected."""
    rule = F.concat(F.lit("When a similar requirement appears, prefer the corrected pattern: "), F.trim("corrected"), F.lit(". Avoid the failed pattern: "), F.trim("failed"), F.lit("."))
    none = F.array().cast("array<string>")
    return failures.select(
        "id", rule.alias("rule"), domain_of(F.concat_ws(" ", "requirement", "corrected")).alias("domain"), F.lit(0.85).alias("importance"),
        F.array(F.trim("corrected")).alias("positive_examples"), F.array(F.trim("failed")).alias("negative_examples"), none.alias("dependencies"),
    )


def fitted(points: DataFrame, limit: int = POINT_BYTES) -> DataFrame:
    """Points whose JSON exceeds ``limit`` bytes keep their last examples and the start of their rule; one that still exceeds it is an error."""
    size = lambda: F.octet_length(F.to_json(F.struct(*points.columns)))
    out = points.withColumn("_big", size() > limit)
    last = lambda c: F.when(F.col("_big") & (F.size(c) > KEPT_EXAMPLES), F.slice(c, -KEPT_EXAMPLES, KEPT_EXAMPLES)).otherwise(F.col(c))
    out = out.withColumns({"rule": F.when(F.col("_big"), F.substring("rule", 1, RULE_CHARS)).otherwise(F.col("rule")), "positive_examples": last("positive_examples"), "negative_examples": last("negative_examples")})
    return out.withColumn("id", F.when(size() > limit, F.raise_error(F.concat(F.lit("too large to save: "), "id"))).otherwise(F.col("id"))).select(*points.columns)


def memory_search(memories: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, id, score): share of the query's words that the memory holds; ties in order of ``seq``, which is unique.

    A score of 0 isn't a hit.  Queries go to the memories in bounded groups
    (``retrieval.best_by_tokens``), so that a word that most memories hold
    gathers nothing in one place.
    """
    asked = queries.select("query_id", F.array_distinct(F.filter(F.split(F.lower("text"), r"\s+"), lambda t: t != "")).alias("t")).where("t is not null")
    bare = lambda t: F.regexp_replace(t, r"^[.,:;()\[\]{}]+|[.,:;()\[\]{}]+$", "")
    held = memories.select(F.col("seq").alias("id"), F.array_distinct(F.transform(F.split(F.lower("text"), r"\s+"), bare)).alias("t"), F.lit(0.0).alias("more")).where("t is not null")
    best = retrieval.best_by_tokens(held, asked, k, overlap=1.0, repeats=False, only_met=True).select("query_id", "rank", F.col("id").alias("_seq"), F.round("score", 4).alias("score"))
    return best.join(memories.select("seq", "id"), F.col("seq") == F.col("_seq")).select("query_id", "rank", "id", "score")


def embedded(points: DataFrame, dim: int = 128) -> DataFrame:
    """Adds ``vector``: the hashed embedding of a point's text, of unit length (all zeros without words)."""

    @F.pandas_udf("array<double>")
    def vectors(lists: pd.Series) -> pd.Series:
        cells = blake_cells(dim)
        out = []
        for t in lists:
            v = np.zeros(dim)
            if len(t):
                np.add.at(v, *cells(list(t)))
            out.append(v / (np.sqrt(v @ v) or 1.0))
        return pd.Series(out)

    return points.withColumn("vector", vectors(words(point_text(F.col("domain"), F.col("rule"), F.col("positive_examples")))))


def upserted(points: DataFrame, changes: DataFrame, embed=embedded) -> DataFrame:
    """Points with vectors after changes (seq, id, op, rule, domain, importance, add_positive, add_negative), each in the order of seq.

    ``update`` replaces what it gives (null: nothing) and appends examples;
    ``create`` begins a point that isn't there, or begins it anew; ``delete``
    removes it.  An update of a point that isn't there, or no longer, is
    ignored.  Changes are folded by id on the map side before they meet the
    points, and only points whose text changes are embedded again: every other
    row keeps the vector it has.
    """
    base = F.when(F.col("op").isin("create", "delete"), F.col("seq"))
    last = changes.groupBy("id").agg(F.max(base).alias("base"), F.max_by("op", base).alias("base_op"))
    live = changes.join(last, "id").where((F.col("op") != "delete") & (F.col("base").isNull() | (F.col("seq") >= F.col("base"))))
    newest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(f"_{c}")
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("seq", F.col(c).alias("v"))))), lambda x: x["v"]).alias(f"_{c}")
    news = live.groupBy("id").agg(newest("rule"), newest("domain"), newest("importance"), listed("add_positive"), listed("add_negative"))
    folded = last.join(news, "id", "left")
    none = F.array().cast("array<string>")
    rows = points.withColumn("_there", F.lit(True)).join(folded, "id", "full")
    fresh = F.coalesce(F.col("base_op") == "create", F.lit(False))
    was = lambda c, empty=None: F.when(fresh, F.lit(None) if empty is None else empty).otherwise(F.col(c))
    kept = rows.where((F.coalesce(F.col("base_op"), F.lit("")) != "delete") & (fresh | F.col("_there")))
    new = kept.select(
        "id", F.coalesce("_rule", was("rule")).alias("rule"), F.coalesce("_domain", was("domain", F.lit("general"))).alias("domain"), F.coalesce("_importance", was("importance", F.lit(0.5))).alias("importance"),
        F.concat(F.coalesce(was("positive_examples", none), none), F.coalesce("_add_positive", none)).alias("positive_examples"),
        F.concat(F.coalesce(was("negative_examples", none), none), F.coalesce("_add_negative", none)).alias("negative_examples"),
        F.coalesce(was("dependencies", none), none).alias("dependencies"), "vector",
        (fresh | F.col("_rule").isNotNull() | F.col("_domain").isNotNull() | (F.size(F.coalesce("_add_positive", none)) > 0)).alias("stale"),
    )
    return new.where(~F.col("stale")).unionByName(embed(new.where("stale").drop("vector")))


def injection(hits: DataFrame) -> DataFrame:
    """(query_id, rank, text) to one text a query, each memory between marks."""
    held = F.array_sort(F.collect_list(F.struct("rank", "text")))
    return hits.groupBy("query_id").agg(F.array_join(F.transform(held, lambda m: F.concat(F.lit("<|memory|> "), m["text"], F.lit(" <|/memory|>"))), "\n").alias("prefix"))


def skeleton(items: DataFrame) -> DataFrame:
    """(session, seq, ops array<string>) to the operations in the order first seen, and a name of the first three."""
    every = F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("seq", "ops"))), lambda x: x["ops"])))
    return items.groupBy("session").agg(every.alias("ops")).withColumn("name", F.array_join(F.slice("ops", 1, 3), "_"))
