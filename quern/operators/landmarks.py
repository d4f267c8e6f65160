"""Landmarks, branches, caches and retrieval of chunks: small stores as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays as A

#: Words of a landmark, landmarks of a store, tokens of a chunk.
WORDS, MOST, CHUNK_TOKENS = 50, 10, 512


def shortened(text: Column, words: int = WORDS) -> Column:
    """The first words, one blank between them."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")
    return F.array_join(F.slice(parts, 1, words), " ")


def landmarks(thoughts: DataFrame, store: str, most: int = MOST) -> DataFrame:
    """(store, seq, text, importance): of each store the ``most`` of largest (importance, seq), with shortened texts.

    Dropping the least one whenever a store overflows leaves the same rows.
    """
    w = Window.partitionBy(store).orderBy(F.desc("importance"), F.desc("seq"))
    kept = thoughts.select(store, "seq", "importance", F.row_number().over(w).alias("_k"), "text").where(F.col("_k") <= most)
    return kept.select(store, "seq", "importance", shortened(F.col("text")).alias("text"))


def tool_result(rows: DataFrame) -> DataFrame:
    """(store, seq, label, ref) to landmarks of importance 0 that only point to the whole result."""
    return rows.select("store", "seq", F.lit(0.0).alias("importance"), F.concat_ws("", "label", F.lit(": see "), "ref").alias("text"))


def best_branch(tried: DataFrame, key: str) -> DataFrame:
    """(key, plan, score): of each key the first plan, by seq, that no other beats."""
    return tried.groupBy(key).agg(F.max_by("plan", F.struct("score", -F.col("seq"))).alias("plan"), F.max("score").alias("score"))


def recently_used(touches: DataFrame, cache: str, units: int) -> DataFrame:
    """(cache, unit, last): what a cache of ``units`` places holds after all touches (seq, unit), least recent out first."""
    last = touches.groupBy(cache, "unit").agg(F.max("seq").alias("last"))
    w = Window.partitionBy(cache).orderBy(F.desc("last"))
    return last.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= units).drop("_k")


def in_rank_order(ranked: DataFrame, rows: DataFrame) -> DataFrame:
    """Ranked ids with their rows; an id that has no row is left out, and the ranks stay."""
    return ranked.join(rows, "id")


def kv_megabytes(chunks: Column, width: int, tokens: int = CHUNK_TOKENS) -> Column:
    """What the keys of so many chunks take, at two bytes a number."""
    return chunks * F.lit(tokens * width * 2 / 2**20)


def retrieved(chunks: DataFrame, queries: DataFrame, k: int, width: int) -> DataFrame:
    """(session, rank, chunk_id, score, kv_mb): of each session the k chunks (at least one) of largest cosine with its query vector, and what they take.

    chunks: (session, chunk_id, v); queries: (session, qv), one row a session.
    """
    scored = chunks.join(queries, "session").select("session", "chunk_id", A.cosine(F.col("qv"), F.col("v")).alias("s"))
    w = Window.partitionBy("session").orderBy(F.desc("s"), "chunk_id")
    top = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max(1, k))
    n = F.count("*").over(Window.partitionBy("session"))
    return top.select("session", "rank", "chunk_id", F.round("s", 4).alias("score"), F.round(kv_megabytes(n, width), 4).alias("kv_mb"))


def searched(queries: DataFrame, items: DataFrame, threshold: float, each: int = 3) -> DataFrame:
    """(query_id, ops, found): for queries (query_id, confidence) below the threshold the first ``each`` items of every provider.

    items: (query_id, provider, rank).  Providers are web, memory and context,
    in this order; the operations are theirs, once each, or a bare retrieval
    where nothing was found.
    """
    order = F.array_position(F.array(F.lit("web"), F.lit("memory"), F.lit("context")), F.col("provider"))
    asked = queries.where(F.coalesce("confidence", F.lit(0.0)) < threshold).select("query_id")
    w = Window.partitionBy("query_id", "provider").orderBy("rank")
    few = items.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= each).withColumn("_o", order)
    found = few.groupBy("query_id").agg(F.array_sort(F.collect_set(F.struct(F.col("_o").alias("o"), F.concat(F.lit("retrieve_"), "provider").alias("op")))).alias("ops"), F.count("*").alias("found"))
    ops = F.coalesce(F.transform("ops", lambda x: x["op"]), F.array(F.lit("retrieve")))
    return asked.join(found, "query_id", "left").select("query_id", ops.alias("ops"), F.coalesce("found", F.lit(0)).alias("found"))
