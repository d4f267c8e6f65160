"""Memories and long contexts as tables: writing, recalling with a note of each access, chunks of hidden states, saved sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import knowledge
from .landmarks import CHUNK_TOKENS

#: The most tokens of a context, and the tokens of an upper span.
CONTEXT_TOKENS, SPAN_TOKENS = 258_000, 2048


def payload_bytes(content: Column, metadata: Column) -> Column:
    """Bytes of a memory's content and of its metadata as JSON, with a blank after each comma and colon between values."""
    entries = F.transform(F.map_entries(metadata), lambda e: F.octet_length(F.to_json(F.struct(e["key"].alias("k")))) + F.octet_length(F.to_json(F.struct(e["value"].alias("v")))) - 12)
    inside = F.aggregate(entries, F.lit(0), lambda s, n: s + n) + 2 * F.size(metadata) + 2 * F.greatest(F.size(metadata) - 1, F.lit(0))
    return (F.octet_length(content) + 2 + F.when(F.size(metadata) > 0, inside).otherwise(0)).cast("long")


def written(rows: DataFrame, now: Column, least: float = 0.5) -> DataFrame:
    """(id, type, content, importance, metadata) to memories; those of an importance of ``least`` or below aren't written."""
    none = F.lit(0).cast("long")
    return rows.where(F.col("importance") > least).select(
        "id", "type", "content", now.alias("timestamp"), "importance", none.alias("access_count"), now.alias("last_access"),
        F.to_json("metadata").alias("metadata"), payload_bytes(F.col("content"), F.col("metadata")).alias("payload_bytes"),
    )


def recalled(memories: DataFrame, queries: DataFrame, k: int, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(hits, memories after them, injected texts): hits are (query_id, rank, id, score); each adds one to its memory's accesses."""
    hits = knowledge.memory_search(memories, queries, k)
    texts = hits.join(memories.select("id", "text"), "id").select("query_id", "rank", "text")
    return hits, knowledge.touched(memories, hits, now), knowledge.injection(texts)


def chunks(tokens: DataFrame, size: int = CHUNK_TOKENS, most: int = CONTEXT_TOKENS, span: int = SPAN_TOKENS) -> DataFrame:
    """(session, pos, hidden, text) to (session, chunk_id, token_start, token_end, span, vector, text): the mean of each chunk's states and its texts in order.

    Tokens from ``most`` on are left out.  The means are summed place by place,
    so that a chunk's states need not lie in one place.
    """
    own = tokens.where(F.col("pos") < most).withColumn("chunk_id", F.floor(F.col("pos") / size))
    place = own.select("session", "chunk_id", F.posexplode(F.col("hidden").cast("array<double>")).alias("k", "x"))
    means = place.groupBy("session", "chunk_id", "k").agg(F.avg("x").alias("x"))
    vector = means.groupBy("session", "chunk_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda p: p["x"]).alias("vector"))
    said = own.groupBy("session", "chunk_id").agg(
        F.min("pos").alias("token_start"), (F.max("pos") + 1).alias("token_end"),
        F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("text", F.lit("")).alias("text")))), lambda p: p["text"]), " ")).alias("text"),
    )
    return said.join(vector, ["session", "chunk_id"]).withColumn("span", F.floor(F.col("token_start") / span)).select("session", "chunk_id", "token_start", "token_end", "span", "vector", "text")


def ingest_report(of: DataFrame, width: int) -> DataFrame:
    """Per session: tokens, chunks, upper spans and what the summaries of both levels take in MB."""
    mb = lambda n: F.round(n * F.lit(width * 2 / 2**20), 4)
    n = of.groupBy("session").agg(F.max("token_end").alias("indexed_tokens"), F.count("*").alias("chunk_count"), F.count_distinct("span").alias("spans"))
    return n.withColumns({"level1_mb": mb(F.col("chunk_count")), "level2_mb": mb(F.col("spans"))})


def save_sessions(of: DataFrame, path: str) -> None:
    """A folder for each session; sessions that are saved again replace themselves, and no others."""
    of.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session").parquet(path)


def load_session(spark: SparkSession, path: str, session: str) -> DataFrame:
    """The chunks of one session, from its folder alone; an unknown one is an error."""
    rows = spark.read.parquet(path).where(F.col("session").cast("string") == session)
    if rows.isEmpty():
        raise KeyError(f"unknown session: {session}")
    return rows


def learned_twice(points: DataFrame, failures: DataFrame, now: Column) -> DataFrame:
    """Points with those learned from failures; one learned again (same domain and rule) counts as an access of what is known."""
    new = knowledge.learned(failures)
    key = ["domain", "rule"]
    again = new.join(points.select(*key, F.col("id").alias("_known")), key).groupBy(F.col("_known").alias("id")).agg(F.count("*").alias("n"))
    hits = again.select("id", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("_one")).select("id")
    first = new.groupBy(*key).agg(F.min_by(F.struct(*new.columns), "id").alias("r")).select("r.*")
    fresh = first.join(points.select(*key), key, "left_anti").withColumns({"access_count": F.lit(0).cast("long"), "last_access": now})
    return knowledge.touched(points, hits, now).unionByName(fresh.select(*points.columns))
