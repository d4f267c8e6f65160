"""Memories, long contexts, trees by themselves, fast fingerprints and full records as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import conversations, dedup, memory, trees
from ..sources.lineage import cut
from . import registry
from .cleaning import _DOC, _GROUP_SQL, _JUDGE_SQL, judged_conversations, lower_sql
from . import derived
from .common import Fixture, table
from .converting import NODES, _rejected, shown
from .registry import query
from .training import _MEMORY_SQL

_WRITES = Fixture.over(derived.writes, "id string, type string, content string, importance double, metadata map<string,string>", ["VARCHAR", "VARCHAR", "VARCHAR", "DOUBLE", "MAP(VARCHAR, VARCHAR)"], [
    ("a", "fact", "the mill é turns", 0.9, {"who": "joan", "where": "the \"old\" mill"}), ("b", "fact", "no", 0.5, {"k": "v"}), ("c", "plan", "", 0.51, {"k": "v"}), ("d", "plan", "grain", 1.0, {"x": "ü"}),
])


@query("memory_write", f"WITH {_WRITES.sql('fx')} SELECT id, type, importance, strlen(content) + 2 + strlen(array_to_string(list_transform(map_entries(metadata), lambda e: to_json(e.key)::VARCHAR || ': ' || to_json(e.value)::VARCHAR), ', ')) AS payload_bytes, 0::BIGINT AS access_count FROM fx WHERE importance > 0.5::DOUBLE")
def memory_write(spark, sf_dir):
    return memory.written(_WRITES.frame(spark, sf_dir), F.lit(0.0)).select("id", "type", "importance", "payload_bytes", "access_count")


def _recalled(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held = docs.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("seq"), "text", F.lit(0).cast("long").alias("access_count"), F.lit(0.0).alias("last_access"))
    return memory.recalled(held, table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"), 3, F.lit(9.0))


@query("memory_accesses", f"WITH {_MEMORY_SQL}, n AS (SELECT doc_id, count(*) AS n FROM r WHERE rank <= 3 GROUP BY doc_id) SELECT doc_id AS id, coalesce(n, 0) AS access_count, CASE WHEN n IS NULL THEN 0.0::DOUBLE ELSE 9.0::DOUBLE END AS last_access FROM documents LEFT JOIN n USING (doc_id)")
def memory_accesses(spark, sf_dir):
    return _recalled(spark, sf_dir)[1].select("id", "access_count", "last_access")


@query("memory_injection", f"WITH {_MEMORY_SQL} SELECT query_id, md5(string_agg('<|memory|> ' || text || ' <|/memory|>', chr(10) ORDER BY rank)) AS prefix FROM r JOIN documents USING (doc_id) WHERE rank <= 3 GROUP BY query_id")
def memory_injection(spark, sf_dir):
    return _recalled(spark, sf_dir)[2].select("query_id", F.md5("prefix").alias("prefix"))


_CHUNKED = """t AS (SELECT label AS session, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
c AS (SELECT session, pos // 8 AS chunk_id, min(pos) AS token_start, max(pos) + 1 AS token_end, avg(e[1]) AS x, avg(e[64]) AS y, string_agg(vec_id::VARCHAR, ' ' ORDER BY pos) AS text FROM t WHERE pos < 258000 GROUP BY ALL)"""


def _chunks(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("label").orderBy("vec_id")
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").alias("session"), (F.row_number().over(w) - 1).alias("pos"), F.col("embedding").alias("hidden"), F.col("vec_id").cast("string").alias("text"))
    return memory.chunks(rows, 8, span=32)


@query("hra_ingest", f"WITH {_CHUNKED} SELECT session, chunk_id::BIGINT AS chunk_id, token_start::BIGINT AS token_start, token_end::BIGINT AS token_end, (token_start // 32)::BIGINT AS span, round(x, 6) AS x, round(y, 6) AS y, text FROM c")
def hra_ingest(spark, sf_dir):
    c = _chunks(spark, sf_dir)
    return c.select("session", "chunk_id", F.col("token_start").cast("long").alias("token_start"), F.col("token_end").cast("long").alias("token_end"), "span", F.round(F.element_at("vector", 1), 6).alias("x"), F.round(F.element_at("vector", 64), 6).alias("y"), "text")


@query("hra_report", f"WITH {_CHUNKED} SELECT session, max(token_end)::BIGINT AS indexed_tokens, count(*) AS chunk_count, count(DISTINCT token_start // 32) AS spans, round(count(*) * (8192 * 2 / 1048576)::DOUBLE, 4) AS level1_mb, round(count(DISTINCT token_start // 32) * (8192 * 2 / 1048576)::DOUBLE, 4) AS level2_mb FROM c GROUP BY session")
def hra_report(spark, sf_dir):
    r = memory.ingest_report(_chunks(spark, sf_dir), 8192)
    return r.withColumn("indexed_tokens", F.col("indexed_tokens").cast("long"))


@query("oasst_per_tree", registry._oracles["oasst_tree_paths"].replace("PARTITION BY turns", "PARTITION BY tree_id, turns"))
def oasst_per_tree(spark, sf_dir):
    """Equal conversations of two trees both stay."""
    return shown(trees.conversations(NODES.frame(spark, sf_dir).where(~_rejected()), "trees", "Apache-2.0", per_tree=True))


_FAST_FORM = lower_sql("fast", "trim(regexp_replace(text, '\\s+', ' ', 'g'))")


@query("fast_key_dedup", f"WITH {_DOC} SELECT doc_id, row_number() OVER (PARTITION BY {_FAST_FORM} ORDER BY doc_id) = 1 AS kept FROM d")
def fast_key_dedup(spark, sf_dir):
    docs = cut(table(spark, sf_dir, "documents").select("doc_id", dedup.fast_key(F.coalesce("text", F.lit(""))).alias("key")))
    first = docs.groupBy("key").agg(F.min("doc_id").alias("least"))
    return docs.join(first, "key").select("doc_id", (F.col("doc_id") == F.col("least")).alias("kept"))


@query("digest_dedup", f"WITH {_DOC} SELECT doc_id, row_number() OVER (PARTITION BY trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) ORDER BY doc_id) = 1 AS kept FROM d")
def digest_dedup(spark, sf_dir):
    docs = cut(table(spark, sf_dir, "documents").select("doc_id", dedup.digest(F.coalesce("text", F.lit(""))).alias("key")))
    first = docs.groupBy("key").agg(F.min("doc_id").alias("least"))
    return docs.join(first, "key").select("doc_id", (F.col("doc_id") == F.col("least")).alias("kept"))


@query("training_records", f"""WITH {_JUDGE_SQL} SELECT conv_id::VARCHAR AS source_id, 'conversations' AS source, 'mit' AS license, {_GROUP_SQL} AS language, md5(text) AS text, category, round(score, 4) AS quality_score,
  list_filter(string_split(quality_tags, ','), lambda t: t <> '') AS quality_tags, CASE WHEN conv_id % 2 = 0 THEN ['message_tree_id=t' || conv_id] ELSE []::VARCHAR[] END AS metadata FROM judged WHERE reject_reason IS NULL""")
def training_records(spark, sf_dir):
    good = judged_conversations(spark, sf_dir).where("reject_reason is null").withColumn("tree_id", F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("t"), "conv_id")))
    out = conversations.full_record(good, "conversations")
    shown_map = F.transform(F.map_entries("metadata"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return out.withColumn("text", F.md5("text")).withColumn("metadata", shown_map)
