"""State that outlives a batch: keys taken, trees that close, points that change."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import knowledge
from ..streaming import cleaning, keys, trees
from . import derived
from .common import Fixture, shared_folder, table
from .registry import query

_BATCHES = 3


@query("keys_across_batches", f"""WITH d AS (SELECT DISTINCT doc_id % {_BATCHES} AS batch, md5(coalesce(text, '')) AS key FROM documents),
f AS (SELECT key, min(batch) AS since FROM d GROUP BY key) SELECT batch::BIGINT AS batch, key, since < batch AS known FROM d JOIN f USING (key)""")
def keys_across_batches(spark, sf_dir):
    """Texts in three batches, each of which takes its own: which an earlier batch had taken."""
    rows = table(spark, sf_dir, "documents").select((F.col("doc_id") % _BATCHES).alias("batch"), F.md5(F.coalesce("text", F.lit(""))).alias("key")).distinct()
    state, out = keys.KeyState(shared_folder(spark, "keys"), parts=8), None
    for b in range(_BATCHES):
        own = rows.where(F.col("batch") == b).select("key")
        known = state.taken_before(own, b).select("key", F.lit(True).alias("known"))
        state.take(own, b)
        said = own.join(known, "key", "left").select(F.lit(b).cast("long").alias("batch"), "key", F.coalesce("known", F.lit(False)).alias("known"))
        out = said if out is None else out.union(said)
    return out


@query("trees_closed", """WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS text, conv_id * 60 + turn AS moment FROM conversations), m AS (SELECT max(moment) AS most FROM t)
SELECT conv_id::VARCHAR AS tree, count(*) AS nodes, sum(length(text))::BIGINT AS letters FROM t, m GROUP BY conv_id, most HAVING max(moment) + 90.5 <= most""")
def trees_closed(spark, sf_dir):
    """Conversations as trees of a stream, a minute apart: those that are complete when it ends, which the last ones aren't."""
    turns = table(spark, sf_dir, "conversations")
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", keys._STATE["spark.sql.streaming.stateStore.providerClass"])
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    stream = cleaning.table_source(own.read.schema(turns.schema).parquet(f"{sf_dir}/conversations.parquet"), f"{sf_dir}/conversations.parquet")
    conv = F.col("conv_id").cast("string")
    nodes = stream.select(
        F.concat_ws(":", conv, "turn").alias("message_id"), F.lit(None).cast("string").alias("parent_id"), conv.alias("tree_id"), "role", F.coalesce("text", F.lit("")).alias("text"),
        F.lit(None).cast("string").alias("rank"), F.lit("en").alias("lang"), F.col("turn").cast("long").alias("seq"), (1_000_000_000 + F.col("conv_id") * 60 + F.col("turn")).cast("timestamp").alias("at"),  # a stream's time begins after 1970
    )
    folder = shared_folder(spark, "trees")
    done = trees.complete(nodes, gap="90.5 seconds")
    done.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema(done.schema).parquet(f"{folder}/out")
    return out.groupBy(F.col("tree_id").alias("tree")).agg(F.count("*").alias("nodes"), F.sum(F.length("text")).cast("long").alias("letters"))


CHANGES = Fixture("seq long, id string, op string, rule string, domain string, importance double, add_positive string, add_negative string", ["BIGINT"] + ["VARCHAR"] * 4 + ["DOUBLE"] + ["VARCHAR"] * 2, [
    (10**9, "doc1", "delete", None, None, None, None, None), (10**9 + 1, "doc1", "create", "again", None, None, "x", None), (10**9 + 2, "doc3", "update", None, "Rust", None, None, "n"), (10**9 + 3, "nowhere", "update", "no", None, None, None, None),
], derived.changes)


@query("knowledge_upsert", f"""WITH {CHANGES.sql('ch')}, p AS (SELECT 'doc' || doc_id AS id, 'rule ' || doc_id AS rule, coalesce(source, 'general') AS domain, doc_id % 10 / 10::DOUBLE AS importance, coalesce(lang, '') AS said FROM documents),
b AS (SELECT id, max(seq) AS base, arg_max(op, seq) AS base_op FROM ch WHERE op <> 'update' GROUP BY id),
l AS (SELECT ch.* FROM ch LEFT JOIN b USING (id) WHERE op <> 'delete' AND (base IS NULL OR seq >= base)),
n AS (SELECT id, arg_max(rule, seq) FILTER (rule IS NOT NULL) AS r, arg_max(domain, seq) FILTER (domain IS NOT NULL) AS d, arg_max(importance, seq) FILTER (importance IS NOT NULL) AS i, string_agg(add_positive, '|' ORDER BY seq) AS pos, string_agg(add_negative, '|' ORDER BY seq) AS neg FROM l GROUP BY id),
j AS (SELECT coalesce(p.id, b.id) AS id, p.id IS NOT NULL AS there, coalesce(base_op, '') AS o, p.rule, p.domain, p.importance, p.said FROM p FULL JOIN b ON p.id = b.id)
SELECT id, coalesce(r, CASE WHEN o <> 'create' THEN rule END) AS rule, coalesce(d, CASE WHEN o = 'create' THEN 'general' ELSE domain END) AS domain, coalesce(i, CASE WHEN o = 'create' THEN 0.5 ELSE importance END) AS importance,
  concat_ws('|', CASE WHEN o <> 'create' THEN said END, pos) AS positive, coalesce(neg, '') AS negative, o = 'create' OR r IS NOT NULL OR d IS NOT NULL OR pos IS NOT NULL AS stale FROM j LEFT JOIN n USING (id) WHERE o <> 'delete' AND (there OR o = 'create')""")
def knowledge_upsert(spark, sf_dir):
    """Documents as points, labels as changes: what they become, and which were embedded again (those that had a vector of nothing but a mark no longer have it)."""
    docs = table(spark, sf_dir, "documents")
    none = F.array().cast("array<string>")
    points = docs.select(
        F.concat(F.lit("doc"), "doc_id").alias("id"), F.concat(F.lit("rule "), "doc_id").alias("rule"), F.coalesce("source", F.lit("general")).alias("domain"), (F.col("doc_id") % 10 / 10).alias("importance"),
        F.array(F.coalesce("lang", F.lit(""))).alias("positive_examples"), none.alias("negative_examples"), none.alias("dependencies"), F.array(F.lit(7.0)).alias("vector"),
    )
    out = knowledge.upserted(points, CHANGES.frame(spark, sf_dir))
    return out.select("id", "rule", "domain", "importance", F.array_join("positive_examples", "|").alias("positive"), F.array_join("negative_examples", "|").alias("negative"), (F.size("vector") > 1).alias("stale"))
