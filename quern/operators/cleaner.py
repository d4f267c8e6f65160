"""The whole cleaner over conversations: rules, scores, two keys, prefilter verdicts, and what a run keeps and reports."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from . import dedup


def thread_key(source: Column, tree_id: Column) -> Column:
    """source:tree, or null without a tree."""
    return F.when(F.coalesce(tree_id, F.lit("")) != "", F.concat_ws(":", source, tree_id))


def cleaned_messages(messages: Column, compose: bool = True) -> Column:
    """The messages with their contents in stored form."""
    contents = F.transform(messages, lambda m: m["content"])
    return F.zip_with(messages, X.nfkc_each(contents) if compose else contents, lambda m, c: F.struct(m["role"].alias("role"), X.tidy(c).alias("content")))


def by_two_keys(judged: DataFrame, seq: str, keep) -> DataFrame:
    """Judged rows (reject_reason, text, thread) with the reasons of duplicates: only accepted rows register their text and thread."""
    keys = judged.where("reject_reason is null").select(F.col(seq).alias("seq"), dedup.fingerprint(F.col("text")).alias("fp"), "thread")
    said = dedup.first_wins(keys, keep).select(F.col("seq").alias("_seq"), F.col("reason").alias("_reason"))
    out = judged.join(said, F.col(seq) == F.col("_seq"), "left")
    return out.withColumn("reject_reason", F.coalesce("reject_reason", "_reason")).drop("_seq", "_reason")


def with_verdicts(rows: DataFrame, verdicts: DataFrame, index: str) -> DataFrame:
    """Adds ``action`` and ``reason`` from verdicts (index, action, reason); a row without a verdict is accepted, an unknown action is an error."""
    v = verdicts.select(F.col(index).alias("_index"), F.col("action").alias("_action"), F.col("reason").alias("_reason"))
    out = rows.join(v, F.col(index) == F.col("_index"), "left")
    known = F.when(F.col("_action").isNull(), "accept").when(F.col("_action").isin("accept", "reject"), F.col("_action"))
    action = F.coalesce(known, F.raise_error(F.concat(F.lit("unknown action of a verdict: "), "_action")).cast("string"))
    return out.withColumn("action", action).withColumn("reason", F.when(F.col("action") == "accept", "accepted").otherwise(F.col("_reason"))).drop("_index", "_action", "_reason")


def top_cleaned(accepted: DataFrame, most: int) -> DataFrame:
    """The accepted rows of largest score, ties by source and id; all of them without a limit."""
    ordered = accepted.orderBy(F.desc("score"), "source", "source_id")
    return ordered.limit(most) if most > 0 else ordered


def truncated_report(judged: DataFrame, kept: DataFrame) -> DataFrame:
    """(metric, key, cnt): accepted, categories and sources of what was kept; seen and rejected of all that was judged."""
    one = lambda rows, metric, key: rows.groupBy(F.lit(metric).alias("metric"), key.alias("key")).agg(F.count("*").alias("cnt"))
    none = F.lit("")
    return (
        one(judged, "seen", none).union(one(judged.where("reject_reason is not null"), "rejected", F.col("reject_reason")))
        .union(one(kept, "accepted", none)).union(one(kept, "category", F.col("category"))).union(one(kept, "source", F.col("source")))
    )


def quality_report(report: DataFrame, policy: dict, outputs: dict, manifest: list[dict] | None = None) -> str:
    """A run's report as JSON with sorted keys: counters (a few hundred rows at most, one for each reason, category and source), settings and paths."""
    counts: dict[str, dict[str, int] | int] = {}
    for r in report.collect():
        if r["key"]:
            counts.setdefault(r["metric"], {})[r["key"]] = r["cnt"]
        else:
            counts[r["metric"]] = r["cnt"]
    return json.dumps({"clean_report": counts, "fetch_manifest": manifest or [], "outputs": outputs, "policy": policy}, ensure_ascii=False, indent=2, sort_keys=True)


def in_order(parts: list[DataFrame]) -> DataFrame:
    """Several sources as one, each row with the ordinal of its source."""
    out = None
    for k, part in enumerate(parts):
        part = part.withColumn("ordinal", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return out
