"""Conversations as arrays of messages: roles, merging, order, text, and the whole cleaner."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import signals as S
from ..functions import text as X
from .rules import Policy, first_reason, lowered, metadata_rules, scored, text_rules

MESSAGES = "array<struct<role:string,content:string>>"


def role(raw: Column) -> Column:
    r = F.lower(F.trim(raw))
    return F.when(r.isin(*S.USERS), "user").when(r.isin(*S.ASSISTANTS), "assistant").otherwise(r)


def merged(messages: Column) -> Column:
    """User and assistant messages with content, neighbours of one role joined by a line end."""
    known = F.filter(F.transform(messages, lambda m: F.struct(role(m["role"]).alias("role"), m["content"].alias("content"))), lambda m: m["role"].isin("user", "assistant") & (F.trim(F.coalesce(m["content"], F.lit(""))) != ""))

    def add(done: Column, m: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.struct(m["role"].alias("role"), F.concat(last["content"], F.lit("\n"), m["content"]).alias("content"))
        same = (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["role"] == m["role"])
        return F.when(same, F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(done, F.array(m)))

    return F.aggregate(known, F.expr(f"cast(array() as {MESSAGES})"), add)


def alternates(messages: Column) -> Column:
    """Begins with the user, takes turns, ends with the assistant."""
    right = F.transform(messages, lambda m, k: m["role"] == F.when(k % 2 == 0, "user").otherwise("assistant"))
    return (F.size(messages) > 0) & (F.size(messages) % 2 == 0) & F.forall(right, lambda x: x)


def plain_text(messages: Column) -> Column:
    name = lambda m: F.when(m["role"] == "user", "User: ").otherwise("Assistant: ")
    return F.array_join(F.transform(messages, lambda m: F.concat(name(m), F.trim(m["content"]))), "\n\n")


def generic_reply_ratio(messages: Column) -> Column:
    replies = F.filter(messages, lambda m: m["role"] == "assistant")
    poor = F.filter(replies, lambda m: F.lower(F.trim(m["content"])).isin(*S.GENERIC_REPLIES) | (F.length(F.trim(m["content"])) < 25))
    return F.size(poor) / F.greatest(F.size(replies), F.lit(1))


def gather(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) rows to one row a conversation: neighbours of one role are one message.

    Islands are found on rows, by windows, so that no array is rebuilt message by message.
    """
    w = Window.partitionBy("conv_id").orderBy("turn")
    known = turns.withColumn("role", role(F.col("role"))).where(F.col("role").isin("user", "assistant") & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    island = known.withColumn("new", (F.lag("role").over(w).eqNullSafe(F.col("role")) == F.lit(False)).cast("int")).withColumn("island", F.sum("new").over(w))
    spoken = island.groupBy("conv_id", "island").agg(F.first("role").alias("role"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n").alias("content"))
    return spoken.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("island", "role", "content"))), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def judge(conversations: DataFrame, policy: Policy | None = None, ruleset: str = "strict") -> DataFrame:
    """Adds text, score, category, quality_tags and reject_reason (null: fine) to rows with messages, license_id and language."""
    policy = policy or Policy()
    text, lower, m = F.col("text"), F.col("lower"), F.col("messages")
    out = conversations.withColumn("text", plain_text(m)).withColumn("lower", lowered(ruleset, F.col("text")))
    score, category, tags = scored(ruleset, text, lower, F.size(m), generic_reply_ratio(m))
    out = out.withColumns({"score": score, "category": category, "quality_tags": tags})
    rules = metadata_rules(policy, F.col("license_id"), F.col("language"), F.size(m), alternates(m), ruleset == "fast") + text_rules(ruleset, policy, text, lower)
    rules.append(("low_quality", F.col("score") < policy.least_score))
    if policy.categories is not None:
        rules.append(("category_not_target", ~F.col("category").isin(*policy.categories)))
    return out.withColumn("reject_reason", first_reason(rules)).drop("lower")


def full_record(rows: DataFrame, source: str) -> DataFrame:
    """``training_record`` with the tags as a list and the metadata (message_tree_id, language; only what is known) as a map."""
    known = F.map_filter(F.create_map(F.lit("language"), F.lower(F.trim(F.coalesce("language", F.lit("")))), F.lit("message_tree_id"), F.coalesce("tree_id", F.lit(""))), lambda k, v: v != "")
    return rows.select(*record_columns(F.lit(source))[:-1], "quality_tags", known.alias("metadata"))


def record_columns(source: Column) -> list[Column]:
    """The columns of a training record, of a judged row; ids need not be unique, as nothing is joined."""
    return [
        F.col("conv_id").cast("string").alias("source_id"), source.alias("source"), F.col("license_id").alias("license"), X.language_group(F.col("language"), F.col("text")).alias("language"),
        F.col("text"), F.col("category"), F.round("score", 4).alias("quality_score"), F.array_join("quality_tags", ",").alias("quality_tags"),
    ]


def training_record(rows: DataFrame, source: str) -> DataFrame:
    return rows.select(*record_columns(F.lit(source)))
