"""Message trees: which nodes count, and every path from a root to an assistant's leaf."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.lineage import cut
from .conversations import alternates, role
from .dedup import fingerprint, first_by_key

# Review labels and their limits.
BAD_LABELS, BAD_FROM = ("spam", "lang_mismatch", "pii", "not_appropriate", "hate_speech", "sexual_content"), 0.35
TOXIC_FROM, QUALITY_FROM = 0.55, 0.35
TREE_LANGUAGES = ("en", "eng", "english", "zh", "zh-cn", "chinese")


def bad_labels(names: Column, values: Column) -> Column:
    """Labels as parallel arrays; of two values of a name the last number counts, what isn't a number doesn't."""
    pairs = F.filter(F.arrays_zip(names.alias("n"), values.cast("array<string>").alias("v")), lambda x: x["n"].isNotNull() & x["v"].try_cast("double").isNotNull())
    label = lambda name: F.try_element_at(F.filter(pairs, lambda x: x["n"] == name), F.lit(-1))["v"].try_cast("double")
    bad = (F.coalesce(label("quality"), F.lit(1.0)) < QUALITY_FROM) | (F.coalesce(label("toxicity"), F.lit(0.0)) >= TOXIC_FROM)
    for n in BAD_LABELS:
        bad = bad | (F.coalesce(label(n), F.lit(0.0)) >= BAD_FROM)
    return F.coalesce(bad, F.lit(False))


def rejected(deleted: Column, synthetic: Column, review: Column, names: Column, values: Column, lang: Column) -> Column:
    code = F.lower(F.coalesce(lang, F.lit("")))
    flagged = F.coalesce(deleted, F.lit(False)) | F.coalesce(synthetic, F.lit(False)) | ~F.coalesce(review, F.lit(True))
    return flagged | bad_labels(names, values) | ((code != "") & ~code.isin(*TREE_LANGUAGES))


def ancestor_paths(nodes: DataFrame) -> DataFrame:
    """(id, parent) to (id, path): ids from the topmost known ancestor down to the node itself.

    Pointer doubling: each round joins every node's path with that of the node
    where it ends, so a tree of depth d takes log2(d) joins, on ids only.  A
    missing parent ends a path, and so does a node that the path already holds.
    """
    known = nodes.select("id", "parent")
    parents = known.select(F.col("id").alias("parent"), F.lit(True).alias("there"))
    state = known.join(parents, "parent", "left").select("id", F.array("id").alias("path"), F.when(F.col("there") & (F.col("parent") != F.col("id")), F.col("parent")).alias("next"))
    state = cut(state)
    while not state.where("next is not null").isEmpty():
        up = state.select(F.col("id").alias("next"), F.col("path").alias("above"), F.col("next").alias("further"))
        joined = state.join(up, "next", "left")
        whole = F.concat(F.coalesce("above", F.array().cast("array<string>")), F.col("path"))
        # from the node upwards, keep what comes before the first repeat
        upward = F.reverse(whole)
        once = F.reverse(F.filter(upward, lambda x, k: F.array_position(upward, x) == k + 1))
        looped = F.size(F.array_distinct(whole)) < F.size(whole)
        state = cut(joined.select("id", F.when(looped, once).otherwise(whole).alias("path"), F.when(~looped, F.col("further")).alias("next")))
    return state.select("id", "path")


def conversations(rows: DataFrame, source: str, license_id: str, per_tree: bool = False) -> DataFrame:
    """(message_id, parent_id, tree_id, role, text, rank, lang, seq) of the kept nodes to records, one for each assistant's leaf.

    Equal conversations count once: the least (tree_id, rank, seq) stays, over
    all trees, or within each with ``per_tree``.  Paths that don't alternate
    from user to assistant are dropped.
    """
    nodes = rows.select(
        F.col("message_id").alias("id"), F.col("parent_id").alias("parent"), F.coalesce("tree_id", "message_id").alias("tree_id"), role(F.col("role")).alias("role"),
        X.clean_text(F.coalesce("text", F.lit(""))).alias("content"), F.coalesce(F.col("rank").try_cast("int"), F.lit(999)).alias("rank"), F.lower(F.coalesce("lang", F.lit(""))).alias("lang"), "seq",
    ).where("id <> '' and role in ('user', 'assistant') and content <> ''")
    nodes = cut(nodes)
    leaves = nodes.where("role = 'assistant'").join(nodes.select(F.col("parent").alias("id")).where("id is not null").distinct(), "id", "left_anti")
    steps = ancestor_paths(nodes).join(leaves.select("id"), "id", "left_semi").select(F.col("id").alias("leaf"), F.posexplode("path").alias("at", "id"))
    spoken = steps.join(nodes.select("id", "role", "content"), "id").groupBy("leaf").agg(F.array_sort(F.collect_list(F.struct("at", "role", "content"))).alias("m"))
    messages = F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    found = spoken.select(F.col("leaf").alias("id"), messages.alias("messages")).where(alternates(F.col("messages")))
    found = found.join(leaves.select("id", "tree_id", "rank", "lang", "seq"), "id")
    text = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")
    keyed = found.withColumns({"fp": F.concat(fingerprint(text), F.when(F.lit(per_tree), F.concat(F.lit(":"), F.col("tree_id"))).otherwise("")), "place": F.struct("tree_id", "rank", "seq")})
    kept = first_by_key(cut(keyed), "fp", "place")
    meta = F.map_filter(F.create_map(F.lit("message_tree_id"), F.col("tree_id"), F.lit("language"), F.col("lang")), lambda k, v: v != "")
    return kept.select(F.lit(source).alias("source"), F.lit(license_id.lower()).alias("license_id"), F.concat("tree_id", F.lit(":"), "id").alias("source_id"), "messages", meta.alias("metadata"))
