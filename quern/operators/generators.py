"""Rows made from a range or from given indexes: prompts, self-play tasks, requests to a model, and levels of effort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Categories of prompts in turn, and words that ask for a level.
CATEGORIES = ("language_understanding", "rewrite", "summarization", "translation", "tone_control", "ambiguity_clarification")
LEVEL_WORDS = ((4, r"\bx\s*open\b|xopen|开放|無限制|无限制"), (3, "ultra|超高|全面调研"), (2, "deep|high|深思|仔细"), (1, "medium|中等|自检"), (0, "low|fast|快速|简短"))


def tasks(spark: SparkSession, count: int, topics: dict[str, tuple[str, ...]], start: int = 0, seed: int = 0, prefix: str = "selfplay") -> DataFrame:
    """(prompt_id, lang, category, topic): languages alternate, categories follow in turn, topics are drawn by a hash of index and seed."""
    if count <= 0:
        raise ValueError("count must be positive")
    return tasks_of(spark.range(start, start + count), topics, seed, prefix)


def tasks_of(indexes: DataFrame, topics: dict[str, tuple[str, ...]], seed: int = 0, prefix: str = "selfplay") -> DataFrame:
    """``tasks`` of the indexes in the column ``id``."""
    lang = F.when(F.col("id") % 2 == 0, "zh").otherwise("en")
    category = F.element_at(F.array(*map(F.lit, CATEGORIES)), ((F.floor(F.col("id") / 2) % len(CATEGORIES)) + 1).cast("int"))
    draw = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(len(xs))) + 1).cast("int"))
    topic = F.when(lang == "zh", draw(topics["zh"])).otherwise(draw(topics["en"]))
    return indexes.select(F.format_string(f"{prefix}_%s_%06d", lang, F.col("id")).alias("prompt_id"), lang.alias("lang"), category.alias("category"), topic.alias("topic"))


def payload(system: Column, user: Column, model: str, temperature: float, top_p: float, max_tokens: int) -> Column:
    """A chat request as JSON."""
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return F.to_json(F.struct(F.lit(model).alias("model"), F.array(turn("system", system), turn("user", user)).alias("messages"), F.lit(temperature).alias("temperature"), F.lit(top_p).alias("top_p"), F.lit(max_tokens).alias("max_tokens")))


def answer(response: Column) -> Column:
    """The first choice of a chat response; a blank one is an error."""
    text = F.trim(F.get_json_object(response, "$.choices[0].message.content"))
    return F.when(F.coalesce(text, F.lit("")) == "", F.raise_error(F.lit("the response has no content"))).otherwise(text)


def requested_level(text: Column) -> Column:
    """The level that a text asks for, 4 to 0 in this order; null if it asks for none."""
    t, out = F.regexp_replace(F.lower(text), r"[^a-z0-9\x{4e00}-\x{9fff}]+", " "), None
    for level, words in LEVEL_WORDS:
        out = F.when(t.rlike(words), level) if out is None else out.when(t.rlike(words), level)
    return out


def escalated(level: Column, failed: Column, informed: Column, most: int = 4) -> Column:
    return F.when(F.coalesce(failed, F.lit(False)) | F.coalesce(informed, F.lit(False)), F.least(level + 1, F.lit(most))).otherwise(level)
