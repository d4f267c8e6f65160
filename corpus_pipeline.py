"""From raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written
as Parquet and read again as the next stage's ``docs``:

1. ``quality``: documents that the rule ensemble rejects go.
2. ``near_copies``: of each group of documents linked by a word 5-gram Jaccard
   similarity of 0.8 or more, the one with the smallest doc_id stays.
3. ``pii``: personal data is replaced by its kind.
4. ``mixing``: sources are sampled down or repeated to their target weights.
5. ``bpe``: texts become token ids (``n_tokens``, ``ids``, and the digests of
   ids and decoded text), with the other columns of documents.

Defined results, stage by stage: a null or empty text is scored like any other
by ``quality``; ``near_copies`` keeps every document without a text, and one
row of those that repeat a text; ``pii`` leaves a null text null; ``mixing``
takes no document without words, and rows that repeat a doc_id of one size
share a decision; ``bpe`` gives a null text no ids.  Very long texts go through
whole.  A score, or a place in the mix, that ties with its limit is kept.  An
empty table gives an empty table.  All but the last stage return the columns
they were given, whatever further columns there are.  tests/llm compares the
stages and ``run`` with brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import bpe, jaccard, mixing, pii, quality
from quern.llm.common import stage, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.take(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs)


STAGES = [("quality", quality_stage), ("near_copies", near_copies_stage), ("pii", pii_stage), ("mixing", mixing_stage), ("bpe", bpe_stage)]

#: Learned rules, set similarity and BPE are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, f in STAGES[:-1]:
        docs = stage(f(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
