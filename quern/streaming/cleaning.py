"""The cleaner as a stream: stateless rules, deduplication in the state store, and writes that survive a restart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedup import fingerprint
from ..operators.rules import Policy, first_reason, lowered, text_rules


def source(spark: SparkSession, path: str, schema, files_per_batch: int = 100, form: str = "parquet") -> DataFrame:
    """A folder of files as a stream; new files are picked up on the next run from the same checkpoint."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(form).load(path)


def table_source(rows: DataFrame, path: str) -> DataFrame:
    """A Parquet table as a stream, whether it is a folder of parts or one file; a stream reads folders, so one file is picked from its own."""
    folder, _, name = path.rpartition("/")
    one = all(f.endswith(f"/{name}") for f in rows.inputFiles())
    reader = rows.sparkSession.readStream.schema(rows.schema)
    return reader.option("pathGlobFilter", name).parquet(folder) if one else reader.parquet(path)


def cleaned(rows: DataFrame, text: Column, policy: Policy | None = None, ruleset: str = "strict") -> DataFrame:
    """Adds ``reject_reason`` and ``fp``; works on streams and tables alike."""
    out = rows.withColumn("_text", F.coalesce(text, F.lit(""))).withColumn("_lower", lowered(ruleset, F.col("_text")))
    reason = first_reason(text_rules(ruleset, policy or Policy(), F.col("_text"), F.col("_lower")))
    return out.withColumns({"reject_reason": reason, "fp": fingerprint(F.col("_text"))}).drop("_text", "_lower")


def unseen(rows: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """The first accepted row of each fingerprint, none of them in ``prior``; the state holds one key for each text."""
    good = rows.where("reject_reason is null")
    good = good if prior is None else good.join(prior.select("fp").distinct(), "fp", "left_anti")
    return good.dropDuplicates(["fp"])


def run(rows: DataFrame, out: str, checkpoint: str) -> None:
    """Reads what has come in since the last run, appends it to Parquet exactly once, and ends."""
    rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
