"""A whole cleaning run as a stream: rules, two keys, byte budgets, shards and a report, a micro-batch at a time.

A batch writes folders of its own, named by its id, and looks only at what
smaller ids took.  So a batch that runs again after a failure writes the same
again, over what it had written, and a run can be stopped and taken up at any
point.  Texts and threads that were taken are looked up in the state store, so
a batch costs as much after a year as on the first day.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cleaner, conversations, quota, reports
from ..operators.dedup import fingerprint
from ..operators.rules import Policy
from ..sources.lineage import cut
from .keys import KeyState

_REPORT, _DONE = "batch long, metric string, key string, cnt long, bytes long", "source string"


@dataclass
class CleaningRun:
    """Where a run writes and what it may: ``whole`` bytes in all, ``budget`` bytes of each language (none: any), shards of ``shard_bytes``."""

    out: str
    whole: int
    budget: dict[str, int] = field(default_factory=dict)
    shard_bytes: int = 1 << 30
    policy: Policy = field(default_factory=Policy)
    ruleset: str = "strict"
    keep_ms: int | None = None
    state_parts: int | None = None

    @property
    def keys(self) -> KeyState:
        """The texts and threads taken so far; with ``keep_ms`` each is forgotten so long after."""
        return KeyState(f"{self.out}/keys", self.keep_ms, self.state_parts)

    def _there(self, spark: SparkSession, part: str) -> bool:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.out}/{part}")
        return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)

    def _earlier(self, spark: SparkSession, part: str, schema: str, batch: int | None = None) -> DataFrame:
        """What earlier batches wrote of a part; nothing, if there is none."""
        rows = spark.read.schema(schema).parquet(f"{self.out}/{part}") if self._there(spark, part) else spark.createDataFrame([], schema)
        return rows if batch is None else rows.where(F.col("batch") < batch)

    def report(self, spark: SparkSession) -> DataFrame:
        """(metric, key, cnt, bytes) of all batches so far."""
        return self._earlier(spark, "report", _REPORT).groupBy("metric", "key").agg(F.sum("cnt").alias("cnt"), F.sum("bytes").alias("bytes"))

    def _written(self, spark: SparkSession, batch: int) -> dict[str, int]:
        """Bytes of each language so far: a row for each language."""
        rows = self._earlier(spark, "report", _REPORT, batch).where("metric = 'written'").groupBy("key").agg(F.sum("bytes").alias("n"))
        return {r["key"]: r["n"] for r in rows.collect()}

    def stopped(self, spark: SparkSession, batch: int | None = None) -> bool:
        return self._earlier(spark, "report", _REPORT, batch).where("metric = 'skipped' and key = 'stopped'").limit(1).count() > 0

    def clean_batch(self, rows: DataFrame, batch: int) -> None:
        """Clean the rows (seq, source, source_id, license_id, language, messages, tree_id), write what fits, and account for all."""
        spark = rows.sparkSession
        judged = conversations.judge(rows.withColumn("thread", cleaner.thread_key(F.col("source"), F.col("tree_id"))), self.policy, self.ruleset)
        judged = cut(judged.withColumn("fp", fingerprint(F.col("text"))))
        fp, thread = F.concat(F.lit("f:"), F.col("fp")), F.concat(F.lit("t:"), F.col("thread"))
        own = lambda rows: rows.select(F.explode(F.filter(F.array(fp, thread), lambda k: k.isNotNull())).alias("key"))
        known = cut(self.keys.taken_before(own(judged.where("reject_reason is null")), batch))
        flag = lambda name: known.select(F.col("key").alias(f"{name}_key"), F.lit(True).alias(name))
        found = judged.join(flag("_t"), thread == F.col("_t_key"), "left").join(flag("_f"), fp == F.col("_f_key"), "left")
        reason = F.coalesce("reject_reason", F.when(F.col("_t"), "duplicate_thread").when(F.col("_f"), "duplicate"))
        judged = cut(cleaner.by_two_keys(found.withColumn("reject_reason", reason).drop("_t", "_f", "_t_key", "_f_key"), "seq", cut))
        good = judged.where("reject_reason is null")
        self.keys.take(own(good), batch)

        record = good.withColumn("conv_id", F.col("source_id")).select("seq", *conversations.record_columns(F.col("source"))).withColumnRenamed("language", "lang")
        lines = record.select("seq", "source", "lang", F.to_json(F.struct("category", "lang", "license", "quality_score", "quality_tags", "source", "source_id", "text")).alias("value"))
        lines = cut(lines)
        sizes = lines.select("seq", "lang", (F.octet_length("value") + 1).cast("long").alias("n"))
        budget = self.budget or {r["lang"]: 1 << 62 for r in sizes.select("lang").distinct().collect()}  # two language groups at most
        verdicts = sizes.withColumn("verdict", F.lit("stopped")) if self.stopped(spark, batch) else quota.with_total(sizes, budget, self.whole, total_first=False, used=self._written(spark, batch))
        verdicts = cut(verdicts)
        placed = quota.shards(verdicts.where("verdict = ''"), self.shard_bytes)
        kept = cut(lines.join(placed.select("seq", "shard", "n"), "seq"))
        kept.repartition("shard").sortWithinPartitions("shard", "seq").select("shard", "value").write.mode("overwrite").partitionBy("shard").text(f"{self.out}/shards/batch={batch}")

        none = F.lit(0).cast("long")
        parts = [
            reports.clean_report(judged).select("metric", "key", "cnt", none.alias("bytes")),
            verdicts.where("verdict <> ''").groupBy(F.lit("skipped").alias("metric"), F.col("verdict").alias("key")).agg(F.count("*").alias("cnt"), F.sum("n").alias("bytes")),
            kept.groupBy(F.lit("written").alias("metric"), F.col("lang").alias("key")).agg(F.count("*").alias("cnt"), F.sum("n").alias("bytes")),
            kept.groupBy(F.lit("source").alias("metric"), F.col("source").alias("key")).agg(F.count("*").alias("cnt"), F.sum("n").alias("bytes")),
            judged.groupBy(F.lit("converted").alias("metric"), F.col("source").alias("key")).agg(F.count("*").alias("cnt"), none.alias("bytes")),
        ]
        told = parts[0].union(parts[1]).union(parts[2]).union(parts[3]).union(parts[4])
        told.select(F.lit(batch).cast("long").alias("batch"), "metric", "key", "cnt", "bytes").coalesce(1).write.mode("overwrite").parquet(f"{self.out}/report/part={batch}")  # a few counters

    def exhausted(self, spark: SparkSession) -> set[str]:
        return {r["source"] for r in self._earlier(spark, "exhausted", _DONE).collect()}

    def take(self, spark: SparkSession, sources: dict[str, DataFrame]) -> None:
        """Run all streams, in order, each from where it ended; one that was read to its end is noted and not begun again, and none is begun once the budget is spent."""
        for place, (name, stream) in enumerate(sources.items()):
            if self.stopped(spark):
                return
            if name in self.exhausted(spark):
                continue
            ids = place << 40  # batches of a source come after those of the sources before it
            work = stream.writeStream.foreachBatch(lambda rows, k, ids=ids: self.clean_batch(rows, ids + k))
            work.option("checkpointLocation", f"{self.out}/checkpoints/{name}").trigger(availableNow=True).start().awaitTermination()
            if not self.stopped(spark):
                spark.createDataFrame([(name,)], _DONE).write.mode("append").parquet(f"{self.out}/exhausted")
