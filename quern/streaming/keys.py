"""Which keys earlier batches have taken, kept in the state store: one small value a key, looked up by key.

Every batch asks for its own distinct keys and later registers those that it
took.  Both are rows of one stream, grouped by key, whose state holds the least
batch that took the key; an answer counts only what earlier batches took.  So a
batch that runs again asks and takes again, and gets the same answers.  The
work of a batch grows with its own keys, not with all that were ever taken.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_EVENTS, _KNOWN = "key string, batch long, taken boolean, at timestamp", "key string, batch long"
#: Settings of the session that the look-ups run in.
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


class _Taken(StatefulProcessor):
    def __init__(self, keep_ms: int | None) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.since = handle, handle.getValueState("since", "batch long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        held = self.since.get()[0] if self.since.exists() else None
        since, asked, latest = held, set(), 0  # the batches of this run: a few
        for r in rows:
            latest = max(latest, int(r["at"].timestamp() * 1000))
            if r["taken"]:
                since = r["batch"] if since is None else min(since, r["batch"])
            else:
                asked.add(r["batch"])
        if since != held:
            self.since.update((since,))
            if self.keep_ms is not None and held is None:
                self.handle.registerTimer(latest + self.keep_ms)
        for batch in sorted(asked):
            if since is not None and since < batch:
                yield Row(key=key[0], batch=batch)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:
        self.since.clear()
        return iter(())

    def close(self) -> None:
        pass


class KeyState:
    """Keys taken so far, below ``folder`` (of the shared folders).

    With ``keep_ms`` a timer lets a key go so long after it was taken, once the
    stream's time, which trails by ``late``, has come so far.  ``parts`` (of the
    state; by default the session's shuffle partitions) and whether there is a
    ``keep_ms`` are fixed by the first run.  Keys must not be null.
    """

    def __init__(self, folder: str, keep_ms: int | None = None, parts: int | None = None, late: str = "1 hour") -> None:
        self.folder, self.keep_ms, self.parts, self.late = folder, keep_ms, parts, late

    def _add(self, keys: DataFrame, batch: int, taken: bool) -> None:
        rows = keys.select(F.col("key").cast("string"), F.lit(batch).cast("long").alias("batch"), F.lit(taken).alias("taken")).distinct()
        rows.withColumn("at", F.current_timestamp()).write.mode("append").parquet(f"{self.folder}/events")

    def taken_before(self, keys: DataFrame, batch: int) -> DataFrame:
        """Of the keys (key), those that a batch before ``batch`` took."""
        self._add(keys, batch, False)
        spark = self._session(keys.sparkSession)
        runs: list[int] = []

        def keep(known: DataFrame, run: int) -> None:
            known.write.mode("overwrite").parquet(f"{self.folder}/known/run={run}")
            runs.append(run)

        events = spark.readStream.schema(_EVENTS).parquet(f"{self.folder}/events")
        events = events if self.keep_ms is None else events.withWatermark("at", self.late)
        known = events.groupBy("key").transformWithState(_Taken(self.keep_ms), _KNOWN, "Update", "None" if self.keep_ms is None else "EventTime")
        query = known.writeStream.foreachBatch(keep).option("checkpointLocation", f"{self.folder}/state").outputMode("update").trigger(availableNow=True).start()
        query.awaitTermination()
        spark = keys.sparkSession
        if not runs:
            return spark.createDataFrame([], "key string")
        paths = [f"{self.folder}/known/run={r}" for r in runs]
        return spark.read.schema(_KNOWN).parquet(*paths).where(F.col("batch") == batch).select("key").distinct()

    def take(self, keys: DataFrame, batch: int) -> None:
        """Register the keys (key) as taken by ``batch``."""
        self._add(keys, batch, True)

    def _session(self, spark: SparkSession) -> SparkSession:
        """A session of its own, so that the caller's settings stay."""
        own = spark.newSession()
        for k, v in _STATE.items():
            own.conf.set(k, v)
        own.conf.set("spark.sql.shuffle.partitions", str(self.parts or spark.conf.get("spark.sql.shuffle.partitions")))
        return own
