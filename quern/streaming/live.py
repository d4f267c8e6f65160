"""A running report: counters of each micro-batch, added up while the stream runs, written when one is due."""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..operators import reports

NAME = "quern_live"


def observed(judged: DataFrame, reasons: list[str], name: str = NAME) -> DataFrame:
    """The rows (reject_reason), counted as they pass: seen, accepted, bytes of accepted text, and each of the known reasons.

    The counts are part of the batch's own job; no row is read twice.
    """
    ok = F.col("reject_reason").isNull()
    size = F.sum(F.when(ok, F.octet_length("text")).otherwise(0)) if "text" in judged.columns else F.lit(None).cast("long")
    each = [F.count_if(F.col("reject_reason") == r).alias(f"rejected:{r}") for r in reasons]
    return judged.observe(name, F.count(F.lit(1)).alias("seen"), F.count_if(ok).alias("accepted"), F.coalesce(size, F.lit(0)).alias("bytes"), *each)


class LiveReport(StreamingQueryListener):
    """Adds up the counters of every batch of the streams that carry ``observed`` and gives them to ``write``: at most each ``least_seconds``, once ``every`` more rows have been accepted, and at the end.

    Add it by ``spark.streams.addListener``.  A batch that runs again after a
    restart is counted by the run that finished it; within a run each batch
    counts once.
    """

    def __init__(self, write: Callable[[dict[str, int]], None], every: int = 1000, least_seconds: float = 5.0, name: str = NAME, clock: Callable[[], float] = time.time) -> None:
        self.write, self.every, self.least_seconds, self.name, self.clock = write, every, least_seconds, name, clock
        self.counts: Counter[str] = Counter()
        self.batches: set[tuple[str, int]] = set()
        self.reported, self.last = 0, clock()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        row = (p.observedMetrics or {}).get(self.name)
        if row is None or (str(p.runId), p.batchId) in self.batches:
            return
        self.batches.add((str(p.runId), p.batchId))
        self.counts.update(row.asDict())
        steps = self.counts["accepted"] // self.every if self.every > 0 else 0
        if steps > self.reported and reports.due(steps * self.every, self.every, self.clock(), self.last, self.least_seconds):
            self.reported, self.last = steps, self.clock()
            self.write(dict(self.counts))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if self.counts:
            self.write(dict(self.counts))
