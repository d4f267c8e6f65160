"""Message trees as a stream: nodes wait in the state of their tree, which is given out once it is complete."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

NODE = "message_id string, parent_id string, tree_id string, role string, text string, rank string, lang string, seq long"


class _Buffered(StatefulProcessor):
    """The nodes of one tree; ``gap_ms`` after its last node (in event time) all are given out and forgotten."""

    def __init__(self, gap_ms: int) -> None:
        self.gap_ms = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.nodes = handle.getListState("nodes", NODE)
        self.due = handle.getValueState("due", "at long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        last, new = self.due.get()[0] if self.due.exists() else None, []
        due = last
        for r in rows:
            new.append(tuple(r[n] for n in _NAMES))
            at = int(r["at"].timestamp() * 1000) + self.gap_ms
            due = at if due is None else max(due, at)
        self.nodes.appendList(new)
        if due != last:
            if last is not None:
                self.handle.deleteTimer(last)
            self.handle.registerTimer(due)
            self.due.update((due,))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:
        for n in self.nodes.get():
            yield Row(**dict(zip(_NAMES, n, strict=True)))
        self.nodes.clear()
        self.due.clear()

    def close(self) -> None:
        pass


_NAMES = [c.split()[0] for c in NODE.split(", ")]


def complete(nodes: DataFrame, gap: str = "10 minutes", late: str = "0 seconds") -> DataFrame:
    """A stream of nodes (message_id, parent_id, tree_id, role, text, rank, lang, seq; event time ``at``) to the nodes of complete trees.

    A tree is complete once the watermark is ``gap`` past its last node: other
    trees have gone on, or a marker ended the stream (``closing``).  The state
    holds the open trees, each under its own key; a node that comes after its
    tree was given out opens it anew.  All nodes of a tree come out in one
    batch, so ``trees.conversations(..., per_tree=True)`` in foreachBatch gives
    whole trees.  Needs the RocksDB state store.
    """
    gap_ms = nodes.sparkSession.sql(f"SELECT unix_millis(TIMESTAMP'1970-01-01 00:00:00Z' + INTERVAL {gap}) AS ms").first()["ms"]
    typed = [F.col(c.split()[0]).cast(c.split()[1]).alias(c.split()[0]) for c in NODE.split(", ")]
    keyed = nodes.select(*typed, F.col("at").cast("timestamp").alias("at"), F.coalesce(F.col("tree_id"), F.col("message_id")).alias("tree")).withWatermark("at", late)
    return keyed.where("tree is not null").groupBy("tree").transformWithState(_Buffered(gap_ms), NODE, "Append", "EventTime")


def closing(nodes: DataFrame, gap: str = "10 minutes") -> DataFrame:
    """One marker row for the end of a finite stream of such nodes: its time lets every tree of the table ``nodes`` count as complete.

    The marker's own tree (named by a line end, which no id holds) has a node without role and text, which makes no conversation.
    """
    typed = [F.lit("\n").alias("tree_id") if c.split()[0] == "tree_id" else F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in NODE.split(", ")]
    return nodes.agg((F.max(F.col("at").cast("timestamp")) + F.expr(f"2 * INTERVAL {gap} + INTERVAL 1 second")).alias("at")).where("at is not null").select(*typed, "at")
