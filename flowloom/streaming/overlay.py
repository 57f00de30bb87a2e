"""Runtime events as a stream over a static graph."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def observed(events: DataFrame, urls: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Events (event_id, ts, endpoint_id), streaming or not, once each, with the only url of their endpoint.

    Events later than ``late`` behind the newest may be dropped; an endpoint of several
    urls matches none.
    """
    unique = urls.groupBy("endpoint_id").agg(F.count("*").alias("n"), F.min("url").alias("url")).filter("n = 1").drop("n")
    once = events.withWatermark("ts", late)
    once = once.dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else once.dropDuplicates(["event_id"])
    return once.join(unique, "endpoint_id", "left")


def counted(events: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events by window and type."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(
        F.col("w.start").alias("start"), "event_type", "n", "total"
    )


PIECES = "array<struct<reason:string,event_id:string,timestamp:string>>"


class _FirstPieces(StatefulProcessor):
    """Keeps the first distinct pieces of evidence of a target, in order, and tells them whenever they change."""

    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("kept", f"changes long, pieces {PIECES}")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        order = lambda p: [(x is not None, x or "") for x in p]
        changes, before = self.kept.get() if self.kept.exists() else (0, [])
        before = [tuple(p) for p in before]
        best = list(before)
        for row in rows:  # never more than twice as many at once
            best.append((row["reason"], row["event_id"], row["timestamp"]))
            if len(best) > 2 * self.most:
                best = sorted(set(best), key=order)[: self.most]
        best = sorted(set(best), key=order)[: self.most]
        if best != before:
            self.kept.update((changes + 1, best))
            yield Row(id=key[0], changes=changes + 1, pieces=best)

    def close(self) -> None:
        pass


def first_pieces(evidence: DataFrame, most: int = 32) -> DataFrame:
    """(id, changes, pieces): the first ``most`` distinct pieces of each target of a stream of evidence (id, reason, event_id, timestamp).

    A target is told again, with a larger number of changes, whenever a piece that stands earlier in the
    order of its columns displaces one, however late it comes; the last telling is what a batch over
    all events gives. The state is ``most`` pieces a target and lives in the checkpoint, so a
    restarted stream goes on from it. Needs the RocksDB state store.
    """
    shown = evidence.select("id", *[F.col(c).cast("string").alias(c) for c in ("reason", "event_id", "timestamp")])
    out = f"id string, changes long, pieces {PIECES}"
    return shown.withColumn("id", F.col("id").cast("string")).groupBy("id").transformWithState(_FirstPieces(most), out, "Update", "None")


def settled_pieces(told: DataFrame) -> DataFrame:
    """(id, reason, event_id, timestamp) of what ``first_pieces`` told last of each target."""
    last = told.groupBy("id").agg(F.max_by("pieces", "changes").alias("pieces"))
    return last.select("id", F.inline("pieces"))
