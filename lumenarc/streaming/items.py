"""The work queue as a stream: the state of an item lives while the item may change, and timers bring it back.

Events are (id, seq, at, outcome, retryable): 'analyzed' stores an analysis, 'ready' ends the item, 'error' defers it, fails
it for some time, or fails it for good. An item that is ready or failed for good leaves the state; a later event of its id
begins anew. A deferred or failed item comes back when the watermark passes its due time, at ANALYZED if it has an analysis and
at DOWNLOADED otherwise; an event after that time finds it back in any case, so batches may be cut anywhere.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import astuple, dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lumenarc.operators.workqueue import Policy

STATE = "status string, attempts int, revives int, has_analysis boolean, due long, seq long"
OUT = "id long, seq long, at long, status string, attempts int, revives int, has_analysis boolean, due long"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass
class Item:
    """due is in milliseconds, -1 for none."""

    status: str = "DOWNLOADED"
    attempts: int = 0
    revives: int = 0
    has_analysis: bool = False
    due: int = -1
    seq: int = -1

    def resumed(self) -> str:
        return "ANALYZED" if self.has_analysis else "DOWNLOADED"

    def comes_back(self, now: int) -> bool:
        """Brings the item back if it is due."""
        if not 0 <= self.due <= now:
            return False
        if self.status == "FAILED":
            self.attempts, self.revives = 0, self.revives + 1
        self.status, self.due = self.resumed(), -1
        return True

    def takes(self, at: int, seq: int, outcome: str, retryable: bool, p: Policy) -> None:
        self.comes_back(at)
        self.seq = seq
        if outcome == "analyzed":
            self.status, self.has_analysis = "EMBEDDING", True
        elif outcome == "ready":
            self.status, self.attempts, self.due = "READY", 0, -1
        elif retryable and self.attempts + 1 < p.max_attempts:
            wait = max(1, round(min(max(0.0, p.retry_base) * 2**self.attempts, max(0.0, p.retry_cap))))
            self.status, self.attempts, self.due = self.resumed(), self.attempts + 1, at + 1000 * wait
        else:
            again = retryable and self.revives < p.max_revives
            self.status, self.due = "FAILED", at + 1000 * max(0, p.revive_after) if again else -1

    def over(self) -> bool:
        return self.status == "READY" or self.status == "FAILED" and self.due < 0


class _Items(StatefulProcessor):
    def __init__(self, policy: Policy):
        self.policy = policy

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.value = handle, handle.getValueState("item", STATE)

    def _put(self, item: Item, before: int, held: bool) -> None:
        if before >= 0 and before != item.due:
            self.handle.deleteTimer(before)
        if item.over():
            if held:
                self.value.clear()
            return
        if item.due >= 0 and item.due != before:
            self.handle.registerTimer(item.due)
        self.value.update(astuple(item))

    @staticmethod
    def _row(key: tuple, at: int, i: Item) -> Row:
        return Row(id=key[0], seq=i.seq, at=at, status=i.status, attempts=i.attempts, revives=i.revives, has_analysis=i.has_analysis, due=i.due)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:  # noqa: N802, N803
        held = self.value.get()  # each call to the state is a message to the JVM, so none is made in vain
        item = Item(*held) if held else Item()
        before, at = item.due, 0
        for at, seq, outcome, retryable in sorted((r["at"], r["seq"], r["outcome"], r["retryable"]) for r in rows):  # one item's events of one batch
            item = Item() if item.over() else item
            item.takes(at, seq, outcome, retryable, self.policy)
        self._put(item, before, bool(held))
        yield self._row(key, at, item)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:  # noqa: N802, N803
        now = expiredTimerInfo.getExpiryTimeInMs()
        held = self.value.get()
        item = Item(*held) if held else Item()
        if item.comes_back(now):
            self.value.update(astuple(item))
            yield self._row(key, now, item)

    def close(self) -> None:
        pass


def states(events: DataFrame, policy: Policy | None = None, late: str = "500 milliseconds") -> DataFrame:
    """A row for each item that a batch or a timer changed; due and at are in milliseconds, due -1 for none. Update mode."""
    flat = events.withWatermark("at", late).select("id", "seq", "at", "outcome", F.coalesce("retryable", F.lit(False)).alias("retryable"))
    timed = flat.select("id", "seq", F.unix_millis("at").alias("at"), F.col("at").alias("event_time"), "outcome", "retryable")
    return timed.groupBy("id").transformWithState(statefulProcessor=_Items(policy or Policy()), outputStructType=OUT, outputMode="Update", timeMode="EventTime")


def run_available(changes: DataFrame, folder: str, tag: str = "items") -> None:
    """Works off what is there of a stream. Every batch writes a folder of its own, so a batch that is run again after a
    crash replaces what it wrote; offsets, state and timers are in the folder's checkpoint."""
    spark = changes.sparkSession
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        query = changes.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(lambda df, k: df.write.mode("overwrite").parquet(f"{folder}/{tag}/batch={k}")).start()
    finally:
        spark.conf.set(PROVIDER, before)
    query.awaitTermination()


def latest(spark: SparkSession, folder: str, tag: str = "items") -> DataFrame:
    """The newest state of each item that run_available() wrote."""
    rows = spark.read.parquet(f"{folder}/{tag}")
    rest = ["status", "attempts", "revives", "has_analysis", "due"]
    newest = rows.groupBy("id").agg(F.max_by(F.struct(*rest), F.struct("at", "seq")).alias("r"))
    return newest.select("id", "r.status", "r.attempts", "r.revives", "r.has_analysis", F.when(F.col("r.due") >= 0, F.timestamp_millis("r.due")).alias("due"))


def fresh_folder(parent: str) -> str:
    return f"{parent}/stream-{uuid.uuid4().hex}"
