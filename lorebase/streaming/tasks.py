"""Task states as a stateful stream: requests and steps by key, with a timer for tasks that went silent."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .progress import ACTIVE, TERMINAL

#: The store that timers and typed states need.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STATE = "status string, retry_count int, cancel_requested boolean, at long, seq long, version long, timer long"
#: What the stream tells of a task whenever it changed; the row of the greatest version is its state.
CHANGES = "task_id string, status string, retry_count int, cancel_requested boolean, stale boolean, updated_at timestamp, version long"


def applied(status: str, retries: int, asked: bool, action: str) -> tuple[str, int, bool]:
    """(status, retry count, whether a cancel is asked for) after one request or step.

    A task that ended stays so until it is resumed; a cancel of a waiting task ends it, of an active one it is asked for,
    and takes effect when the task ends. Other actions change nothing.
    """
    ended = status in TERMINAL
    if action == "resume":
        return "recovering", retries + 1, False
    if ended:
        return status, retries, asked
    if action == "cancel":
        return ("cancel_requested", retries, True) if status in ACTIVE else ("cancelled", retries, False)
    if action == "start":
        return (status if asked else "running"), retries, asked
    if action in ("complete", "fail"):
        return ("cancelled" if asked else "completed" if action == "complete" else "failed"), retries, False
    return status, retries, asked


def silent(retries: int, asked: bool) -> tuple[str, int, bool]:
    """What becomes of an active task that went silent."""
    return ("cancelled" if asked else "failed"), retries, False


class Tasks(StatefulProcessor):
    """One task a key. Rows count in the order of time and sequence; one that isn't after the last one changes nothing,
    so repeated rows, and late ones that the watermark still lets in, do no harm."""

    def __init__(self, silent_ms: int):
        self.silent_ms = silent_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("task", _STATE)

    def _told(self, key, state: tuple, stale: bool) -> Row:
        status, retries, asked, at, _, version, _ = state
        when = datetime.fromtimestamp(at / 1_000_000, timezone.utc).replace(tzinfo=None)
        return Row(task_id=key[0], status=status, retry_count=retries, cancel_requested=asked, stale=stale, updated_at=when, version=version)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        status, retries, asked, at, seq, version, timer = tuple(self.state.get()) if self.state.exists() else ("pending", 0, False, -(1 << 62), 0, 0, 0)
        before = version
        # the rows of one key in one batch
        for r in sorted(rows, key=lambda r: (r["at_us"], r["seq"])):
            if (r["at_us"], r["seq"]) > (at, seq):
                if status in ACTIVE and r["at_us"] // 1000 >= at // 1000 + self.silent_ms:
                    status, retries, asked = silent(retries, asked)  # as the timer would have, had this row come in a later batch
                    version += 1
                status, retries, asked = applied(status, retries, asked, r["action"])
                at, seq, version = r["at_us"], r["seq"], version + 1
        if version == before:
            return
        if timer:
            self.handle.deleteTimer(timer)
        timer = at // 1000 + self.silent_ms if status in ACTIVE else 0
        if timer:
            self.handle.registerTimer(timer)
        state = (status, retries, asked, at, seq, version, timer)
        self.state.update(state)
        yield self._told(key, state, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        status, retries, asked, at, seq, version, timer = tuple(self.state.get()) if self.state.exists() else (None,) * 7
        if timer != expiredTimerInfo.getExpiryTimeInMs() or status not in ACTIVE:
            return
        state = (*silent(retries, asked), at, seq, version + 1, 0)
        self.state.update(state)
        yield self._told(key, state, True)

    def close(self) -> None:
        pass


def task_changes(events: DataFrame, late: str = "10 minutes", silent_minutes: int = 60) -> DataFrame:
    """CHANGES of a stream of (task_id, action, at, seq): a row for each task that a batch or its timer changed.

    An active task that is silent for `silent_minutes` of event time fails (or is cancelled, if that was asked for) once
    the watermark, `late` behind the newest row, has passed that.
    """
    rows = events.select("task_id", "action", "at", F.unix_micros("at").alias("at_us"), F.col("seq").cast("long").alias("seq")).filter("task_id is not null and at is not null").withWatermark("at", late)
    return rows.groupBy("task_id").transformWithState(Tasks(silent_minutes * 60_000), CHANGES, "Append", "EventTime")


@contextmanager
def typed_states(spark: SparkSession):
    """Streams started inside keep their state where timers can be; the session's own setting comes back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(name, was) if was else spark.conf.unset(name)


def states(changes: DataFrame) -> DataFrame:
    """The last change of each task: a map-side combined arg-max."""
    fields = [c for c in changes.columns if c != "task_id"]
    return changes.groupBy("task_id").agg(F.max_by(F.struct(*fields), "version").alias("s")).select("task_id", "s.*")
