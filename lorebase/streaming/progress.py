"""Progress streams: windows over events with watermarks, latest state by key, and the task state machine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRACE = "trace_id string, event string, task_id string, status string, ts timestamp, value double, payload map<string,string>"
# Statuses in which a task can still change, and those that end it.
ACTIVE, TERMINAL = ("running", "recovering", "cancel_requested"), ("completed", "failed", "cancelled")


def read_traces(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    """JSON lines as they arrive, at most so many files a batch."""
    return spark.readStream.schema(TRACE).option("maxFilesPerTrigger", files).json(path)


def tumbling(events: DataFrame, width: str = "1 hour", late: str | None = None, by: str = "event_type", time: str = "ts") -> DataFrame:
    e = events.withWatermark(time, late) if late else events
    return e.groupBy(F.window(time, width).alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None, by: str = "user_id", time: str = "ts") -> DataFrame:
    e = events.withWatermark(time, late) if late else events
    return e.groupBy(F.session_window(time, gap).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def deduplicated(events: DataFrame, keys: list[str], late: str | None = None, time: str = "ts") -> DataFrame:
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys) if late else events.dropDuplicates(keys)


def latest_state(events: DataFrame, key: str, order: list[str], fields: list[str]) -> DataFrame:
    """The fields of each key's last event; in update mode the state is one row a key."""
    return events.groupBy(key).agg(F.max_by(F.struct(*fields), F.struct(*order)).alias("s")).select(key, "s.*")


def transition(tasks: DataFrame, requests: DataFrame) -> DataFrame:
    """Tasks after requests (task_id, action, at): cancel, resume; the last request of a task counts, terminal ones stay."""
    last = requests.groupBy("task_id").agg(F.max_by(F.struct("action", "at"), "at").alias("r"))
    j = tasks.join(last, "task_id", "left")
    action, status = F.col("r.action"), F.col("status")
    ended = status.isin(*TERMINAL)
    new = (
        F.when((action == "cancel") & ended, status).when((action == "cancel") & status.isin(*ACTIVE), "cancel_requested").when(action == "cancel", "cancelled")
        .when(action == "resume", "recovering").otherwise(status)
    )
    return j.withColumns({"retry_count": F.col("retry_count") + F.when(action == "resume", 1).otherwise(0), "cancel_requested": (action == "cancel") & ~ended & status.isin(*ACTIVE) | F.coalesce("cancel_requested", F.lit(False)) & ((action != "resume") | action.isNull()), "updated_at": F.when(action.isNotNull() & (new != status), F.col("r.at")).otherwise(F.col("updated_at")), "status": new}).drop("r")


def write_states(events: DataFrame, store, checkpoint: str, table: str = "ingest_tasks", order: str = "updated_at"):
    """Each micro-batch is merged into the store by its key; run with what has arrived.

    A key's row is that with the greatest `order`, over all batches: a batch that is run again, or rows that come late,
    don't undo what is newer.
    """

    def merge(batch: DataFrame, number: int) -> None:
        store.merge_newest(table, batch, order)

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drained(stream: DataFrame, folder: str) -> DataFrame:
    """What the stream has given once all that has arrived is read: rows are appended as Parquet and read back.

    With a watermark a window comes out once it is closed. A run that ended early goes on from its checkpoint in the
    folder, each batch being written once.
    """
    done = stream.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    done.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")
