"""Tasks and checkpoints: what is left to do, what can be restored, and what is started again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..functions import text as T
from .progress import document_progress, latest_stage, with_context
from .store import RECOVERABLE

# Stages of a graph build, statuses that count as failed in listings, and the kind of a chunk's retry.
STAGES = ("fusion", "doc_graph_assets", "entity_alignment", "relation_alignment", "mentions", "graph_index", "save_graph_assets")
UI_ACTIVE, UI_FAILED = ("pending", "running", "recovering", "cancel_requested"), ("failed", "cancelled")
RETRY = "chunk_retry"
_DOC = ["group_id", "doc_id"]


def now() -> Column:
    """The time of the query as ISO-8601 text in UTC."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def recoverable(tasks: DataFrame, limit: int = 200) -> DataFrame:
    """Tasks that a start has to take up again, oldest first; one that is asked to cancel isn't among them."""
    return tasks.filter(F.col("status").isin(*RECOVERABLE)).orderBy("updated_at", "created_at", "task_id").limit(limit)


def started_again(tasks: DataFrame, active: DataFrame, at: Column, limit: int = 1000) -> DataFrame:
    """Recoverable tasks that don't run already (task_id in `active`), now recovering and tried once more."""
    idle = recoverable(tasks, limit).join(active.select("task_id"), "task_id", "left_anti")
    return idle.withColumns({"status": F.lit("recovering"), "retry_count": F.coalesce("retry_count", F.lit(0)) + 1, "updated_at": at})


def chunk_places(asked: DataFrame, chunks: DataFrame) -> DataFrame:
    """Adds chunk_index, -1 for an unknown chunk, and task_index, where the first chunk counts as unknown too.

    A chunk's own place is kept whole; task_index is what a retry task's record holds.
    """
    keys = [*_DOC, "chunk_id"]
    found = asked.join(chunks.select(*keys, "chunk_index"), keys, "left").withColumn("chunk_index", F.coalesce("chunk_index", F.lit(-1)))
    return found.withColumn("task_index", F.when(F.col("chunk_index") == 0, -1).otherwise(F.col("chunk_index")))


def restored(checkpoints: DataFrame, chunks: DataFrame) -> DataFrame:
    """Finished chunks with their text (empty if the chunk is gone) and place (0 if it is gone), by document and place."""
    keys = [*_DOC, "chunk_id"]
    done = checkpoints.filter("status = 'completed'").drop("chunk_index")
    out = done.join(chunks.select(*keys, "chunk_index", "text"), keys, "left")
    return out.withColumns({"text": F.coalesce("text", F.lit("")), "chunk_index": F.coalesce("chunk_index", F.lit(0))}).orderBy(*_DOC, "chunk_index", "chunk_id")


def remaining(chunks: DataFrame, checkpoints: DataFrame, width: int = 200) -> DataFrame:
    """Chunks without a finished checkpoint, with the end of the chunk before and the beginning of the one after."""
    done = checkpoints.filter("status = 'completed'").select(*_DOC, "chunk_id")
    return with_context(chunks, _DOC, width).join(done, [*_DOC, "chunk_id"], "left_anti")


def pipeline_map(checkpoints: DataFrame) -> DataFrame:
    """(group_id, doc_id, pipeline): stage -> status, payload, error and time of the last row of each stage."""
    fields = [c for c in ("status", "payload", "error", "updated_at") if c in checkpoints.columns]
    last = checkpoints.groupBy(*_DOC, "stage").agg(F.max_by(F.struct(*fields), "updated_at").alias("s"))
    return last.groupBy(*_DOC).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("stage", "s")))).alias("pipeline"))


def stage_rows(documents: DataFrame, stage: str, status: str, at: Column, payload: Column | None = None, error: Column | None = None) -> DataFrame:
    """Checkpoint rows of a stage for documents, to be merged by (group_id, doc_id, stage)."""
    if stage not in STAGES:
        raise ValueError(f"unknown stage {stage!r}")
    empty = F.expr("cast(map() as map<string,string>)")
    return documents.select(*_DOC, F.lit(stage).alias("stage"), F.lit(status).alias("status"), (empty if payload is None else payload).alias("payload"), (F.lit("") if error is None else error).alias("error"), at.alias("updated_at"))


def timeline_summary(chunk_states: DataFrame, stages: DataFrame) -> DataFrame:
    """Per document: steps by status over stages and chunks, the latest stage, and the chunks by status."""
    steps = stages.select(*_DOC, T.status(F.col("status")).alias("s")).unionByName(chunk_states.select(*_DOC, T.status(F.col("status")).alias("s")))
    counted = steps.groupBy(*_DOC).agg(F.count("*").alias("total_steps"), *(F.count_if(F.col("s") == x).alias(f"{x}_steps") for x in ("completed", "running", "failed", "pending")))
    chunks = document_progress(chunk_states, _DOC).withColumnsRenamed({c: f"{c}_chunks" for c in ("total", "completed", "failed", "processing", "pending")})
    last = latest_stage(stages, _DOC).select(*_DOC, T.status(F.col("status")).alias("status"), F.col("stage").alias("current_step_name"))
    zero = {f"{c}_chunks": F.coalesce(f"{c}_chunks", F.lit(0)) for c in ("total", "completed", "failed", "processing", "pending")}
    return counted.join(chunks.drop("all_completed"), _DOC, "left").join(last, _DOC, "left").withColumns({"status": F.coalesce("status", F.lit("pending")), "current_step_name": F.coalesce("current_step_name", F.lit("")), **zero})


def chunk_retries(asked: DataFrame, chunks: DataFrame, at: Column) -> DataFrame:
    """Task rows that process single chunks (group_id, doc_id, doc_name, doc_time, chunk_id) again; unknown chunks get none.

    The id is made of the chunk and the time, so that a request that is repeated gives the same task.
    """
    known = chunk_places(asked, chunks).filter("chunk_index >= 0")
    metadata = F.create_map(F.lit("kind"), F.lit(RETRY), F.lit("chunk_id"), F.col("chunk_id"), F.lit("chunk_index"), F.col("task_index").cast("string"))
    key = F.concat_ws(":", F.lit(RETRY), "group_id", "doc_id", "chunk_id", at)
    return known.select(
        ids.uuid5(key).alias("task_id"), *_DOC, "doc_name", "doc_time", F.lit("pending").alias("status"), F.lit("queued").alias("stage"), F.lit("").alias("message"), at.alias("created_at"), at.alias("updated_at"),
        F.lit("").alias("trace_id"), F.lit(0).alias("retry_count"), F.lit(False).alias("cancel_requested"), metadata.alias("metadata"),
    )


def rebuilds(checkpoints: DataFrame, chunks: DataFrame, tasks: DataFrame) -> DataFrame:
    """Documents (group_id, doc_id) whose chunks are all finished, after retries of some, and for which no other task runs."""
    state = chunks.select(*_DOC, "chunk_id").join(checkpoints.select(*_DOC, "chunk_id", "status"), [*_DOC, "chunk_id"], "left")
    whole = document_progress(state, _DOC).filter("all_completed").select(*_DOC)
    retried = tasks.filter(F.try_element_at("metadata", F.lit("kind")) == RETRY)
    running = tasks.filter(F.col("status").isin(*UI_ACTIVE) & (F.coalesce(F.try_element_at("metadata", F.lit("kind")), F.lit("")) != RETRY))
    return whole.join(retried.select(*_DOC), _DOC, "left_semi").join(running.select(*_DOC), _DOC, "left_anti")


def task_counts(tasks: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Running tasks (active in any way) and failed ones (cancelled too)."""
    return tasks.groupBy(*keys).agg(F.count_if(F.col("status").isin(*UI_ACTIVE)).alias("running"), F.count_if(F.col("status").isin(*UI_FAILED)).alias("failed"))


def with_metadata(rows: DataFrame, more: Column, column: str = "metadata") -> DataFrame:
    """The map column overlaid by another map, whose values win."""
    old = F.coalesce(column, F.expr("cast(map() as map<string,string>)"))
    return rows.withColumn(column, F.map_concat(F.map_filter(old, lambda k, v: ~F.coalesce(F.map_contains_key(more, k), F.lit(False))), F.coalesce(more, F.expr("cast(map() as map<string,string>)"))))


def progress_rows(events: DataFrame) -> DataFrame:
    """The last event of each task as the fields of its row: status, stage, message, updated_at, and a row's fixed fields."""
    fixed = [c for c in ("group_id", "doc_id", "doc_name", "doc_time", "created_at") if c in events.columns]
    return events.groupBy("task_id", *fixed).agg(F.max_by(F.struct("status", "stage", "message", "updated_at"), F.struct("updated_at", "seq")).alias("s"), F.max("seq").alias("seq")).select("task_id", *fixed, "s.*", "seq")


def to_json(parsed: Column) -> Column:
    """A parsed extraction as JSON text."""
    return F.to_json(parsed)


def from_json(text: Column) -> Column:
    """JSON text as a parsed extraction: entities without name, and relations without subject or object, are left out; bad text is an empty one."""
    from ..schemas import _PARSED

    got = F.from_json(F.coalesce(text, F.lit("")), _PARSED)
    none = F.from_json(F.lit('{"entities":[],"relations":[],"errors":[]}'), _PARSED)
    blank = lambda c: T.strip(F.coalesce(c, F.lit(""))) == ""
    return F.struct(
        F.coalesce(F.filter(got["entities"], lambda x: ~blank(x["name"])), none["entities"]).alias("entities"),
        F.coalesce(F.filter(got["relations"], lambda x: ~blank(x["subject"]) & ~blank(x["object"])), none["relations"]).alias("relations"),
        F.coalesce(got["errors"], none["errors"]).alias("errors"),
    )


def updated_entity(stored: DataFrame, changes: DataFrame) -> DataFrame:
    """Entities after partial changes (entity_id, group_id, doc_id, canonical_name, type, aliases, description; null or empty: as it was).

    An id that isn't there makes a new entity, if the change has its name and document. Aliases and a description
    that are given count even if empty.
    """
    keys = ["group_id", "entity_id"]
    j = stored.withColumn("_old", F.lit(True)).alias("s").join(changes.withColumn("_new", F.lit(True)).alias("c"), keys, "full")
    given = lambda c: F.nullif(F.col(f"c.{c}"), F.lit(""))
    kept = F.col("_old") | (given("canonical_name").isNotNull() & given("doc_id").isNotNull())
    pick = {c: F.coalesce(given(c), F.col(f"s.{c}"), F.lit("")) for c in ("doc_id", "canonical_name", "type")}
    pick |= {"aliases": F.coalesce("c.aliases", "s.aliases", F.array().cast("array<string>")), "description": F.coalesce("c.description", "s.description", F.lit(""))}
    return j.filter(kept).select(*(F.col(c) if c in keys else pick[c].alias(c) for c in stored.columns))
