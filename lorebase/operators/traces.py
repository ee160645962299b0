"""Agent events, checkpoints and interface listings as step rows; all declarative."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

_BLANK = lambda c: F.coalesce(F.nullif(c, F.lit("")))

# Titles of whole events and of events by their beginning.
TITLES = {"meta": "会话开始", "done": "回答完成", "trace.ready": "Trace 已就绪", "usage.llm": "LLM Token 使用", "agent.tool_calls": "模型选择工具"}
TITLES_BY_START = {"assistant.": "助手输出", "agent.think": "模型思考", "skill.load": "加载技能", "skill.file": "读取技能文件", "skill.script": "执行技能脚本"}


def first(*columns: Column) -> Column:
    return F.coalesce(*map(_BLANK, columns), F.lit(""))


def title_of_event(event: Column, tool: Column, step: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for name, title in TITLES.items():
        out = out.when(event == name, title)
    for start, title in TITLES_BY_START.items():
        out = out.when(event.startswith(start), title)
    return (
        out.when(event.startswith("tool."), F.coalesce(_BLANK(tool), F.lit("工具调用"))).when(event.startswith("retrieval.plan"), "检索计划")
        .when(event.startswith("retrieval.step"), T.strip(F.concat(F.lit("检索步骤 "), F.coalesce(step, F.lit(""))))).otherwise(event)
    )


def _ended(status: Column, at: Column) -> Column:
    return F.when(status.isin("completed", "failed"), at).otherwise("")


def agent_steps(events: DataFrame, trace_id: str = "") -> DataFrame:
    """events: type, task_id, tool_name, step, status, timestamp, started_at, updated_at, ended_at, latency_ms (all may be null)."""
    event = first(F.col("type"), F.lit("message"))
    status = T.status_of_event(event, F.col("status"))
    stamp = first(F.col("timestamp"), F.col("updated_at"))
    started = first(F.col("started_at"), stamp)
    updated = first(F.col("updated_at"), stamp, started)
    return events.select(
        first(F.col("task_id"), F.uuid()).alias("step_id"), F.lit(trace_id).alias("trace_id"), F.lit("agent").alias("source"), T.kind_of_event(event, F.col("tool_name").isNotNull()).alias("kind"),
        event.alias("event"), first(F.col("tool_name"), event).alias("step_name"), title_of_event(event, F.col("tool_name"), F.col("step")).alias("title"), status.alias("status"),
        started.alias("started_at"), first(F.col("ended_at"), _ended(status, updated)).alias("ended_at"), updated.alias("updated_at"), F.col("latency_ms").cast("double").alias("latency_ms"),
    )


def pipeline_steps(checkpoints: DataFrame, trace_id: str = "") -> DataFrame:
    """checkpoints: stage, status, updated_at, payload map, error."""
    status = T.status(F.col("status"))
    get = lambda k: F.try_element_at("payload", F.lit(k))
    updated = first(F.col("updated_at"), get("updated_at"))
    number = lambda k: F.coalesce(get(k).try_cast("long"), F.lit(0))
    return checkpoints.select(
        F.concat(F.lit("pipeline:"), "stage").alias("step_id"), F.lit(trace_id).alias("trace_id"), F.lit("pipeline_checkpoint").alias("kind"), F.col("stage").alias("title"), status.alias("status"),
        first(get("started_at"), updated).alias("started_at"), _ended(status, updated).alias("ended_at"), updated.alias("updated_at"), get("latency_ms").try_cast("double").alias("latency_ms"),
        number("input_tokens").alias("input_tokens"), number("output_tokens").alias("output_tokens"), number("total_tokens").alias("total_tokens"), F.col("error"),
    )


def chunk_steps(chunks: DataFrame, trace_id: str = "") -> DataFrame:
    """chunks: chunk_id, chunk_index, status, updated_at, error."""
    status, updated = T.status(F.col("status")), F.coalesce("updated_at", F.lit(""))
    return chunks.select(
        F.concat(F.lit("chunk:"), "chunk_id").alias("step_id"), F.lit(trace_id).alias("trace_id"), F.lit("chunk_checkpoint").alias("kind"), F.concat(F.lit("Chunk "), "chunk_index").alias("title"),
        status.alias("status"), updated.alias("started_at"), _ended(status, updated).alias("ended_at"), updated.alias("updated_at"), F.col("error"),
    )


def sorted_steps(steps: DataFrame, last: int | None = None) -> DataFrame:
    """By time (updated, else started) and id; with `last`, the last so many in that order."""
    at = first(F.col("updated_at"), F.col("started_at"))
    some = steps if last is None else steps.orderBy(at.desc(), F.desc("step_id")).limit(last)
    return some.orderBy(at, "step_id")


def chunk_progress(chunks: DataFrame, checkpoints: DataFrame, tasks: DataFrame) -> DataFrame:
    """Chunks with their checkpoint (pending if none) and their latest retry task (kind chunk_retry)."""
    newest = tasks.filter("kind = 'chunk_retry'").groupBy("group_id", "doc_id", "chunk_id").agg(F.max_by(F.struct("task_id", "task_status"), F.struct("updated_at", "created_at")).alias("t"))
    keys = ["group_id", "doc_id", "chunk_id"]
    out = chunks.join(checkpoints.select(*keys, "status", "error", "updated_at"), keys, "left").join(newest, keys, "left")
    return out.withColumn("status", F.coalesce("status", F.lit("pending"))).withColumn("task_id", F.col("t.task_id")).withColumn("task_status", F.col("t.task_status")).drop("t").orderBy("chunk_index")


def has_issue(status: Column, error: Column, parse_errors: Column, step_status: Column, step_error: Column) -> Column:
    some = lambda c: F.coalesce(c, F.lit("")) != ""
    return (T.status(status) == "failed") | some(error) | (F.coalesce(F.size(parse_errors), F.lit(0)) > 0) | (T.status(step_status) == "failed") | some(step_error)


def search_text(*fields: Column) -> Column:
    """Fields that aren't blank, one a line, in lower case."""
    return F.lower(F.concat_ws("\n", *(F.nullif(f, F.lit("")) for f in fields)))


def flow_nodes(nodes: DataFrame, order: str = "pos") -> DataFrame:
    """Node ids for drawing: the given id, else doc:name, else the place; later ones of an id get #2, #3 and so on."""
    name = T.strip(F.coalesce("name", F.lit("")))
    base = first(T.strip(F.coalesce("id", F.lit(""))), F.when(name != "", F.concat(first(F.col("doc_id"), F.lit("_")), F.lit(":"), name)), F.col(order).cast("string"))
    n = F.row_number().over(Window.partitionBy("_base").orderBy(order))
    return nodes.withColumn("_base", base).withColumn("flow_id", F.when(n > 1, F.concat("_base", F.lit("#"), n)).otherwise(F.col("_base"))).drop("_base")


def flow_edges(edges: DataFrame, nodes: DataFrame, order: str = "pos") -> DataFrame:
    """Edges between drawn nodes: the first node of a name, else the name itself; edges without both ends are dropped."""
    ids = nodes.filter("coalesce(name, '') <> ''").groupBy(T.strip(F.col("name")).alias("_n")).agg(F.min_by("flow_id", order).alias("_id"))
    out = edges
    for end, column in (("from", "head_name"), ("to", "tail_name")):
        out = out.withColumn("_n", T.strip(F.coalesce(column, F.lit("")))).join(ids, "_n", "left").withColumn(end, F.coalesce("_id", "_n")).drop("_n", "_id")
    return out.filter("`from` <> '' and `to` <> ''")


def group_summaries(documents: DataFrame, stage: str = "stage", recent: int = 3) -> DataFrame:
    """Per group: documents, completed and failed graphs, all others as base, and the newest few ids."""
    few = F.slice(F.transform(F.sort_array(F.collect_list(F.struct("doc_time", "doc_id")), asc=False), lambda x: x["doc_id"]), 1, recent)
    counted = documents.groupBy("group_id").agg(F.count("*").alias("total"), F.count_if(F.col(stage) == "graph_completed").alias("graph"), F.count_if(F.col(stage) == "graph_failed").alias("failed"))
    newest = documents.withColumn("_n", F.row_number().over(Window.partitionBy("group_id").orderBy(F.desc("doc_time"), F.desc("doc_id")))).filter(F.col("_n") <= recent)
    return counted.withColumn("base", F.col("total") - F.col("graph") - F.col("failed")).join(newest.groupBy("group_id").agg(few.alias("recent")), "group_id", "left")


def cap_sessions(sessions: DataFrame, scope: list[str], limit: int) -> DataFrame:
    """The newest sessions of each scope."""
    return sessions.withColumn("_n", F.row_number().over(Window.partitionBy(*scope).orderBy(F.desc("updated_at"), "session_id"))).filter(F.col("_n") <= limit).drop("_n")


def usage_fields(own: Column, other: Column) -> Column:
    """Token counts of the first of two maps that has any entry, whichever names it uses; zeros and `estimated` if neither."""
    get = lambda m, *k: F.coalesce(*(F.try_element_at(m, F.lit(x)).try_cast("long") for x in k), F.lit(0))
    made = lambda m, s: F.struct(get(m, "input_tokens", "prompt_tokens").alias("input_tokens"), get(m, "output_tokens", "completion_tokens").alias("output_tokens"), get(m, "total_tokens").alias("total_tokens"), F.lit(s).alias("source"))
    none = F.struct(*(F.lit(0).cast("long").alias(c) for c in ("input_tokens", "output_tokens", "total_tokens")), F.lit("estimated").alias("source"))
    return F.when(F.size(own) > 0, made(own, "usage_metadata")).when(F.size(other) > 0, made(other, "response_metadata")).otherwise(none)


def rag_context(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds group_id and doc_id of the first `[RAG_CONTEXT] name = value` line that gives each, and the rest of the text."""
    lines = T.lines(F.col(text))
    pattern = r"(?iU)^\s*\[RAG_CONTEXT\]\s*(group_id|doc_id)\s*=\s*(.+?)\s*$"
    of = lambda k: F.coalesce(F.get(F.filter(F.transform(F.filter(lines, lambda x: F.lower(F.regexp_extract(x, pattern, 1)) == k), lambda x: T.strip(F.regexp_extract(x, pattern, 2))), lambda x: x != ""), F.lit(0)), F.lit(""))
    rest = T.strip(F.array_join(F.filter(lines, lambda x: F.regexp_extract(x, pattern, 1) == ""), "\n"))
    return df.withColumns({"group_id": of("group_id"), "doc_id": of("doc_id"), "rest": rest})
