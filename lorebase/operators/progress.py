"""Roll-ups and ordered de-duplication: progress, traces, plans, messages, evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T


def keep_first(rows: DataFrame, keys: list[str | Column], order: list[str | Column]) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def document_progress(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by status; pending is what is left of the total."""
    n = lambda s: F.count_if(F.col("status") == s)
    out = chunks.groupBy(*keys).agg(F.count("*").alias("total"), n("completed").alias("completed"), n("failed").alias("failed"), n("processing").alias("processing"))
    rest = F.greatest(F.col("total") - F.col("completed") - F.col("failed") - F.col("processing"), F.lit(0))
    return out.withColumn("pending", rest).withColumn("all_completed", F.expr("total > 0 and completed = total and failed = 0 and processing = 0"))


def latest_stage(stages: DataFrame, keys: list[str]) -> DataFrame:
    """The stage updated last; ties go to the greatest stage."""
    return stages.groupBy(*keys).agg(F.max_by(F.struct("stage", "status", "updated_at"), F.struct("updated_at", "stage")).alias("s")).select(*keys, "s.*")


def trace_summary(steps: DataFrame, keys: list[str], status: str = "status") -> DataFrame:
    s = T.status(F.col(status))
    return steps.groupBy(*keys).agg(F.count("*").alias("total"), *(F.count_if(s == x).alias(x) for x in ("completed", "failed", "running", "pending")))


def with_context(chunks: DataFrame, scope: list[str], width: int = 200) -> DataFrame:
    """The end of the chunk before and the beginning of the one after."""
    w = Window.partitionBy(*scope).orderBy("chunk_index")
    return chunks.withColumn("before", F.right(F.coalesce(F.lag("text").over(w), F.lit("")), F.lit(width))).withColumn("after", F.left(F.coalesce(F.lead("text").over(w), F.lit("")), F.lit(width)))


def compact_messages(messages: DataFrame, scope: list[str], order: str) -> DataFrame:
    """The first message of each (role, content) that isn't blank; tool messages are exempt."""
    m = messages.withColumn("content", T.strip(T.drop_thinking(F.coalesce("content", F.lit("")))))
    first = F.row_number().over(Window.partitionBy(*scope, "role", "content").orderBy(order))
    return m.withColumn("_n", first).filter("role = 'tool' or (content <> '' and _n = 1)").drop("_n")


def dedupe_lines(c: Column) -> Column:
    """Lines without their later repeats (trimmed), runs of blank lines as one."""
    kept = F.aggregate(
        F.split(c, "\n"), F.array().cast("array<string>"),
        lambda acc, x: F.when(T.strip(x) == "", F.when((F.size(acc) > 0) & (F.coalesce(F.element_at(F.concat(F.array(F.lit("x")), acc), -1), F.lit("")) != ""), F.array_append(acc, F.lit(""))).otherwise(acc))
        .when(F.exists(acc, lambda y: T.strip(y) == T.strip(x)), acc).otherwise(F.array_append(acc, x)),
    )
    return T.strip(F.array_join(kept, "\n"))


def plan_items(items: DataFrame, return_limit: int = 12) -> DataFrame:
    """Items of all steps in order, the first of each (mode, doc, chunk, text, entity, relation), cut to the limit."""
    key = [F.coalesce(c, F.lit("")) for c in ("mode", "doc_id", "chunk_id", "text", "entity_name", "relation")]
    return keep_first(items, key, ["step", "pos"]).orderBy("step", "pos").limit(max(1, return_limit))


def pick_names(entity_hits: DataFrame, relation_hits: DataFrame, limit: int = 8) -> DataFrame:
    """Distinct names: entities first, then heads and tails of relations, in their order."""
    heads = relation_hits.select(F.lit(1).alias("part"), "pos", F.posexplode(F.array("head_name", "tail_name")).alias("side", "name"))
    every = entity_hits.select(F.lit(0).alias("part"), "pos", F.lit(0).alias("side"), "name").unionByName(heads).filter("coalesce(trim(name), '') <> ''")
    return every.groupBy("name").agg(F.min(F.struct("part", "pos", "side")).alias("o")).orderBy("o", "name").limit(limit).select("name", F.col("o.part").alias("part"), F.col("o.pos").alias("pos"))


def hit_at_k(hits: DataFrame, keys: list[str], test: Column, k: int) -> DataFrame:
    """Whether any of the first k hits passes, and whether the first does."""
    one = F.when(F.coalesce(test, F.lit(False)) & (F.col("rank") <= k), 1).otherwise(0)
    return hits.groupBy(*keys).agg(F.max(one).alias("hit_any"), F.max(F.when(F.col("rank") == 1, one).otherwise(0)).alias("hit_top1"))


def usage(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sum("tokens").alias("tokens"), F.round(F.sum("latency_ms"), 4).alias("latency_ms"), F.bool_or("is_estimated").alias("is_estimated"))
