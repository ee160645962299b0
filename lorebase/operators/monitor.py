"""Counters, observations, spans and invocations as aggregates over their event rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def counters(events: DataFrame, keys: Sequence[str] = ("name",), value: str = "value") -> DataFrame:
    """Sums of increments by name."""
    return events.groupBy(*keys).agg(F.sum(value).alias("total"))


def observations(events: DataFrame, keys: Sequence[str] = ("name",), value: str = "value") -> DataFrame:
    """Number, sum, mean, least and greatest of the observed values by name; they aren't gathered into lists."""
    return events.groupBy(*keys).agg(F.count(value).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"))


def spans(events: DataFrame, keys: Sequence[str] = ("name",)) -> DataFrame:
    """Durations in ms by name, and how many ended in an exception. events: duration_ms, failed."""
    return events.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("duration_ms").alias("mean_ms"), F.max("duration_ms").alias("most_ms"), F.count_if("failed").alias("failed"))


def invocations(starts: DataFrame, ends: DataFrame) -> DataFrame:
    """Ended invocations with what their start said; an end without a start is of kind generic, unknown, and took no time.

    starts: invocation_id, kind, name, ts; ends: invocation_id, status, ts. An id that is ended twice ends at the first.
    """
    first = ends.groupBy("invocation_id").agg(F.min_by(F.struct("status", "ts"), "ts").alias("e")).select("invocation_id", F.col("e.status").alias("status"), F.col("e.ts").alias("ended"))
    begun = starts.groupBy("invocation_id").agg(F.max_by(F.struct("kind", "name", "ts"), "ts").alias("s")).select("invocation_id", "s.kind", "s.name", F.col("s.ts").alias("started"))
    j = first.join(begun, "invocation_id", "left")
    started = F.coalesce("started", "ended")
    latency = F.round((F.unix_micros(F.col("ended").cast("timestamp")) - F.unix_micros(started.cast("timestamp"))) / 1000, 2)
    return j.select("invocation_id", F.coalesce("kind", F.lit("generic")).alias("kind"), F.coalesce("name", F.lit("unknown")).alias("name"), F.coalesce(F.nullif("status", F.lit("")), F.lit("completed")).alias("status"), started.alias("started_at"), F.col("ended").alias("ended_at"), latency.alias("latency_ms"))


def paired(starts: DataFrame, ends: DataFrame, late: str = "1 hour") -> DataFrame:
    """`invocations` of two streams: joined by id within the watermark, the state of one that never ends goes."""
    s = starts.withWatermark("ts", late).select(F.col("invocation_id").alias("s_id"), "kind", "name", F.col("ts").alias("started"))
    e = ends.withWatermark("ts", late).select("invocation_id", "status", F.col("ts").alias("ended"))
    on = F.expr(f"invocation_id = s_id and ended >= started and ended <= started + interval {late}")
    return e.join(s, on).select("invocation_id", "kind", "name", "status", "started", "ended", F.round((F.unix_micros(F.col("ended").cast("timestamp")) - F.unix_micros(F.col("started").cast("timestamp"))) / 1000, 2).alias("latency_ms"))


def paired_all(starts: DataFrame, ends: DataFrame, late: str = "1 hour", within: str = "1 hour") -> DataFrame:
    """`invocations` of two streams with the ends that nothing began and the starts that nothing ended.

    An id that starts or ends again within the watermark counts once, by its first row. A start waits for its end as long
    as one can still come: one without is told as unfinished when the watermark has passed it by `within`, and an end
    without a start (kind generic, name unknown, no time) likewise.
    """
    s = starts.select("invocation_id", "kind", "name", "ts").withWatermark("ts", late).dropDuplicatesWithinWatermark(["invocation_id"]).select(F.col("invocation_id").alias("s_id"), "kind", "name", F.col("ts").alias("started"))
    e = ends.select("invocation_id", "status", "ts").withWatermark("ts", late).dropDuplicatesWithinWatermark(["invocation_id"]).select(F.col("invocation_id").alias("e_id"), "status", F.col("ts").alias("ended"))
    j = s.join(e, F.expr(f"s_id = e_id and ended >= started and ended <= started + interval {within}"), "full_outer")
    status = F.when(F.col("ended").isNull(), "unfinished").otherwise(F.coalesce(F.nullif("status", F.lit("")), F.lit("completed")))
    begun = F.coalesce("started", "ended")
    latency = F.round((F.unix_micros(F.col("ended").cast("timestamp")) - F.unix_micros(begun.cast("timestamp"))) / 1000, 2)
    return j.select(F.coalesce("s_id", "e_id").alias("invocation_id"), F.coalesce("kind", F.lit("generic")).alias("kind"), F.coalesce("name", F.lit("unknown")).alias("name"), status.alias("status"), begun.alias("started_at"), F.col("ended").alias("ended_at"), latency.alias("latency_ms"))


def delivered(rows: DataFrame, after: tuple | None = None, limit: int = 500, order: Sequence[str] = ("started_at", "invocation_id")) -> DataFrame:
    """The next `limit` rows after a cursor (the order columns of the last row delivered), in order: a reader goes on where it stopped."""
    place = F.struct(*order)
    some = rows if after is None else rows.filter(place > F.struct(*(F.lit(x).cast(dict(rows.dtypes)[c]).alias(c) for x, c in zip(after, order))))
    return some.orderBy(*order).limit(limit)


def published(events: DataFrame, at: Column) -> DataFrame:
    """Events (type, payload map) as they are sent out: stamped with the time unless they have one."""
    stamp = F.coalesce(F.nullif(F.try_element_at("payload", F.lit("timestamp")), F.lit("")), at)
    return events.withColumn("timestamp", stamp)


def sanitised(payload: Column, items: int, width: int) -> Column:
    """A map<string,array<string>> cut to so many entries (by key), entries of so many values, values of so many characters."""
    entries = F.slice(F.array_sort(F.map_entries(payload)), 1, items)
    return F.map_from_entries(F.transform(entries, lambda e: F.struct(e["key"], F.transform(F.slice(e["value"], 1, items), lambda v: T.truncate(v, width)).alias("value"))))


def json_safe(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(json): the columns of each row as one JSON object, in their order; nulls stay in it."""
    return rows.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("json"))


def export(parts: dict[str, DataFrame], path: str) -> None:
    """Counters, observations and spans as JSON lines, a folder for each part."""
    for name, rows in parts.items():
        rows.write.mode("overwrite").json(f"{path}/{name}")
