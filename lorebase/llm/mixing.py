"""Mixing sources to target weights: hash-random order within a source, prefix sums of words, an exact cut."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .runtime import cut

#: Weights of the sources in order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: A source is used so many times at most.
MOST = 3
#: Leading hex digits of a row's key that part a source into ranges of nearly equal size, as keys are uniform.
RANGE_DIGITS = 3
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def running(rows: DataFrame, order: Sequence[Column], values: dict[str, Column]) -> DataFrame:
    """All rows, each with the sum of every value over the rows before it in `order` (rows that tie come in any order).

    Rows are range-sorted over partitions and summed there; only the partitions' totals, one row each, come together.
    """
    part, at = (f"{x}_{uuid.uuid4().hex}" for x in ("part", "at"))
    own = {name: f"{name}_{uuid.uuid4().hex}" for name in values}
    laid = rows.withColumns({own[n]: v for n, v in values.items()}).repartitionByRange(*order).withColumn(part, F.spark_partition_id())
    laid = cut(laid)  # what a partition holds stays so
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    totals = laid.groupBy(part).agg(*(F.sum(c).alias(c) for c in own.values()))
    totals = totals.select(F.col(part).alias(at), *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in own.values()))
    inside = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # totals: one row a partition, so a bounded broadcast
    found = laid.withColumns({f"{c}_in": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in own.values()}).join(F.broadcast(totals), F.col(part) == F.col(at))
    return found.select(*rows.columns, *((F.col(f"{c}_in") + F.col(f"{c}_before")).alias(n) for n, c in own.items()))


def source_targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, words, target) of (source, words), one row a source.

    Sources by code point, null last, take the weights in turn and share the sum of all words by them. No target is
    above `most` times its source's words: what is over is shared by weight among the others, until none is above.
    In order of words per weight the limited sources come first, so that prefix sums tell where they end. Without words
    all targets are 0.
    """
    if not weights or min(weights) <= 0 or most < 1:
        raise ValueError("weights must be positive, and a source must be used once at least")
    placed = running(sources.select("source", F.col("words").cast("long").alias("words")), [F.col("source").asc_nulls_last()], {"place": F.lit(1)})
    weighed = placed.select("source", "words", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("long").alias("weight"))
    total = weighed.agg(F.sum("words").alias("words"), F.sum("weight").alias("weight")).first()
    words, weight = total["words"] or 0, total["weight"] or 0
    most_words = F.col("words") * most
    scarce = running(weighed, [most_words / F.col("weight"), F.col("source").asc_nulls_last()], {"full_before": most_words, "weight_before": F.col("weight")})
    full = most_words.cast("double") * (F.lit(weight) - F.col("weight_before")) <= F.col("weight").cast("double") * (F.lit(words) - F.col("full_before"))
    scarce = cut(scarce.withColumn("full", full))
    rest = scarce.agg(F.sum(F.when(F.col("full"), most_words)).alias("words"), F.sum(F.when(~F.col("full"), F.col("weight"))).alias("weight")).first()
    shared = F.col("weight").cast("double") * float(words - (rest["words"] or 0)) / float(rest["weight"] or 1)
    return scarce.select("source", "words", F.when(F.col("full"), most_words.cast("double")).otherwise(shared).alias("target"))


def mix(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(doc_id, source, size, source_size, target, epochs, taken) of every row: how many of its words the mix takes.

    A source's budget is its target to the nearest word. Whole passes over the source are taken first (`epochs` of them),
    then its rows in the order of their keys, an MD5 of id and text, up to the budget: the last row is taken in part.
    A source is parted by its keys' leading digits, so no task holds one; only rows equal in id and text fall together,
    and these are alike in the result whatever their order. A null text has no words, a null source is one of its own, a
    null id counts as an empty one. Empty tables give no rows, a table without words takes none; other columns are ignored.
    """
    key = F.md5(F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")).cast("binary"))).cast("binary"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size"), key.alias("key"))
    # a key of the source that is never null: the shuffle of the window then serves the join as well
    own = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
    rows = cut(rows.withColumns({"own": own, "range": F.substring("key", 1, RANGE_DIGITS)}))
    ranges = rows.groupBy("own", "source", "range").agg(F.sum("size").alias("words"))
    targets = source_targets(ranges.groupBy("source").agg(F.sum("words").alias("words")), weights, most).select(own.alias("own"), F.col("words").alias("source_size"), "target")
    earlier = Window.partitionBy("own").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select("own", "range", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("start")).join(targets, "own")
    inside = Window.partitionBy("own", "range").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    laid = rows.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(starts, ["own", "range"])
    budget = F.floor(F.col("target") + 0.5)
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    left = budget - epochs * F.col("source_size") - F.col("start") - F.col("before")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), left))
    return laid.select("doc_id", "source", "size", "source_size", "target", epochs.cast("long").alias("epochs"), taken.cast("long").alias("taken"))
