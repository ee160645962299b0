"""Rendezvous hashing of stable record keys over weighted shards, with gapless slots; DataFrame functions only."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Leading hex digits of a key's hash that part a shard into buckets, each of which is numbered by itself.
BUCKET_DIGITS = 3
#: So many of the most frequent keys have buckets of their own, parted further by `spread`.
HOT_KEYS = 16


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard with the greatest -weight / ln(u), u being a uniform hash of key and shard in (0, 1).

    A shard's score depends on the key and itself alone: another shard takes rows only into itself, and a changed
    weight moves rows only to or from its shard. Scores that tie go to the smaller shard.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    best = F.array_max(F.array(*(F.struct(_score(key, s, w).alias("score"), F.lit(-s).alias("shard")) for s, w in enumerate(weights))))
    return (-best["shard"]).cast("int")


def _score(key: Column, shard: int, weight: float) -> Column:
    # 12 hex digits are 48 bits, exact as a double
    u = (F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{shard}")).cast("binary")), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    return -F.lit(float(weight)) / F.ln(u)


def shard_rows(
    rows: DataFrame, key: str, weights: Sequence[float], shard: str = "shard", slot: str = "slot", grown: str | None = None, grown_weight: float = 1.0, tie: Sequence[str] = (), spread: Column | None = None,
) -> DataFrame:
    """All rows with their shard, a slot (gapless from 0 within the shard) and, if named, the shard with one more shard.

    The key's text decides, a null key counts as an empty text. Slots follow the key's hash, then the key, then the
    columns of `tie`; rows that tie in all are numbered in any order. A shard is numbered bucket by bucket of the hash,
    so no task holds a shard; the buckets' counts, a bounded number, give their offsets. `spread`, a column of few values
    that never falls as the columns of `tie` rise, parts the rows of frequent keys (or of none) too: these are looked
    for in a pass of their own, and change no result. Empty tables give no rows. Columns of `rows` named like the results
    are replaced.
    """
    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    made = {"__shard": rendezvous(name, weights), "__hash": F.md5(name.cast("binary"))}
    if grown:
        made["__grown"] = rendezvous(name, [*weights, grown_weight])
    dealt = rows.withColumns(made).withColumn("__bucket", F.substring("__hash", 1, BUCKET_DIGITS))
    sub, part = F.lit(0), F.lit(0).cast("long")
    if spread is not None:
        hot = sorted(hashlib.md5(k.encode()).hexdigest() for k in _frequent(rows.select(name.alias("key"))))
        is_hot = F.col("__hash").isin(hot)
        # along the order of hashes: before the first hot key, that key, between it and the next
        sub = sum((2 * (F.col("__hash") > h).cast("int") + (F.col("__hash") == h).cast("int") for h in hot), sub)
        part = F.when(is_hot, F.coalesce(spread.cast("long"), F.lit(-(1 << 63)))).otherwise(part)
    dealt = dealt.withColumns({"__sub": sub, "__part": part})
    own = ["__bucket", "__sub", "__part"]
    counts = dealt.groupBy("__shard", *own).agg(F.count("*").alias("__n"))
    before = Window.partitionBy("__shard").orderBy(*own).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__shard", *own, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy("__shard", *own).orderBy("__hash", name, *tie)
    # at most 16^BUCKET_DIGITS offsets a shard, and those of HOT_KEYS keys' parts, are broadcast
    out = dealt.withColumn("__row", F.row_number().over(within)).join(F.broadcast(offsets), ["__shard", *own])
    named = {shard: F.col("__shard"), slot: (F.col("__before") + F.col("__row") - 1).cast("long")} | ({grown: F.col("__grown")} if grown else {})
    return out.withColumns(named).drop("__shard", "__hash", "__bucket", "__grown", "__row", "__before", "__sub", "__part")


def _frequent(keys: DataFrame) -> list[str]:
    """The HOT_KEYS most frequent keys (fewer if there are fewer), as a sketch of bounded size tells them."""
    found = keys.agg(F.expr(f"approx_top_k(key, {HOT_KEYS}, {HOT_KEYS * 256})").alias("top")).first()
    return [r["item"] for r in found["top"] or []]
