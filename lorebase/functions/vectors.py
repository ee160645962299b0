"""Vectors as array columns; sums run left to right in double."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(vector: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """-1 if either is empty or of norm zero, or their sizes differ."""
    bad = F.coalesce((F.size(a) <= 0) | (F.size(a) != F.size(b)), F.lit(True))
    lengths = norm(a) * norm(b)
    return F.when(bad, -1.0).when(lengths == 0, -1.0).otherwise(dot(a, b) / F.nullif(lengths, F.lit(0.0)))


def mean(vectors: Column) -> Column:
    """Component-wise mean of an array of vectors of one size; empty if there are none."""
    n = F.size(vectors)
    total = F.aggregate(F.slice(vectors, F.lit(2), F.greatest(n, F.lit(1))), F.transform(F.get(vectors, F.lit(0)), lambda x: x.cast("double")), lambda s, v: F.zip_with(s, v, lambda x, y: x + y.cast("double")))
    return F.when(n > 0, F.transform(total, lambda x: x / n)).otherwise(F.array().cast("array<double>"))
