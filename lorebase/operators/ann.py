"""Inverted lists for vector search: vectors dealt to their nearest centroid, a search reads only the lists nearest to its query."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors
from .search import vector_top

#: Lists of an index, and lists that a search reads.
LISTS, PROBES = 1024, 16
#: Vectors that centroids are fitted on at most, those with the smallest hash of their key: a bound for the driver.
MAX_SAMPLE = 50_000


def fit(vectors: DataFrame, key: str, lists: int = LISTS, rounds: int = 10, embedding: str = "embedding", sample: int = MAX_SAMPLE) -> np.ndarray:
    """Unit centroids (lists x dim) by spherical k-means over at most `sample` vectors; no vectors, no centroids."""
    some = vectors.filter(F.size(embedding) > 0).orderBy(F.xxhash64(key), key).limit(sample).select(embedding).toArrow().column(0)
    if not len(some):
        return np.zeros((0, 0), np.float32)
    x = np.array(some.to_pylist(), np.float32)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    c = x[np.linspace(0, len(x) - 1, min(lists, len(x))).astype(int)].copy()
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(size > 0, total / np.maximum(size, 1e-12), c)
    return c


def list_of(centroids: np.ndarray, embedding: Column) -> Column:
    """The number of the nearest centroid; -1 for a vector that is empty or of another size."""

    @F.pandas_udf("int")
    def run(vectors: pd.Series) -> pd.Series:
        dim = centroids.shape[1]
        good = vectors.map(lambda v: v is not None and len(v) == dim and dim > 0)
        out = np.full(len(vectors), -1)
        if good.any():
            out[good.to_numpy()] = (np.stack(vectors[good].to_numpy()).astype(np.float32) @ centroids.T).argmax(axis=1)
        return pd.Series(out)

    return run(embedding)


def build(vectors: DataFrame, centroids: np.ndarray, embedding: str = "embedding") -> DataFrame:
    """The vectors with their list; written partitioned by it, a search prunes all other lists."""
    return vectors.withColumn("list", list_of(centroids, F.col(embedding)))


def save(index: DataFrame, path: str, by: Sequence[str] = ("group_id", "list")) -> None:
    """Parquet folders by group and list. A hot list is split over many files: rows are dealt by list and key, not by list alone."""
    index.write.partitionBy(*by).parquet(path)


def nearest(centroids: np.ndarray, query: Sequence[float], probes: int = PROBES) -> list[int]:
    return np.argsort(-(centroids @ np.asarray(query, np.float32)), kind="stable")[:probes].tolist() if len(centroids) else []


def search(index: DataFrame, centroids: np.ndarray, query: Sequence[float], top_k: int, key: str, fields: Sequence[str] | None = None, probes: int = PROBES, embedding: str = "embedding") -> DataFrame:
    """The top_k by inner product among the lists nearest to the query; exact if all lists are probed.

    Lists that are probed in vain are no reason to give fewer rows: with fewer than top_k rows there, all lists are read.
    """
    if not len(query):
        return vector_top(index.drop("list"), query, top_k, key, fields, embedding)
    some = index.filter(F.col("list").isin(nearest(centroids, query, probes)))
    if probes < len(centroids) and some.limit(top_k).count() < top_k:
        some = index
    return vector_top(some.drop("list"), query, top_k, key, fields, embedding)


def radii(rows: DataFrame, centroids: np.ndarray, keys: Sequence[str] = ("group_id", "list"), embedding: str = "embedding") -> DataFrame:
    """(keys, radius, longest): the greatest angle of each list's vectors with its centroid, and their greatest length.

    A vector without a list counts nowhere; one of length zero stands at a right angle to everything.
    """
    sent = rows.sparkSession.sparkContext.broadcast(centroids)

    @F.pandas_udf("radius double, longest double")
    def far(v: pd.Series, place: pd.Series) -> pd.DataFrame:
        x = np.stack(v.to_numpy()).astype(np.float64)
        size = np.linalg.norm(x, axis=1)
        cosine = (x * sent.value[place.to_numpy()].astype(np.float64)).sum(axis=1) / np.maximum(size, 1e-300)
        return pd.DataFrame({"radius": np.arccos(np.clip(cosine, -1, 1)), "longest": size})

    told = rows.filter("list >= 0").withColumn("_far", far(F.col(embedding), F.col("list")))
    return told.groupBy(*keys).agg(F.max("_far.radius").alias("radius"), F.max("_far.longest").alias("longest"))


def cosine_bound(cosine: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Upper bound of the cosine with any vector within an angle of a centroid, from the cosine with the centroid.

    Angles obey the triangle inequality; a little is added for the arc cosine's roundings near 1.
    """
    return np.cos(np.maximum(np.arccos(np.clip(cosine, -1, 1)) - radius - 1e-6, 0))


def in_reach(centroids: np.ndarray, reach: dict[int, tuple[float, float]], query: Sequence[float]) -> list[tuple[float, int]]:
    """(upper bound of the inner product with the query, list), the greatest first. reach: radius and longest of each list."""
    q, lists = np.asarray(query, np.float64), sorted(reach)
    size = np.linalg.norm(q)
    if not lists or not size:
        return [(0.0, at) for at in lists]
    radius, longest = np.array([reach[at] for at in lists]).T
    bounds = cosine_bound(centroids[lists].astype(np.float64) @ q / size, radius)
    # a vector of the list may be as short as nothing: below a right angle the bound is zero
    bounds = np.where(bounds > 0, bounds * longest * size, 0.0)
    return sorted(zip(bounds.tolist(), lists), key=lambda x: (-x[0], x[1]))


def bounded(index: DataFrame, centroids: np.ndarray, reach: dict[int, tuple[float, float]], query: Sequence[float], top_k: int, probes: int = PROBES, embedding: str = "embedding") -> list[int] | None:
    """The lists that can hold one of the top_k by inner product (None: all, as there are too few rows in the first ones).

    The `probes` lists of the greatest bound are searched first; their k-th score is what any other list's bound has to
    reach. Rows without a list (-1) are always among those read.
    """
    order = in_reach(centroids, reach, query)
    first = [at for _, at in order[:probes]]
    score = vectors.dot(F.col(embedding), vectors.literal(query))
    best = [r[0] for r in index.filter(F.col("list").isin(-1, *first)).select(score.alias("s")).orderBy(F.desc("s")).limit(top_k).collect()]  # top_k numbers
    if len(best) < top_k:
        return None
    return [-1, *(at for b, at in order if at in first or b >= best[-1] - 1e-6)]  # scores are told to six digits


def lists_for(rows: int) -> int:
    """Lists that suit so many vectors: about four times the square root, LISTS at least from a million on."""
    return max(1, min(max(LISTS, 4 * math.isqrt(rows)), rows // 8 or 1))
