"""Nearest vectors by cells: a join of queries with the cells whose bound can still beat what they have found."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import ship
from . import ann

#: Rows of a cell, and queries, that one task compares at once; larger cells are dealt to parts.
PART_ROWS, PART_QUERIES = 16_384, 4_096
#: Cells that a query looks into first.
PROBES = 4
#: Scores are told to six digits.
SLACK = 1e-6


@dataclass
class Cells:
    """Unit centroids and the greatest angle of a member with each; -1 where a cell has none. Their number follows `ann.lists_for`."""

    centroids: np.ndarray
    radius: np.ndarray

    def bounds(self, unit: np.ndarray) -> np.ndarray:
        """Upper bound of the cosine of each query (rows of unit length) with the members of each cell (`ann.cosine_bound`)."""
        out = ann.cosine_bound(unit @ self.centroids.T, self.radius[None, :])
        out[:, self.radius < 0] = -np.inf
        return out


def units(column: pd.Series) -> np.ndarray:
    x = np.stack(column.to_numpy()).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _usable(rows: DataFrame, vector: str, dim: int) -> DataFrame:
    return rows.filter((F.size(vector) == dim) & ~F.exists(vector, lambda x: x.isNull()) & (F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")) > 0))


def assigned(rows: DataFrame, centroids: np.ndarray, vector: str, cell: str = "cell", far: str = "far") -> DataFrame:
    """The rows with their nearest centroid and their angle with it. The centroids go out as a broadcast (bounded by their number)."""
    sent = rows.sparkSession.sparkContext.broadcast(centroids)

    @F.pandas_udf("cell int, far double")
    def place(v: pd.Series) -> pd.DataFrame:
        c, x = sent.value, units(v)
        cosine = x @ c.T
        near = cosine.argmax(axis=1)
        return pd.DataFrame({"cell": near, "far": np.arccos(np.clip(cosine[np.arange(len(x)), near], -1, 1))})

    at = f"at_{uuid.uuid4().hex}"
    return rows.withColumn(at, place(F.col(vector))).withColumns({cell: F.col(f"{at}.cell"), far: F.col(f"{at}.far")}).drop(at)


def _looked_into(queries: DataFrame, cells: Cells, probes: int, again: bool) -> DataFrame:
    """A row for each query and cell: its `probes` best cells, or (again) the others whose bound reaches the query's `floor`."""
    sent = queries.sparkSession.sparkContext.broadcast(cells)

    @F.pandas_udf("array<int>")
    def cells_of(v: pd.Series, floor: pd.Series) -> pd.Series:
        bounds = sent.value.bounds(units(v))
        order = np.argsort(-bounds, axis=1, kind="stable")
        first = np.zeros(bounds.shape, bool)
        np.put_along_axis(first, order[:, :probes], True, axis=1)
        pick = (~first & (bounds >= floor.to_numpy()[:, None] - SLACK)) if again else first
        return pd.Series([np.flatnonzero(p & np.isfinite(b)).tolist() for p, b in zip(pick, bounds)])

    return queries.withColumn("cell", F.explode(cells_of(F.col("q_vector"), F.col("floor"))))


def _compared(asked: DataFrame, rows: DataFrame, sizes: DataFrame, by: Sequence[str], k: int) -> DataFrame:
    """(query, key, tie, score): the k best rows of each query in each part of a cell it looks into, by rounded score, then tie.

    A cell is cut into parts of PART_ROWS rows (by a hash of their keys) and its queries into parts of PART_QUERIES, so a
    task holds two bounded matrices; each query goes to all parts of the cell.
    """
    spark, on = asked.sparkSession, [*by, "cell"]
    ship(spark)
    laid = rows.join(sizes, on).withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")).select(*on, "part", F.lit(0).alias("q_part"), "key", "tie", "vector")
    asked_sizes = asked.groupBy(*on).agg(F.ceil(F.count("*") / PART_QUERIES).cast("int").alias("q_parts"))
    # rows go to each part of the queries as well
    laid = laid.drop("q_part").join(asked_sizes, on).withColumn("q_part", F.explode(F.sequence(F.lit(0), F.col("q_parts") - 1))).drop("q_parts")
    dealt = asked.join(sizes, on).join(asked_sizes, on).withColumns({"part": F.explode(F.sequence(F.lit(0), F.col("parts") - 1)), "q_part": F.pmod(F.xxhash64("query"), F.col("q_parts")).cast("int")})
    groups = [*on, "part", "q_part"]

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = {"query": [], "key": [], "tie": [], "score": []}
        if len(left) and len(right):
            right = right.sort_values("tie", kind="stable")
            x, keys, ties = units(right["vector"]), right["key"].to_numpy(), right["tie"].to_numpy()
            q, names = units(left["q_vector"]), left["query"].to_numpy()
            for at in range(0, len(q), 256):
                score = np.floor((q[at : at + 256] @ x.T) * 1e6 + 0.5) / 1e6
                top = np.argsort(-score, axis=1, kind="stable")[:, :k]
                out["query"] += np.repeat(names[at : at + 256], top.shape[1]).tolist()
                out["key"] += keys[top].ravel().tolist()
                out["tie"] += ties[top].ravel().tolist()
                out["score"] += np.take_along_axis(score, top, 1).ravel().tolist()
        return pd.DataFrame(out)

    kinds = dict(asked.dtypes) | dict(rows.dtypes)
    shape = f"query {kinds['query']}, key {kinds['key']}, tie {kinds['tie']}, score double"
    return dealt.select(*groups, "query", "q_vector").groupBy(*groups).cogroup(laid.groupBy(*groups)).applyInPandas(best, shape)


def _top(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query, cut before they are shuffled."""
    order = [F.desc("score"), F.asc("tie"), F.asc("key")]
    if k == 1:
        best = F.min(F.struct((-F.col("score")).alias("down"), "tie", "key")).alias("h")
        return found.groupBy("query").agg(best).select("query", "h.key", "h.tie", (-F.col("h.down")).alias("score"), F.lit(1).alias("place"))
    return found.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(*order))).filter(F.col("place") <= k)


@dataclass
class Nearest:
    hits: DataFrame  # query, key, score, place from 1
    looked: list[DataFrame]  # query, cell, n: what was compared, round by round

    def pairs(self) -> int:
        """Vectors compared, over all queries."""
        return sum(x.agg(F.sum("n")).first()[0] or 0 for x in self.looked)


def nearest(queries: DataFrame, rows: DataFrame, k: int, by: Sequence[str] = (), probes: int = PROBES, floor: float = -1.0, exact: bool = True, staged=None) -> Nearest:
    """The k rows of each query's `by` with the greatest cosine, ties by `tie`.

    queries: query, by..., vector; rows: key, tie, by..., vector. A query looks into its `probes` best cells first; then,
    unless `exact` is false, into all others whose bound reaches its k-th score so far (or `floor`, under which nothing is
    asked for), so that no better row is missed. Vectors that are null, empty, of norm zero, or of a length that no row
    or query shares give no row. staged(df) writes a table between the rounds and reads it; without it they are worked
    out again.
    """
    once = staged or (lambda df: df)
    dims = [r[0] for r in queries.select(F.size("vector")).distinct().collect() if r[0] and r[0] > 0]  # the lengths in use, a few
    parts = [_nearest(_usable(queries, "vector", d).withColumnRenamed("vector", "q_vector"), _usable(rows, "vector", d), k, list(by), probes, floor, exact, once) for d in sorted(dims)]
    parts = [p for p in parts if p is not None]
    if not parts:
        kinds = dict(queries.dtypes) | dict(rows.dtypes)
        return Nearest(queries.sparkSession.createDataFrame([], f"query {kinds['query']}, key {kinds['key']}, score double, place int"), [])
    return Nearest(reduce(DataFrame.unionByName, (p.hits for p in parts)), [x for p in parts for x in p.looked])


def _nearest(queries: DataFrame, rows: DataFrame, k: int, by: list[str], probes: int, floor: float, exact: bool, once) -> Nearest | None:
    centroids = ann.fit(rows, "key", ann.lists_for(rows.count()), embedding="vector")
    if not len(centroids):
        return None
    laid = once(assigned(rows.select("key", "tie", *by, "vector"), centroids, "vector"))
    radius = np.full(len(centroids), -1.0)
    for r in laid.groupBy("cell").agg(F.max("far").alias("far")).collect():  # a row for each cell
        radius[r["cell"]] = r["far"]
    cells = Cells(centroids.astype(np.float64), radius)
    sizes = once(laid.groupBy(*by, "cell").agg(F.count("*").alias("n"), F.ceil(F.count("*") / PART_ROWS).cast("int").alias("parts")))
    asked = queries.select("query", *by, "q_vector").withColumn("floor", F.lit(floor))
    looked = [_looked_into(asked, cells, probes, again=False)]
    found = once(_top(_compared(looked[0], laid, sizes.drop("n"), by, k), k))
    if exact and probes < len(centroids):
        kth = found.filter(F.col("place") == k).select("query", F.greatest("score", F.lit(floor)).alias("kth"))
        left = asked.join(kth, "query", "left").withColumn("floor", F.coalesce("kth", "floor")).drop("kth")
        looked.append(_looked_into(left, cells, probes, again=True))
        more = _compared(looked[1], laid, sizes.drop("n"), by, k)
        found = _top(found.drop("place").unionByName(more), k)
    return Nearest(found.select("query", "key", "score", "place"), [x.join(sizes.drop("parts"), [*by, "cell"]).select("query", "cell", "n") for x in looked])
