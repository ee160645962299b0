"""Density clusters of entity vectors within a scope (hierarchical, excess of mass): small scopes in a task each, large ones by parts."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship, written
from .resolution import NOISE_FROM

#: Rows of a part; two parts are compared in one task, by a matrix of this many rows and columns (134 MB).
PART_ROWS = 4_096
#: Forests of pairs of parts that one task merges at once.
FAN_IN = 16


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances. A pair's is worked out alike wherever its rows stand, so tasks agree on it to the last bit."""
    out = np.empty((len(x), len(y)))
    for i, row in enumerate(x):
        d = y - row
        d *= d
        out[i] = d.sum(axis=1)
    return np.sqrt(out, out=out)


def _least(d: np.ndarray, k: int) -> np.ndarray:
    """The k smallest of each row (fewer where a row is shorter), ascending."""
    k = min(k, d.shape[1])
    return np.sort(np.partition(d, k - 1, axis=1)[:, :k], axis=1)


def _forest(d: np.ndarray, two_sided: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges (weight, one end, other end) of a minimum spanning tree of all rows, or, two-sided, of rows against columns.

    Two-sided, columns are numbered after the rows, and ends lie on different sides.
    """
    p, q = d.shape
    n = p + q if two_sided else p
    near, via, left = np.full(n, np.inf), np.zeros(n, np.int64), np.ones(n, bool)
    weight, one, other = np.empty(max(n - 1, 0)), np.empty(max(n - 1, 0), np.int64), np.empty(max(n - 1, 0), np.int64)
    i = 0
    for step in range(n - 1):
        left[i], near[i] = False, np.inf
        side = slice(0, n) if not two_sided else slice(p, n) if i < p else slice(0, p)
        row = d[i] if i < p else d[:, i - p]
        better = left[side] & (row < near[side])
        near[side][better] = row[better]
        via[side][better] = i
        i = int(near.argmin())
        weight[step], one[step], other[step] = near[i], via[i], i
    return weight, one, other


def _spanning(weight: np.ndarray, one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Places of the edges of a minimum spanning forest, ascending by weight."""
    ends, flat = np.unique(np.concatenate([one, other]), return_inverse=True)
    a, b = flat[: len(one)].tolist(), flat[len(one) :].tolist()
    up, kept = list(range(len(ends))), []
    for i in np.argsort(weight, kind="stable").tolist():
        u, v = a[i], b[i]
        while up[u] != u:
            up[u] = u = up[up[u]]
        while up[v] != v:
            up[v] = v = up[up[v]]
        if u != v:
            up[u] = v
            kept.append(i)
    return np.array(kept, np.int64)


def tree_labels(n: int, edges: Iterable[tuple[float, int, int]], min_cluster_size: int = 2) -> np.ndarray:
    """Cluster numbers of n points, -1 for noise, from the edges of a spanning tree, ascending by weight.

    Groups that meet at one weight are merged at once, so the labels follow from the distances alone, whichever of the
    trees of least weight is given. Chosen are the most stable clusters of at least min_cluster_size, the root excepted;
    they are numbered by their first point.
    """
    least = max(2, min_cluster_size)
    if n < least:
        return np.full(n, -1)
    kids: dict[int, list[int]] = {}
    height: dict[int, float] = {}
    size, up, stands = [1] * n, list(range(n)), list(range(n))  # stands: the node that a root of `up` is
    for w, a, b in edges:
        while up[a] != a:
            up[a] = a = up[up[a]]
        while up[b] != b:
            up[b] = b = up[up[b]]
        if a == b:
            continue
        one, two = stands[a], stands[b]
        if height.get(one) != w or height.get(two) == w and len(kids[two]) > len(kids[one]):
            one, two = two, one
        if height.get(one) != w:
            new = len(size)
            kids[new], height[new] = [one, two], w
            size.append(size[one] + size[two])
        else:
            new = one
            kids[new].extend(kids.pop(two) if height.get(two) == w else [two])
            size[new] += size[two]
        up[a], stands[b] = b, new
    top = stands[next(i for i in range(n) if up[i] == i)]

    # condense: a cluster lives until it splits into two or more of the least size
    born, mass, split, order, todo = {top: 0.0}, {}, {}, [], [top]
    while todo:
        c = i = todo.pop()
        order.append(c)
        mass[c] = 0.0
        while i >= n:
            rate = 1 / max(height[i], 1e-12)
            big = [j for j in kids[i] if size[j] >= least]
            gone = size[i] - size[big[0]] if len(big) == 1 else size[i]
            mass[c] += gone * (rate - born[c])
            if len(big) == 1:
                i = big[0]
                continue
            if big:
                split[c] = big
                born.update(dict.fromkeys(big, rate))
                todo += big
            break
    stays: set[int] = set()
    for c in reversed(order):
        below = math.fsum(mass[j] for j in split.get(c, ()))
        if c != top and (c not in split or mass[c] >= below):
            stays.add(c)
        else:
            mass[c] = below
    chosen, todo = [], [top]
    while todo:
        c = todo.pop()
        if c in stays:
            chosen.append(c)
        else:
            todo += split.get(c, ())
    members = []
    for c in chosen:
        points, todo = [], [c]
        while todo:
            j = todo.pop()
            if j < n:
                points.append(j)
            else:
                todo += kids[j]
        members.append(points)
    labels = np.full(n, -1)
    for number, points in enumerate(sorted(members, key=min)):
        labels[points] = number
    return labels


def density_labels(x: np.ndarray, min_cluster_size: int = 2) -> np.ndarray:
    """Cluster numbers of the rows of x, -1 for noise (`tree_labels`), by all distances at once."""
    x, k = np.asarray(x, float), max(2, min_cluster_size)
    if len(x) < k:
        return np.full(len(x), -1)
    d = distances(x, x)
    core = _least(d, k)[:, -1]
    d = np.maximum(np.maximum(d, core), core[:, None])
    weight, one, other = _forest(d, False)
    order = np.argsort(weight, kind="stable")
    return tree_labels(len(x), zip(weight[order].tolist(), one[order].tolist(), other[order].tolist()), k)


def _numbered(labels: np.ndarray) -> np.ndarray:
    labels[labels < 0] = NOISE_FROM + np.arange((labels < 0).sum())
    return labels


def _pairs(rows: DataFrame) -> DataFrame:
    """Each row once for every part of its scope, its own included: (scope, a, b, row, part, vector, core)."""
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    dealt = rows.select("*", other)
    return dealt.select("scope", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"), "row", "part", "vector", "core")


def _sides(part: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame, np.ndarray]:
    a, b = part["a"].iloc[0], part["b"].iloc[0]
    left, right = part[part["part"] == a], part[part["part"] == b]
    if not len(left) or not len(right):
        return left, right, np.empty((len(left), len(right)))
    return left, right, distances(np.stack(left["vector"].to_list()).astype(float), np.stack(right["vector"].to_list()).astype(float))


def _with_cores(rows: DataFrame, k: int) -> DataFrame:
    """The distance of each row to the k-th nearest of its scope, itself the first. From a row's k nearest in each part."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        left, right, d = _sides(part)
        out = [pd.DataFrame({"row": left["row"].to_numpy(), "near": list(_least(d, k))})] if d.size else []
        if d.size and part["a"].iloc[0] != part["b"].iloc[0]:
            out.append(pd.DataFrame({"row": right["row"].to_numpy(), "near": list(_least(d.T, k))}))
        return pd.concat(out) if out else pd.DataFrame({"row": np.empty(0, np.int64), "near": np.empty(0, object)})

    near = _pairs(rows).groupBy("scope", "a", "b").applyInPandas(run, "row long, near array<double>")
    core = near.groupBy("row").agg(F.element_at(F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k), -1).alias("core"))
    return rows.drop("core").join(core, "row")


def spanning_trees(rows: DataFrame, k: int, most_parts: int) -> DataFrame:
    """(scope, weight, one, other): a minimum spanning tree of mutual reachability for each scope.

    rows: scope, row, part, parts, vector. An edge of the tree between two parts is one of a least forest between just
    these two, since what closes a circle there closes it in the scope. So each pair of parts is one bounded task, and
    forests are merged FAN_IN at a time till a scope has one.
    """
    rows = rows.withColumn("core", F.lit(0.0))
    if k > 2:  # up to 2 no row's core distance exceeds any of its distances
        rows = _with_cores(rows, k)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        left, right, d = _sides(part)
        two = bool(part["a"].iloc[0] != part["b"].iloc[0])
        ids = np.concatenate([left["row"], right["row"]]) if two else left["row"].to_numpy()
        if not d.size:
            none = np.empty(0, np.int64)
            return pd.DataFrame({"scope": none.astype(object), "forest": none, "weight": none.astype(float), "one": none, "other": none})
        d = np.maximum(np.maximum(d, right["core"].to_numpy()), left["core"].to_numpy()[:, None])
        weight, one, other = _forest(d, two)
        a, b = int(part["a"].iloc[0]), int(part["b"].iloc[0])
        name = np.full(len(weight), part["scope"].iloc[0], object)
        return pd.DataFrame({"scope": name, "forest": b * (b + 1) // 2 + a, "weight": weight, "one": ids[one], "other": ids[other]})

    shape = "scope string, forest long, weight double, one long, other long"

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        kept = part.iloc[_spanning(part["weight"].to_numpy(), part["one"].to_numpy(), part["other"].to_numpy())]
        return kept.assign(scope=kept["scope"].to_numpy(object))

    found = _pairs(rows).groupBy("scope", "a", "b").applyInPandas(run, shape)
    forests = most_parts * (most_parts + 1) // 2
    while forests > 1:
        found = found.withColumn("forest", F.floor(F.col("forest") / FAN_IN).cast("long")).groupBy("scope", "forest").applyInPandas(merge, shape)
        forests = -(-forests // FAN_IN)
    return found.drop("forest")


def density_clusters(entities: DataFrame, scope: list[str], embedding: str = "embedding", min_cluster_size: int = 2, part_rows: int = PART_ROWS, staged: Callable[[DataFrame], DataFrame] = written) -> DataFrame:
    """Adds `cluster` (long) by the entities of the same `scope`, of which null is one; one that fits none is alone, from
    number 10,000,000 on. Clusters, and those alone, are numbered in order of `seq` (rows of equal seq in any order).

    A scope of at most part_rows is worked out in one task. A larger one is cut into parts; a task compares two of them,
    and the result is the same. One task holds the tree of a scope, an edge and a seq for each entity, but no vectors.
    Repeated vectors are at distance 0 and may be a cluster. A vector that is null, empty, or holds null or non-finite
    components leaves its row alone; vectors of different lengths in a scope are an error. staged(rows) writes the table,
    with a number for each row, and reads it.
    """
    spark = entities.sparkSession
    ship(spark)
    tag = uuid.uuid4().hex
    key, row = f"scope_{tag}", f"row_{tag}"
    named = F.to_json(F.struct(*[F.col(f"`{c}`").cast("string").alias(str(i)) for i, c in enumerate(scope)])) if scope else F.lit("")
    kept = staged(entities.withColumns({key: named, row: F.monotonically_increasing_id()}))
    vector = F.col(f"`{embedding}`")
    usable = F.coalesce((F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))
    rows = kept.select(F.col(key).alias("scope"), F.col(row).alias("row"), "seq", F.when(usable, vector).alias("vector"))
    sizes = rows.groupBy("scope").agg(F.count("*").alias("n"))
    large = sizes.filter(F.col("n") > part_rows).select("scope", F.ceil(F.col("n") / part_rows).cast("int").alias("parts"))
    most_parts = large.agg(F.max("parts")).first()[0] or 0

    def small(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["seq", "row"]).reset_index(drop=True)
        labels, fit = np.full(len(part), -1), part["vector"].notna().to_numpy()
        if fit.any():
            labels[fit] = density_labels(np.stack(part.loc[fit, "vector"].to_list()), min_cluster_size)
        return pd.DataFrame({"row": part["row"], "cluster": _numbered(labels)})

    shape = "row long, cluster long"
    found = rows.join(large, "scope", "left_anti").groupBy("scope").applyInPandas(small, shape)
    if most_parts:
        cut = rows.join(large, "scope").withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))
        trees = spanning_trees(cut.filter(F.col("vector").isNotNull()).select("scope", "row", "part", "parts", "vector"), max(2, min_cluster_size), most_parts)

        def condensed(nodes: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
            nodes, edges = nodes.sort_values(["seq", "row"]).reset_index(drop=True), edges.sort_values("weight", kind="stable")
            labels, fit = np.full(len(nodes), -1), nodes["fits"].to_numpy()
            place = pd.Series(np.arange(fit.sum()), index=nodes.loc[fit, "row"])
            labels[fit] = tree_labels(int(fit.sum()), zip(edges["weight"].tolist(), place[edges["one"]].tolist(), place[edges["other"]].tolist()), min_cluster_size)
            return pd.DataFrame({"row": nodes["row"], "cluster": _numbered(labels)})

        nodes = cut.select("scope", "row", "seq", F.col("vector").isNotNull().alias("fits"))
        found = found.unionByName(nodes.groupBy("scope").cogroup(trees.groupBy("scope")).applyInPandas(condensed, shape))
    labels = found.select(F.col("row").alias(row), F.col("cluster").alias(f"cluster_{tag}"))
    return kept.join(labels, row).drop("cluster").withColumnRenamed(f"cluster_{tag}", "cluster").drop(key, row)
