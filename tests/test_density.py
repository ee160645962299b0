"""Density clusters against the definition by thresholds, and large scopes, cut into parts, against small ones."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorebase.operators import density


def plain(x, k):
    """Labels by the definition: groups fall apart where the graph of the edges under a weight does."""
    n = len(x)
    if n < k:
        return [-1] * n
    d = density.distances(x, x)
    core = np.sort(d, axis=1)[:, k - 1]
    w = [[max(d[i][j], core[i], core[j]) for j in range(n)] for i in range(n)]

    def apart(group, under):
        left, out = set(group), []
        while left:
            todo = [left.pop()]
            part = set(todo)
            while todo:
                i = todo.pop()
                more = {j for j in left if under(w[i][j])}
                left -= more
                part |= more
                todo += more
            out.append(part)
        return out

    def cluster(group, born):
        """(mass, chosen below or itself)"""
        mass = 0.0
        now = group
        while True:
            if len(now) == 1:
                return mass, None
            height = min(h for h in {w[i][j] for i in now for j in now if i != j} if len(apart(now, lambda e: e <= h)) == 1)  # noqa: B023
            big = [p for p in apart(now, lambda e: e < height) if len(p) >= k]  # noqa: B023
            rate = 1 / max(height, 1e-12)
            if len(big) == 1:
                mass += (len(now) - len(big[0])) * (rate - born)
                now = big[0]
                continue
            mass += len(now) * (rate - born)
            return mass, [(p, *cluster(p, rate)) for p in big] or None

    def chosen(group, mass, below):
        """(worth, clusters)"""
        if not below:
            return mass, [group]
        parts = [chosen(*b) for b in below]
        worth = math.fsum(p[0] for p in parts)
        return (mass, [group]) if mass >= worth else (worth, [c for p in parts for c in p[1]])

    _, below = cluster(set(range(n)), 0.0)
    out = [-1] * n
    found = [c for b in below or [] for c in chosen(*b)[1]]
    for number, group in enumerate(sorted(found, key=min)):
        for i in group:
            out[i] = number
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 4)), min_size=0, max_size=18), st.integers(2, 4))
def test_labels_by_definition(points, k):
    """Points of a small grid, so that ties and repeated points abound."""
    x = np.array(points, float).reshape(-1, 2)
    assert density.density_labels(x, k).tolist() == plain(x, k)


def test_labels_of_spread_points():
    rng = np.random.default_rng(4)
    for k in (2, 3, 5):
        x = np.concatenate([rng.normal(c, s, (8, 3)) for c, s in ((0, 0.1), (2, 0.3), (5, 0.2), (9, 2))])
        assert density.density_labels(x, k).tolist() == plain(x, k)


def table(spark, scopes):
    rows = [(name, i, None if v is None else [float(c) for c in v]) for name, x in scopes.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "scope string, seq int, embedding array<double>")


@pytest.mark.parametrize("k", [2, 4])
def test_parts_give_the_same_clusters(spark, k):
    """Scopes of 1 to 190 rows in parts of 16 or so, on a grid (ties) and spread, a null scope among them."""
    rng = np.random.default_rng(k)
    scopes = {"grid": rng.integers(0, 9, (120, 2)), "wide": rng.normal(0, 1, (190, 5)), None: np.repeat(rng.normal(0, 1, (17, 3)), 3, axis=0), "one": [[1.0]], "few": rng.normal(0, 1, (9, 2))}
    rows = table(spark, scopes)
    got = density.density_clusters(rows.withColumn("cluster", F.lit("old")), ["scope"], min_cluster_size=k, part_rows=16)
    assert got.columns == ["scope", "seq", "embedding", "cluster"]
    found = {}
    for r in got.collect():
        found.setdefault(r.scope, {})[r.seq] = r.cluster
    for name, x in scopes.items():
        want = density._numbered(density.density_labels(np.array(x, float), k))
        assert [found[name][i] for i in range(len(x))] == want.tolist(), name
    whole = density.density_clusters(rows, ["scope"], min_cluster_size=k)
    assert sorted(map(str, whole.select("scope", "seq", "cluster").collect())) == sorted(map(str, got.select("scope", "seq", "cluster").collect()))


def test_rows_without_a_vector_are_alone(spark):
    close = [[i / 100, 0.0] for i in range(10)] + [[5 + i / 90, 1.0] for i in range(10)]
    rows = table(spark, {"a": [None, [], [float("nan"), 1.0], [float("inf"), 0.0], *close], "b": [None, None]})
    for part_rows, k in ((4, 3), (4_096, 2)):
        got = {(r.scope, r.seq): r.cluster for r in density.density_clusters(rows, ["scope"], min_cluster_size=k, part_rows=part_rows).collect()}
        assert [got["a", i] for i in range(4)] == [10_000_000 + i for i in range(4)]
        assert [got["b", i] for i in range(2)] == [10_000_000, 10_000_001]
        assert len(got) == 26 and min(got.values()) == 0
    assert density.density_clusters(rows.limit(0), ["scope"]).count() == 0


def test_repeated_rows_of_one_seq(spark):
    rows = spark.createDataFrame([("a", 1, [0.0])] * 40 + [("a", 2, [9.0])] * 40, "scope string, seq int, embedding array<double>")
    got = density.density_clusters(rows, ["scope"], part_rows=8)
    assert {tuple(r) for r in got.groupBy("seq", "cluster").count().collect()} == {(1, 0, 40), (2, 1, 40)}
