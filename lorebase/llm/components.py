"""Connected components of a graph given as an edge table, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import cut


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge, root being the smallest node of its component.

    Alternates large-star and small-star steps (Kiveris et al., 2014): hot nodes are only ever reduced by a
    map-side combined minimum and joined by their key, so no adjacency list is built. Duplicate edges, loops and
    both directions may occur; edges with a null end are ignored. No edges: no rows.
    """
    cur = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u is not null and v is not null").distinct())
    mark = None
    while True:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        rest = large.filter("u > v").distinct()
        low = rest.groupBy("u").agg(F.min("v").alias("m"))
        small = rest.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v")
        cur = cut(small.unionByName(low.withColumnRenamed("m", "v")).distinct())
        now = cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    # the fixed point is one star per component; the hub is its own root
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
