"""Property-graph queries: incident edges, endpoints, undirected k-hop trails, subgraph unions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def edges_of(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations whose two ends exist; the others are dropped."""
    names = entities.select("group_id", "doc_id", "canonical_name").distinct()
    out = relations
    for end in ("subject", "object"):
        out = out.join(names.withColumnRenamed("canonical_name", end), ["group_id", "doc_id", end], "left_semi")
    return out


def undirected(edges: DataFrame) -> DataFrame:
    """Each edge from both of its ends; a loop once."""
    a = edges.withColumn("from", F.col("subject")).withColumn("to", F.col("object"))
    return a.unionByName(edges.filter("subject <> object").withColumn("from", F.col("object")).withColumn("to", F.col("subject")))


def named(entities: DataFrame, names: Sequence[str]) -> DataFrame:
    """Entities of one of the names, or with it as an alias."""
    spark = entities.sparkSession
    asked = spark.createDataFrame([(n,) for n in dict.fromkeys(x.strip() for x in names) if n], "_name string")
    known = entities.select("*", F.explode(F.array_distinct(F.concat(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("_name"))
    return known.join(F.broadcast(asked), "_name", "left_semi").drop("_name").dropDuplicates(["group_id", "doc_id", "canonical_name"])


def relations_by_entities(relations: DataFrame, entities: DataFrame, names: Sequence[str], limit: int = 200) -> DataFrame:
    """Distinct relations at either end of the named entities, by relation_id."""
    seeds = named(entities, names).select(F.col("canonical_name").alias("from")).distinct()
    return undirected(relations).join(seeds, "from", "left_semi").drop("from", "to").dropDuplicates(["relation_id"]).orderBy("relation_id").limit(limit)


def entities_by_relations(relations: DataFrame, entities: DataFrame, ids: Sequence[str] = (), triples: Sequence[tuple[str, str, str]] = (), limit: int = 200) -> DataFrame:
    """The ends of relations given by id or, without ids, by (head, type, tail) in either direction; an empty type fits any."""
    spark = relations.sparkSession
    if ids:
        hit = relations.join(F.broadcast(spark.createDataFrame([(x,) for x in ids], "relation_id string")), "relation_id", "left_semi")
    else:
        asked = spark.createDataFrame([(h, t, k or "") for h, k, t in triples if h and t], "head string, tail string, kind string")
        ways = asked.union(asked.select("tail", "head", "kind")).distinct()
        on = (F.col("subject") == F.col("head")) & (F.col("object") == F.col("tail")) & ((F.col("kind") == "") | (F.col("kind") == F.col("relation_type")))
        hit = relations.join(F.broadcast(ways), on, "left_semi")
    ends = hit.select(F.col("subject").alias("canonical_name")).union(hit.select("object")).distinct()
    return entities.join(ends, "canonical_name", "left_semi").orderBy("canonical_name").limit(limit)


def khop(edges: DataFrame, seeds: DataFrame, depth: int = 2, limit: int | None = 50) -> DataFrame:
    """Undirected trails of 1 to depth edges from the seeds (column `name`), none using an edge twice.

    (seed, node, hops, path): path is the array of relation_ids. With a limit, each seed keeps its first trails by
    length and path; as shorter ones come first, each hop is cut to the limit as it is made and a seed that has its
    trails goes no further, so that a hub costs its edges once and not their products. One join a hop; the edges are
    shuffled by their end once and reused.
    """
    steps = undirected(edges).select("relation_id", "from", "to")
    front = seeds.select(F.col("name").alias("seed"), F.col("name").alias("node"), F.array().cast("array<string>").alias("path"))
    found = None
    place = Window.partitionBy("seed").orderBy("path", "node")
    for hop in range(max(1, depth)):
        if limit is not None and found is not None:
            full = found.groupBy("seed").agg(F.count("*").alias("n")).filter(F.col("n") >= limit)
            front = front.join(full, "seed", "left_anti")
        front = front.join(steps, front["node"] == steps["from"]).filter(~F.array_contains("path", F.col("relation_id"))).select("seed", F.col("to").alias("node"), F.array_append("path", F.col("relation_id")).alias("path"))
        if limit is not None:
            front = front.withColumn("_n", F.row_number().over(place)).filter(F.col("_n") <= limit).drop("_n")
        found = front if found is None else found.unionByName(front)
    found = found.withColumn("hops", F.size("path"))
    if limit is not None:
        by_length = Window.partitionBy("seed").orderBy("hops", "path", "node")
        found = found.withColumn("_n", F.row_number().over(by_length)).filter(F.col("_n") <= limit).drop("_n")
    return found


def subgraph(trails: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct nodes (seeds and trail ends) and the trails' edges, once for each trail that uses them."""
    nodes = trails.select(F.col("seed").alias("name")).union(trails.select("node")).distinct()
    used = trails.select(F.explode("path").alias("relation_id"))
    return nodes, used.join(edges, "relation_id")


def merge_subgraphs(edges: DataFrame, sequence: str) -> DataFrame:
    """The first edge of each (group, doc, type, description, confidence): the key has no ends, so edges can collapse."""
    key = ["group_id", "doc_id", "relation_type", "description", "confidence"]
    rest = [c for c in edges.columns if c not in key]
    first = edges.groupBy(*key).agg(F.min_by(F.struct(*rest), sequence).alias("_e"))  # combined map-side, no window
    return first.select(*(F.col(c) if c in key else F.col(f"_e.{c}").alias(c) for c in edges.columns))


def group_sample(edges: DataFrame, limit: int = 200) -> DataFrame:
    """Edges from both ends, by relation_id and start."""
    return undirected(edges).orderBy("relation_id", "from").limit(limit)
