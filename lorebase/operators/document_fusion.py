"""Entities of a document fused by meaning: vectors, density clusters, one model's answer for each cluster, names made one."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import models
from ..functions.text import strip
from ..session import written
from . import density, resolution


def one_of_each_name(fused: DataFrame, scope: list[str]) -> DataFrame:
    """Entities that several clusters gave one name: the first type that isn't blank, all aliases, the first longest description."""
    kind = F.nullif(strip(F.coalesce("type", F.lit(""))), F.lit(""))
    length = F.length(F.coalesce("description", F.lit("")))
    # the rest of a row decides where two of one name begin at the same place, so reruns agree
    return fused.groupBy(*scope, "canonical_name").agg(
        F.coalesce(F.min_by(kind, F.when(kind.isNotNull(), F.struct("seq", "type"))), F.lit("Unknown")).alias("type"),
        resolution._all_aliases(F.flatten(F.collect_set("aliases"))).alias("aliases"),
        F.max_by("description", F.struct(length, -F.col("seq"), "description")).alias("description"),
        F.min("seq").alias("seq"),
    )


def fuse_by_meaning(
    entities: DataFrame, scope: list[str], embed: Callable[[str], Sequence[float]], call: Callable[[str], str],
    budget: int = 24_000, min_cluster_size: int = 2, tries: int = 3, staged: Callable[[DataFrame], DataFrame] = written,
) -> DataFrame:
    """(scope, canonical_name, type, aliases, description, seq) of entities (scope, seq, name, type, description).

    A scope's entities are clustered by the density of their vectors (`density.density_clusters`; one that fits no
    cluster is a cluster of its own), and each cluster is fused by the model, in prompts of at most `budget` characters
    (`resolution.fuse_tree`). Where the model fails or says nothing usable, the cluster is fused by name. Entities
    without a name are left out. Vectors are asked for once, and so is the model.
    """
    named = entities.select(*scope, "seq", "name", "type", "description").filter(strip(F.col("name")) != "")
    text = named.withColumns({"canonical_name": F.col("name"), "aliases": F.array().cast("array<string>")}).select(*named.columns, resolution.entity_text().alias("said"))
    seen = staged(text.withColumn("embedding", models.embedded(embed, F.col("said"))).drop("said"))
    clusters = density.density_clusters(seen, scope, min_cluster_size=min_cluster_size, staged=staged).drop("embedding")
    return one_of_each_name(resolution.fuse_tree(clusters, [*scope, "cluster"], call, budget, tries, staged=staged), scope)
