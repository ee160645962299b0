"""Keyed merges, deletes with their cascade, and the store's ordered listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schemas import IMMUTABLE, KEYS, SCHEMAS

ACTIVE = ("pending", "running", "recovering", "cancel_requested")
RECOVERABLE = ("pending", "running", "recovering")


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[table])


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], keep: int = 1) -> DataFrame:
    """The first `keep` rows of each key in the order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_n") <= keep).drop("_n")


def upsert(stored: DataFrame, incoming: DataFrame, keys: Sequence[str], sequence: str, immutable: Sequence[str] = ()) -> DataFrame:
    """Stored rows overlaid by the incoming ones, the last of a key winning; immutable columns keep the stored value.

    Of incoming rows of one key and place in the sequence the greatest as JSON text counts. One shuffle by key: a
    map-side combined arg-max, no window.
    """
    rest = [c for c in stored.columns if c not in keys]
    both = stored.withColumn("_seq", F.lit(None).cast("long")).withColumn("_old", F.lit(True)).unionByName(incoming.withColumn("_seq", F.col(sequence).cast("long")).withColumn("_old", F.lit(False)).select(*stored.columns, "_seq", "_old"))
    if not rest:
        return both.select(*keys).distinct()
    row = F.struct(*rest)
    place = F.struct(~F.col("_old"), "_seq", F.when(~F.col("_old"), F.to_json(row)))
    best = both.groupBy(*keys).agg(F.max_by(row, place).alias("_new"), F.max_by(row, F.when(F.col("_old"), 1)).alias("_first"), F.bool_or("_old").alias("_had"))
    return best.select(*keys, *(F.when(F.col("_had") & F.lit(c in immutable), F.col(f"_first.{c}")).otherwise(F.col(f"_new.{c}")).alias(c) for c in rest)).select(*stored.columns)


def newest(stored: DataFrame, incoming: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The last row of each key by `order`, among stored and incoming ones; a tie goes to the greatest as JSON text.

    Incoming rows may lack columns of the stored ones: what a key's last row has no value for, the one before it gives.
    """
    rest = [c for c in stored.columns if c not in keys]
    have = incoming.select(*[c for c in stored.columns if c in incoming.columns])
    both = stored.unionByName(have, allowMissingColumns=True)
    place = F.struct(order, F.to_json(F.struct(*rest)))
    return both.groupBy(*keys).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), place)).alias(c) for c in rest)).select(*stored.columns)


def upsert_table(name: str, stored: DataFrame, incoming: DataFrame, sequence: str = "seq") -> DataFrame:
    return upsert(stored, incoming, KEYS[name], sequence, IMMUTABLE.get(name, ()))


def duplicate_names(entities: DataFrame) -> DataFrame:
    """(group_id, canonical_name) that more than one global entity has: a merge must not make any."""
    return entities.groupBy("group_id", "canonical_name").agg(F.count_distinct("global_entity_id").alias("n")).filter("n > 1")


def delete(df: DataFrame, test: Column) -> DataFrame:
    return df.filter(~F.coalesce(test, F.lit(False)))


def delete_document(tables: dict[str, DataFrame], group_id: str, doc_id: str, graph_only: bool = False) -> dict[str, DataFrame]:
    """The tables without a document, and without global rows that nothing is aligned to any more; checkpoints stay."""
    here = (F.col("group_id") == group_id) & (F.col("doc_id") == doc_id)
    gone = ["entities", "relations", "entity_alignments", "relation_alignments", "entity_mentions", "relation_mentions"] + ["documents", "chunks"] * (not graph_only)
    out = dict(tables) | {t: delete(tables[t], here) for t in gone if t in tables}
    for level, links, key in (("global_relations", "relation_alignments", "global_relation_id"), ("global_entities", "entity_alignments", "global_entity_id")):
        if level in tables and links in out:
            mine = F.col("group_id") == group_id
            kept = tables[level].filter(mine).join(out[links].select("group_id", key), ["group_id", key], "left_semi")
            out[level] = tables[level].filter(~mine).unionByName(kept)
    return out


def listing(df: DataFrame, order: Sequence[Column | str], limit: int | None) -> DataFrame:
    out = df.orderBy(*order)
    return out if limit is None else out.limit(limit)


def group_documents(documents: DataFrame, group_id: str, limit: int = 200, start: str | None = None, end: str | None = None) -> DataFrame:
    from .search import in_group

    return listing(in_group(documents, group_id, None, start, end), [F.desc("doc_time"), F.desc("doc_id")], limit)


def group_ids(documents: DataFrame, groups: DataFrame, limit: int = 500) -> DataFrame:
    return documents.select("group_id").union(groups.select("group_id")).distinct().orderBy("group_id").limit(limit).filter("trim(group_id) <> ''")


def document_text(chunks: DataFrame) -> DataFrame:
    """Non-blank chunk texts of each document in order, joined by blank lines."""
    parts = F.array_sort(F.collect_list(F.struct("chunk_index", "text")))
    return chunks.filter("trim(text) <> ''").groupBy("group_id", "doc_id").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\n\n").alias("text"))


def mentions(rows: DataFrame, level: str, global_ids: Sequence[str] = (), local_ids: Sequence[str] = (), doc_id: str | None = None, limit: int = 200) -> DataFrame:
    """Mentions of any of the ids; none without ids."""
    hit = F.col(f"global_{level}_id").isin(*global_ids) | F.col(f"local_{level}_id").isin(*local_ids)
    some = rows.filter(hit) if global_ids or local_ids else rows.limit(0)
    some = some.filter(F.col("doc_id") == doc_id) if doc_id else some
    return listing(some, [F.desc("doc_id"), "chunk_id", "mention_id"], limit)
