"""Evidence of graph hits, the combined graph search, and texts and counts of results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import graph
from .progress import pick_names
from .search import GLOBAL

#: Mentions of an answer, seeds of a graph search, relations and entities that it lists.
MENTIONS, SEEDS, LISTED = 300, 8, 200


def mentions_of(hits: DataFrame, mentions: DataFrame, level: str, doc_id: str | None = None, limit: int = MENTIONS) -> DataFrame:
    """Mentions of the hits (source_id, doc_id): by global id if a hit is of the group's level, else by local id.

    Newest documents first, then by chunk and id, at most `limit`. Hits without source_id have none. One mention is
    listed once, whatever hits it answers.
    """
    asked = hits.select(T.strip(F.coalesce("source_id", F.lit(""))).alias("_id"), (T.strip(F.coalesce("doc_id", F.lit(""))) == GLOBAL).alias("_global")).filter("_id <> ''").distinct()
    some = mentions.filter(F.col("doc_id") == doc_id) if doc_id else mentions
    both = F.array(F.struct(F.col(f"global_{level}_id").alias("_id"), F.lit(True).alias("_global")), F.struct(F.col(f"local_{level}_id").alias("_id"), F.lit(False).alias("_global")))
    # a semi-join that needs one key: each mention stands under its two ids
    found = some.select("mention_id", F.explode(both).alias("k")).select("mention_id", "k._id", "k._global").join(asked, ["_id", "_global"], "left_semi").select("mention_id").distinct()
    return some.join(found, "mention_id", "left_semi").orderBy(F.desc("doc_id"), "chunk_id", "mention_id").limit(limit)


def chunks_of(mentions: DataFrame, chunks: DataFrame) -> DataFrame:
    """The distinct chunks that mentions stand in, by document and place."""
    keys = ["group_id", "chunk_id"]
    return chunks.join(mentions.select(*keys).distinct(), keys, "left_semi").orderBy("doc_id", "chunk_index", "chunk_id")


def graph_search(entity_hits: DataFrame, relation_hits: DataFrame, relations: DataFrame, entities: DataFrame, entity_mentions: DataFrame, relation_mentions: DataFrame, chunks: DataFrame, doc_id: str | None = None) -> dict[str, DataFrame]:
    """The parts of an answer: seeds, relations at them, their ends, mentions of all hits, and the chunks these stand in.

    entity_hits: pos, name, source_id, doc_id; relation_hits: pos, head_name, tail_name, source_id, doc_id. The seeds
    are a table of at most SEEDS names, so what is joined to them may be broadcast; nothing is collected.
    """
    seeds = pick_names(entity_hits, relation_hits, SEEDS).select(F.col("name").alias("_name"))
    known = entities.select("canonical_name", F.explode(F.array_distinct(F.concat(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("_name"))
    at = known.join(F.broadcast(seeds), "_name", "left_semi").select(F.col("canonical_name").alias("from")).distinct()
    incident = graph.undirected(relations).join(at, "from", "left_semi").drop("from", "to").dropDuplicates(["relation_id"]).orderBy("relation_id").limit(LISTED)
    ends = incident.select(F.explode(F.array("subject", "object")).alias("canonical_name")).distinct()
    around = entities.join(ends, "canonical_name", "left_semi").orderBy("canonical_name").limit(LISTED)
    of_entities = mentions_of(entity_hits, entity_mentions, "entity", doc_id)
    of_relations = mentions_of(relation_hits, relation_mentions, "relation", doc_id)
    both = of_entities.select("group_id", "chunk_id").unionByName(of_relations.select("group_id", "chunk_id"))
    return {
        "seeds": seeds.withColumnRenamed("_name", "name"), "relations": incident, "entities": around,
        "entity_mentions": of_entities, "relation_mentions": of_relations, "chunks": chunks_of(both, chunks),
    }


def result_counts(parts: dict[str, DataFrame]) -> DataFrame:
    """(part, n, used): rows of each part of a result, and whether there are any."""
    out = None
    for name, rows in parts.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n", (F.col("n") > 0).alias("used"))
        out = one if out is None else out.unionByName(one)
    return out


def expand_by_triples(edges: DataFrame, triples: DataFrame, depth: int = 2, limit: int | None = 50) -> DataFrame:
    """k-hop trails from the heads and tails (columns head, tail) of triples; blank names are no seeds."""
    seeds = triples.select(F.explode(F.array("head", "tail")).alias("name")).select(T.strip("name").alias("name")).filter("name <> ''").distinct()
    return graph.khop(edges, seeds, depth, limit)


def _labelled(*fields: tuple[str, Column]) -> Column:
    parts = [F.when(value != "", F.concat(F.lit(f"{label}: "), value)) for label, value in fields]
    return F.concat_ws("\n", *parts)


def _text(name: str) -> Column:
    return T.strip(F.coalesce(F.col(name).cast("string"), F.lit("")))


def _aliases() -> Column:
    return F.array_join(F.filter(F.transform(F.coalesce("aliases", F.array().cast("array<string>")), T.strip), lambda x: x != ""), ", ")


def node_text() -> Column:
    """What a reranker reads of a node (name, aliases, type, description, doc_name): labelled lines, blank ones left out."""
    told = _labelled(("name", _text("name")), ("aliases", _aliases()), ("type", _text("type")), ("description", _text("description")), ("doc", _text("doc_name")))
    return F.when(told == "", "node").otherwise(told)


def hit_text() -> Column:
    """What a reranker reads of a graph-index hit: as `node_text`, and a line for its triple; the name under any of its names."""
    name = T.first_non_empty(_text("canonical_name"), _text("name"), _text("entity_name"))
    triple = F.concat_ws(" ", *(F.nullif(_text(c), F.lit("")) for c in ("head_name", "relation_type", "tail_name")))
    told = _labelled(("name", F.coalesce(name, F.lit(""))), ("aliases", _aliases()), ("type", _text("type")), ("triple", triple), ("description", _text("description")), ("doc", _text("doc_name")))
    return F.when(told == "", "hit").otherwise(told)


def cluster_text(separator: str = "｜") -> Column:
    """What is embedded of an entity for clustering: name, type and description, without separators at the ends."""
    return F.regexp_replace(F.concat_ws(separator, _text("name"), _text("type"), _text("description")), f"^{separator}+|{separator}+$", "")


def compact_items(items: DataFrame, keys: Sequence[str], limit: int = 5, width: int = 320) -> DataFrame:
    """The first few items of each key (pos counts them from 0), in the columns that an agent reads, their text compacted."""
    shown = ("type", "document_name", "doc_id", "chunk_id", "entity_name", "relation", "score", "mode", "label")
    have = [c for c in shown if c in items.columns]
    return items.filter(F.col("pos") < limit).select(*keys, "pos", *have, T.compact(F.coalesce("text", F.lit("")), width).alias("text"))


def first_evidence(steps: DataFrame, keys: Sequence[str], limit: int = 20) -> DataFrame:
    """The first pieces of evidence of each key: the arrays of its steps, one after the other."""
    flat = steps.groupBy(*keys).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "evidence"))), lambda x: x["evidence"])).alias("e"))
    return flat.select(*keys, F.posexplode(F.slice("e", 1, limit)).alias("pos", "evidence"))



def entity_index(entities: DataFrame) -> DataFrame:
    """Graph-index rows (without vectors) of entities (group_id, doc_id, entity_id, canonical_name, aliases, description)."""
    text = T.strip(F.concat_ws("\n", F.col("canonical_name"), F.coalesce(F.array_join(F.filter("aliases", lambda a: T.strip(a) != ""), " "), F.lit("")), F.coalesce("description", F.lit(""))))
    none = [F.lit("").alias(c) for c in ("head_name", "tail_name", "relation_type")]
    return entities.select(F.concat(F.lit("e:"), "entity_id").alias("pk"), F.lit("entity").alias("kind"), "group_id", "doc_id", F.col("entity_id").alias("source_id"), F.col("canonical_name").alias("name"), text.alias("text"), *none)


def relation_index(relations: DataFrame) -> DataFrame:
    """Graph-index rows (without vectors) of relations (group_id, doc_id, relation_id, subject, object, relation_type, description)."""
    text = T.strip(F.concat("subject", F.lit(" -["), "relation_type", F.lit("]-> "), "object", F.lit("\n"), F.coalesce("description", F.lit(""))))
    return relations.select(F.concat(F.lit("r:"), "relation_id").alias("pk"), F.lit("relation").alias("kind"), "group_id", "doc_id", F.col("relation_id").alias("source_id"), F.col("relation_type").alias("name"), text.alias("text"), F.col("subject").alias("head_name"), F.col("object").alias("tail_name"), "relation_type")
