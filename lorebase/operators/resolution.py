"""Entity resolution: clusters, fusion, alias maps, alignment to the group's level, mentions."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import ids, vectors
from ..functions.text import norm, strip
from ..session import written
from . import cells

# Cosine from which a vector match counts, and the gap below it in which a model decides.
VECTOR, GAP, RATIO = 0.90, 0.05, 3.0
#: Fixed value: the first cluster of entities that a density clustering leaves alone.
NOISE_FROM = 10_000_000


def with_ordinals(entities: DataFrame, scope: list[str], order: list[str]) -> DataFrame:
    """Running numbers e1 to eN over chunks and the entities in them."""
    return entities.withColumn("seq", F.row_number().over(Window.partitionBy(*scope).orderBy(*order))).withColumn("entity_no", F.concat(F.lit("e"), F.col("seq")))


def exact_clusters(entities: DataFrame, scope: list[str]) -> DataFrame:
    """Adds `cluster`: entities of one trimmed name, numbered by first appearance."""
    named = entities.withColumn("_name", strip(F.col("name")))
    first = named.groupBy(*scope, "_name").agg(F.min("seq").alias("_first"))
    numbered = first.withColumn("cluster", F.row_number().over(Window.partitionBy(*scope).orderBy("_first")) - 1)
    return named.join(numbered.drop("_first"), [*scope, "_name"]).drop("_name")


def fuse(entities: DataFrame, keys: list[str]) -> DataFrame:
    """One entity of each name in a cluster: first type that isn't blank, else Unknown; the first longest description."""
    name, kind = strip(F.col("name")), strip(F.coalesce("type", F.lit("")))
    text = strip(F.coalesce("description", F.lit("")))
    return (
        entities.withColumns({"canonical_name": name, "_type": kind, "_text": text}).filter("canonical_name <> ''")
        .groupBy(*keys, "canonical_name")
        .agg(
            F.coalesce(F.min_by(F.when(F.col("_type") != "", F.col("_type")), F.when(F.col("_type") != "", F.col("seq"))), F.lit("Unknown")).alias("type"),
            F.max_by("_text", F.struct(F.length("_text"), -F.col("seq"))).alias("description"),
            F.min("seq").alias("seq"),
        )
    )


def alias_map(fused: DataFrame, scope: list[str]) -> DataFrame:
    """(alias, canonical_name): the first mapping of a name wins, an entity's own name going before its aliases."""
    own = F.concat(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>")))
    every = fused.select(*scope, "canonical_name", "seq", F.posexplode(own).alias("pos", "alias")).filter("alias <> ''")
    return every.groupBy(*scope, "alias").agg(F.min_by("canonical_name", F.struct("seq", "pos")).alias("canonical_name"))


def rewrite(relations: DataFrame, aliases: DataFrame, scope: list[str]) -> DataFrame:
    """Relations with their ends under their canonical names; unknown names stay. Names match exactly."""
    out = relations
    for end in ("subject", "object"):
        told = aliases.select(*scope, F.col("alias").alias(end), F.col("canonical_name").alias("_to"))
        out = out.join(told, [*scope, end], "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
    return out


def cosine(a: Column, b: Column) -> Column:
    return vectors.cosine(a, b)


def align(new: DataFrame, old: DataFrame, vector_threshold: float = VECTOR, gap: float = GAP, staged=None) -> DataFrame:
    """How each new entity finds its global one: (seq, canonical_name, global_entity_id, method, score).

    new: seq, group_id, canonical_name, type, aliases, embedding. old: global_entity_id, group_id, canonical_name, type,
    aliases, embedding, seq. Old entities are a fixed snapshot, so each new one is decided by itself: by name among old
    names and aliases, then by its aliases in order, then by the best cosine among old ones of the same or no type.
    The vector step joins only what the names left, by group and type: an old entity stands under its type and under
    any type, a new one looks under its own type and none, or, if it has none, under any. Vectors of a group and type
    are compared cell by cell, as far as a cell's bound can beat what a new entity has found (`cells.nearest`); hot
    types are split over tasks. staged(df), if given, writes a table between the steps and reads it.
    """
    keys = old.select("group_id", "global_entity_id", "seq", F.posexplode(F.concat(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("place", "_n"))
    keys = keys.withColumn("_n", norm(F.col("_n"))).filter("_n <> ''").groupBy("group_id", "_n").agg(F.min_by("global_entity_id", F.struct("seq", "place")).alias("global_entity_id"))
    tries = new.select("seq", "group_id", F.posexplode(F.concat(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("pos", "_n")).withColumn("_n", norm(F.col("_n")))
    by_name = tries.join(keys, ["group_id", "_n"]).groupBy("seq").agg(F.min_by(F.struct("pos", "global_entity_id"), "pos").alias("hit"))
    told = new.join(by_name, "seq", "left")
    kind = F.coalesce("type", F.lit(""))
    typed = F.concat(F.lit("="), kind)
    asked = F.when(kind == "", F.array(F.lit("any"))).otherwise(F.array(typed, F.lit("=")))
    left = told.filter("hit is null").select(F.col("seq").alias("query"), "group_id", F.explode(asked).alias("_as"), F.col("embedding").alias("vector"))
    offered = old.select(F.col("global_entity_id").alias("key"), F.col("seq").alias("tie"), "group_id", F.explode(F.array(typed, F.lit("any"))).alias("_as"), F.col("embedding").alias("vector"))
    found = cells.nearest(left, offered, 1, ["group_id", "_as"], staged=staged).hits
    # a new entity that has old ones to be held against, but no vector that can be, is as far as can be
    offers = left.select("query", "group_id", "_as").join(offered.select("group_id", "_as").distinct(), ["group_id", "_as"], "left_semi").select("query").distinct()
    near = offers.join(found, "query", "left")
    best = near.select(F.col("query").alias("seq"), F.struct(F.col("key").alias("global_entity_id"), F.coalesce("score", F.lit(-1.0)).alias("score")).alias("near"))
    out = told.join(best, "seq", "left")
    named, near = F.col("hit").isNotNull(), F.col("near.score")
    method = (
        F.when(named & (F.col("hit.pos") == 0), "exact_name").when(named, "alias").when(near >= vector_threshold, "vector_match")
        .when(near >= vector_threshold - gap, "candidate").otherwise("create_global")
    )
    to = F.when(named, F.col("hit.global_entity_id")).when(near >= vector_threshold, F.col("near.global_entity_id")).otherwise(ids.global_entity_id(F.col("group_id"), F.col("canonical_name")))
    return out.select("seq", "canonical_name", to.alias("global_entity_id"), method.alias("method"), F.when(~named, near).alias("score"))


def merge_entities(hits: DataFrame) -> DataFrame:
    """(normalised name -> merged entity): the last new entity that hit a global one wins, merged with the snapshot.

    hits: seq, old_name, old_type, old_aliases, old_description, name, type, aliases, description.
    """
    last = hits.groupBy(norm(F.col("old_name")).alias("key")).agg(F.max_by(F.struct(*hits.columns), "seq").alias("h")).select("key", "h.*")
    longer = F.length(F.coalesce("description", F.lit(""))) > F.length(F.coalesce("old_description", F.lit("")))
    union = F.array_sort(F.array_distinct(F.concat(F.coalesce("old_aliases", F.array().cast("array<string>")), F.coalesce("aliases", F.array().cast("array<string>")), F.array("name"))))
    return last.select("key", F.col("old_name").alias("canonical_name"), F.when(F.coalesce("old_type", F.lit("")) != "", F.col("old_type")).otherwise(F.col("type")).alias("type"), union.alias("aliases"), F.when(longer, F.col("description")).otherwise(F.col("old_description")).alias("description"))


def merge_relations(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations of the group: ends looked up by name, unknown ones skipped; longest description, greatest confidence."""
    known = entities.select("group_id", norm(F.col("canonical_name")).alias("_n"), "global_entity_id", "canonical_name").dropDuplicates(["group_id", "_n"])
    out = relations
    for end in ("subject", "object"):
        side = known.select("group_id", F.col("_n").alias(f"_{end}"), F.col("global_entity_id").alias(f"{end}_id"), F.col("canonical_name").alias(f"{end}_name"))
        out = out.withColumn(f"_{end}", norm(F.col(end))).join(side, ["group_id", f"_{end}"])
    key = ["group_id", "subject_id", "relation_type", "object_id"]
    text = F.coalesce("description", F.lit(""))
    merged = out.groupBy(*key).agg(F.max_by("description", F.struct(F.length(text), text)).alias("description"), F.max("confidence").alias("confidence"), F.min("subject_name").alias("subject"), F.min("object_name").alias("object"))
    return merged.withColumn("global_relation_id", ids.global_relation_id(F.col("group_id"), F.col("subject_id"), F.col("relation_type"), F.col("object_id")))


def _last(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One value of each key: that of the last row by `seq`, or the greatest if rows have no order."""
    order = "seq" if "seq" in rows.columns else value
    return rows.groupBy(*keys).agg(F.max_by(value, F.struct(order, value)).alias(value))


def _renamed(rows: DataFrame, aliases: DataFrame, column: str, key: str) -> DataFrame:
    """Adds `key`: the normalised canonical name that the alias map gives a name, else the name itself.

    A map with doc_id holds for names of its own documents only.
    """
    scope = [c for c in ("group_id", "doc_id") if c in aliases.columns]
    amap = _last(aliases.withColumn("_n", norm(F.col("alias"))).filter("_n <> ''"), [*scope, "_n"], "canonical_name").withColumnRenamed("canonical_name", "_c")
    return rows.withColumn("_n", norm(F.col(column))).join(amap, [*scope, "_n"], "left").withColumn(key, norm(F.coalesce("_c", column))).drop("_n", "_c")


def entity_mentions(found: DataFrame, aliases: DataFrame, local: DataFrame, overall: DataFrame) -> DataFrame:
    """Mentions of extracted entities (group_id, doc_id, chunk_id, name, type, description, chunk_text): both levels are required.

    The name goes through the alias map, then into the local and the global entities, all by normalised name; of rows
    with one key the last counts.
    """
    scope = ["group_id", "doc_id"]
    step = _renamed(found, aliases, "name", "_k")
    loc = _last(local.withColumns({"_k": norm(F.col("canonical_name")), "local_entity_id": F.col("entity_id")}), [*scope, "_k"], "local_entity_id")
    glob = _last(overall.withColumn("_k", norm(F.col("canonical_name"))), ["group_id", "_k"], "global_entity_id")
    out = step.join(loc, [*scope, "_k"]).join(glob, ["group_id", "_k"])
    name = strip(F.col("name"))
    key = F.concat_ws(":", F.lit("ent_mention"), "group_id", "doc_id", "chunk_id", name, "type")
    return out.select(
        ids.uuid5(key).alias("mention_id"), *scope, "chunk_id", name.alias("entity_name"), F.col("type").alias("entity_type"), "description",
        F.left("chunk_text", F.lit(1000)).alias("evidence_text"), "local_entity_id", "global_entity_id",
    )


def relation_mentions(found: DataFrame, aliases: DataFrame, local: DataFrame, overall: DataFrame) -> DataFrame:
    """Mentions of extracted relations (group_id, doc_id, chunk_id, subject, object, relation_type, description, chunk_text).

    As `entity_mentions`, by both ends; the type matches exactly.
    """
    scope, ends = ["group_id", "doc_id"], ["_s", "relation_type", "_o"]
    step = _renamed(_renamed(found, aliases, "subject", "_s"), aliases, "object", "_o")
    keyed = lambda rows: rows.withColumns({"_s": norm(F.col("subject")), "_o": norm(F.col("object"))})
    loc = _last(keyed(local).withColumn("local_relation_id", F.col("relation_id")), [*scope, *ends], "local_relation_id")
    glob = _last(keyed(overall), ["group_id", *ends], "global_relation_id")
    out = step.join(loc, [*scope, *ends]).join(glob, ["group_id", *ends])
    subject, obj = strip(F.col("subject")), strip(F.col("object"))
    key = F.concat_ws(":", F.lit("rel_mention"), "group_id", "doc_id", "chunk_id", subject, "relation_type", obj)
    return out.select(
        ids.uuid5(key).alias("mention_id"), *scope, "chunk_id", subject.alias("subject"), obj.alias("object"), "relation_type", "description",
        F.left("chunk_text", F.lit(1000)).alias("evidence_text"), "local_relation_id", "global_relation_id",
    )


def length_ratio(a: Column, b: Column) -> Column:
    """Longer over shorter trimmed length (1 at least); 0 if both are blank."""
    x, y = F.length(strip(F.coalesce(a, F.lit("")))), F.length(strip(F.coalesce(b, F.lit(""))))
    return F.when((x == 0) & (y == 0), 0.0).otherwise(F.greatest(x, y) / F.greatest(F.lit(1), F.least(x, y)))


def fuse_clusters(entities: DataFrame, keys: list[str], call: Callable[[str], str], tries: int = 3, shown: list[str] | None = None, staged: Callable[[DataFrame], DataFrame] = written) -> DataFrame:
    """Fused entities of each cluster by a model: (keys, canonical_name, type, aliases, description, seq, errors).

    The model gets a cluster's entities as JSON (ordered by seq, with the columns `shown`, by default the keys) and answers with a JSON list. A cluster whose call
    fails, or whose reply has no usable entity, is fused by `fuse`. Clusters are spread over the workers as rows; one
    cluster is one prompt, so its size is what the model can read. staged(rows) writes the replies and reads them, so that
    the model is asked once for each cluster.
    """
    from ..functions import models, replies

    row = F.struct("seq", *(keys if shown is None else shown), "name", "type", "description")
    prompts = entities.groupBy(*keys).agg(F.to_json(F.sort_array(F.collect_list(row))).alias("prompt"), F.min("seq").alias("seq"))
    replied = staged(prompts.select(*keys, "seq", models.answered(call, F.col("prompt"), tries).alias("_a")))
    told = replied.withColumn("_v", replies.first_value(F.col("_a.reply")))
    told = told.withColumn("_f", replies.fused_entities(F.col("_v")))
    errors = F.when(F.col("_a.error").isNotNull(), F.array("_a.error")).otherwise(F.col("_f.errors"))
    good = told.filter(F.size("_f.entities") > 0).select(*keys, "seq", errors.alias("errors"), F.explode("_f.entities").alias("e")).select(*keys, "e.*", "seq", "errors")
    bad = told.filter(F.size("_f.entities") == 0).select(*keys, errors.alias("errors"))
    rest = fuse(entities.join(bad.select(*keys), keys, "left_semi"), keys).withColumn("aliases", F.array().cast("array<string>")).join(bad, keys)
    return good.unionByName(rest)


def _dealt(rows: DataFrame, keys: list[str], budget: int, name: dict[str, str], by_name: bool) -> DataFrame:
    """Adds the part of a cluster that an entity is asked about in: no part's prompt is over the budget, unless one entity is.

    Entities are spread over buckets of some 16 parts by a hash, so that no task holds a cluster (of the name alone: those
    of one name meet), and filled up by running sums in each: a part has what begins within half the budget, one of more
    than that stands alone.
    """
    half = max(1, budget // 2)
    row = F.struct("seq", *keys, "name", "type", "description")
    sized = rows.withColumn(name["size"], F.length(F.to_json(row)) + 1)
    total = sized.groupBy(*keys).agg(F.sum(name["size"]).alias(name["total"]))
    spread = sized.join(total, keys).withColumn(name["bucket"], F.when(F.col(name["total"]) <= half, 0).otherwise(F.pmod(F.xxhash64(*(["name"] if by_name else ["name", "seq"])), F.ceil(F.col(name["total"]) / (16 * half)))).cast("int"))
    small = F.col(name["size"]) <= half
    before = Window.partitionBy(*keys, name["bucket"], small).orderBy("name", "seq").rowsBetween(Window.unboundedPreceding, -1)
    begun = F.coalesce(F.sum(name["size"]).over(before), F.lit(0))
    part = F.concat_ws(":", name["bucket"], F.when(F.col(name["total"]) <= half, F.lit("all")).when(small, F.floor(begun / half).cast("string")).otherwise(F.concat(F.lit("alone"), F.row_number().over(Window.partitionBy(*keys, name["bucket"], small).orderBy("name", "seq")).cast("string"))))
    return spread.withColumn(name["part"], part).drop(name["size"], name["total"], name["bucket"])


def fuse_tree(entities: DataFrame, keys: list[str], call: Callable[[str], str], budget: int, tries: int = 3, levels: int = 16, staged: Callable[[DataFrame], DataFrame] = written) -> DataFrame:
    """`fuse_clusters` for clusters of any size: parts within the budget (characters) are fused level by level.

    A level asks about each part by itself; what comes back are the entities of the next level, until a cluster has one
    part. What two levels on end no longer make smaller stays in its parts, whose entities of one name are then fused by
    `fuse`. Aliases that any level told stay with the entity that carries them, or its new name. staged(rows)
    writes a level and reads it, so that the model is asked once and a level's plan doesn't hold those before it.
    """
    name = {x: f"{x}_{uuid.uuid4().hex}" for x in ("size", "total", "bucket", "part", "parts", "n", "was", "carried", "key")}
    level = entities.select(*keys, "seq", "name", "type", "description", F.array().cast("array<string>").alias(name["carried"]))
    done: list[DataFrame] = []
    sizes: list[int] = []
    for at in range(levels):
        dealt = staged(_dealt(level, keys, budget, name, at % 2 == 1))
        told = fuse_clusters(dealt, [*keys, name["part"]], call, tries, shown=keys, staged=staged)
        # names that led to a fused entity: its own, or those that it tells as aliases
        said = told.select(*keys, name["part"], "canonical_name", F.explode(F.array_distinct(F.concat(F.array("canonical_name"), "aliases"))).alias(name["key"]))
        kept = dealt.select(*keys, name["part"], strip(F.col("name")).alias(name["key"]), F.explode(name["carried"]).alias("alias"))
        carried = said.join(kept, [*keys, name["part"], name["key"]]).groupBy(*keys, name["part"], "canonical_name").agg(F.collect_set("alias").alias(name["was"]))
        fused = told.join(carried, [*keys, name["part"], "canonical_name"], "left").withColumn("aliases", _all_aliases(F.col("aliases"), F.col(name["was"]))).drop(name["was"])
        counts = fused.groupBy(*keys).agg(F.count_distinct(name["part"]).alias(name["parts"]), F.count("*").alias(name["n"]))
        fused = staged(fused.join(counts, keys))
        done.append(fused.filter(F.col(name["parts"]) == 1).select(*keys, "canonical_name", "type", "aliases", "description", "seq", "errors"))
        rest = fused.filter(F.col(name["parts"]) > 1)
        left = rest.count()
        if not left:
            return reduce(DataFrame.unionByName, done)
        sizes.append(left)
        if len(sizes) > 2 and left >= sizes[-3]:
            break
        level = rest.select(*keys, "seq", F.col("canonical_name").alias("name"), "type", "description", F.col("aliases").alias(name["carried"]))
    same = rest.groupBy(*keys, "canonical_name").agg(
        F.min_by("type", "seq").alias("type"), _all_aliases(F.flatten(F.collect_set("aliases"))).alias("aliases"),
        F.max_by("description", F.struct(F.length(F.coalesce("description", F.lit(""))), -F.col("seq"))).alias("description"), F.min("seq").alias("seq"), F.array_distinct(F.flatten(F.collect_list("errors"))).alias("errors"),
    )
    return reduce(DataFrame.unionByName, [*done, same])


def entity_text() -> Column:
    """What an entity is embedded as for alignment: name, aliases, type and description."""
    blank = lambda c: F.nullif(strip(F.coalesce(c, F.lit(""))), F.lit(""))
    return F.concat_ws("\n", blank(F.col("canonical_name")), F.nullif(F.array_join("aliases", ", "), F.lit("")), blank(F.col("type")), blank(F.col("description")))


def align_group(new: DataFrame, old: DataFrame, staged=None) -> DataFrame:
    """`align` of documents' entities (group_id, doc_id, canonical_name, type, aliases, description, embedding) with the
    group's level, in the shape of alignment rows: (group_id, doc_id, local_entity_id, local_name, global_entity_id,
    global_name, method, score, type, aliases, description).

    Old entities of one name or alias are told apart by their id's order; a new one that finds none makes its own.
    """
    keyed = new.withColumn("local_entity_id", ids.entity_id(F.col("group_id"), F.col("doc_id"), F.col("canonical_name")))
    mine = keyed.withColumn("seq", F.col("local_entity_id"))
    known = old.withColumn("seq", F.xxhash64("global_entity_id"))
    told = align(mine, known, staged=staged).select(F.col("seq").alias("local_entity_id"), "global_entity_id", "method", "score")
    names = old.select("group_id", "global_entity_id", F.col("canonical_name").alias("_old"))
    out = keyed.join(told, "local_entity_id").join(names, ["group_id", "global_entity_id"], "left")
    return out.select("group_id", "doc_id", "local_entity_id", F.col("canonical_name").alias("local_name"), "global_entity_id", F.coalesce("_old", "canonical_name").alias("global_name"), "method", "score", "type", "aliases", "description")


def _all_aliases(*parts: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.array_sort(F.array_distinct(F.filter(F.concat(*(F.coalesce(p, none) for p in parts)), lambda x: strip(x) != "")))


def merged_level(told: DataFrame, old: DataFrame) -> DataFrame:
    """Global entities that alignments made or touched: the old type, else the first that isn't blank by document; all
    aliases and names; the longest description, the old one if none is longer."""
    length = F.length(F.coalesce("description", F.lit("")))
    kind = F.nullif(strip(F.coalesce("type", F.lit(""))), F.lit(""))
    new = told.groupBy("group_id", "global_entity_id").agg(
        F.min_by("global_name", "doc_id").alias("canonical_name"), F.min_by(kind, F.when(kind.isNotNull(), F.struct("doc_id", "local_name"))).alias("type"),
        F.collect_set("local_name").alias("names"), F.array_distinct(F.flatten(F.collect_set("aliases"))).alias("aliases"),
        F.max_by("description", F.struct(length, "description")).alias("description"),
    )
    was = old.select("group_id", "global_entity_id", F.col("type").alias("_type"), F.col("aliases").alias("_aliases"), F.col("description").alias("_text"))
    j = new.join(was, ["group_id", "global_entity_id"], "left")
    longer = length > F.length(F.coalesce("_text", F.lit("")))
    return j.select(
        "global_entity_id", "group_id", "canonical_name", F.coalesce(F.nullif("_type", F.lit("")), "type", F.lit("")).alias("type"),
        _all_aliases(F.col("_aliases"), F.col("aliases"), F.col("names"), F.array("canonical_name")).alias("aliases"),
        F.when(longer | F.col("_text").isNull(), F.col("description")).otherwise(F.col("_text")).alias("description"),
    )


def rewritten_entities(told: DataFrame, old: DataFrame) -> DataFrame:
    """Documents' entities under their global names; those that now share one are merged, ids follow the new name."""
    was = old.select("group_id", "global_entity_id", F.col("type").alias("_type"), F.col("aliases").alias("_aliases"), F.col("description").alias("_text"))
    j = told.join(was, ["group_id", "global_entity_id"], "left")
    text = F.when(F.length(F.coalesce("description", F.lit(""))) > F.length(F.coalesce("_text", F.lit(""))), F.col("description")).otherwise(F.coalesce("_text", "description"))
    one = j.select("group_id", "doc_id", F.col("global_name").alias("canonical_name"), F.coalesce(F.nullif("_type", F.lit("")), "type").alias("type"), _all_aliases(F.col("aliases"), F.col("_aliases")).alias("aliases"), text.alias("description"), "local_name")
    scope = ["group_id", "doc_id", "canonical_name"]
    merged = one.groupBy(*scope).agg(F.min_by("type", "local_name").alias("type"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("aliases")))).alias("aliases"), F.max_by("description", F.struct(F.length("description"), "description")).alias("description"))
    return merged.withColumn("entity_id", ids.entity_id(F.col("group_id"), F.col("doc_id"), F.col("canonical_name")))


def alignment_map(told: DataFrame) -> DataFrame:
    """(group_id, doc_id, alias, canonical_name): a document's names and aliases to global names, own names going first."""
    own = F.concat(F.array("local_name"), F.coalesce("aliases", F.array().cast("array<string>")))
    every = told.select("group_id", "doc_id", F.posexplode(own).alias("pos", "alias"), "global_name").filter("alias <> ''")
    return every.groupBy("group_id", "doc_id", "alias").agg(F.min_by("global_name", F.struct("pos", "global_name")).alias("canonical_name"))


def aligned_relations(relations: DataFrame, entities: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(global relations that these make or change, alignment rows). Relations without both global ends are left out.

    A stored global relation keeps its id; descriptions and confidences are merged with it, the longest and greatest.
    """
    made = merge_relations(relations, entities)
    was = stored.select("group_id", "global_relation_id", F.col("description").alias("_text"), F.col("confidence").alias("_confidence"))
    longer = F.length(F.coalesce("description", F.lit(""))) > F.length(F.coalesce("_text", F.lit("")))
    level = made.join(was, ["group_id", "global_relation_id"], "left").withColumns({"description": F.when(longer | F.col("_text").isNull(), F.col("description")).otherwise(F.col("_text")), "confidence": F.greatest("confidence", "_confidence")}).drop("_text", "_confidence")
    method = F.when(F.col("_known"), "merge_global_relation").otherwise("create_global_relation")  # fixed values
    known = stored.select("group_id", "global_relation_id", F.lit(True).alias("_known"))
    ends = made.join(known, ["group_id", "global_relation_id"], "left").select("group_id", "relation_type", "global_relation_id", method.alias("_method"), norm(F.col("subject")).alias("_s"), norm(F.col("object")).alias("_o"))
    keyed = relations.withColumns({"_s": norm(F.col("subject")), "_o": norm(F.col("object"))})
    links = keyed.join(ends, ["group_id", "relation_type", "_s", "_o"]).select(
        "group_id", "doc_id", F.col("relation_id").alias("local_relation_id"), "global_relation_id", "subject", "object", "relation_type",
        F.col("_method").alias("alignment_method"), F.lit(None).cast("double").alias("alignment_score"),
    )
    return level, links
