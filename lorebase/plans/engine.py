"""The facade: ingest, search by mode, plans of several steps."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from contextlib import ExitStack

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from ..functions import ids, models
from ..functions.chunker import Limits, chunk_documents
from ..operators import ann, document_fusion, evidence, extraction, graph, keyword_index, recovery, resolution, search
from ..operators.progress import plan_items
from ..operators.search import required
from ..schemas import SCHEMAS
from ..sources.store import Store

MODES = ("chunks_vector", "chunks_keyword", "entities", "relations", "relations_by_entities", "entities_by_relations", "graph_search")


def hash_embedding(text: str, dim: int = 64) -> list[float]:
    """A deterministic stand-in for a model: signed counts of hashed words, of unit length."""
    import hashlib
    import math

    v = [0.0] * dim
    for word in text.lower().split():
        h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
        v[h % dim] += 1.0 if h >> 63 else -1.0
    n = math.sqrt(sum(x * x for x in v)) or 1.0
    return [x / n for x in v]


class Engine:
    """Models are functions: embed(text) -> vector, extract(text) -> tagged lines, coreference(text) -> tagged replacements,
    fusion(prompt) -> JSON of a cluster's entities made fewer (without it a document's entities are fused by name); they
    run on the workers in batches. rerank(query, texts) -> scores sees one search's hits."""

    def __init__(self, store: Store, embed: Callable[[str], Sequence[float]] = hash_embedding, extract: Callable[[str], str] | None = None, limits: Limits = Limits(), tries: int = 3, rerank: search.Reranker | None = None, coreference: Callable[[str], str] | None = None, fusion: Callable[[str], str] | None = None, fusion_budget: int = 24_000, min_cluster_size: int = 2):
        self.fusion, self.fusion_budget, self.min_cluster_size = fusion, fusion_budget, min_cluster_size
        self.store, self.embed, self.extract, self.limits, self.tries, self.rerank, self.coreference = store, embed, extract, limits, tries, rerank, coreference

    def _embedded(self, df: DataFrame, text: str, name: str = "embedding") -> DataFrame:
        return df.withColumn(name, models.embedded(self.embed, F.col(text)))

    def ingest(self, docs: DataFrame) -> None:
        """docs: group_id, doc_id, doc_name, doc_time, text. A document that is there already is replaced.

        All tables change together: a run that fails leaves the store as it was. The graph follows as a second change.
        """
        base = docs.select("group_id", "doc_id", "doc_name", "doc_time", F.expr("cast(map() as map<string,string>)").alias("metadata"))
        fresh = docs.select("group_id", "doc_id").distinct()
        chunks = chunk_documents(docs, self.limits)
        with self.store.batch() as store:
            store.forget_graph(fresh)  # a replaced document's graph goes with its text
            for name in ("chunks", "chunk_grams", "chunk_embeddings", "chunk_checkpoints"):
                store.remove(name, fresh)
            store.upsert("documents", base)
            store.upsert("chunks", chunks)
            mine = store.read("chunks").join(docs.select("group_id", "doc_id", "doc_time"), ["group_id", "doc_id"])
            vectors = self._embedded(mine, "text").select(F.concat_ws(":", "group_id", "chunk_id").alias("pk"), "group_id", "doc_id", "doc_time", "chunk_id", "embedding")
            self._put_vectors("chunk_embeddings", vectors)
            store.upsert("chunk_grams", keyword_index.postings(mine))
        if self.extract:
            self.build_graph(fresh)

    def extract_chunks(self, documents: DataFrame) -> None:
        """Extract what documents (group_id, doc_id) have left to extract; a chunk that is done isn't asked for again.

        Each chunk's reply is kept as its checkpoint, so a run that stops goes on from there.
        """
        keys = ["group_id", "doc_id"]
        chunks = self.store.read("chunks").join(documents.select(*keys).distinct(), keys, "left_semi")
        left = recovery.remaining(chunks, self.store.read("chunk_checkpoints"))
        if self.coreference:  # what is extracted is the text with its references resolved
            with self.store.staged(models.resolved(left, self.coreference, F.col("text"), tries=self.tries).select(*left.columns, "resolved_text")) as ready:
                self._extracted(ready)
        else:
            self._extracted(left.withColumn("resolved_text", F.col("text")))

    def _extracted(self, left: DataFrame) -> None:
        keys = ["group_id", "doc_id"]
        told = left.withColumn("_a", models.answered(self.extract, F.col("resolved_text"), self.tries, 0.0))
        status = F.when(F.col("_a.error").isNull(), "completed").otherwise("failed")
        none = F.lit(None).cast(dict(self.store.read("chunk_checkpoints").dtypes)["parsed"])
        rows = told.select(*keys, "chunk_id", "chunk_index", status.alias("status"), "resolved_text", F.coalesce("_a.reply", F.lit("")).alias("raw"), none.alias("parsed"), F.coalesce("_a.error", F.lit("")).alias("error"), recovery.now().alias("updated_at"))
        self.store.upsert("chunk_checkpoints", rows)

    def build_graph(self, documents: DataFrame) -> None:
        """Documents (group_id, doc_id): extract, fuse within each, align with the group's level, write all of it together."""
        self.extract_chunks(documents)
        with ExitStack() as stack, self.store.batch() as store:
            # what several tables are made of is written once; models run and vectors are compared once
            once = lambda rows: stack.enter_context(store.staged(rows))
            keys, scope = ["group_id", "doc_id", "chunk_id", "chunk_index"], ["group_id", "doc_id"]
            mine = once(documents.select(*scope).distinct())
            done = once(recovery.restored(store.read("chunk_checkpoints").join(mine, scope, "left_semi"), store.read("chunks")).select(*keys, "raw", "text"))
            lines = extraction.tagged_lines(done, keys)
            texts = done.select("group_id", "chunk_id", F.col("text").alias("chunk_text"))
            named = once(resolution.with_ordinals(extraction.entities(lines, keys), scope, ["chunk_index", "line"]).join(texts, ["group_id", "chunk_id"]))
            found = once(extraction.relations(lines, keys).join(texts, ["group_id", "chunk_id"]))
            fused = once(self._fused(named, scope, once))
            aliases = once(resolution.alias_map(fused, scope))
            # the group's level as it is now: a fixed snapshot that all new entities are aligned with
            groups = mine.select("group_id").distinct()
            store.forget_graph(mine)
            old = once(store.read("global_entities").join(groups, "group_id", "left_semi"))
            index = store.read("graph_index").filter(F.col("kind") == "entity").filter(F.col("doc_id") == search.GLOBAL).select("group_id", F.col("source_id").alias("global_entity_id"), "embedding")
            asked = once(self._embedded(fused.withColumn("_text", resolution.entity_text()), "_text"))
            told = once(resolution.align_group(asked, old.join(index, ["group_id", "global_entity_id"], "left"), staged=once))
            store.upsert("entity_alignments", told.select(*scope, "local_entity_id", "global_entity_id", "local_name", "global_name", F.col("method").alias("alignment_method"), F.col("score").alias("alignment_score")))
            store.upsert("global_entities", resolution.merged_level(told, old))
            entities = once(resolution.rewritten_entities(told, old))
            store.upsert("entities", entities)
            overall = store.read("global_entities").join(groups, "group_id", "left_semi")
            renamed = resolution.rewrite(resolution.rewrite(found, aliases, scope), resolution.alignment_map(told), scope)
            local = renamed.withColumns({"relation_id": ids.relation_id(F.col("group_id"), F.col("doc_id"), F.col("subject"), F.col("relation_type"), F.col("object")), "seq": F.col("chunk_index") * 100_000 + F.col("line")})
            store.upsert("relations", local)
            new = once(store.read("relations").join(mine, scope, "left_semi"))
            known = store.read("global_relations").join(groups, "group_id", "left_semi")
            level, links = resolution.aligned_relations(new, overall, known)
            store.upsert("relation_alignments", links)
            store.upsert("global_relations", level)
            store.upsert("entity_mentions", resolution.entity_mentions(named, aliases, entities, overall))
            store.upsert("relation_mentions", resolution.relation_mentions(found, aliases, new, store.read("global_relations")))
            self._index(mine)

    def _fused(self, named: DataFrame, scope: list[str], once: Callable[[DataFrame], DataFrame]) -> DataFrame:
        if self.fusion is None:
            return resolution.fuse(named, scope).withColumn("aliases", F.array().cast("array<string>"))
        return document_fusion.fuse_by_meaning(named, scope, self.embed, self.fusion, self.fusion_budget, self.min_cluster_size, self.tries, once)

    def _put_vectors(self, name: str, rows: DataFrame) -> None:
        """Vectors with the list of their nearest centroid (-1 while the table has none); a list's radius grows with them."""
        centroids = self._centroids(name)
        if not len(centroids):
            self.store.upsert(name, rows.withColumn("list", F.lit(-1)))
            return
        # the model's vectors are written first: it isn't asked again when their lists are found
        with self.store.staged(rows) as rows, self.store.staged(ann.build(rows, centroids)) as listed, self.store.batch() as store:
            store.upsert(name, listed)
            new = ann.radii(listed, centroids).withColumn("name", F.lit(name))
            both = new.unionByName(store.read("list_radii").filter(F.col("name") == name).join(new.select("group_id", "list"), ["group_id", "list"], "left_semi"))
            store.upsert("list_radii", both.groupBy("group_id", "name", "list").agg(F.max("radius").alias("radius"), F.max("longest").alias("longest")))

    def _centroids(self, name: str) -> np.ndarray:
        rows = self.store.read("vector_lists").filter(F.col("name") == name).orderBy("list").select("centroid").collect()  # ann.LISTS of them, or 4 times the root of the rows
        return np.array([r[0] for r in rows], np.float32)

    def fit_lists(self, lists: int | None = None) -> None:
        """Inverted lists for both vector tables: centroids from a bounded sample, every vector's list, each group's radii."""
        with self.store.batch() as store:
            for name in ("chunk_embeddings", "graph_index"):
                rows = store.read(name)
                centroids = ann.fit(rows, "pk", lists or ann.lists_for(rows.count()))
                made = store.spark.createDataFrame([(name, i, c.tolist()) for i, c in enumerate(centroids)], SCHEMAS["vector_lists"])
                others = store.read("vector_lists").filter(F.col("name") != name)
                store.replace("vector_lists", others.unionByName(made))
                if len(centroids):
                    with store.staged(ann.build(rows.drop("list"), centroids)) as listed:
                        store.replace(name, listed)
                        radii = ann.radii(listed, centroids).withColumn("name", F.lit(name))
                        store.replace("list_radii", store.read("list_radii").filter(F.col("name") != name).unionByName(radii))

    def lists_of(self, name: str, group_id: str, rows: DataFrame, vector: Sequence[float], top_k: int) -> list[int] | None:
        """The lists that a search of a group's rows has to read, by their bounds (None: all)."""
        if not len(vector) or not len(centroids := self._centroids(name)):
            return None
        mine = search.in_group(self.store.read("list_radii"), group_id).filter(F.col("name") == name)
        return ann.bounded(rows, centroids, {r["list"]: (r["radius"], r["longest"]) for r in mine.collect()}, vector, top_k)  # a row for each list

    def _reached(self, name: str, group_id: str, rows: DataFrame, vector: Sequence[float], top_k: int) -> DataFrame:
        lists = self.lists_of(name, group_id, rows, vector, top_k)
        return rows if lists is None else rows.filter(F.col("list").isin(lists))

    def _index(self, documents: DataFrame) -> None:
        """The graph index of documents and of their groups' level: only rows whose text is new or changed go to the model."""
        store, scope = self.store, ["group_id", "doc_id"]
        groups = documents.select("group_id").distinct()
        level = groups.withColumn("doc_id", F.lit(search.GLOBAL))
        places = documents.select(*scope).unionByName(level)
        e = store.read("global_entities").join(groups, "group_id", "left_semi").withColumns({"doc_id": F.lit(search.GLOBAL), "entity_id": F.col("global_entity_id")})
        r = store.read("global_relations").join(groups, "group_id", "left_semi").withColumns({"doc_id": F.lit(search.GLOBAL), "relation_id": F.col("global_relation_id")})
        cols = ["group_id", "doc_id"]
        every_e = e.select(*cols, "entity_id", "canonical_name", "aliases", "description").unionByName(store.read("entities").join(documents, scope, "left_semi").select(*cols, "entity_id", "canonical_name", "aliases", "description"))
        fields = [*cols, "relation_id", "subject", "object", "relation_type", "description"]
        every_r = r.select(*fields).unionByName(store.read("relations").join(documents, scope, "left_semi").select(*fields))
        rows = evidence.entity_index(every_e).unionByName(evidence.relation_index(every_r))
        known = store.read("graph_index").join(places, scope, "left_semi")
        with store.staged(rows) as rows, store.staged(known.join(rows, "pk", "left_anti").select(*scope, "pk")) as gone:
            same = known.filter("size(embedding) > 0").select("pk", F.col("text").alias("_was"))
            changed = rows.join(same, "pk", "left").filter(~F.col("text").eqNullSafe(F.col("_was"))).drop("_was")
            with store.staged(self._embedded(changed, "text")) as fresh:
                store.remove("graph_index", gone)
                self._put_vectors("graph_index", fresh)

    def retry_chunk(self, group_id: str, doc_id: str, chunk_id: str) -> None:
        """Extract one chunk again, and build its document's graph anew. An unknown chunk is an error."""
        one = self.store.spark.createDataFrame([(group_id, doc_id, chunk_id)], "group_id string, doc_id string, chunk_id string")
        if recovery.chunk_places(one, search.in_group(self.store.read("chunks"), group_id, doc_id)).filter("chunk_index >= 0").isEmpty():
            raise ValueError(f"unknown chunk {chunk_id!r} of document {doc_id!r}")
        self.store.remove("chunk_checkpoints", one)
        self.build_graph(one.select("group_id", "doc_id"))

    def recover(self, active: Sequence[str] = ()) -> int:
        """Take up tasks that were running when the engine stopped (but those in `active`); how many there were."""
        spark = self.store.spark
        running = spark.createDataFrame([(x,) for x in active], "task_id string")
        tasks = recovery.started_again(self.store.read("ingest_tasks"), running, recovery.now())
        number = tasks.count()
        if number:
            self.store.merge_newest("ingest_tasks", tasks)
            if self.extract:
                again = self.store.read("ingest_tasks").filter("status = 'recovering'").select("group_id", "doc_id").distinct()
                self.build_graph(again)
            done = self.store.read("ingest_tasks").filter("status = 'recovering'").withColumns({"status": F.lit("completed"), "updated_at": recovery.now()})
            self.store.merge_newest("ingest_tasks", done)
        return number

    def graph_search(self, group_id: str, query: str, top_k: int = 10, doc_id: str | None = None) -> dict[str, DataFrame]:
        """Entities and relations near the query, up to eight seeds of them, what is around these, and where it is said."""
        mine = lambda t: search.in_group(self.store.read(t), required("group_id", group_id))
        rel, ent = self._graph(group_id, doc_id)
        hits = {m: self.search(m, group_id, query, top_k, doc_id).withColumn("pos", F.struct(-F.col("score"), "pk")) for m in ("entities", "relations")}
        parts = evidence.graph_search(hits["entities"], hits["relations"], rel, ent, mine("entity_mentions"), mine("relation_mentions"), mine("chunks"), doc_id)
        return {"entity_hits": hits["entities"].drop("pos"), "relation_hits": hits["relations"].drop("pos")} | parts

    def _graph(self, group_id: str, doc_id: str | None) -> tuple[DataFrame, DataFrame]:
        """Relations and entities of a document, or of the group's level."""
        if doc_id:
            return tuple(search.in_group(self.store.read(t), group_id, doc_id) for t in ("relations", "entities"))
        rel = search.in_group(self.store.read("global_relations"), group_id).withColumns({"relation_id": F.col("global_relation_id"), "doc_id": F.lit(search.GLOBAL)})
        return rel, search.in_group(self.store.read("global_entities"), group_id).withColumn("doc_id", F.lit(search.GLOBAL))

    def reranked(self, hits: DataFrame, query: str, top_k: int | None = None, text: str = "text") -> DataFrame:
        """A search's hits (as many as it gives, so a bounded number) in the order of the reranker's scores; as they are without one."""
        rows = hits.collect()
        if not self.rerank or not rows:
            return hits
        try:
            scores = [float(x) for x in self.rerank(query, [r[text] or "" for r in rows])]
        except Exception:  # a service that fails leaves the order as it is
            return hits
        order = sorted(range(len(rows)), key=lambda i: (-scores[i], i) if i < len(scores) else (float("inf"), i))
        told = [(*rows[i], place, scores[i] if i < len(scores) else None) for place, i in enumerate(order[:top_k])]
        kind = StructType([*hits.schema, StructField("rerank_place", IntegerType()), StructField("rerank_score", DoubleType())])
        return self.store.spark.createDataFrame(told, kind).orderBy("rerank_place")

    def search(self, mode: str, group_id: str, query: str = "", top_k: int = 20, doc_id: str | None = None, start: str | None = None, end: str | None = None, names: Sequence[str] = (), relation_ids: Sequence[str] = (), triples: Sequence[tuple[str, str, str]] = (), limit: int = 200) -> DataFrame:
        """One of MODES; any other is an error, and so is a blank group."""
        required("group_id", group_id)
        if mode not in MODES:
            raise ValueError(f"unknown mode {mode!r}")
        read = self.store.read
        vector = list(self.embed(query)) if query.strip() else []
        if mode == "chunks_keyword":
            return keyword_index.search(read("chunk_grams"), read("chunks"), read("documents"), group_id, query, top_k, doc_id, start, end)
        if mode == "chunks_vector":
            some = search.in_group(read("chunk_embeddings"), group_id, doc_id, start, end)
            some = self._reached("chunk_embeddings", group_id, some, vector, top_k)
            return search.with_text(search.chunks_vector(some, group_id, vector, top_k), search.in_group(read("chunks"), group_id))
        if mode in ("entities", "relations"):
            kind = "entity" if mode == "entities" else "relation"
            some = search.in_group(read("graph_index"), group_id, search.GLOBAL if doc_id is None else doc_id).filter(F.col("kind") == kind)
            return search.graph_index(self._reached("graph_index", group_id, some, vector, top_k), group_id, kind, vector, top_k, doc_id, fields=[c for c in some.columns if c not in ("embedding", "list")])
        rel, ent = self._graph(group_id, doc_id)
        if mode == "relations_by_entities":
            return graph.relations_by_entities(rel, ent, names, limit)
        if mode == "entities_by_relations":
            return graph.entities_by_relations(rel, ent, relation_ids, triples, limit)
        return self.graph_search(group_id, query, min(top_k, 10), doc_id)["relations"]

    def expand(self, group_id: str, names: Sequence[str], depth: int = 2, limit: int = 50, doc_id: str | None = None) -> DataFrame:
        """Trails of a document's graph, or of the group's level, from the entities that bear the names or have them as aliases.

        A name that no entity has stands for itself. Names are distinct and not blank.
        """
        required("group_id", group_id)
        rel, ent = self._graph(group_id, doc_id)
        asked = self.store.spark.createDataFrame([(n,) for n in dict.fromkeys(x.strip() for x in names) if n], "name string")
        found = graph.named(ent, names).select(F.col("canonical_name").alias("name"))
        return graph.khop(rel, asked.unionByName(found).distinct(), depth, limit)

    def run_plan(self, group_id: str, query: str, steps: Sequence[dict], return_limit: int = 12) -> tuple[DataFrame, list[dict]]:
        """Steps {mode, query, top_k, ...} in order as one table of distinct items; a step that fails is told, others go on."""
        parts, failed = [], []
        for i, step in enumerate(steps):
            try:
                hits = self.search(step["mode"], group_id, step.get("query") or query, int(step.get("top_k") or 10), step.get("doc_id"))
            except (KeyError, ValueError) as e:  # told to the caller; an error of the engine is not caught
                failed.append({"step": i, "error": str(e)})
                continue
            have = set(hits.columns)
            pick = lambda *c: F.coalesce(*(F.col(x).cast("string") for x in c if x in have), F.lit(""))  # noqa: E731, B023
            key = [pick("doc_id"), pick("chunk_id", "pk", "relation_id", "entity_id", "global_entity_id", "canonical_name")]
            # at most top_k or limit rows: their place is that of their sort key, whatever task they are in
            place = F.struct(*([-F.col("score")] if "score" in have else []), *key)
            parts.append(hits.select(F.lit(i).alias("step"), F.to_json(place).alias("_tie"), (-F.col("score") if "score" in have else F.lit(0.0)).cast("double").alias("_by"), F.lit(step["mode"]).alias("mode"), pick("doc_id").alias("doc_id"), pick("chunk_id").alias("chunk_id"), pick("text").alias("text"), pick("name", "canonical_name").alias("entity_name"), pick("relation_type").alias("relation")).withColumn("pos", F.struct("_by", "_tie")).drop("_by", "_tie"))
        if not parts:
            return self.store.spark.createDataFrame([], "step int, pos struct<_by:double,_tie:string>, mode string, doc_id string, chunk_id string, text string, entity_name string, relation string"), failed
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        return plan_items(every, return_limit), failed
