"""Keyword, vector and graph-index search, and reordering by a reranker."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import trigram, vectors

# Weights and thresholds of the keyword ranking.
W_QUERY, W_SIMILARITY, W_WORD, W_COMPACT, W_TOKEN = 5.0, 2.5, 2.0, 2.5, 0.75
MIN_SIMILARITY, MIN_WORD, MAX_TOKENS = 0.08, 0.12, 8
GLOBAL = "__global__"


def required(name: str, value: str | None) -> str:
    if not str(value or "").strip():
        raise ValueError(f"{name} is required")
    return str(value)


def in_group(df: DataFrame, group_id: str, doc_id: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """The rows of a group, of a document and of a range of doc_time (compared as text)."""
    out = df.filter(F.col("group_id") == required("group_id", group_id))
    for test, value in ((lambda v: F.col("doc_id") == v, doc_id), (lambda v: F.col("doc_time") >= v, start), (lambda v: F.col("doc_time") <= v, end)):
        if value:
            out = out.filter(test(value))
    return out


def query_tokens(query: str) -> tuple[str, list[str], str]:
    q = query.strip()
    return q, [t for t in re.split(r"[\s,，。；;、|/]+", q) if t][:MAX_TOKENS], re.sub(r"\s+", "", q)


def keyword_score(text: Column, query: str) -> tuple[Column, Column]:
    """(score, whether it matches); the query's % and _ are wildcards."""
    q, tokens, compact = query_tokens(query)
    both = F.struct(trigram.sequence(F.lit(q)).alias("q"), trigram.sequence(text).alias("t"))
    told = trigram.let(both, lambda x: F.struct(trigram.similarity(x["q"], x["t"]).alias("near"), trigram.word_similarity(x["q"], x["t"]).alias("word")))
    like = lambda x: F.coalesce(text.ilike(f"%{x}%"), F.lit(False))
    one = lambda hit, w: F.when(hit, w).otherwise(0.0)
    more = [(compact, W_COMPACT)] * (compact != q) + [(t, W_TOKEN) for t in tokens]
    made = trigram.let(told, lambda x: F.struct(
        (sum((one(like(p), w) for p, w in more), one(like(q), W_QUERY) + x["near"] * W_SIMILARITY + x["word"] * W_WORD)).alias("score"),
        reduce(lambda a, b: a | b, (like(p) for p, _ in more), like(q) | (x["near"] >= MIN_SIMILARITY) | (x["word"] >= MIN_WORD)).alias("match"),
    ))
    return made["score"], made["match"]


def chunks_keyword(chunks: DataFrame, documents: DataFrame, group_id: str, query: str, limit: int = 20, doc_id: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Best chunks by fuzzy keywords; chunks without their document don't count; ties by time, place and ids."""
    required("group_id", group_id)
    if not (query or "").strip():
        return chunks.limit(0).select("doc_id", "chunk_id", "chunk_index", "text", F.lit("").alias("doc_time"), F.lit(0.0).alias("score"))
    score, match = keyword_score(F.col("text"), query)
    docs = in_group(documents, group_id, doc_id, start, end).select("group_id", "doc_id", "doc_time")
    found = in_group(chunks, group_id, doc_id).join(docs, ["group_id", "doc_id"]).filter(match)
    return found.select("doc_id", "chunk_id", "chunk_index", "text", "doc_time", F.round(score, 6).alias("score")).orderBy(F.desc("score"), F.desc("doc_time"), "chunk_index", "doc_id", "chunk_id").limit(limit)


def vector_top(df: DataFrame, query: Sequence[float], top_k: int, key: str, fields: Sequence[str] | None = None, embedding: str = "embedding", digits: int = 6) -> DataFrame:
    """The top_k rows by inner product, ties by key; no vector, no rows."""
    if not len(query):
        return df.limit(0).select(*(fields or [c for c in df.columns if c != embedding]), F.lit(0.0).alias("score"))
    score = F.round(vectors.dot(F.col(embedding), vectors.literal(query)), digits)
    return df.select(*(fields or [c for c in df.columns if c != embedding]), score.alias("score")).orderBy(F.desc("score"), key).limit(top_k)


def chunks_vector(embeddings: DataFrame, group_id: str, query: Sequence[float], top_k: int = 10, doc_id: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    return vector_top(in_group(embeddings, group_id, doc_id, start, end), query, top_k, "pk", ["pk", "group_id", "doc_id", "doc_time", "chunk_id"])


def with_text(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits with their chunk's text, empty where there is none, in the order of the hits."""
    texts = chunks.select("group_id", "chunk_id", F.col("text").alias("_text"))
    return hits.join(texts, ["group_id", "chunk_id"], "left").withColumn("text", F.coalesce("_text", F.lit(""))).drop("_text").orderBy(F.desc("score"), "chunk_id")


def graph_index(index: DataFrame, group_id: str, kind: str, query: Sequence[float], top_k: int = 10, doc_id: str | None = None, fields: Sequence[str] | None = None) -> DataFrame:
    """Entities or relations by vector; no doc_id means the group's level, an empty one any document."""
    if kind not in ("entity", "relation"):
        raise ValueError(f"unknown kind {kind!r}")
    level = GLOBAL if doc_id is None else doc_id
    return vector_top(in_group(index, group_id, level).filter(F.col("kind") == kind), query, top_k, "pk", fields)


def chunks_by_ids(chunks: DataFrame, group_id: str, ids: Sequence[str]) -> DataFrame:
    """In the order of the ids, repeats kept, unknown ids dropped."""
    spark = chunks.sparkSession
    asked = spark.createDataFrame([(i, x) for i, x in enumerate(ids)], "pos int, chunk_id string")
    return in_group(chunks, group_id).join(F.broadcast(asked), "chunk_id").orderBy("pos")


def rerank(hits: DataFrame, scored: DataFrame | None, top_k: int | None = None, text: str = "text", order: str = "pos") -> DataFrame:
    """Hits in the order of `scored` (text, occurrence, rank), the unscored after them in their own order, cut to top_k.

    Equal texts are told apart by their occurrence. Without scores the hits stay as they are, uncut.
    """
    if scored is None:
        return hits.orderBy(order)
    seen = hits.withColumn("occurrence", F.row_number().over(Window.partitionBy(text).orderBy(order)))
    told = seen.join(scored.select(F.col("text").alias(text), "occurrence", "rank"), [text, "occurrence"], "left").drop("occurrence")
    out = told.orderBy(F.coalesce("rank", F.lit(2**31 - 1)), order)
    return out if top_k is None else out.limit(top_k)


Reranker = Callable[[str, list[str]], list[float]]
