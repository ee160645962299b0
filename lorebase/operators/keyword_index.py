"""Keyword search by a posting table of trigrams: bounds from shared trigrams choose the few chunks whose text is scored."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions import trigram
from ..session import ship, small_batches
from .search import MIN_SIMILARITY, MIN_WORD, W_COMPACT, W_QUERY, W_SIMILARITY, W_TOKEN, W_WORD, in_group, keyword_score, query_tokens, required

#: Chunks with the best bounds that are scored first; their k-th score then says which others can matter.
FIRST = 64
#: Scores are told to six digits, so bounds within that are looked at.
SLACK = 1e-6
#: Trigrams that a task works out at once, and entries of its table of counts.
PIECE, TABLE = 1 << 20, 1 << 21


def _words() -> Column:
    """The distinct words of a text, as `trigram.sequence` has them."""
    return F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(trigram.WORD), 1))


def _distinct(owner: np.ndarray, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(owner, code), in this order and without repeats, of the trigrams of words; code: three code points of 21 bits."""
    coded = words.dictionary_encode()
    points = np.frombuffer(("  " + "   ".join(coded.dictionary.to_pylist()) + " ").encode("utf-32-le"), np.uint32).astype(np.int64)
    codes, place = np.unique((points[:-2] << 42) | (points[1:-1] << 21) | points[2:], return_inverse=True)
    count = pc.utf8_length(coded.dictionary).to_numpy().astype(np.int64) + 1
    # a word of n characters has n + 1 trigrams, and two more begin in the blanks before the next word
    begin, at = np.cumsum(count + 2) - count - 2, coded.indices.to_numpy()
    many = count[at]
    each = np.repeat(begin[at] - np.cumsum(many) + many, many) + np.arange(many.sum())
    key = np.repeat(owner, many) * len(codes) + place[each]
    key.sort()
    key = key[np.diff(key, prepend=-1) > 0]
    return key // len(codes), codes[key % len(codes)]


def _held(words: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(row, code), in this order and without repeats, of the trigrams of each row's words; worked out for PIECE trigrams at a time."""
    flat = words.flatten()
    row = np.repeat(np.arange(len(words)), pc.fill_null(pc.list_value_length(words), 0).to_numpy())
    piece = np.cumsum(pc.utf8_length(flat).to_numpy().astype(np.int64) + 1) // PIECE
    cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(flat)]
    done: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for a, b in zip(cuts, cuts[1:]):
        if a == b:
            continue
        rows, codes = _distinct(row[a:b], flat.slice(a, b - a))
        last_rows, last = done[-1]
        if len(last_rows) and last_rows[-1] == rows[0]:  # a row that goes on from the piece before
            begun, more = np.searchsorted(last_rows, rows[0]), np.searchsorted(rows, rows[0], "right")
            whole = np.union1d(last[begun:], codes[:more])
            done[-1] = (last_rows[:begun], last[:begun])
            rows, codes = np.concatenate([np.full(len(whole), rows[0]), rows[more:]]), np.concatenate([whole, codes[more:]])
        done.append((rows, codes))
    return np.concatenate([r for r, _ in done]), np.concatenate([c for _, c in done])


def _told(codes: np.ndarray) -> pa.Array:
    """Trigrams as texts."""
    some, place = np.unique(codes, return_inverse=True)
    points = np.stack([some >> 42, (some >> 21) & 0x1FFFFF, some & 0x1FFFFF], axis=1).astype(np.uint32)
    return pa.array(points.view("<U3").ravel(), pa.string()).take(pa.array(place))


def postings(chunks: DataFrame) -> DataFrame:
    """(group_id, doc_id, chunk_id, gram, n): the distinct trigrams of each chunk, n being their number.

    A chunk without letters or digits has none. Written in order of the gram, a search reads the pages of its own grams.
    Words are those of `trigram.sequence`.
    """
    ship(chunks.sparkSession)
    small_batches(chunks.sparkSession)

    @F.arrow_udf("array<string>")
    def grams_of(words: pa.Array) -> pa.Array:
        rows, codes = _held(words)
        ends = np.cumsum(np.bincount(rows, minlength=len(words)))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), _told(codes))

    grams = chunks.select("group_id", "doc_id", "chunk_id", grams_of(_words()).alias("grams"))
    # a plain explode would be planned with a filter on its array's size below it, and the function would run twice
    return grams.select("group_id", "doc_id", "chunk_id", F.explode_outer("grams").alias("gram"), F.size("grams").alias("n")).filter(F.col("gram").isNotNull())


def frequencies(chunks: DataFrame) -> DataFrame:
    """(group_id, gram, chunks): in how many chunks of a group a trigram stands, as counted from `postings`.

    A task counts in a table of at most TABLE entries, which it gives out when it is full, so that not every posting
    goes to the sum as a row.
    """
    ship(chunks.sparkSession)
    small_batches(chunks.sparkSession)

    def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        codes, place = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
        return codes, np.bincount(place, np.concatenate([n for _, n in parts]), len(codes)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict[object, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for group, parts in table.items():
                codes, n = summed(parts)
                for i in range(0, len(codes), 1 << 16):
                    some = codes[i : i + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array([group], kind).take(pa.array(np.zeros(len(some), np.int64))), _told(some), pa.array(n[i : i + (1 << 16)])], ["group_id", "gram", "chunks"])

        for batch in batches:
            groups, kind = batch.column(0).dictionary_encode("encode"), batch.column(0).type
            rows, codes = _held(batch.column(1))
            mine = groups.indices.to_numpy()[rows]
            order = np.argsort(mine, kind="stable")
            ends = np.cumsum(np.bincount(mine, minlength=len(groups.dictionary)))
            for group, a, b in zip(groups.dictionary.to_pylist(), [0, *ends], ends):
                if a < b:
                    some, n = np.unique(codes[order[a:b]], return_counts=True)
                    table.setdefault(group, []).append((some, n))
                    size += len(some)
            if size > TABLE:
                table = {group: [summed(parts)] for group, parts in table.items()}
                size = sum(len(parts[0][0]) for parts in table.values())
                if size > TABLE // 2:
                    yield from out()
                    table, size = {}, 0
        yield from out()

    schema = StructType([chunks.schema["group_id"], StructField("gram", StringType()), StructField("chunks", LongType())])
    return chunks.select("group_id", _words().alias("words")).mapInArrow(run, schema).groupBy("group_id", "gram").agg(F.sum("chunks").alias("chunks"))


@dataclass(frozen=True)
class Pattern:
    """A text that a chunk may contain, what it adds to the score, and trigrams without which a chunk can't contain it."""

    text: str
    weight: float
    grams: frozenset[str]


@dataclass(frozen=True)
class Asked:
    grams: tuple[str, ...]  # of the whole query
    patterns: tuple[Pattern, ...]

    @property
    def open(self) -> list[Pattern]:
        """Patterns too short for a trigram: where they stand only a scan tells."""
        return [p for p in self.patterns if not p.grams]


def inner_grams(segment: str, runs: Sequence[str]) -> set[str]:
    """Trigrams that every text with this segment has; runs: the segment's runs of letters and digits, in order.

    Where a run begins or ends inside the segment, a word of the text does so too; at the segment's own ends it may go on.
    """
    out, at = set(), 0
    for run in runs:
        at = segment.index(run, at)
        padded = "  " * (at > 0) + run + " " * (at + len(run) < len(segment))
        out |= {padded[i : i + 3] for i in range(len(padded) - 2)}
        at += len(run)
    return out


def asked(spark: SparkSession, query: str) -> Asked:
    """The query's trigrams and patterns; lower case and letters are what the session takes for them."""
    q, tokens, compact = query_tokens(query)
    weights = [(q, W_QUERY), *[(compact, W_COMPACT)] * (compact != q), *((t, W_TOKEN) for t in tokens)]
    # % and _ stand for anything, so a pattern is as good as its literal segments
    segments = [(i, s) for i, (p, _) in enumerate(weights) for s in re.split(r"[%_\\]+", p) if s]
    rows = spark.createDataFrame([(-1, q), *segments], "i int, s string").select("i", F.lower("s").alias("s"), F.regexp_extract_all(F.lower("s"), F.lit(trigram.WORD), 1).alias("runs"), F.array_distinct(trigram.sequence(F.col("s"))).alias("grams")).collect()
    found: list[set[str]] = [set() for _ in weights]
    for r in rows:
        if r["i"] >= 0:
            found[r["i"]] |= inner_grams(r["s"], r["runs"])
    return Asked(tuple(rows[0]["grams"]), tuple(Pattern(p, w, frozenset(g)) for (p, w), g in zip(weights, found)))


def _some(grams: Sequence[str]) -> Column:
    return F.col("gram").isin(sorted(grams))


def candidates(index: DataFrame, chunks: DataFrame, ask: Asked) -> DataFrame:
    """(doc_id, chunk_id, bound) of all chunks that can match: an upper bound of their score from the posting table alone.

    The similarity of query and chunk is exact, as their shared and distinct trigrams are known. The word similarity is
    at most the share of the query's trigrams that the chunk has. A pattern counts in full if the chunk has all of its
    trigrams. Chunks that hold a pattern without trigrams come from a scan for it.
    """
    every = {g for p in ask.patterns for g in p.grams} | set(ask.grams)
    m, closed = len(ask.grams), [p for p in ask.patterns if p.grams]
    hits = [F.count_if(_some(p.grams)).alias(f"p{i}") for i, p in enumerate(closed)]
    held = index.filter(_some(every)).groupBy("doc_id", "chunk_id").agg(F.first("n").alias("n"), (F.count_if(_some(ask.grams)) if m else F.lit(0)).alias("shared"), *hits)
    whole = [F.col(f"p{i}") == len(p.grams) for i, p in enumerate(closed)]
    near = F.col("shared") / (m + F.col("n") - F.col("shared"))
    word = F.col("shared") / F.lit(max(m, 1))
    bound = near * W_SIMILARITY + word * W_WORD + sum(p.weight for p in ask.open)
    can = (near >= MIN_SIMILARITY) | (word >= MIN_WORD)
    for p, all_there in zip(closed, whole):
        bound, can = bound + F.when(all_there, p.weight).otherwise(0.0), can | all_there
    out = held.select("doc_id", "chunk_id", bound.alias("bound"), can.alias("can"))
    if ask.open:
        said = F.lit(False)
        for p in ask.open:
            said = said | F.col("text").ilike(f"%{p.text}%")
        scanned = chunks.filter(said).select("doc_id", "chunk_id", F.lit(float(sum(p.weight for p in ask.open))).alias("bound"), F.lit(True).alias("can"))
        out = out.unionByName(scanned).groupBy("doc_id", "chunk_id").agg(F.max("bound").alias("bound"), F.bool_or("can").alias("can"))
    return out.filter("can").drop("can")


@dataclass
class Plan:
    """What a search looks at: candidates that can match, and the bound under which none can be among the best."""

    candidates: DataFrame
    least: float | None

    def looked_at(self) -> DataFrame:
        return self.candidates if self.least is None else self.candidates.filter(F.col("bound") >= self.least)


def _scored(chunks: DataFrame, keys: DataFrame, query: str) -> DataFrame:
    score, match = keyword_score(F.col("text"), query)
    # the ranking names the bound, which only candidates have: it can't be worked out before the join
    told = F.when(F.col("bound").isNotNull(), F.struct(F.round(score, 6).alias("score"), match.alias("match")))
    # few rows, much work for each: dealt anew, wherever they lay
    some = chunks.join(keys, ["doc_id", "chunk_id"]).repartition(chunks.sparkSession.sparkContext.defaultParallelism, "doc_id", "chunk_id")
    return some.withColumn("told", told).filter("told.match").withColumn("score", F.col("told.score")).drop("told", "bound")


def plan(index: DataFrame, chunks: DataFrame, documents: DataFrame, group_id: str, query: str, limit: int = 20, doc_id: str | None = None, start: str | None = None, end: str | None = None, first: int = FIRST) -> Plan:
    """Score the `first` candidates by bound; if `limit` of them match, the last one's score bounds all others."""
    docs = in_group(documents, group_id, doc_id, start, end).select("doc_id", "doc_time")
    mine = in_group(chunks, group_id, doc_id)
    found = candidates(in_group(index, group_id, doc_id), mine, asked(chunks.sparkSession, query)).join(docs, "doc_id")
    best = found.orderBy(F.desc("bound"), "doc_id", "chunk_id").limit(max(first, limit))
    scores = [r["score"] for r in _scored(mine, F.broadcast(best.select("doc_id", "chunk_id", "bound")), query).select("score").orderBy(F.desc("score")).limit(limit).collect()]  # at most limit numbers
    return Plan(found, scores[-1] - SLACK if len(scores) == limit else None)


def search(index: DataFrame, chunks: DataFrame, documents: DataFrame, group_id: str, query: str, limit: int = 20, doc_id: str | None = None, start: str | None = None, end: str | None = None, first: int = FIRST) -> DataFrame:
    """The rows of `search.chunks_keyword`, from the posting table: texts of candidates are scored, no others.

    No candidate is left out that could be among the best: those whose bound reaches the k-th score of the first ones are
    scored as well, and all of them if fewer than `limit` match.
    """
    required("group_id", group_id)
    mine = in_group(chunks, group_id, doc_id)
    if not (query or "").strip() or limit <= 0:
        return mine.limit(0).select("doc_id", "chunk_id", "chunk_index", "text", F.lit("").alias("doc_time"), F.lit(0.0).alias("score"))
    todo = plan(index, chunks, documents, group_id, query, limit, doc_id, start, end, first).looked_at()
    out = _scored(mine, todo.select("doc_id", "chunk_id", "doc_time", "bound"), query)
    return out.select("doc_id", "chunk_id", "chunk_index", "text", "doc_time", "score").orderBy(F.desc("score"), F.desc("doc_time"), "chunk_index", "doc_id", "chunk_id").limit(limit)
