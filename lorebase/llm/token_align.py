"""Alignment of two tokenizers' tokens by elementary intervals of their byte ranges."""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .flat import changes, distinct
from .piece_bpe import SPACE, Vocabulary, _chunks, encode_words, merge_rounds
from .runtime import cut, prepare, tidy

#: Characters of white space, and others that some pattern may count among them.
WHITE = " \t\n\r\f\v\x85\xa0  -     　"
DOUBTFUL = "\x1c-\x1f᠎​﻿"
#: Units, and characters of units, that a task remembers.
MEMORY, MEMORY_CHARS = 400_000, 8_000_000
#: Id pairs, the most frequent ones, whose counts are broadcast (some 17 bytes each); others are joined by a shuffle.
MOST_PAIRS = 2_000_000


def byte_of() -> dict[str, int]:
    """Byte of each character of a byte-level vocabulary: printable ones stand for themselves, the others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class Aligned:
    """Flat result for units of text; `first` arrays part it by unit."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    pairs: np.ndarray  # a * size of B's vocabulary + b of each overlap
    first: np.ndarray  # of a unit's pairs
    groups: list[str]  # a1,a2|b1;a3|b2,b3;


def overlaps(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(interval ends, owner in A, owner in B, whether both end there) of two token sequences over the same bytes.

    Between two neighbouring ends lies one token of either side, so each interval is one overlap; no two overlap twice.
    """
    ends = distinct(np.concatenate((ends_a, ends_b)))  # as union1d, by a sort
    own_a, own_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
    return ends, own_a, own_b, (ends_a[own_a] == ends) & (ends_b[own_b] == ends) if len(ends) else np.zeros(0, bool)


def products(n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (index in A, index in B) of each group, given its numbers of tokens: the group's many-to-many links."""
    size = n_a * n_b
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    wide = np.repeat(n_b, size)
    return np.repeat(np.cumsum(n_a) - n_a, size) + at // np.maximum(wide, 1), np.repeat(np.cumsum(n_b) - n_b, size) + at % np.maximum(wide, 1)


def vocabulary_size(vocabulary: Vocabulary) -> int:
    return max(vocabulary.surface) + 1


class Pair:
    """Both tokenizers, and their tables by id."""

    def __init__(self, spec_a: bytes, vocabulary: Vocabulary):
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_buffer(spec_a), vocabulary
        self.a.encode_special_tokens = True
        of = byte_of()
        told = self.a.get_vocab(with_added_tokens=False)
        self.bytes_a = [b""] * (max(told.values()) + 1)
        for token, i in told.items():
            self.bytes_a[i] = bytes(of[c] for c in token)
        self.size_b = vocabulary_size(vocabulary)
        self.bytes_b = [vocabulary.surface.get(i, b"") for i in range(self.size_b)]
        self.len_a, self.len_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        ids = [str(i) for i in range(max(len(self.bytes_a), self.size_b))]
        self.words = [*(f"{i}," for i in ids), *(f"{i}|" for i in ids), *(f"{i};" for i in ids)]
        self.n_ids = len(ids)
        self.by_symbol = np.append(np.array(vocabulary.by_symbol, np.int64), -1)  # the last: a character that no piece has
        self.unit = re.compile(self.pattern(vocabulary))

    @staticmethod
    def pattern(vocabulary: Vocabulary) -> str:
        """Units of text: they begin where neither tokenizer has a token that goes on.

        That is before white space after a character that is surely none: A parts its words there, and B does unless a
        piece goes on with this white space after another character (then the unit goes on as well).
        """
        inner = {c for piece in vocabulary.ids for c in re.findall(f"(?<=[^{WHITE}{DOUBTFUL}])[{WHITE}]", piece.replace(SPACE, " "))}
        safe = "".join(c for c in " \t\n" if c not in inner)
        odd = f"{WHITE}{DOUBTFUL}"
        return f"[{odd}]*[^{odd}]+(?:(?![{safe}])[{odd}][{odd}]*[^{odd}]*)*|[{odd}]+"

    def tokens_a(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all units, number of each)."""
        ids = [e.ids for e in self.a.encode_batch(units, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(ids), np.int64), np.fromiter(map(len, ids), np.int64, len(ids))

    def tokens_b(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As `tokens_a`, by merge rounds over all units at once; one that has a symbol without an id is encoded by itself."""
        words = [u.replace(" ", SPACE) for u in units]
        found = merge_rounds(self.b, words)
        counts = np.fromiter(map(len, found), np.int64, len(found))
        ids = self.by_symbol[np.concatenate(found)] if len(found) else np.zeros(0, np.int64)
        odd = np.unique(np.repeat(np.arange(len(words)), counts)[ids < 0]).tolist()
        if odd:
            cuts = np.cumsum(counts)
            parts, at = [], 0
            for i, told in zip(odd, encode_words(self.b, [words[i] for i in odd])):
                parts += [ids[at : cuts[i] - counts[i]], np.array(told, np.int64)]
                at = cuts[i]
                counts[i] = len(told)
            ids = np.concatenate([*parts, ids[at:]])
        return ids, counts

    def align(self, units: list[str]) -> Aligned:
        """Tokens, groups and overlaps of units; one whose tokens' bytes differ from its own has n_a of -1."""
        # U+2581 comes back as a space
        raw = [u.encode() if SPACE not in u else b"" for u in units]
        (a, n_a), (b, n_b) = self.tokens_a([u if r else "" for u, r in zip(units, raw)]), self.tokens_b([u if r else "" for u, r in zip(units, raw)])
        for ids, counts, texts in ((a, n_a, self.bytes_a), (b, n_b, self.bytes_b)):
            if b"".join([texts[i] for i in ids.tolist()]) != b"".join(raw):
                cuts = np.cumsum(counts)
                bad = {i for i, (r, n, end) in enumerate(zip(raw, counts.tolist(), cuts.tolist())) if b"".join([texts[k] for k in ids[end - n : end].tolist()]) != r}
                raw = [b"" if i in bad else r for i, r in enumerate(raw)]
        ok = np.array([len(r) > 0 for r in raw], bool)
        a, b = a[np.repeat(ok, n_a)], b[np.repeat(ok, n_b)]
        n_a, n_b = np.where(ok, n_a, 0), np.where(ok, n_b, 0)
        ends_a, ends_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        ends, own_a, own_b, shared = overlaps(ends_a, ends_b)
        unit_ends = np.cumsum([len(r) for r in raw])
        group_ends = ends[shared]
        first, first_group = (np.searchsorted(x, np.concatenate(([0], unit_ends)), "right") for x in (ends, group_ends))
        # the text of the groups: A's tokens, then B's, each with what follows it
        group_a, group_b = np.searchsorted(group_ends, ends_a), np.searchsorted(group_ends, ends_b)
        last_a, last_b = (np.append(g[1:] != g[:-1], True)[: len(g)] for g in (group_a, group_b))
        codes = np.concatenate((a + self.n_ids * last_a, b + 2 * self.n_ids * last_b))[np.argsort(np.concatenate((2 * group_a, 2 * group_b + 1)), kind="stable")]
        words, codes, groups, at = self.words, codes.tolist(), [], 0
        for n in (n_a + n_b).tolist():
            groups.append("".join([words[c] for c in codes[at : at + n]]))
            at += n
        return Aligned(np.where(ok, n_a, -1), n_b, np.diff(first_group), a[own_a] * self.size_b + b[own_b], first, groups)


@dataclass
class Memory:
    """Units that a task has aligned, with their results in growing tables."""

    pair: Pair
    at: dict[str, int] = field(default_factory=dict)
    n_chars: int = 0

    def __post_init__(self):
        self._clear()

    def _clear(self):
        self.at.clear()
        self.n_chars, self.groups = 0, []
        self.counts, self.pairs, self.first = np.zeros((3, 0), np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64)

    def learn(self, units: set[str]) -> None:
        new = [u for u in units if u not in self.at]
        if self.at and (len(self.at) + len(new) > MEMORY or self.n_chars + sum(map(len, new)) > MEMORY_CHARS):
            self._clear()
            new = list(units)
        if not new:
            return
        told = self.pair.align(new)
        self.at.update(zip(new, range(len(self.at), len(self.at) + len(new))))
        self.n_chars += sum(map(len, new))
        self.groups += told.groups
        self.counts = np.concatenate((self.counts, np.stack((told.n_a, told.n_b, told.n_groups))), 1)
        self.first = np.concatenate((self.first, told.first[1:] + len(self.pairs)))
        self.pairs = np.concatenate((self.pairs, told.pairs))

    def rows(self, texts: list[str]) -> list[tuple]:
        """(n_a, n_b, n_groups, n_links, digest, distinct pairs, times of each) of each text."""
        units = [self.pair.unit.findall(" " + t) if t else [] for t in texts]
        self.learn(set().union(*units))
        where = self.at.__getitem__
        told = [list(map(where, u)) for u in units]
        flat = np.fromiter(chain.from_iterable(told), np.int64)
        sizes = np.array([len(u) for u in units], np.int64)
        doc = np.repeat(np.arange(len(texts)), sizes)
        bad = np.zeros(len(texts), bool)
        bad[doc[self.counts[0][flat] < 0]] = True
        flat, doc = flat[~bad[doc]], doc[~bad[doc]]
        n_a, n_b, n_groups = (np.bincount(doc, row[flat], len(texts)).astype(np.int64) for row in self.counts)
        size = self.first[flat + 1] - self.first[flat]
        n_links = np.bincount(doc, size, len(texts)).astype(np.int64)
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - self.first[flat], size)
        # a pair is below 2^40 with vocabularies of a million, a block has far fewer than 2^23 texts
        both = np.sort(np.repeat(doc, size) << 40 | self.pairs[place])
        begin = np.flatnonzero(changes(both)[: len(both)])
        times, pairs, owner = np.diff(np.append(begin, len(both))), both[begin] & (1 << 40) - 1, both[begin] >> 40
        cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
        groups, out = self.groups, []
        for i, u in enumerate(told):
            digest = "" if bad[i] or not u else hashlib.sha256("".join([groups[k] for k in u])[:-1].encode()).hexdigest()
            out.append((int(n_a[i]), int(n_b[i]), int(n_groups[i]), int(n_links[i]), digest, pairs[cuts[i] : cuts[i + 1]], times[cuts[i] : cuts[i + 1]]))
        return out


_FIELDS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"


def aligned(docs: DataFrame, path_a: str, vocabulary: Vocabulary, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times) of each text, the pairs distinct and in order.

    A pair is the number a * size of B's vocabulary + b; `times` says how many overlaps are of it. Texts are cut into
    units where tokens of both sides end; a task aligns each unit it meets once. A null or empty text, and one whose
    tokens don't give back its bytes, has zeros and no pairs. Repeated rows are aligned one by one, empty tables give no
    rows, other columns are ignored.
    """
    prepare(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast((_read(path_a), vocabulary))  # as large as the models, not as the data

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        memory = Memory(Pair(*model.value))
        for batch in batches:
            rows = [row for texts in _chunks([x or "" for x in batch.column(1).to_pylist()]) for row in memory.rows(texts)]
            columns = list(zip(*rows)) if rows else [[]] * 7
            kinds = [*[pa.int64()] * 4, pa.string()]
            first = np.cumsum([0, *map(len, columns[5])]).astype(np.int32)
            flat = [np.concatenate(c) if len(c) else np.zeros(0, np.int64) for c in columns[5:]]
            lists = [pa.ListArray.from_arrays(pa.array(first), pa.array(x.astype(kind))) for x, kind in zip(flat, (np.int64, np.int32))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds)), *lists], names=[f.split()[0] for f in _FIELDS.split(", ")])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(tidy(run), _FIELDS)


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def pair_counts(found: DataFrame, size_b: int) -> DataFrame:
    """(pair, n, best): how many documents hold a pair linked, and whether no pair of its A id has more."""
    counts = cut(found.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")))
    most = counts.groupBy((F.col("pair") / size_b).cast("long").alias("a")).agg(F.max("n").alias("most"))
    met = counts.withColumn("a", (F.col("pair") / size_b).cast("long")).join(most, "a")
    return met.select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _frequent(counts: DataFrame, most: int) -> tuple[int, bool]:
    """(n from which on at most `most` pairs are, whether rarer ones exist), from a histogram by powers of two."""
    told = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("power")).agg(F.count("*").alias("pairs")).collect()
    room, least = most, None
    for power, pairs in sorted(((r["power"], r["pairs"]) for r in told), reverse=True):
        if pairs > room:
            return 1 << (power + 1), True
        room, least = room - pairs, power
    return 1, False


def scored(found: DataFrame, size_b: int, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of `aligned` rows.

    A pair's count is the number of rows that hold it linked; n_best counts the links whose pair no other of its A id
    exceeds, count_sum adds the counts over links. At most `most_pairs` of the most frequent pairs go to the tasks
    with their counts; what is left of a row goes by a shuffle to the counts of the rarer pairs, none of which is hot.
    """
    spark = found.sparkSession
    row = f"row_{uuid.uuid4().hex}"
    found = cut(found.withColumn(row, F.monotonically_increasing_id()))  # numbered once: what is written keeps its number
    counts = cut(pair_counts(found, size_b))
    least, rarer = _frequent(counts, most_pairs)
    table = counts.filter(F.col("n") >= least).toArrow()
    order = np.argsort(table.column("pair").to_numpy())
    sent = spark.sparkContext.broadcast(tuple(table.column(c).to_numpy()[order] for c in ("pair", "n", "best")))

    def run(batches):
        known, n, best = sent.value
        for batch in batches:
            pairs, times = (batch.column(k).flatten().to_numpy().astype(np.int64) for k in (1, 2))
            owner = np.repeat(np.arange(batch.num_rows), batch.column(1).value_lengths().to_numpy(zero_copy_only=False))
            at = np.minimum(np.searchsorted(known, pairs), len(known) - 1) if len(known) else np.zeros(len(pairs), np.int64)
            hit = known[at] == pairs if len(known) else np.zeros(len(pairs), bool)
            at = at[hit]
            sums = [np.zeros(batch.num_rows, np.int64) for _ in range(2)]
            for out, value in zip(sums, (times[hit] * best[at], times[hit] * n[at]) if len(known) else ()):
                np.add.at(out, owner[hit], value)
            first = pa.array(np.searchsorted(owner[~hit], np.arange(batch.num_rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(first, pa.array(x[~hit])) for x in (pairs, times)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, sums), *lists], names=[row, "n_best", "count_sum", "pairs", "times"])

    sums = found.select(row, "pairs", "times").mapInArrow(tidy(run), f"{row} long, n_best long, count_sum long, pairs array<long>, times array<long>")
    if rarer:
        sums = cut(sums)
        left = sums.select(row, F.explode(F.arrays_zip("pairs", "times")).alias("x")).select(row, "x.pairs", "x.times")
        met = left.join(counts.filter(F.col("n") < least), left["pairs"] == F.col("pair"))
        more = met.select(row, (F.col("times") * F.col("best").cast("long")).alias("n_best"), (F.col("times") * F.col("n")).alias("count_sum"))
        sums = sums.select(row, "n_best", "count_sum").unionByName(more).groupBy(row).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    kept = found.select(row, "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    return kept.join(sums.select(row, "n_best", "count_sum"), row).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def compare(docs: DataFrame, path_a: str, path_b: str, text: str = "text", doc_id: str = "doc_id", most_pairs: int = MOST_PAIRS) -> DataFrame:
    """`scored` rows of all texts: see `aligned` for nulls, ties, repeated rows and empty tables."""
    vocabulary = Vocabulary.load(path_b)
    return scored(aligned(docs, path_a, vocabulary, text, doc_id), vocabulary_size(vocabulary), most_pairs)
