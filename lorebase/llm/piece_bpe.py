"""SentencePiece BPE encoding by vectorised merge rounds, and decoding, with a given public model."""

from __future__ import annotations

import hashlib
import heapq
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import prepare, tidy

SPACE = "▁"
#: Characters of text whose words are merged together.
BLOCK_CHARS = 1 << 20
#: Words that a worker remembers.
MEMORY = 150_000
#: Rounds after which what is left is merged one by one: only long runs of one character (of spaces, in this model) need
#: that, where a merge makes a better pair at once and so each round holds few merges.
ROUNDS = 1000
_NEVER = np.int32(2**31 - 1)


_SLOTS = 1 << 20


def _slot(key: np.ndarray) -> np.ndarray:
    return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)


@dataclass
class Vocabulary:
    ids: dict[str, int]  # of normal pieces
    symbols: dict[str, int]  # of normal pieces and of the characters they are made of
    texts: list[str]  # by symbol
    pair: np.ndarray  # keys left * len(texts) + right
    rank: np.ndarray  # of the pair: 0 is merged first; equal scores have equal ranks
    merged: np.ndarray  # the symbol that the pair becomes
    table: np.ndarray  # place of a pair by the hash of its key, linear probing; -1: none
    byte_ids: list[int]
    surface: dict[int, bytes]  # what an id decodes to
    breaks: bool  # whether no piece of more than one character has a line feed
    by_symbol: list[int]  # id of a symbol, -1 if it is no piece

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """Read pieces and scores of a BPE model with byte fallback, identity normalisation and a dummy prefix."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids, score, surface = {}, {}, {}
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                surface[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                ids[piece], score[piece] = i, sp.get_score(i)
                surface[i] = piece.replace(SPACE, " ").encode()
        if any(SPACE in piece.lstrip(SPACE) for piece in ids):
            raise ValueError("a piece spans two words")
        symbols = {s: i for i, s in enumerate(dict.fromkeys([*ids, *(c for piece in ids for c in piece)]))}
        order = {s: i for i, s in enumerate(sorted(set(score.values()), reverse=True))}
        rows = []
        for piece in ids:
            for cut in range(1, len(piece)):
                a, b = symbols.get(piece[:cut]), symbols.get(piece[cut:])
                if a is not None and b is not None:
                    rows.append((a * len(symbols) + b, order[score[piece]], symbols[piece]))
        rows.append((-2, _NEVER, -1))
        pairs = np.array(rows, np.int64)
        table = np.full(_SLOTS, -1, np.int32)
        for i, slot in enumerate(_slot(pairs[:-1, 0]).tolist()):
            while table[slot] >= 0:
                slot = (slot + 1) % _SLOTS
            table[slot] = i
        byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        return cls(ids, symbols, list(symbols), pairs[:, 0], pairs[:, 1].astype(np.int32), pairs[:, 2].astype(np.int32), table, byte_ids, surface, not any("\n" in p for p in ids), [ids.get(t, -1) for t in symbols])

    def look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of each pair; unknown symbols are -1 and never merge."""
        key = left.astype(np.int64) * len(self.texts) + right
        key[(left < 0) | (right < 0)] = -1
        slot = _slot(key)
        at = self.table[slot]
        late = np.flatnonzero((at >= 0) & (self.pair[at] != key))
        while len(late):
            slot[late] = (slot[late] + 1) & (len(self.table) - 1)
            at[late] = self.table[slot[late]]
            late = late[(at[late] >= 0) & (self.pair[at[late]] != key[late])]
        return self.rank[at], self.merged[at]  # the last entries of both stand for "no pair"

    def splitter(self) -> re.Pattern:
        """Words that no merge can join: before a space symbol that follows another character, and around line feeds."""
        return re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n" if self.breaks else f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def _heap_merge(v: Vocabulary, chars: str) -> list[str]:
    """The same merges of one word, best rank and then leftmost first."""
    part: list[str | None] = list(chars)
    after, before = list(range(1, len(part) + 1)), list(range(-1, len(part) - 1))
    known: dict[tuple[str, str], int | None] = {}

    def rank(a: str, b: str):
        if (a, b) not in known:
            x, y = v.symbols.get(a), v.symbols.get(b)
            r = None
            if x is not None and y is not None:
                found = int(v.look(np.array([x]), np.array([y]))[0][0])
                r = found if found != _NEVER else None
            known[a, b] = r
        return known[a, b]

    heap = [(r, i, part[i] + part[i + 1]) for i in range(len(part) - 1) if (r := rank(part[i], part[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        r, i, both = heapq.heappop(heap)
        j = after[i] if part[i] is not None else len(part)
        if j >= len(part) or part[j] is None or part[i] + part[j] != both:
            continue
        part[i], part[j] = both, None
        after[i] = after[j]
        if after[i] < len(part):
            before[after[i]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < len(part) and (r := rank(part[a], part[b])) is not None:
                heapq.heappush(heap, (r, a, part[a] + part[b]))
    return [p for p in part if p is not None]


def merge_rounds(v: Vocabulary, words: list[str]) -> list[np.ndarray]:
    """Symbols of each word after all merges (-1: a character that no piece has).

    One round takes, for every word at once, its least pair rank and merges that rank's pairs from the left without
    overlap, as far as one-by-one merging would: up to the first merge that makes a pair of the same or a better rank.
    Then the arrays are compacted; words without a pair leave. After ROUNDS rounds the words that are left are merged
    one by one, in the same order.
    """
    done: list[np.ndarray] = [np.zeros(0, np.int32)] * len(words)
    size = np.array([len(w) for w in words], np.int64)
    flat = "".join(words)
    points = np.frombuffer(flat.encode("utf-32-le"), np.uint32)
    chars, place = np.unique(points, return_inverse=True)
    sym = np.array([v.symbols.get(chr(c), -1) for c in chars], np.int32)[place] if len(chars) else np.zeros(0, np.int32)
    word = np.repeat(np.arange(len(words)), size)
    n = len(sym)
    rank, to = np.full(n, _NEVER), np.full(n, -1, np.int32)  # of the pair that a symbol makes with the next one
    i = np.flatnonzero(word[1:] == word[:-1])
    rank[i], to[i] = v.look(sym[i], sym[i + 1])
    rounds = 0
    while len(sym):
        rounds += 1
        if rounds > ROUNDS:
            for w in word[np.concatenate(([True], word[1:] != word[:-1]))].tolist():
                done[w] = np.array([v.symbols.get(x, -1) for x in _heap_merge(v, words[w])], np.int32)
            break
        begin = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        count = np.diff(np.append(begin, len(sym)))
        least = np.minimum.reduceat(rank, begin)
        over = least == _NEVER
        if over.any():
            for w, a, c in zip(word[begin[over]].tolist(), begin[over].tolist(), count[over].tolist()):
                done[w] = sym[a : a + c]
            stay = ~np.repeat(over, count)
            sym, word, rank, to = sym[stay], word[stay], rank[stay], to[stay]
            count, least = count[~over], least[~over]
            begin = np.cumsum(count) - count
            if not len(sym):
                break
        n = len(sym)
        low = np.repeat(least, count)
        p = np.flatnonzero(rank == low)
        # of adjacent picks every second one, from the left
        fresh = np.concatenate(([True], np.diff(p) != 1))
        at = np.arange(len(p))
        p = p[(at - np.maximum.accumulate(np.where(fresh, at, 0))) % 2 == 0]
        new, home = to[p], word[p]
        beyond = np.minimum(p + 2, n - 1)
        r_right, _ = v.look(new, np.where((p + 2 < n) & (word[beyond] == home), sym[beyond], -1))
        back = np.maximum(p - 1, 0)
        joined = np.concatenate(([False], (np.diff(p) == 2) & (home[1:] == home[:-1])))
        left = np.where((p > 0) & (word[back] == home), np.where(joined, np.concatenate(([-1], new[:-1])), sym[back]), -1)
        r_left, _ = v.look(left, new)
        stop = np.minimum(r_left, r_right) <= low[p]
        if stop.any():
            limit = np.full(len(words), n)
            np.minimum.at(limit, home[stop], p[stop])
            keep = p <= limit[home]
            p, new, home = p[keep], new[keep], home[keep]
        sym[p] = new
        alive = np.ones(n, bool)
        alive[p + 1] = False
        sym, word, rank, to = sym[alive], word[alive], rank[alive], to[alive]
        # only pairs beside a merged symbol have changed
        p = p - np.arange(len(p))
        p = np.concatenate((p, p[p > 0] - 1))
        n = len(sym)
        after = np.minimum(p + 1, n - 1)
        rank[p], to[p] = v.look(sym[p], np.where((p + 1 < n) & (word[after] == word[p]), sym[after], -1))
    return done


def encode_words(v: Vocabulary, words: list[str]) -> list[list[int]]:
    """Ids of each word (spaces as U+2581)."""
    out: list[list[int]] = []

    def ids(piece: str) -> list[int]:
        i = v.ids.get(piece)
        return [i] if i is not None else [v.byte_ids[b] for c in piece for b in c.encode()]

    by_symbol = v.by_symbol
    for word, found in zip(words, merge_rounds(v, words)):
        symbols = found.tolist()
        row = [by_symbol[s] if s >= 0 else -1 for s in symbols]
        if -1 in row:
            row, at = [], 0
            for s in symbols:
                piece = v.texts[s] if s >= 0 else word[at]
                row += ids(piece)
                at += len(piece)
        out.append(row)
    return out


class Codec:
    """Encodes and decodes texts; remembers the words it has seen last."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.split = vocabulary.splitter()
        self.known: dict[str, tuple[list[int], str, bytes]] = {}

    def words(self, text: str) -> list[str]:
        return self.split.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def learn(self, texts_words: list[list[str]]) -> None:
        new = list({w for words in texts_words for w in words}.difference(self.known))
        if len(self.known) + len(new) > MEMORY:
            self.known.clear()
            new = list({w for words in texts_words for w in words})
        surface = self.v.surface.__getitem__
        for w, ids in zip(new, encode_words(self.v, new)):
            self.known[w] = ids, ",".join(map(str, ids)), b"".join(map(surface, ids))

    def encode(self, text: str) -> list[int]:
        words = self.words(text)
        self.learn([words])
        return [i for w in words for i in self.known[w][0]]

    def decode(self, ids: list[int]) -> str:
        """Bytes of the pieces, without the space of the dummy prefix; bytes that are no UTF-8 become U+FFFD."""
        raw = b"".join(self.v.surface.get(i, b"") for i in ids)
        return raw.removeprefix(b" ").decode("utf-8", "replace")


def _chunks(texts: list[str]):
    lo, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > BLOCK_CHARS:
            yield texts[lo:i]
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield texts[lo:]


def _mapped(docs: DataFrame, text: str, doc_id: str, model: str, fields: str, row) -> DataFrame:
    prepare(docs.sparkSession)
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model))  # as large as the model, not as the data

    def run(batches):
        codec = Codec(vocabulary.value)
        for batch in batches:
            rows = []
            for texts in _chunks([x or "" for x in batch.column(1).to_pylist()]):
                split = [codec.words(t) for t in texts]
                codec.learn(split)
                rows += [row(codec, words) for words in split]
            columns = [pa.array(c) for c in zip(*rows)] if rows else []
            names = [f.split()[0] for f in fields.split(", ")]
            kinds = [{"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}[f.split()[1]] for f in fields.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column(0), *((c.cast(k) for c, k in zip(columns, kinds)) if rows else (pa.array([], k) for k in kinds))], names=["doc_id", *names])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(tidy(run), f"doc_id long, {fields}")


def encode(docs: DataFrame, model: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, ids, decoded) for every row.

    A null text is empty; an empty text has no ids and decodes to an empty text. Characters that no piece has become
    their UTF-8 bytes. Empty tables give no rows; equal rows equal results; other columns are ignored.
    """

    def row(codec: Codec, words: list[str]):
        ids = [i for w in words for i in codec.known[w][0]]
        return ids, codec.decode(ids)

    return _mapped(docs, text, doc_id, model, "ids array<int>, decoded string", row)


def digests(docs: DataFrame, model: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of what `encode` gives, without sending ids and texts back."""

    def row(codec: Codec, words: list[str]):
        found = [codec.known[w] for w in words]
        raw = b"".join([f[2] for f in found]).removeprefix(b" ")
        decoded = raw.decode("utf-8", "replace").encode()
        return sum([len(f[0]) for f in found]), hashlib.sha256(",".join([f[1] for f in found]).encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()

    return _mapped(docs, text, doc_id, model, "n_tokens long, ids_sha256 string, decoded_sha256 string", row)
