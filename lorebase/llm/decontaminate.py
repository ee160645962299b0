"""Benchmark decontamination: a prefix-filtered containment join of item-sized word windows with whole documents.

A window (13 consecutive item words, or a shorter item as a whole) must be contained word for word, so of its shingles,
ordered by rarity over all documents, the rarest alone is a necessary prefix. Documents are probed with those shingles
only; the places that a shingle has in its windows bound where a window must start and end in the document (positional
and length bound). What the words there hash to fetches the one window they may be, and they are compared with it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flat
from .runtime import prepare, tidy

WINDOW = 13
#: Words of the shingles that are ordered by rarity (shorter windows use their whole length).
SHINGLE = 4
#: Bytes of item text that are indexed and broadcast at once; more items make more passes.
BLOCK_BYTES = 4 << 20

_SPANS = "array<struct<start:int,end:int>>"
#: What a pass adds to the rows: number of words, maximal runs of hit words, ids of items.
_FOUND = {"__n_words": "long", "__spans": _SPANS, "__items": "array<string>"}
_KINDS = (pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.list_(pa.string()))


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (count[0] of them), first[1], ..."""
    return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)


def _shingle_length(size: int) -> int:
    return min(SHINGLE, size)


class _Items:
    """Distinct windows of one block of items by their hash and, after `choose`, the index from their rarest shingles."""

    def __init__(self, ids: list[str | None], texts: pa.Array, window: int):
        self.words: list[list[bytes]] = []
        hashes = []
        for lo, hi, raw, offsets in flat.blocks(texts):
            w = flat.words(raw, offsets, flat.ALNUM)
            h = w.hashes()
            for i in range(hi - lo):
                a, b = w.first[i], w.first[i + 1]
                self.words.append([w.word(j) for j in range(a, b)])
                hashes.append(h[a:b])
        parts: dict[int, list] = {}  # by window size: hashes of windows, their items and places, the shingles of each
        for item, h in enumerate(hashes):
            if size := min(window, len(h)):
                n, q = len(h) - size + 1, _shingle_length(size)
                inside = np.lib.stride_tricks.sliding_window_view(flat.grams(h, q), size - q + 1)
                parts.setdefault(size, []).append((flat.grams(h, size), np.full(n, item), np.arange(n), inside))
        #: By size: sorted hashes of windows; an item and place that has each; the ids (first[i]:first[i + 1]) of its items.
        self.windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.ids: dict[int, tuple[np.ndarray, list[str | None]]] = {}
        self._inside = {}
        for size, found in parts.items():
            hashed, item, at, inside = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((at, item, hashed))
            hashed, item, at = hashed[order], item[order], at[order]
            new = flat.changes(hashed)
            self.windows[size] = hashed[new], item[new], at[new]
            self._inside[size] = inside[order[new]]
            once = new | flat.changes(item)  # an item may have a window more than once
            self.ids[size] = np.append(np.flatnonzero(new[once]), once.sum()), [ids[i] for i in item[once].tolist()]
        self.shingles = {q: flat.distinct(np.concatenate([x.ravel() for s, x in self._inside.items() if _shingle_length(s) == q])) for q in {_shingle_length(s) for s in parts}}

    def choose(self, counts: dict[int, np.ndarray]) -> None:
        """Index each window by its rarest shingle; counts: by shingle length, how often each shingle occurs."""
        found: dict[int, list] = {}
        for size, inside in self._inside.items():
            q = _shingle_length(size)
            rank = np.empty(len(counts[q]), np.int64)
            rank[np.lexsort((self.shingles[q], counts[q]))] = np.arange(len(rank))
            place = np.searchsorted(self.shingles[q], inside)
            j = rank[place].argmin(axis=1)
            key = inside[np.arange(len(inside)), j]
            found.setdefault(q, []).append((key, j, np.full(len(key), size)))
        #: By shingle length: sorted shingles, and the distinct (place in a window, window size) of each.
        self.index = {}
        for q, parts in found.items():
            key, j, size = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((size, j, key))
            key, j, size = key[order], j[order], size[order]
            once = flat.changes(key) | flat.changes(j) | flat.changes(size)
            key, j, size = key[once], j[once], size[once]
            new = flat.changes(key)
            self.index[q] = key[new], np.append(np.flatnonzero(new), len(key)), j, size
        self._inside = {}


def _probe(w: flat.Words, h: np.ndarray, q: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the block's q-word shingles that are among the sorted keys, and which key each is."""
    g = flat.grams(h, q)
    if not len(g) or not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
    hit = np.flatnonzero(keys[at] == g)
    text = np.searchsorted(w.first, hit, "right") - 1
    hit = hit[hit + q <= w.first[text + 1]]  # a shingle across two texts is none
    return hit, at[hit]


def _matches(items: _Items, w: flat.Words, h: np.ndarray, same: set):
    """(first words, size, windows) of the windows that occur in a block of texts; same: what was compared before."""
    for q, (keys, first, place, sizes) in items.index.items():
        hits, key = _probe(w, h, q, keys)
        if not len(hits):
            continue
        count = first[key + 1] - first[key]
        at = _ranges(first[key], count)
        start, size = np.repeat(hits, count) - place[at], sizes[at]
        text = np.repeat(np.searchsorted(w.first, hits, "right") - 1, count)
        fits = (start >= w.first[text]) & (start + size <= w.first[text + 1])
        start, size = start[fits], size[fits]
        for z in flat.distinct(size).tolist():
            own = flat.distinct(start[size == z])
            hashed, item, begin = items.windows[z]
            g = flat.grams(h, z)[own]
            i = np.minimum(np.searchsorted(hashed, g), len(hashed) - 1)
            own, i = own[hashed[i] == g], i[hashed[i] == g]
            good = np.zeros(len(own), bool)
            for x, (s, k) in enumerate(zip(own.tolist(), i.tolist())):
                seen = z, k, w.data[w.start[s] : w.end[s + z - 1]].tobytes()
                if seen not in same:
                    told = items.words[item[k]][begin[k] : begin[k] + z]
                    if [w.word(s + y) for y in range(z)] != told:
                        continue
                    same.add(seen)
                good[x] = True
            yield own[good], z, i[good]


def _counted(texts: DataFrame, block: _Items) -> None:
    """Choose the block's rarest shingles: one pass over the texts counts all of them."""
    spark = texts.sparkSession
    asked = spark.sparkContext.broadcast(block.shingles)

    def count(batches):
        total = {q: np.zeros(len(x), np.int64) for q, x in asked.value.items()}
        for batch in batches:
            for _, _, raw, offsets in flat.blocks(batch.column(0)):
                w = flat.words(raw, offsets, flat.ALNUM)
                h = w.hashes()
                for q, x in asked.value.items():
                    total[q] += np.bincount(_probe(w, h, q, x)[1], minlength=len(x))
        for q, n in total.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), q), pa.int64()), pa.array(some, pa.int64()), pa.array(n[some], pa.int64())], names=["q", "shingle", "n"])

    counts = {q: np.zeros(len(x), np.int64) for q, x in block.shingles.items()}
    if counts:
        # at most one row for each shingle of the block comes back
        counted = texts.mapInArrow(tidy(count), "q long, shingle long, n long").groupBy("q", "shingle").agg(F.sum("n").alias("n")).toArrow()
        length, shingle, n = (counted.column(c).to_numpy() for c in ("q", "shingle", "n"))
        for q, own in counts.items():
            own[shingle[length == q]] = n[length == q]
    block.choose(counts)


def _pass(docs: DataFrame, block: _Items, text: str, tag: str, goes_on: bool) -> DataFrame:
    """docs with the columns of _FOUND, their names ending in `tag`; it has them already if the pass goes on from another."""
    told = docs.sparkSession.sparkContext.broadcast(block)
    names = [f"{c}{tag}" for c in _FOUND]
    kept = [c for c in docs.columns if c not in names]
    at = docs.columns.index(text)

    def find(batches):
        b, same = told.value, set()
        for batch in batches:
            n_words, spans, found = [], [], []
            before = [batch.column(batch.schema.get_field_index(f"{c}{tag}")).to_pylist() for c in ("__spans", "__items")] if goes_on else None
            row = 0
            for lo, hi, raw, offsets in flat.blocks(batch.column(at)):
                w = flat.words(raw, offsets, flat.ALNUM)
                h = w.hashes()
                edges = np.zeros(len(h) + 1, np.int64)
                which: dict[int, set] = {}
                for start, z, window in _matches(b, w, h, same):
                    np.add.at(edges, start, 1)
                    np.add.at(edges, start + z, -1)
                    first, ids = b.ids[z]
                    pairs = flat.distinct((np.searchsorted(w.first, start, "right") - 1) << 32 | window)
                    for t, k in zip((pairs >> 32).tolist(), (pairs & 0xFFFFFFFF).tolist()):
                        which.setdefault(t, set()).update(ids[first[k] : first[k + 1]])
                if len(same) > 200_000:
                    same.clear()
                hit = np.cumsum(edges[:-1]) > 0
                for i in range(hi - lo):
                    a, z = w.first[i], w.first[i + 1]
                    mark, ids = hit[a:z], which.get(i, set())
                    if before:
                        mark = mark.copy()
                        for x in before[0][row]:
                            mark[x["start"] : x["end"]] = True
                        ids.update(before[1][row])
                    edge = np.flatnonzero(np.diff(mark, prepend=False, append=False)) if mark.any() else ()
                    spans.append([{"start": int(x), "end": int(y)} for x, y in zip(edge[::2], edge[1::2])])
                    found.append(sorted(x for x in ids if x is not None))
                    n_words.append(int(z - a))
                    row += 1
            made = [pa.array(x, kind) for x, kind in zip((n_words, spans, found), _KINDS)]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), *made], names=[*kept, *names])

    schema = [f"`{c}` {t}" for c, t in docs.dtypes if c in kept] + [f"`{c}` {t}" for c, t in zip(names, _FOUND.values())]
    return docs.mapInArrow(tidy(find), ", ".join(schema))


def marked(docs: DataFrame, items: DataFrame, text: str = "text", item_text: str = "text", item_id: str = "item_id", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, tag: str = "") -> DataFrame:
    """Every row of docs, whole, with __n_words, __n_hit, __spans and __items; see `contamination` for their meaning.

    The rows stay in place: each pass over a block of items adds to what the passes before it found. Shingles are counted
    on the texts as they came, so work grows with the number of blocks. `tag` ends the new names, where docs may have some
    like them.
    """
    prepare(docs.sparkSession)
    asked = items.select(F.col(item_id).cast("string").alias("id"), F.col(item_text).alias("text")).filter("text is not null").distinct()
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = -(-size // block_bytes) or 1
    dealt = asked.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(n_blocks)))
    out, texts = docs, docs.select(text)
    for i in range(n_blocks):
        rows = dealt.filter(F.col("block") == i).drop("block").toArrow()  # block_bytes of item text on average
        block = _Items(rows.column("id").to_pylist(), rows.column("text").combine_chunks(), window)
        _counted(texts, block)
        out = _pass(out, block, text, tag, i > 0)
    return out.withColumn(f"__n_hit{tag}", F.expr(f"aggregate(`__spans{tag}`, 0L, (a, x) -> a + x.end - x.start)"))


def contamination(
    docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id", window: int = WINDOW, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """(doc_id, n_words, n_hit, spans, items) for every row of docs.

    spans: maximal runs of hit words (word positions, end exclusive); items: the distinct ids (as strings, sorted) of
    items of which a window occurs. Words: `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z is lower-cased. Null and
    empty texts have no words and no hits; an item without words has no window. Repeated rows get equal results;
    repeated items count once by id; an item without id marks words but isn't listed. Empty tables give no rows or no
    hits. Other columns are ignored.
    """
    mine = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = marked(mine, items, "text", item_text, item_id, window, block_bytes)
    return found.select("doc_id", F.col("__n_words").alias("n_words"), F.col("__n_hit").alias("n_hit"), F.col("__spans").alias("spans"), F.col("__items").alias("items"))


def contaminated(share: int = 20, n_hit: str = "n_hit", n_words: str = "n_words"):
    """At least one hit, and hits are at least one word in `share`."""
    return F.expr(f"{n_hit} > 0 and {share} * {n_hit} >= {n_words}")
