"""N-gram Jaccard self-join: class-wise token combinations as prefixes, verified on whole shingle sets.

Shingles are ordered rare class first, frequent class last (within a class by hash). Rare shingles are indexed alone.
Frequent ones are dealt to small groups by hash, and every pair of a group is indexed; the prefix is extended until
losing the allowed number of shingles can't destroy every indexed single and pair:

    rare + sum(max(0, group - 1)) >= allowed losses + 1

so two linked sets always share an indexed entry (the class of a shingle is a function of the shingle alone, and the
number of groups one of the size level under which both sets are indexed). Classes only steer cost; any class
assignment gives the same links.

Candidates are verified where they meet, in two steps, neither of which writes out pairs of a group:

1. The sets of an entry are compared by parity sketches, which never rule out a link. What may link is joined to a
   forest, entry by entry; the trees of all entries together make blobs, and every link lies inside one blob.
2. The whole sets of a blob are brought together once and compared exactly; a spanning forest of its links comes out.

Entries and blobs beyond a fixed size are dealt to a grid of cells, so that no task holds more than two chunks.
"""

from __future__ import annotations

import uuid
import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flat
from .components import components
from .runtime import MAX_BROADCAST_BYTES, cut, prepare, tidy

SHINGLE = 5
#: Two sets link when 100 * intersection >= SIMILARITY * union.
SIMILARITY = 80
#: Distinct-set estimate from which on a shingle is of the frequent class: set bits of a 16-bit linear counter.
FREQUENT_BITS = 13
#: Frequent shingles that are told to the workers; further ones stay in the rare class, which costs time, not links.
MAX_FREQUENT = MAX_BROADCAST_BYTES // 16
#: Rows and shingles of the sets that a task holds at once; larger entries and blobs are dealt to cells of two chunks.
CHUNK_ROWS = 2048
CHUNK_SHINGLES = 2 << 20
#: Cells of a parity sketch for each shingle of the set, at least.
SKETCH_CELLS = 2
#: log2 of the least and most bits of the filter that finds the candidates' texts again (16 for each candidate between
#: them); false hits are dropped by a join.
FILTER_BITS = 16, (MAX_BROADCAST_BYTES * 8).bit_length() - 1


def _sets(column: pa.Array, k: int):
    """For each text its sorted distinct shingle hashes and its class key (0 for a text without words)."""
    for lo, hi, raw, offsets in flat.blocks(column):
        w = flat.words(raw, offsets, flat.NON_SPACE)
        hashes = w.hashes()
        whole = flat.grams(hashes, k)
        for i in range(hi - lo):
            a, b = w.first[i], w.first[i + 1]
            if a == b:
                yield np.zeros(0, np.uint64), 0
                continue
            s = np.sort(whole[a : b - k + 1] if b - a >= k else flat.grams(hashes[a:b], int(b - a)))
            s = s[flat.changes(s)]
            yield s, int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def _bounds(n: int, similarity: int) -> tuple[int, int, int]:
    """Smallest and largest size of a partner, and the least overlap with one, of a set of n."""
    least = -(-similarity * n // 100)
    return least, 100 * n // similarity, least


def _groups_at(level: int) -> int:
    return max(1, (1 << level) // 24)


def signatures(s: np.ndarray, frequent: np.ndarray, token_bits: int, similarity: int = SIMILARITY) -> np.ndarray:
    """The entries under which a set (sorted distinct hashes) is indexed; none if only an equal set can be its partner."""
    n = len(s)
    low, high, least = _bounds(n, similarity)
    if low == n == high or n == 0:
        return np.zeros(0, np.uint64)
    need = n - least + 1
    if len(frequent):
        token = s >> np.uint64(64 - token_bits)
        common = frequent[np.minimum(np.searchsorted(frequent, token), len(frequent) - 1)] == token
        rare, often = s[~common], s[common]
    else:
        rare, often = s, s[:0]
    out = [rare[:need]]
    missing = need - len(rare)
    if missing > 0:
        for level in range(low.bit_length() - 1, high.bit_length()):
            groups = _groups_at(level)
            g = ((often & np.uint64(0xFFFFFFFF)) % np.uint64(groups)).astype(np.int64)
            # the shortest prefix in which `missing` shingles are not the first of their group
            first = np.zeros(len(often), bool)
            by_group = np.argsort(g, kind="stable")
            first[by_group[flat.changes(g[by_group])]] = True
            upto = int(np.searchsorted(np.cumsum(~first), missing)) + 1
            t, g = often[:upto], g[:upto]
            order = np.argsort(g, kind="stable")
            t, g = t[order], g[order]
            cuts = np.flatnonzero(np.diff(g)) + 1
            for part in np.split(t, cuts):
                if len(part) > 1:
                    i, j = np.triu_indices(len(part), 1)
                    out.append(flat.mix(part[i] * np.uint64(0x9E3779B97F4A7C15) + part[j] + np.uint64(level)))
    return np.concatenate(out)


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x, pa.int64())


def _level(n):
    """log2 of the cells of the parity sketch of a set of n."""
    return np.maximum(6, np.ceil(np.log2(SKETCH_CELLS * np.maximum(n, 1))).astype(np.int64))


def parity(s: np.ndarray) -> bytes:
    """For each of 2^_level(len(s)) cells whether it holds an odd number of the hashes.

    Two sets differ in at least as many elements as their parities, folded to one width, differ in bits.
    """
    bits = 1 << int(_level(len(s)))
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def document_sets(docs: DataFrame, text: str, doc_id: str, k: int = SHINGLE) -> DataFrame:
    """(doc_id, text_hash, n, key, parity): size of each document's shingle set, a 64-bit key equal for equal sets, and its parity sketch.

    Without words n is 0, and key and parity are null.
    """

    def run(batches):
        for batch in batches:
            n, key, sketch = [], [], []
            for s, c in _sets(batch.column(1), k):
                n.append(len(s))
                key.append(c if len(s) else None)
                sketch.append(parity(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(key, pa.int64()), pa.array(sketch, pa.binary())], names=["doc_id", "text_hash", "n", "key", "parity"])

    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("text_hash"))
    return chosen.mapInArrow(tidy(run), "doc_id long, text_hash long, n long, key long, parity binary")


def _token_bits(total: int) -> int:
    """Leading hash bits that stand for a shingle when shingles are counted: about two values for each."""
    return min(59, max(16, total.bit_length() + 1))


def _frequent(texts: DataFrame, total: int, k: int) -> np.ndarray:
    """Sorted tokens of shingles in many different sets: 16-bit linear counters, so copies of a set count once."""
    token_bits = _token_bits(total)
    ranges = min(token_bits, max(5, (max(1, total) >> 21).bit_length()))
    shift, part_of = np.uint64(64 - token_bits), np.uint64(token_bits + 4 - ranges)

    def count(batches):
        def flush(parts):
            s = flat.distinct(np.concatenate(parts))
            at = np.searchsorted((s >> part_of).astype(np.int64), np.arange((1 << ranges) + 1))
            made = [(i, _packed(s[a:b])) for i, (a, b) in enumerate(zip(at, at[1:])) if b > a]
            return pa.RecordBatch.from_arrays([pa.array([i for i, _ in made], pa.int32()), pa.array([x for _, x in made], pa.binary())], names=["part", "packed"])

        held, size, seen = [], 0, set()
        for batch in batches:
            for s, key in _sets(batch.column(0), k):
                if len(s) and key not in seen:
                    seen.add(key)
                    # a token and the bit of its counter that this set sets
                    held.append((s >> shift) << np.uint64(4) | np.uint64(key & 15))
                    size += len(s)
                    if len(seen) > 1_000_000:
                        seen.clear()
            if size > 4_000_000:
                yield flush(held)
                held, size = [], 0
        if held:
            yield flush(held)

    def reduce(table):
        s = flat.distinct(np.concatenate([_unpacked(x.as_py()) for x in table.column("packed")]))
        token = s >> np.uint64(4)
        first = np.flatnonzero(flat.changes(token))
        many = np.diff(np.append(first, len(s))) >= FREQUENT_BITS
        return pa.table({"token": _long(token[first][many])})

    found = texts.mapInArrow(tidy(count), "part int, packed binary").groupBy("part").applyInArrow(reduce, "token long")
    found = cut(found)
    told = found.count()
    if told > MAX_FREQUENT:  # an even share by hash, the same in every run
        found = found.filter(F.pmod(F.xxhash64("token"), F.lit(told)) < MAX_FREQUENT * 9 // 10)
    return np.sort(found.toArrow().column(0).to_numpy().astype(np.int64).view(np.uint64))


def _packed(s: np.ndarray) -> bytes:
    """Sorted values as differences, byte planes apart, compressed."""
    d = np.diff(s, prepend=np.uint64(0))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes())


def _unpacked(x: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _runs(index: DataFrame, similarity: int) -> DataFrame:
    """(run, wide, part, key, n): sets that share an entry and may link by size.

    An entry's sets are cut by size where no set fits the next larger one; pieces of one set go, pieces of the same
    sets make one run in a task (a hash of the keys names it). Entries beyond a chunk are wide: they go out as they
    come in, in parts that follow each other in size.
    """

    def run(batches):
        known: set[int] = set()
        # rows that aren't worked on yet; all of the last entry stay here till it ends
        held, rows, total = [], 0, 0
        wide = None  # (entry, part, rows and shingles of the part, key of the last row) of a wide entry that goes on

        def batch_of(name, is_wide, part, key, n):
            columns = [name.view(np.int64), np.full(len(key), is_wide), part, key, n]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["run", "wide", "part", "key", "n"])

        def narrow(sig, key, n):
            keep = flat.changes(sig) | flat.changes(key)
            sig, key, n = sig[keep], key[keep], n[keep]
            new = flat.changes(sig)
            new[1:] |= similarity * n[1:] > 100 * n[:-1]
            at = np.flatnonzero(new)
            size = np.diff(np.append(at, len(sig)))
            many = np.repeat(size > 1, size)
            key, n, size = key[many], n[many], size[size > 1]
            if not len(size):
                return
            first = np.cumsum(size) - size
            name = flat.mix(np.add.reduceat(flat.mix(key.view(np.uint64)), first) + size.astype(np.uint64))
            order = np.argsort(name, kind="stable")
            fresh = np.zeros(len(name), bool)
            fresh[order[flat.changes(name[order])]] = True
            fresh &= np.fromiter((x not in known for x in name.tolist()), bool, len(name))
            known.update(name[fresh].tolist())
            if len(known) > 1_000_000:
                known.clear()
            inside = np.repeat(fresh, size)
            if inside.any():
                yield batch_of(np.repeat(name, size)[inside], False, np.zeros(inside.sum(), np.int32), key[inside], n[inside])

        def widen(sig, key, n):
            """Rows of one entry; its parts go on from those of the rows before."""
            nonlocal wide
            _, part, there, shingles, last = wide
            keep = flat.changes(key)
            keep[0] = key[0] != last
            key, n = key[keep], n[keep]
            if not len(key):
                return
            parts = np.empty(len(key), np.int32)
            lo = 0
            while lo < len(key):
                room = np.searchsorted(np.cumsum(n[lo:]), CHUNK_SHINGLES - shingles, "right")
                hi = lo + int(max(there == 0, min(CHUNK_ROWS - there, room, len(key) - lo)))
                parts[lo:hi] = part
                there, shingles = there + hi - lo, shingles + int(n[lo:hi].sum())
                if hi < len(key):
                    part, there, shingles = part + 1, 0, 0
                lo = hi
            wide = sig, part, there, shingles, key[-1]
            yield batch_of(np.full(len(key), flat.mix(np.array([sig]).view(np.uint64))[0]), True, parts, key, n)

        def work(last: bool):
            nonlocal held, rows, total, wide
            sig, key, n = (np.concatenate(c) for c in zip(*held))
            end = len(sig) if last else int(np.searchsorted(sig, sig[-1]))
            if wide is not None:
                own = int(np.searchsorted(sig, wide[0], "right")) if sig[0] == wide[0] else 0
                if own:
                    yield from widen(int(sig[0]), key[:own], n[:own])
                    sig, key, n, end = sig[own:], key[own:], n[own:], max(0, end - own)
                if len(sig) or last:
                    wide = None
            # entries beyond a chunk that ended here, or go on
            at = np.flatnonzero(flat.changes(sig)) if len(sig) else np.zeros(0, np.int64)
            ends = np.append(at[1:], len(sig)) if len(at) else at
            weight = np.add.reduceat(n, at) if len(at) else at
            big = (ends - at > CHUNK_ROWS) | (weight > CHUNK_SHINGLES) & (ends - at > 1)
            small = np.ones(len(sig), bool)
            for a, b in zip(at[big].tolist(), ends[big].tolist()):
                wide = int(sig[a]), 0, 0, 0, None
                yield from widen(int(sig[a]), key[a:b], n[a:b])
                small[a:b] = False
                if b < len(sig) or last:
                    wide = None
            done = small[:end] if end else small[:0]
            if done.any():
                yield from narrow(sig[:end][done], key[:end][done], n[:end][done])
            rest = np.flatnonzero(small[end:]) + end
            held = [(sig[rest], key[rest], n[rest])] if len(rest) else []
            rows, total = len(rest), int(n[rest].sum())

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(tuple(batch.column(i).to_numpy() for i in range(3)))
            rows, total = rows + batch.num_rows, total + int(held[-1][2].sum())
            if rows > 200_000:
                yield from work(False)
        if held:
            yield from work(True)

    dealt = index.repartition("sig").sortWithinPartitions("sig", "n", "key")
    return dealt.mapInArrow(tidy(run), "run long, wide boolean, part int, key long, n long")


def _cells(runs: DataFrame, similarity: int) -> DataFrame:
    """(run, i, j, part, key, n): the runs, the wide ones as cells of two parts that may link by size (i = j: one part)."""
    narrow = runs.filter("not wide").select("run", F.lit(0).alias("i"), F.lit(0).alias("j"), "part", "key", "n").distinct()
    wide = runs.filter("wide").drop("wide")
    parts = wide.groupBy("run", "part").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    x, y = parts.select("run", F.col("part").alias("i"), F.col("most").alias("below")), parts.select("run", F.col("part").alias("j"), F.col("least").alias("above"))
    cells = x.join(y, "run").filter((F.col("i") <= F.col("j")) & (similarity * F.col("above") <= 100 * F.col("below")))
    ends = cells.select("run", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("part"))
    return narrow.unionByName(wide.join(ends, ["run", "part"]).select(*narrow.columns))


def _grouped(batches, width: int):
    """The rows of each run of equal values of the first `width` columns, as lists of the other columns' Arrow slices."""
    name, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy() for i in range(width)]
        new = np.zeros(batch.num_rows, bool)
        new[0] = True
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        at = [*np.flatnonzero(new).tolist(), batch.num_rows]
        for a, b in zip(at, at[1:]):
            own = tuple(int(c[a]) for c in columns)
            if name is not None and own != name:
                yield held
                held = []
            name = own
            held.append([batch.column(i).slice(a, b - a) for i in range(width, batch.num_columns)])
    if held:
        yield held


def _one(held: list, i: int) -> pa.Array:
    return held[0][i] if len(held) == 1 else pa.concat_arrays([h[i] for h in held])


def _pairs_in_batches(found):
    """(a, b) pairs as Arrow batches."""
    out = []
    for pair in found:
        out.append(pair)
        if len(out) >= 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b"])
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b"])


def _may_link(cells: DataFrame, sketches: DataFrame, similarity: int) -> DataFrame:
    """(a, b): a spanning forest, cell by cell, of the pairs that parity sketches don't rule out."""

    def forest(held):
        part, key, n = (_one(held, i).to_numpy() for i in range(3))
        if len(key) < 2:
            return
        raw = _one(held, 3)
        order = np.lexsort((key, n))
        part, key, n = part[order], key[order], n[order]
        raw = [raw[i].as_py() for i in order.tolist()]
        crossed = part.min() != part.max()  # a cell of two parts: pairs within a part are met elsewhere
        root = np.arange(len(key))
        level = _level(n)
        upto = np.searchsorted(n, 100 * n // similarity, "right")
        matrix, base, own = None, 0, -1
        for i in range(len(key) - 1):
            hi = int(upto[i])
            if hi <= i + 1:
                continue
            if level[i] != own:
                own, base = int(level[i]), i
                matrix = np.empty((int(upto[np.searchsorted(level, own, "right") - 1]) - i, 1 << (own - 6)), np.uint64)
                for lv in range(own, int(level[i + len(matrix) - 1]) + 1):
                    a, b = (min(int(np.searchsorted(level, lv, side)), i + len(matrix)) for side in ("left", "right"))
                    a = max(a, i)
                    if b > a:
                        x = np.frombuffer(b"".join(raw[a:b]), np.uint64).reshape(b - a, -1)
                        while x.shape[1] > matrix.shape[1]:
                            half = x.shape[1] // 2
                            x = x[:, :half] ^ x[:, half:]
                        matrix[a - i : b - i] = x
            other = root[i + 1 : hi] != root[i]
            if crossed:
                other &= part[i + 1 : hi] != part[i]
            others = np.flatnonzero(other) + i + 1
            for lo in range(0, len(others), 8192):
                some = others[lo : lo + 8192]
                far = np.bitwise_count(matrix[some - base] ^ matrix[i - base]).sum(axis=1, dtype=np.int64)
                for j in some[(100 + similarity) * far <= (100 - similarity) * (n[some] + n[i])].tolist():
                    if root[j] != root[i]:
                        yield int(key[i]), int(key[j])
                        root[root == root[j]] = root[i]

    def run(batches):
        yield from _pairs_in_batches(pair for held in _grouped(batches, 3) for pair in forest(held))

    rows = cells.join(sketches, "key").select("run", "i", "j", "part", "key", "n", "parity")
    return rows.repartition("run", "i", "j").sortWithinPartitions("run", "i", "j").mapInArrow(tidy(run), "a long, b long").distinct()


def _found_again(docs: DataFrame, wanted: DataFrame, text: str, doc_id: str, k: int) -> DataFrame:
    """(key, n, shingles) of the wanted (key, doc_id): a pass over all texts keeps those whose key and id a filter knows.

    doc_id is that of one row with the key, or null if only rows without an id have it.
    """
    spark = docs.sparkSession
    least, most = FILTER_BITS
    filter_bits = min(most, max(least, (16 * wanted.count()).bit_length()))
    mask = (1 << filter_bits) - 1
    slot = F.col("key").bitwiseXOR(F.coalesce("doc_id", F.lit(0))).bitwiseAND(F.lit(mask))
    bits = wanted.select((slot + 1).alias("slot")).groupBy(F.expr("bitmap_bucket_number(slot)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(slot))").alias("bits"))
    known = np.zeros(1 << (filter_bits - 3), np.uint8)
    size = 4096  # bytes of one bitmap; there are at most 2^filter_bits / 32768 of them
    for bucket, b in bits.toLocalIterator():
        lo = (bucket - 1) * size  # numbers 1 to 32768 are of bucket 1
        part = np.frombuffer(b, np.uint8)[: len(known) - lo]
        known[lo : lo + len(part)] |= part
    shared = spark.sparkContext.broadcast(known)

    def run(batches):
        told = shared.value
        for batch in batches:
            ids = batch.column(0).to_pylist()
            key, kept, out = [], [], []
            for i, (s, c) in enumerate(_sets(batch.column(1), k)):
                if len(s):
                    x = (c ^ (ids[i] or 0)) & mask
                    if told[x >> 3] >> (x & 7) & 1:
                        key.append(c)
                        kept.append(ids[i])
                        out.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(kept, pa.int64()), pa.array(out, pa.binary())], names=["key", "doc_id", "shingles"])

    found = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(tidy(run), "key long, doc_id long, shingles binary")
    same = (found["key"] == wanted["key"]) & found["doc_id"].eqNullSafe(wanted["doc_id"])
    return found.join(wanted, same, "left_semi").dropDuplicates(["key"]).select("key", F.expr("octet_length(shingles) div 8").alias("n"), "shingles")


def linked_forest(sets: list[np.ndarray], side: np.ndarray, group: np.ndarray, similarity: int):
    """(i, j) edges that span the links between sets (sorted distinct hashes) of different groups.

    Sets of one group are taken as linked already. Side 0 links with all, sides 1 and 2 only with each other.
    """
    n = np.array([len(s) for s in sets], np.int64)

    def allowed(i, js):
        return (group[js] != group[i]) & ((side[js] != side[i]) | (side[js] == 0))

    if len(sets) == 2:
        if allowed(0, np.array([1]))[0]:
            both = int((sets[1][np.minimum(np.searchsorted(sets[1], sets[0]), n[1] - 1)] == sets[0]).sum())
            if 100 * both >= similarity * (n.sum() - both):
                yield 0, 1
        return
    owner = np.repeat(np.arange(len(sets)), n)
    token = np.concatenate(sets)
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    waiting = np.ones(len(sets), bool)  # not reached by the search yet
    left = indexed = len(sets)
    for start in np.flatnonzero(side != 2).tolist():  # a link has one end at least there
        if not waiting[start]:
            continue
        waiting[start] = False
        left -= 1
        queue = [start]
        while queue and left:
            i = queue.pop()
            if 2 * left < indexed:  # look up only those that wait
                keep = waiting[owner]
                token, owner, indexed = token[keep], owner[keep], left
            lo, hi = np.searchsorted(token, sets[i], "left"), np.searchsorted(token, sets[i], "right")
            count = hi - lo
            at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
            both = np.bincount(owner[at], minlength=len(sets))
            js = np.flatnonzero(waiting & (both > 0))
            js = js[allowed(i, js) & (100 * both[js] >= similarity * (n[js] + n[i] - both[js]))]
            for j in js.tolist():
                yield i, j
            waiting[js] = False
            left -= len(js)
            queue += js.tolist()
        if not left:
            return


def _links_of(cells: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """(a, b): a spanning forest of the true links of each cell (blob, i, j, side, grp, key)."""

    def forest(held):
        side, group, key = (_one(held, i).to_numpy() for i in range(3))
        if len(key) > 1:
            raw = _one(held, 3)
            own = [np.frombuffer(x.as_buffer(), np.uint64) for x in raw]
            for i, j in linked_forest(own, side, group, similarity):
                if key[i] != key[j]:
                    yield int(key[i]), int(key[j])

    def run(batches):
        yield from _pairs_in_batches(pair for held in _grouped(batches, 3) for pair in forest(held))

    rows = cells.join(sets.select("key", "shingles"), "key").select("blob", "i", "j", "side", "grp", "key", "shingles")
    return rows.repartition("blob", "i", "j").sortWithinPartitions("blob", "i", "j").mapInArrow(tidy(run), "a long, b long")


def _chunks(groups: DataFrame, by: str) -> DataFrame:
    """(by, chunks): into how many chunks the sets of each group go."""
    rows, shingles = F.ceil(F.count("*") / CHUNK_ROWS), F.ceil(F.sum("n") / CHUNK_SHINGLES)
    return groups.groupBy(by).agg(F.greatest(rows, shingles).cast("int").alias("chunks"))


def _exact_links(maybe: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """(a, b): a spanning forest of the true links within the blobs that the pairs `maybe` make.

    A blob of one chunk is compared whole. Of a larger one each chunk is first compared together with a hub, the set
    with most of the pairs; what that leaves outside the largest component then meets all chunks.
    """
    blobs = components(maybe).withColumnsRenamed({"node": "key", "root": "blob"})
    degree = maybe.select(F.explode(F.array("a", "b")).alias("key")).groupBy("key").agg(F.count("*").alias("degree"))
    nodes = blobs.join(sets.select("key", "n"), "key").join(degree, "key")
    hubs = nodes.groupBy("blob").agg(F.max_by("key", F.struct("degree", "key")).alias("hub"))
    nodes = cut(nodes.join(_chunks(nodes, "blob").join(hubs, "blob"), "blob").withColumn("chunk", F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int")))
    whole = nodes.select("blob", F.col("chunk").alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"), F.col("key").alias("grp"), "key")
    split = nodes.filter("chunks > 1")
    told = split.select("blob", F.col("chunk").alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"), F.col("hub").alias("grp"), F.col("hub").alias("key")).distinct()
    first = cut(_links_of(whole.unionByName(told).distinct(), sets, similarity))
    if split.isEmpty():
        return first
    roots = components(first).withColumnsRenamed({"node": "key", "root": "grp"})
    split = split.join(roots, "key", "left").withColumn("grp", F.coalesce("grp", "key"))
    sizes = split.groupBy("blob", "grp").agg(F.count("*").alias("c"))
    main = sizes.groupBy("blob").agg(F.max_by("grp", F.struct("c", "grp")).alias("main"))
    split = cut(split.join(main, "blob"))
    outside = split.filter("grp <> main")
    slices = _chunks(outside, "blob").withColumnRenamed("chunks", "slices")
    left = outside.join(slices, "blob").select("blob", F.pmod(F.xxhash64("key", F.lit(1)), F.col("slices")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("j"), F.lit(1).alias("side"), "grp", "key")
    right = split.join(slices, "blob").select("blob", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("i"), F.col("chunk").alias("j"), F.lit(2).alias("side"), "grp", "key")
    return first.unionByName(cut(_links_of(left.unionByName(right), sets, similarity)))


def jaccard_components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", k: int = SHINGLE, similarity: int = SIMILARITY) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of `docs`.

    A document's set: its distinct k-word shingles, or its whole word sequence as one if it has fewer than k words.
    Sets link when 100 * intersection >= similarity * union; component_id is the smallest doc_id reachable by links.
    Equal sets are one class and only class representatives are compared, so copies are never expanded into pairs.
    A text that is null, empty or blank has no set and is its own component. Rows with the same doc_id are kept, each
    with its own set. A null doc_id takes part in links but never names a component (null if no id does). An empty
    table gives no rows; other columns are ignored. Links are decided on 64-bit shingle hashes.
    """
    return component_rows(docs, text, doc_id, k, similarity).select("doc_id", "n_shingles", "component_id")


def component_rows(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", k: int = SHINGLE, similarity: int = SIMILARITY) -> DataFrame:
    """The rows of `jaccard_components` with `text_hash` (xxhash64 of the text) and `component`.

    component, unlike component_id, tells components apart whatever the ids are; it is null for a text without words.
    """
    spark = docs.sparkSession
    prepare(spark)
    base = cut(document_sets(docs, text, doc_id, k))
    texts = docs.select(F.col(text).alias("text"))
    total = base.agg(F.sum("n")).first()[0] or 0
    frequent, token_bits = spark.sparkContext.broadcast(_frequent(texts, total, k)), _token_bits(total)

    def index(batches):
        often = frequent.value
        seen: set[int] = set()
        for batch in batches:
            sig, key, size = [], [], []
            for s, c in _sets(batch.column(0), k):
                if c in seen:
                    continue
                seen.add(c)
                found = signatures(s, often, token_bits, similarity)
                sig.append(found)
                key.append(np.full(len(found), c))
                size.append(np.full(len(found), len(s)))
            if len(seen) > 1_000_000:
                seen.clear()
            if sig:
                yield pa.RecordBatch.from_arrays([_long(np.concatenate(sig)), _long(np.concatenate(key).astype(np.int64)), _long(np.concatenate(size).astype(np.int64))], names=["sig", "key", "n"])

    runs = cut(_runs(texts.mapInArrow(tidy(index), "sig long, key long, n long"), similarity))
    classes = base.filter("key is not null").groupBy("key").agg(F.min("doc_id").alias("doc_id"))
    sketches = base.select("key", "parity").join(runs.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"])
    maybe = cut(_may_link(_cells(runs, similarity), sketches, similarity))
    ends = maybe.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    sets = cut(_found_again(docs, cut(classes.join(ends, "key", "left_semi")), text, doc_id, k))
    roots = components(_exact_links(maybe, sets, similarity))
    least = classes.join(roots, classes["key"] == roots["node"]).groupBy("root").agg(F.min("doc_id").alias("low"))
    linked = roots.join(least, "root").select(F.col("node").alias("key"), "root", "low")
    # a table of its own: the last join then has no aggregate in its stage, and a key of very many copies can be split
    named = cut(classes.join(linked, "key", "left").select("key", F.coalesce("root", "key").alias("component"), F.coalesce("low", "doc_id").alias("component_id")))
    return (
        base.join(named, "key", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "text_hash", "component")
    )


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", k: int = SHINGLE, similarity: int = SIMILARITY) -> DataFrame:
    """The rows of docs, whole, but of the rows of each component only one: that with the smallest doc_id.

    Ids tie: the smaller hash of the text; texts tie too: any one of the rows. A row without id stays only if its
    component has none with one. Rows whose text has no words are linked with nothing and all stay. Decisions go by id
    and text together, so a row that shares its id with one that goes isn't touched. Empty tables give no rows.
    """
    h, own_id, own_hash, goes = (f"{x}_{uuid.uuid4().hex}" for x in ("hash", "own_id", "own_hash", "goes"))  # docs may have any column
    found = cut(component_rows(docs, text, doc_id, k, similarity).filter("component is not null").groupBy("doc_id", "text_hash", "component").agg(F.count("*").alias("n")))
    first = cut(found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("first")))
    away = F.expr("not (doc_id <=> first.doc_id and text_hash = first.text_hash)")
    # rows that go, and those that are there more than once
    named = found.join(first, "component").withColumn("away", away).filter("away or n > 1").select(F.col("doc_id").alias(own_id), F.col("text_hash").alias(own_hash), F.col("away").alias(goes))
    told = docs.withColumn(h, F.xxhash64(F.col(text))).join(cut(named), F.col(doc_id).cast("long").eqNullSafe(F.col(own_id)) & (F.col(h) == F.col(own_hash)), "left")
    once = told.filter(~F.col(goes)).dropDuplicates([own_id, own_hash])
    return told.filter(F.col(goes).isNull()).unionByName(once).select(*(F.col(f"`{c}`") for c in docs.columns))
