"""Vector code compression by Lloyd rounds that rescan only parts whose bounds the entries' moves have broken."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import cut, prepare, shared, tidy, unlink

PARTS = 16
ENTRIES = 64
ROUNDS = 2
#: Labels up to this number (some 40 bytes each) have their sums broadcast; beyond, rows are joined over SALT copies.
MANY_LABELS = 1 << 20
SALT = 64
#: Bounds are kept so much tighter than they are, for roundings.
MARGIN = 1e-3


@dataclass
class Codebooks:
    """Entries by part position and index, and how far they have moved."""

    entries: np.ndarray  # positions x entries x width, int64
    drift: np.ndarray  # positions x entries: an entry's own moves and the farthest moves among the others, over all rounds

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def distances(parts: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of each part to each entry: as doubles if these hold them, else as 64-bit integers."""
    most = 2 * max(np.abs(parts).max(initial=0), np.abs(entries).max(initial=0))
    if parts.shape[1] * int(most) ** 2 < 1 << 53:
        x, c = parts.astype(np.float64), entries.astype(np.float64)
        return (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None, :]
    return np.stack([((parts - c) ** 2).sum(1) for c in entries], 1)


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry (the lower one of a tie), and the slack: least distance to the others minus that to it."""
    far = distances(parts, entries)
    best = far.argmin(1)
    least = np.sqrt(far[np.arange(len(best)), best].astype(np.float64))
    if far.shape[1] == 1:
        return best, np.full(len(best), np.inf)
    others = np.sqrt(np.partition(far, 1, axis=1)[:, 1].astype(np.float64))
    return best, others - least - MARGIN - 1e-12 * others


@dataclass
class Heaps:
    """For each entry of a part position, a heap of the block's parts assigned to it, the least slack on top.

    The heaps of a position lie one after another in `row` and `key`, each in ascending order (an array in order is a
    heap). A key is the slack when its part was last looked at plus the entry's drift by then, so it needs no change as
    the drift grows: the part is to be looked at again once the drift has reached its key.
    """

    row: np.ndarray
    key: np.ndarray
    size: np.ndarray  # of each entry's heap

    @classmethod
    def of(cls, assigned: np.ndarray, key: np.ndarray, row: np.ndarray, entries: int) -> Heaps:
        order = np.lexsort((key, assigned))
        return cls(row[order], key[order], np.bincount(assigned, minlength=entries))

    def pop(self, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, entries) of all parts on top whose key the drift of their entry has reached."""
        first = np.cumsum(self.size) - self.size
        taken = np.array([np.searchsorted(self.key[a : a + n], d, "right") for a, n, d in zip(first, self.size, drift)], np.int64)
        return np.repeat(first - (np.cumsum(taken) - taken), taken) + np.arange(taken.sum()), np.repeat(np.arange(len(taken)), taken)

    def assigned(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.size)), self.size)


def first_pass(parts: np.ndarray, books: Codebooks) -> tuple[list[Heaps], np.ndarray]:
    """The heaps of each position once every part is assigned, and by entry the sums of its parts with their count last."""
    n, positions, width = parts.shape
    entries = books.entries.shape[1]
    sums, heaps = np.zeros((positions, entries, width + 1), np.int64), []
    for m in range(positions):
        best, slack = nearest(parts[:, m], books.entries[m])
        np.add.at(sums[m], best, np.concatenate((parts[:, m], np.ones((n, 1), np.int64)), 1))
        heaps.append(Heaps.of(best, slack + books.drift[m][best], np.arange(n), entries))
    return heaps, sums


def next_pass(parts: np.ndarray, heaps: list[Heaps], books: Codebooks) -> tuple[list[Heaps], np.ndarray, int]:
    """The heaps after entries moved, what the sums gain (parts that stay change nothing), and how many parts were popped."""
    positions, entries, width = books.entries.shape
    gain, out, seen = np.zeros((positions, entries, width + 1), np.int64), [], 0
    for m, heap in enumerate(heaps):
        places, entry = heap.pop(books.drift[m])
        seen += len(places)
        if len(places):
            rows = heap.row[places]
            best, slack = nearest(parts[rows, m], books.entries[m])
            away = best != entry
            load = np.concatenate((parts[rows[away], m], np.ones((int(away.sum()), 1), np.int64)), 1)
            np.add.at(gain[m], best[away], load)
            np.add.at(gain[m], entry[away], -load)
            assigned, key = heap.assigned(), heap.key.astype(np.float64)
            assigned[places], key[places] = best, slack + books.drift[m][best]
            heap = Heaps.of(assigned, key, heap.row, entries)
        out.append(heap)
    return out, gain, seen


def moved(books: Codebooks, sums: np.ndarray) -> Codebooks:
    """Each entry at the floor of its parts' mean (unused ones stay), and the drifts grown by the moves."""
    entries = books.entries.copy()
    used = sums[:, :, -1] > 0
    entries[used] = sums[used][:, :-1] // sums[used][:, -1:]
    own = np.sqrt(((entries - books.entries).astype(np.float64) ** 2).sum(2)) * (1 + 1e-9)
    drift = books.drift.copy()
    for m in range(len(own) if own.shape[1] > 1 else 0):
        second, first = np.argsort(own[m])[-2:]
        others = np.full(own.shape[1], own[m][first])
        others[first] = own[m][second]
        drift[m] += own[m] + others
    return Codebooks(entries, drift)


def integers(column: pa.Array, width: int) -> np.ndarray:
    """floor(256 x) of each component, cut into parts."""
    x = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * 256)
    if (column.value_lengths().to_numpy(zero_copy_only=False) != PARTS * width).any():
        raise ValueError(f"all vectors must have {PARTS * width} components")
    if PARTS * width * (2 * np.abs(x).max(initial=0)) ** 2 >= 2.0**63:
        raise ValueError("components are too large for squared distances of 64 bits")
    return x.astype(np.int64).reshape(len(column), PARTS, width)


#: A row is a block of vectors with its heaps (kind block), or a task's sums (kind sums).
_STATE = "ids array<long>, labels array<long>, wide int, parts binary, row binary, key binary, size binary, sums array<long>, seen long, kind string"
_ARROW = pa.schema([("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.int64())), ("wide", pa.int32()), *((n, pa.binary()) for n in ("parts", "row", "key", "size")), ("sums", pa.list_(pa.int64())), ("seen", pa.int64()), ("kind", pa.string())])


def _block(ids: pa.Array, labels: pa.Array, parts: np.ndarray, heaps: list[Heaps]) -> dict:
    wide = 2 if np.abs(parts).max(initial=0) < 1 << 15 else 8
    keys = np.concatenate([h.key for h in heaps])
    # the next smaller float: a part may be looked at once too often, never too rarely
    low = np.nextafter(keys.astype(np.float32), np.float32(-np.inf))
    return {
        "ids": ids.to_pylist(), "labels": labels.to_pylist(), "wide": wide, "parts": parts.astype(f"i{wide}").tobytes(), "row": np.concatenate([h.row for h in heaps]).astype(np.int32).tobytes(),
        "key": low.tobytes(), "size": np.concatenate([h.size for h in heaps]).astype(np.int32).tobytes(), "kind": "block",
    }


def _opened(batch: pa.RecordBatch, i: int, width: int) -> tuple[list, list, np.ndarray, list[Heaps]]:
    row = {n: batch.column(k)[i].as_py() for k, n in enumerate(batch.schema.names)}
    parts = np.frombuffer(row["parts"], f"i{row['wide']}").astype(np.int64).reshape(-1, PARTS, width)
    at, key, size = (np.frombuffer(row[n], kind).reshape(PARTS, -1) for n, kind in (("row", np.int32), ("key", np.float32), ("size", np.int32)))
    # a sort by float32 keys keeps the order of each heap
    return row["ids"], row["labels"], parts, [Heaps(at[m].astype(np.int64), key[m], size[m].astype(np.int64)) for m in range(PARTS)]


def _seeds(rows: DataFrame, entries: int) -> np.ndarray:
    """The first vectors by id as entries; rows of one id come by their components, rows without id last."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).collect()
    if not first:
        return np.zeros((PARTS, 0, 0), np.int64)
    size = len(first[0]["vector"])
    if size % PARTS:
        raise ValueError(f"vectors of {size} components can't be cut into {PARTS} parts")
    found = integers(pa.array([r["vector"] for r in first], pa.list_(pa.float64())), size // PARTS)
    return np.ascontiguousarray(found.transpose(1, 0, 2))


def _summed(states: DataFrame, like: tuple[int, ...]) -> tuple[np.ndarray, int]:
    """The tasks' sums together: as many numbers as a codebook has, whatever the input."""
    told = states.filter("kind = 'sums'")
    out = np.zeros(int(np.prod(like)), np.int64)
    for r in told.select(F.posexplode("sums").alias("at", "value")).groupBy("at").agg(F.sum("value").alias("value")).collect():
        out[r["at"]] = r["value"]
    return out.reshape(like), int(told.agg(F.sum("seen")).first()[0] or 0)


@dataclass
class Compressed:
    codes: DataFrame  # vec_id, label, code, error
    books: Codebooks
    seen: list[int]  # parts looked at in each round after the first


def compress(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", entries: int = ENTRIES, rounds: int = ROUNDS) -> Compressed:
    """(vec_id, label, code, error) of every vector with finite components only, and the codebooks.

    Rows whose vector is null, empty, or holds a null or a non-finite component are dropped. Every round is one job over
    blocks of vectors; a block's heaps are written to the shared folder with it, so a lost executor costs its tasks only.
    Parts that stay with their entry aren't read again: the sums of a round are those of the one before and what the
    moved parts change. Repeated ids and rows are compressed one by one, labels may be null, fewer vectors than `entries`
    make smaller codebooks, an empty table gives no rows. Vectors of different lengths, of a length that PARTS doesn't
    divide, or of components whose squared distances leave 64 bits raise ValueError. Other columns are ignored.
    """
    spark = vectors.sparkSession
    prepare(spark)
    fine = F.col("vector").isNotNull() & (F.size("vector") > 0) & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("vector")).filter(fine)
    seeds = _seeds(rows, entries)
    width, books = seeds.shape[2], Codebooks(seeds, np.zeros(seeds.shape[:2]))
    like = (*seeds.shape[:2], width + 1)
    path, seen = shared(spark, "codes"), []

    def begin(batches: Iterator[pa.RecordBatch], books: Codebooks = books) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(like, np.int64)
        for batch in batches:
            parts = integers(batch.column(2), width)
            heaps, own = first_pass(parts, books)
            sums += own
            yield pa.RecordBatch.from_pylist([_block(batch.column(0), batch.column(1), parts, heaps)], _ARROW)
        yield pa.RecordBatch.from_pylist([{"sums": sums.ravel().tolist(), "seen": 0, "kind": "sums"}], _ARROW)

    def again(books: Codebooks):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            gain, n = np.zeros(like, np.int64), 0
            for batch in batches:
                for i in range(batch.num_rows):
                    ids, labels, parts, heaps = _opened(batch, i, width)
                    heaps, own, count = next_pass(parts, heaps, books)
                    gain, n = gain + own, n + count
                    yield pa.RecordBatch.from_pylist([_block(pa.array(ids, pa.int64()), pa.array(labels, pa.int64()), parts, heaps)], _ARROW)
            yield pa.RecordBatch.from_pylist([{"sums": gain.ravel().tolist(), "seen": n, "kind": "sums"}], _ARROW)

        return run

    def finish(books: Codebooks):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    ids, labels, parts, heaps = _opened(batch, i, width)
                    heaps, _, count = next_pass(parts, heaps, books)
                    code, error = np.empty((len(ids), PARTS), np.uint8), np.zeros(len(ids), np.int64)
                    for m, heap in enumerate(heaps):
                        code[heap.row, m] = heap.assigned()
                        error += ((parts[:, m] - books.entries[m][code[:, m]]) ** 2).sum(1)
                    text = code.tobytes().hex()
                    codes = [text[j : j + 2 * PARTS] for j in range(0, len(text), 2 * PARTS)]
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(labels, pa.int64()), pa.array(codes, pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

        return run

    state = rows.mapInArrow(tidy(begin), _STATE)
    sums = np.zeros(like, np.int64)
    for i in range(rounds):
        state.write.partitionBy("kind").parquet(f"{path}/{i}")
        states = spark.read.schema(_STATE).parquet(f"{path}/{i}")
        gain, n = _summed(states, like)
        sums, seen = sums + gain, seen + [n] * (i > 0)
        books = moved(books, sums)
        state = states.filter("kind = 'block'")
        if i + 1 < rounds:
            state = state.mapInArrow(tidy(again(books)), _STATE)
    codes = cut((state if rounds else rows.mapInArrow(tidy(begin), _STATE).filter("kind = 'block'")).mapInArrow(tidy(finish(books)), "vec_id long, label long, code string, error long"))
    unlink(spark, path)
    return Compressed(codes, books, seen)


def with_label_errors(codes: DataFrame) -> DataFrame:
    """`codes` with the errors of all rows of the same label (null is one) summed as label_error.

    Labels may be few and hot, or many: up to MANY_LABELS their sums are broadcast, beyond that each is joined in SALT
    copies, over which its rows are dealt.
    """
    name, salt, total = (f"{x}_{uuid.uuid4().hex}" for x in ("label", "salt", "total"))
    sums = cut(codes.groupBy(F.col("label").alias(name)).agg(F.sum("error").alias(total)))
    if sums.count() <= MANY_LABELS:
        return codes.join(F.broadcast(sums), F.col("label").eqNullSafe(F.col(name)), "left").withColumn("label_error", F.col(total)).drop(name, total)
    dealt = codes.withColumn(salt, F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALT)))
    copies = sums.withColumn(f"{salt}_", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    met = dealt.join(copies, F.col("label").eqNullSafe(F.col(name)) & (F.col(salt) == F.col(f"{salt}_")), "left")
    return met.withColumn("label_error", F.col(total)).drop(name, total, salt, f"{salt}_")
