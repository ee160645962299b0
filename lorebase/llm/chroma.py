"""Chroma audio fingerprints: integral-image filters over pitch-class frames as packed integers, and their alignment."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import flat
from .runtime import cut, prepare, tidy

#: Filters (kind, first class, classes, frames), two bits each: sixteen make a 32-bit integer.
FILTERS = [(kind, y, h, w) for kind in range(4) for y, h, w in ((0, 12, 4), (0, 6, 8), (4, 8, 8), (2, 4, 12))]
WIDTH = max(w for *_, w in FILTERS)
# For each filter the quartiles of its value (log of the ratio of its two areas), which part the values
# into four ranges with a Gray code each.
LEVELS = [
    (0.047, 0.152, 0.248), (-0.284, -0.144, 0.021), (0.198, 0.31, 0.407), (-0.271, -0.147, -0.001),
    (-0.02, 0.0, 0.02), (-0.054, 0.0, 0.055), (-0.047, 0.0, 0.047), (-0.055, 0.0, 0.056),
    (-0.078, 0.0, 0.078), (-0.075, 0.0, 0.074), (-0.071, 0.0, 0.071), (-0.077, 0.0, 0.078),
    (-0.018, 0.001, 0.019), (-0.052, -0.001, 0.052), (-0.044, 0.001, 0.044), (-0.055, 0.0, 0.055),
]
GRAY = np.array([0, 1, 3, 2], np.uint32)


@dataclass(frozen=True)
class Sound:
    """How samples become frames; a frame spans about 0.37 s and moves by a third."""

    rate: int = 11025
    frame: int = 4096
    hop: int = 1365
    low: float = 28.0
    high: float = 3520.0
    #: A shorter recording, unless empty, is followed by silence (its mean) up to so many samples.
    least: int = 0
    #: As LEVELS, for these frames.
    levels: tuple = tuple(LEVELS)

    def classes(self) -> np.ndarray:
        """The pitch class of each spectrum line, -1 outside low to high."""
        hz = np.fft.rfftfreq(self.frame, 1 / self.rate)
        with np.errstate(divide="ignore"):
            note = np.floor(12 * np.log2(np.maximum(hz, 1e-9) / 27.5)).astype(int) % 12
        return np.where((hz >= self.low) & (hz <= self.high), note, -1)


#: One byte a sample at so low a rate that 272 bytes make three integers; shorter texts go on with silence till there.
BYTES_AS_SOUND = Sound(
    rate=690, frame=64, hop=16, low=28.0, high=345.0, least=64 + 16 * (WIDTH + 1),
    levels=(
        (-0.114, 0.068, 0.251), (-0.224, -0.029, 0.182), (0.292, 0.466, 0.645), (-0.348, -0.159, 0.041),
        (-0.044, 0.0, 0.043), (-0.104, 0.0, 0.103), (-0.08, 0.0, 0.08), (-0.103, 0.0, 0.103),
        (-0.133, 0.0, 0.132), (-0.134, 0.0, 0.135), (-0.129, 0.0, 0.128), (-0.13, 0.0, 0.132),
        (-0.036, 0.001, 0.037), (-0.094, 0.0, 0.094), (-0.073, 0.0, 0.073), (-0.097, 0.0, 0.097),
    ),
)


def chroma(samples: np.ndarray, sound: Sound) -> np.ndarray:
    """Frames of twelve pitch-class energies of unit length; fewer samples than a frame give none."""
    n = (len(samples) - sound.frame) // sound.hop + 1
    if n <= 0:
        return np.zeros((0, 12))
    cls, window = sound.classes(), np.hamming(sound.frame)
    fold = np.zeros((len(cls), 12))
    fold[np.flatnonzero(cls >= 0), cls[cls >= 0]] = 1
    out = np.empty((n, 12))
    frames = np.lib.stride_tricks.sliding_window_view(samples, sound.frame)[:: sound.hop]
    for lo in range(0, n, 2048):
        part = frames[lo : lo + 2048]
        spectrum = np.fft.rfft((part - part.mean(axis=1, keepdims=True)) * window, axis=1)
        out[lo : lo + 2048] = (spectrum.real**2 + spectrum.imag**2) @ fold
    norm = np.sqrt((out**2).sum(axis=1, keepdims=True))
    return np.where(norm > 1e-9, out / np.maximum(norm, 1e-9), 0.0)


def pack(frames: np.ndarray, every: tuple = tuple(LEVELS)) -> np.ndarray:
    """One 32-bit integer for each run of WIDTH frames, from area sums of the integral image."""
    n = len(frames) - WIDTH + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    image = np.zeros((len(frames) + 1, 13))
    image[1:, 1:] = frames.cumsum(0).cumsum(1)

    def area(x: int, w: int, y: int, h: int) -> np.ndarray:
        a, b = image[x : x + n], image[x + w : x + w + n]
        return (b[:, y + h] - a[:, y + h]) - (b[:, y] - a[:, y])

    out = np.zeros(n, np.uint32)
    for (kind, y, h, w), levels in zip(FILTERS, every):
        whole = area(0, w, y, h)
        if kind == 0:  # one half of the classes against the other
            part = area(0, w, y, h // 2)
        elif kind == 1:  # earlier frames against later ones
            part = area(0, w // 2, y, h)
        elif kind == 2:  # opposite quarters
            part = area(0, w // 2, y, h // 2) + area(w // 2, w - w // 2, y + h // 2, h - h // 2)
        else:  # the middle frames
            part = area(w // 4, w // 2, y, h)
        value = np.log((1 + np.maximum(part, 0)) / (1 + np.maximum(whole - part, 0)))
        out = (out << np.uint32(2)) | GRAY[np.searchsorted(levels, value)]
    return out


def fingerprint(samples: np.ndarray, sound: Sound) -> np.ndarray:
    samples = samples.astype(np.float64)
    if 0 < len(samples) < sound.least:
        samples = np.pad(samples, (0, sound.least - len(samples)), constant_values=samples.mean())
    return pack(chroma(samples, sound), sound.levels)


#: An alignment needs so many equal (or near-equal, where asked for) integers at its offset, and at most this share of
#: different bits over the overlap.
VOTES, BIT_ERRORS = 3, 0.30
#: Integers of the queries that are held by a worker at once.
BLOCK_INTEGERS = 1_000_000
#: The integers within one bit of x are x ^ FLIPS.
FLIPS = np.concatenate(([0], 1 << np.arange(32))).astype(np.uint32)
#: Integers that are looked up at once.
PROBES = 20_000
#: Equal integers that are counted at once.
HITS = 2_000_000
#: Alignments that a task holds before it hands them on.
ROWS = 10_000


def _popcount(x: np.ndarray) -> int:
    return int(np.bitwise_count(x).sum())


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    every, at = np.unique(key, return_inverse=True)
    return every, np.bincount(at, n, len(every)).astype(np.int64)


class Recordings:
    """Queries, indexed by integer: finds those that align with a recording."""

    def __init__(self, ids: list[int], prints: list[np.ndarray], near: bool = False):
        self.flips = FLIPS if near else FLIPS[:1]
        self.ids, self.prints = ids, prints
        size = np.array([len(p) for p in prints], np.int64)
        value = np.concatenate(prints) if prints else np.zeros(0, np.uint32)
        order = np.argsort(value, kind="stable")
        self.value = value[order]
        self.owner = np.repeat(np.arange(len(prints)), size)[order]
        self.place = (np.arange(len(value)) - np.repeat(np.cumsum(size) - size, size))[order]
        # by hash: whether an integer votes for any of them (at times told of another)
        self.shift = np.uint32(32 - min(27, (len(self.flips) * len(value)).bit_length() + 2))
        self.near = np.zeros(1 << (32 - int(self.shift)), bool)
        own = flat.distinct(value)
        for flip in self.flips:
            self.near[self._slot(own ^ flip)] = True

    def _slot(self, value: np.ndarray) -> np.ndarray:
        return (value * np.uint32(2654435761)) >> self.shift

    def _found(self, other: np.ndarray):
        """(place in other, first and number of equal integers in the index) for each integer that votes."""
        at = np.flatnonzero(self.near[self._slot(other)])
        for lo in range(0, len(at), PROBES):
            part = at[lo : lo + PROBES]
            probe = (other[part, None] ^ self.flips).ravel()
            low = np.searchsorted(self.value, probe, "left")
            hit = np.flatnonzero(self.value[np.minimum(low, len(self.value) - 1)] == probe)
            if len(hit):
                yield part[hit // len(self.flips)], low[hit], np.searchsorted(self.value, probe[hit], "right") - low[hit]

    def align(self, other: np.ndarray, votes: int = VOTES, errors: float = BIT_ERRORS):
        """(query number, offset, votes, bit errors) of the best offset of each query that aligns.

        The offset is the place in `other` less that in the query. Votes are equal integers at an offset, or those of at
        most one different bit if the index is `near`. Every offset with enough votes is tested; the best has fewest bit errors, ties going to more votes,
        then the smaller distance, then the smaller offset.
        """
        keys, counts = [], []
        for place, low, count in self._found(other):
            begin = 0
            while begin < len(place):
                # slices of bounded size, however often an integer repeats
                end = begin + max(1, int(np.searchsorted(np.cumsum(count[begin:]), HITS, "right")))
                c = count[begin:end]
                at = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c) + np.repeat(low[begin:end], c)
                k, m = np.unique(self.owner[at] * (1 << 32) + (np.repeat(place[begin:end], c) - self.place[at] + (1 << 31)), return_counts=True)
                keys.append(k)
                counts.append(m)
                begin = end
        if not keys:
            return
        key, n = (keys[0], counts[0]) if len(keys) == 1 else _summed(np.concatenate(keys), np.concatenate(counts))
        key, n = key[n >= votes], n[n >= votes]
        query, offset = key >> 32, (key & ((1 << 32) - 1)) - (1 << 31)
        order = np.lexsort((offset, np.abs(offset), -n, query))
        last, best = -1, None
        for q, o, v in zip(query[order].tolist(), offset[order].tolist(), n[order].tolist()):
            if q != last:
                if best:
                    yield last, *best
                last, best = q, None
            if best and not best[2]:
                continue  # nothing has fewer errors than none
            mine = self.prints[q]
            a, b = max(0, -o), min(len(mine), len(other) - o)
            wrong = _popcount(mine[a:b] ^ other[a + o : b + o]) / (32 * (b - a))
            if wrong <= errors and (not best or wrong < best[2]):
                best = o, v, wrong
        if best:
            yield last, *best


def fingerprints(media: DataFrame, sound: Sound, data: str = "data", media_id: str = "media_id") -> DataFrame:
    """(media_id, print, n) for every row with 8-bit unsigned samples in a binary column; print is 32-bit integers.

    Null and empty recordings, and those too short for the widest filter where sound.least adds no silence, have an
    empty print, n = 0. Repeated rows are kept; empty tables give no rows; other columns are ignored.
    """
    prepare(media.sparkSession)

    def run(batches):
        for batch in batches:
            made = [fingerprint(np.frombuffer(x or b"", np.uint8), sound) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m.tobytes() for m in made], pa.binary()), pa.array([len(m) for m in made], pa.int32())], names=["media_id", "print", "n"])

    return media.select(F.col(media_id).cast("long").alias("media_id"), F.col(data).cast("binary").alias("data")).mapInArrow(tidy(run), "media_id long, print binary, n int")


def classes(prints: DataFrame) -> DataFrame:
    """(digest, class_id, copies): recordings of equal, non-empty prints, named by the smallest id."""
    return prints.filter("n > 0").groupBy(F.sha2("print", 256).alias("digest")).agg(F.min("media_id").alias("class_id"), F.count("*").alias("copies"))


def aligned(prints: DataFrame, every: int = 50, block_integers: int = BLOCK_INTEGERS, near: bool = False) -> DataFrame:
    """(class_id, match_id, copies, offset, votes, bit_errors): all classes that align with a class that holds a query.

    Queries are the recordings whose id is divisible by `every`. Recordings with equal prints are one class, named by
    its smallest id, with its number of rows; a class isn't matched with itself. Every class that holds a query is held
    against every class: the former go to the workers in blocks of bounded size, one after the other, and each task
    writes alignments out as it finds them. With `near`, integers of at most one different bit vote too. Copies of a query or of a match make no rows.
    """
    spark = prints.sparkSession
    heard = cut(prints.filter("n > 0 and media_id is not null").groupBy("print").agg(F.min("media_id").alias("match_id"), F.count("*").alias("copies"), F.max(F.col("media_id") % every == 0).alias("asked")))
    asked = heard.filter("asked").select("match_id", "print")
    total = asked.agg(F.sum(F.octet_length("print"))).first()[0] or 0
    n_blocks = -(-total // (4 * block_integers)) or 1
    schema = "class_id long, match_id long, copies long, offset int, votes int, bit_errors double"
    out = None
    for i in range(n_blocks):
        part = asked.filter(F.pmod(F.xxhash64("match_id"), F.lit(n_blocks)) == i).orderBy("match_id").toArrow()  # about block_integers integers
        shared = spark.sparkContext.broadcast((part.column(0).to_pylist(), part.column(1).to_pylist()))

        def run(batches, shared=shared):
            ids, raw = shared.value
            held = Recordings(ids, [np.frombuffer(x, np.uint32) for x in raw], near)
            rows = []

            def flush():
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64())
                columns = list(zip(*rows)) if rows else [[]] * 6
                rows.clear()
                return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in schema.split(", ")])

            for batch in batches:
                for data, match, copies in zip(*(c.to_pylist() for c in batch.columns)):
                    for q, o, v, wrong in held.align(np.frombuffer(data, np.uint32)):
                        if ids[q] != match:
                            rows.append((ids[q], match, copies, o, v, wrong))
                        if len(rows) >= ROWS:
                            yield flush()
            yield flush()

        found = heard.select("print", "match_id", "copies").mapInArrow(tidy(run), schema)
        out = found if out is None else out.unionByName(found)
    return out


def search(prints: DataFrame, every: int = 50, top: int | None = None, block_integers: int = BLOCK_INTEGERS, near: bool = False) -> DataFrame:
    """(query_id, match_id, copies, offset, votes, bit_errors): the alignments of every query, those of its class.

    With `top`, only so many of each query (fewest bit errors, then most votes, then smallest id), and their place.
    """
    found = cut(aligned(prints, every, block_integers, near))
    asked = prints.filter((F.col("media_id") % every == 0) & (F.col("n") > 0)).select(F.col("media_id").alias("query_id"), F.sha2("print", 256).alias("digest")).distinct()
    kinds = classes(prints.filter("media_id is not null")).select("digest", "class_id")
    out = asked.join(kinds, "digest").join(found, "class_id").select("query_id", "match_id", "copies", "offset", "votes", "bit_errors")
    if top is None:
        return out
    order = Window.partitionBy("query_id").orderBy("bit_errors", F.desc("votes"), "match_id")
    return out.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top)
