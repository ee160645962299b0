"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flat
from .runtime import prepare, tidy

#: log2 of the weights; a model is at most 12 bytes for each, however much text there is.
BUCKET_BITS = 20
#: Labelled rows that a model is fitted on at most: those with the smallest hash of their id.
MAX_TRAIN_ROWS = 16_000
EPOCHS = 4
#: FTRL-proximal: learning rate, its smoothing, L1 and L2 strength.
ALPHA, BETA, L1, L2 = 2.0, 1.0, 6.0, 0.01
#: A feature is included once so many of the fitted rows have it.
MIN_ROWS = 3
#: Word distances of skip-grams, beside n-grams of one to three words.
SKIPS = (2, 3)


def _features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every n-gram and skip-gram of a block of texts; not distinct, order of no meaning."""
    w = flat.words(raw, offsets, flat.ALNUM)
    h = w.hashes()
    text = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
    texts, buckets = [], []
    for n, step in ((1, 1), (2, 1), (3, 1), *((2, s) for s in SKIPS)):
        reach = (n - 1) * step
        g = np.full(max(0, len(h) - reach), np.uint64(n * 16 + step))
        for j in range(n):
            g = flat.mix(g + h[j * step : j * step + len(g)])
        whole = text[: len(g)] == text[reach:][: len(g)]
        texts.append(text[: len(g)][whole])
        buckets.append((g[whole] >> np.uint64(64 - BUCKET_BITS)).astype(np.int64))
    return np.concatenate(texts), np.concatenate(buckets)


@dataclass
class Model:
    bias: float
    bucket: np.ndarray
    weight: np.ndarray

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BUCKET_BITS, np.float32)
        out[self.bucket] = self.weight
        return out


class Ftrl:
    """Per-coordinate FTRL-proximal over sets of buckets; the last coordinate is the bias, which has no L1."""

    def __init__(self):
        self.z = np.zeros((1 << BUCKET_BITS) + 1)
        self.n = np.zeros((1 << BUCKET_BITS) + 1)

    def weights(self, i: np.ndarray) -> np.ndarray:
        z, l1 = self.z[i], np.where(i == len(self.z) - 1, 0.0, L1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(self.n[i])) / ALPHA + L2))

    def learn(self, buckets: np.ndarray, label: int) -> None:
        i = np.append(buckets, len(self.z) - 1)
        w = self.weights(i)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[i]
        self.z[i] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[i] = n + g * g

    def model(self) -> tuple[np.ndarray, np.ndarray]:
        i = np.flatnonzero((np.abs(self.z) > L1) & (self.n > 0))
        i = np.union1d(i, [len(self.z) - 1])
        return i, self.weights(i)


def fit(rows: DataFrame, text: str = "text", label: str = "label", epochs: int = EPOCHS, max_rows: int = MAX_TRAIN_ROWS) -> Model:
    """Fit on at most max_rows rows (one task learns them in the order of a hash); sparse weights come back.

    Rows without label are left out, a null text is empty; labels above 0 count as 1. Rows of one hash are learnt label
    0 first; repeated rows are each learnt. Without any row the model has no weights and scores 0.5. Columns other than
    text and label are ignored.
    """
    prepare(rows.sparkSession)
    order = F.xxhash64(F.col(text), F.col(label))
    kept = rows.select(F.col(text).alias("text"), F.col(label).cast("int").alias("label"), order.alias("place")).filter("label is not null")
    one = kept.repartition(1).sortWithinPartitions("place", "label")

    def run(batches):
        features, learner, left = [], Ftrl(), max_rows
        for batch in batches:
            labels = batch.column(1).to_numpy()
            for lo, hi, raw, offsets in flat.blocks(batch.column(0)):
                text_of, bucket = _features(raw, offsets)
                both = flat.distinct((text_of << BUCKET_BITS) | bucket)
                at = np.searchsorted(both >> BUCKET_BITS, np.arange(hi - lo + 1))
                bucket = (both & ((1 << BUCKET_BITS) - 1)).astype(np.int32)
                for i in range(hi - lo):
                    if left > 0:
                        features.append((bucket[at[i] : at[i + 1]], int(labels[lo + i] > 0)))
                        left -= 1
        rows_of = np.zeros(1 << BUCKET_BITS, np.int32)
        for bucket, _ in features:
            rows_of[bucket] += 1
        for i, (bucket, y) in enumerate(features):
            features[i] = bucket[rows_of[bucket] >= MIN_ROWS], y
        for _ in range(epochs if features else 0):
            for bucket, y in features:
                learner.learn(bucket, y)
        i, w = learner.model()
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(w, pa.float64())], names=["bucket", "weight"])

    got = one.select("text", "label").mapInArrow(tidy(run), "bucket long, weight double").toArrow()  # at most 2^BUCKET_BITS + 1 rows
    bucket, weight = got.column(0).to_numpy(), got.column(1).to_numpy()
    bias = bucket == 1 << BUCKET_BITS
    return Model(float(weight[bias].sum()), bucket[~bias], weight[~bias].astype(np.float32))


def score(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    """The kept columns of every row and, as column `name`, the score (0 to 1) of its whole text; the model is broadcast.

    Null and empty texts score by the bias alone. Empty tables give no rows; repeated rows are kept, equal texts have
    equal scores (ties are left as they are); columns that aren't kept are ignored, a kept one may not be called `name`.
    """
    if name in keep:
        raise ValueError(f"a kept column is called {name}")
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.bias, model.bucket.astype(np.int32), model.weight))

    def run(batches):
        bias, bucket, weight = shared.value
        w = Model(bias, bucket, weight).dense()
        for batch in batches:
            column, total = batch.column(at), np.full(batch.num_rows, bias)
            for lo, hi, raw, offsets in flat.blocks(column):
                text_of, found = _features(raw, offsets)
                told = w[found] != 0
                both = flat.distinct((text_of[told] << BUCKET_BITS) | found[told])
                total[lo:hi] += np.bincount(both >> BUCKET_BITS, w[both & ((1 << BUCKET_BITS) - 1)], hi - lo)
            value = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(value, pa.float64())], names=[*keep, name])

    # a kept text is sent once
    chosen = docs.select(*keep) if text in keep else docs.select(*keep, text)
    at = chosen.columns.index(text)
    schema = ", ".join(f"`{c}` {t}" for c, t in chosen.dtypes[: len(keep)]) + f", `{name}` double"
    return chosen.mapInArrow(tidy(run), schema)


def held_out(doc_id: str = "doc_id", folds: int = 5):
    """Whether a row is kept from fitting: crc32 of its id's text leaves 0 (a null id: as of an empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds == 0


def train_rows(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """(text, label) of labelled documents outside the held-out fold, at most max_rows labels by the hash of their id.

    Labels without id or value are left out; of several labels of one id the largest counts. A document row is taken as
    often as it is there; empty tables give no rows; other columns are ignored.
    """
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .filter("doc_id is not null and label is not null").filter(~held_out())
        .groupBy("doc_id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    )
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("text", "label")
