"""Logistic regression on hashed sparse features, trained by follow-the-regularised-leader updates.

A featuriser turns a sub-batch of texts into (document, feature, value) triples in numpy. Training takes a bounded sample of
labelled rows, in one task and in a fixed order; scoring is a gather of weights and a sum for each document,
in the scan of the texts, with no shuffle. Only the weights, bounded by 2**bits, are broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared, textvec, tokens

BITS = 20
#: Labelled rows that a model is fitted on at most: those of the smallest hashes of doc_id.
TRAIN_ROWS = 8000
#: A training row of this label holds the difference of a sentence and its counterfactual.
PAIR = -1

Triples = tuple[np.ndarray, np.ndarray, np.ndarray]
Featuriser = Callable[[textvec.Texts], Triples]


def bucket(h: np.ndarray, salt: int) -> np.ndarray:
    return (textvec.mix(h ^ np.uint64(salt)) >> np.uint64(64 - BITS)).astype(np.int64)


def merged(triples: Triples, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each of n documents its distinct features and their summed values."""
    doc, feature, value = triples
    key = doc << BITS | feature
    order = np.argsort(key, kind="stable")
    key, value = key[order], value[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    total = np.add.reduceat(value, first) if len(first) else value
    doc, feature = key[first] >> BITS, key[first] & ((1 << BITS) - 1)
    at = np.searchsorted(doc, np.arange(n + 1))
    return [(feature[a:b], total[a:b]) for a, b in zip(at, at[1:])]


class Ftrl:
    """Per-coordinate FTRL-proximal; weights exist only through the sums z and n."""

    def __init__(self, alpha: float, l1: float, l2: float = 0.0, beta: float = 1.0, pull: float = 0.0) -> None:
        self.alpha, self.l1, self.l2, self.beta, self.pull = alpha, l1, l2, beta, pull
        #: The last coordinate is the bias: always on, without l1.
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
        self.bias = 1 << BITS

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        l1 = np.where(at == self.bias, 0.0, self.l1)
        w = (np.sign(z) * l1 - z) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)
        w[np.abs(z) <= l1] = 0
        return w

    def update(self, at: np.ndarray, value: np.ndarray, label: int) -> None:
        if label != PAIR:
            at, value = np.append(at, self.bias), np.append(value, 1.0)
        w = self.weights(at)
        s = float(w @ value)
        g = (self.pull * s if label == PAIR else 1 / (1 + np.exp(-np.clip(s, -35, 35))) - label) * value
        n = self.n[at]
        more = n + g * g
        self.z[at] += g - (np.sqrt(more) - np.sqrt(n)) / self.alpha * w
        self.n[at] = more

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int, seed: int = 7) -> np.ndarray:
        order = np.random.default_rng(seed)
        for _ in range(epochs):
            for k in order.permutation(len(rows)):
                self.update(*rows[k])
        return self.weights(np.arange(self.bias + 1))


def labelled(docs: DataFrame, labels: DataFrame, label: str, bound: int = TRAIN_ROWS) -> DataFrame:
    """At most `bound` labelled texts that aren't held out; rows without label or with conflicting ones are left out."""
    one = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~shared.held_out(F.col("doc_id")))
    one = one.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(label).cast("int").alias("label"), F.max(label).cast("int").alias("most")).where("label = most")
    picked = one.select("doc_id", "label").orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound).collect()
    sample = docs.sparkSession.createDataFrame(picked, "doc_id long, label int")
    return shared.texts(docs).join(F.broadcast(sample), "doc_id")


def fit(rows: DataFrame, featurise: Featuriser, model: Ftrl, epochs: int, pairs: Callable[[str], list[tuple[str, str]]] | None = None) -> np.ndarray:
    """Weights by feature, the bias last. pairs: sentences of a text and what they become; their scores are pulled together."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels, texts = (batch.column(c).to_pylist() for c in ("doc_id", "label", "text"))
            for lo, hi, x in textvec.slices(batch):
                out = [(i, y, *r) for i, y, r in zip(ids[lo:hi], labels[lo:hi], merged(featurise(x), hi - lo))]
                for i, t in zip(ids[lo:hi], texts[lo:hi]) if pairs else ():
                    for a, b in pairs(t):
                        both = pa.RecordBatch.from_arrays([pa.array([a, b])], names=["text"])
                        (fa, va), (fb, vb) = (r for _, n, s in textvec.slices(both) for r in merged(featurise(s), len(s)))
                        at, where = np.unique(np.concatenate([fa, fb]), return_inverse=True)
                        out.append((i, PAIR, at, np.bincount(where, np.concatenate([va, -vb]), len(at))))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2].astype("<i4").tobytes() for o in out], pa.binary()), pa.array([o[3].astype("<f4").tobytes() for o in out], pa.binary())],
                    names=["doc_id", "label", "at", "value"],
                )

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [(np.frombuffer(a, "<i4").astype(np.int64), np.frombuffer(v, "<f4").astype(float), y) for b in batches for a, v, y in zip(*(b.column(c).to_pylist() for c in ("at", "value", "label")))]
        w = model.fit(seen, epochs)
        used = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(w[used])], names=["at", "weight"])

    made = rows.mapInArrow(tokens.tidy(features), "doc_id long, label int, at binary, value binary")
    got = made.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "label", "at").mapInArrow(tokens.tidy(train), "at long, weight double").toPandas()
    w = np.zeros((1 << BITS) + 1, np.float32)
    w[got["at"].to_numpy(np.int64)] = got["weight"].to_numpy()
    return w


def _scores(x: textvec.Texts, featurise: Featuriser, w: np.ndarray) -> np.ndarray:
    doc, feature, value = featurise(x)
    part = w[feature]
    used = np.flatnonzero(part)
    s = np.bincount(doc[used], part[used].astype(float) * value[used], len(x)) + float(w[-1])
    return 1 / (1 + np.exp(-np.clip(s, -35, 35)))


def keep(docs: DataFrame, featurise: Featuriser, weights: np.ndarray, threshold: float) -> DataFrame:
    """The rows of docs, all columns, that score the threshold or more; decided in the scan. A null text scores like an empty one; each row
    is judged by its whole text alone."""
    shared.small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.forget()
        for batch in batches:
            text = pa.RecordBatch.from_arrays([batch.column("text").fill_null("")], names=["text"])
            for lo, hi, x in textvec.slices(text):
                yield batch.slice(lo, hi - lo).filter(pa.array(_scores(x, featurise, sent.value) >= threshold))

    return docs.mapInArrow(tokens.tidy(run), docs.schema)


def score(docs: DataFrame, featurise: Featuriser, weights: np.ndarray, threshold: float) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for batch in batches:
            for lo, hi, x in textvec.slices(batch):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(_scores(x, featurise, w))], names=["doc_id", "score"])

    scored = shared.texts(docs).mapInArrow(tokens.tidy(run), "doc_id long, score double")
    return scored.select("doc_id", shared.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
