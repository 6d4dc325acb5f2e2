"""Quality classifier: a linear support vector machine over naive Bayes features.

Indicators of n-grams (words, word pairs, ends of words), hashed into FEATURES slots, are scaled by the class log-count ratio of their
slot; a hinge-loss model without other inputs is fitted to the scaled indicators by dual coordinate descent.
Margins become a score from 0 to 1 by a logistic curve fitted on training rows that the model did not see.

The fit uses at most SAMPLE labelled documents, those of the smallest text hashes, from the training folds;
scoring covers every document.

Defined results: null, empty and blank texts have no feature and get the score of the bias alone; a label
without a document, or without a value, is not used; of a doc_id's differing labels the smaller counts;
without labelled rows of both classes every score is the share of label 1 (0.5 without rows); other columns
are never inputs.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_hash_mod

FEATURE_BITS = 18
FEATURES = 1 << FEATURE_BITS
#: Labelled documents that the fit reads at most.
SAMPLE = 4000
SMOOTHING = 1.0
COST = 0.5
EPOCHS = 12
CUT = 0.3
KEPT_WORDS = 400_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Features:
    """Slots of a text's n-grams: words, word pairs, word ends, and whether a word follows itself.

    What is needed of the words met is kept, up to KEPT_WORDS.
    """

    def __init__(self) -> None:
        self.kept: dict[bytes, int] = {}
        self.whole = np.zeros(KEPT_WORDS, np.uint64)
        self.end = np.zeros(KEPT_WORDS, np.uint64)

    @staticmethod
    def _hash(word: bytes) -> int:
        return (zlib.crc32(word) * 0x9E3779B97F4A7C15 ^ len(word) * 0xC2B2AE3D27D4EB4F) & (1 << 64) - 1

    def _numbers(self, words: list[bytes]) -> np.ndarray:
        numbers = list(map(self.kept.get, words))
        if None in numbers:
            new = {w for w, k in zip(words, numbers, strict=True) if k is None}
            if len(self.kept) + len(new) > KEPT_WORDS:
                self.kept.clear()
                new = set(words)
                if len(new) > len(self.whole):
                    self.whole, self.end = np.zeros(len(new), np.uint64), np.zeros(len(new), np.uint64)
            for w in new:
                k = self.kept[w] = len(self.kept)
                self.whole[k], self.end[k] = self._hash(w), self._hash(b"\x00" + w[-3:])
            numbers = list(map(self.kept.__getitem__, words))
        return np.array(numbers, np.int64)

    def slots(self, text: bytes | None) -> np.ndarray:
        """Distinct slots, ascending."""
        words = (text or b"").split()
        if not words:
            return np.zeros(0, np.int64)
        k = self._numbers(words)
        h = self.whole[k]
        again = np.uint64([self._hash(b"\x00again")]) if (h[1:] == h[:-1]).any() else np.zeros(0, np.uint64)
        grams = np.concatenate([h, h[:-1] ^ (h[1:] << np.uint64(1)), self.end[k], again])
        slots = ((grams * _MIX) >> np.uint64(64 - FEATURE_BITS)).astype(np.int32)
        slots.sort()
        return slots[np.concatenate([[True], slots[1:] != slots[:-1]])]


@dataclass
class Model:
    weights: np.ndarray  # of each slot, times its log-count ratio
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, slots: np.ndarray) -> float:
        return float(self.weights[slots].sum() / math.sqrt(max(1, len(slots)))) + self.bias

    def score(self, margin: float) -> float:
        x = self.slope * margin + self.shift
        return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    counts = [np.full(FEATURES, SMOOTHING), np.full(FEATURES, SMOOTHING)]
    for slots, label in zip(rows, y, strict=True):
        counts[int(label)][slots] += 1
    return (np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())).astype(np.float32)


def dual_descent(rows: list[np.ndarray], y: np.ndarray, r: np.ndarray, seed: int = 5) -> tuple[np.ndarray, float]:
    """Weights and bias of the hinge-loss model on scaled indicators; rows of either class cost alike in all."""
    w, bias = np.zeros(FEATURES), 0.0
    values = [r[s] / math.sqrt(max(1, len(s))) for s in rows]
    square = np.array([float(v @ v) + 1.0 for v in values])
    share = max(1e-9, y.mean())
    cost = np.where(y == 1, COST * 0.5 / share, COST * 0.5 / max(1e-9, 1 - share))
    sign = np.where(y == 1, 1.0, -1.0)
    alpha = np.zeros(len(rows))
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for k in rng.permutation(len(rows)):
            s, v = rows[k], values[k]
            gradient = sign[k] * (w[s] @ v + bias) - 1
            new = min(max(alpha[k] - gradient / square[k], 0.0), cost[k])
            if new != alpha[k]:
                step = (new - alpha[k]) * sign[k]
                w[s] += step * v
                bias += step
                alpha[k] = new
    return w, bias


def _logistic(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton steps, with smoothed targets."""
    n1, n0 = y.sum(), len(y) - y.sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g, h = p - t, p * (1 - p) + 1e-9
        m = np.array([[h @ margins**2 + 1e-3, h @ margins], [h @ margins, h.sum() + 1e-3]])
        a, b = np.array([a, b]) - np.linalg.solve(m, np.array([g @ margins, g.sum()]))
        a = float(np.clip(a, 0.05, 50))
    return a, float(b)


def fit(texts: list[bytes], labels: list[int]) -> Model:
    features = Features()
    return fit_slots([features.slots(t) for t in texts], labels)


def fit_slots(rows: list[np.ndarray], labels: list[int]) -> Model:
    """The model of rows given by their distinct slots, ascending."""
    y = np.array(labels, np.int64)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        return Model(np.zeros(FEATURES, np.float32), 0.0, 1.0, math.log(max(1e-6, share) / max(1e-6, 1 - share)))
    folds = np.arange(len(y)) % 3
    margins = np.zeros(len(y))
    for k in range(3):
        inside = [n for n in range(len(y)) if folds[n] != k]
        if len(set(y[inside])) < 2:
            continue
        own = [rows[n] for n in inside]
        r = log_count_ratios(own, y[inside])
        w, bias = dual_descent(own, y[inside], r)
        part = Model((w * r).astype(np.float32), bias)
        for n in np.flatnonzero(folds == k):
            margins[n] = part.margin(rows[n])
    r = log_count_ratios(rows, y)
    w, bias = dual_descent(rows, y, r)
    return Model((w * r).astype(np.float32), bias, *_logistic(margins, y))


def training_rows(docs: DataFrame, labels: DataFrame, held_out, sample: int = SAMPLE) -> DataFrame:
    """(place, doc_id, text, label) of at most sample labelled documents that are not held out, by the hash of their id: those
    that docs has.  Of rows that repeat a doc_id one is learnt from, that whose text has the least hash."""
    told = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("label"))
    place = F.xxhash64("doc_id", F.lit(11))
    chosen = told.filter(~held_out(F.col("doc_id"))).join(docs.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(place, "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    each = rows.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("r"))
    return each.select(place.alias("place"), "doc_id", F.col("r.text").alias("text"), "label")


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model of at most sample rows.  Executors make their slots, so no text reaches the driver, and no row is larger
    than the table of slots."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        features = Features()
        for batch in batches:
            slots = [features.slots(t.as_py()).astype("<i4").tobytes() for t in batch.column(3).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in (0, 1, 2, 4)), pa.array(slots, pa.binary())], ["place", "doc_id", "h", "label", "slots"])

    rows = training_rows(docs, labels, held_out, sample).select("place", F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text", F.col("label").cast("int").alias("label"))
    made = rows.mapInArrow(run, "place long, doc_id long, h long, label int, slots binary")
    kept = made.orderBy("place", "doc_id", "h").limit(sample).collect()
    return fit_slots([np.frombuffer(r.slots, "<i4") for r in kept], [r.label for r in kept])


def held_out(doc_id: Column) -> Column:
    return id_hash_mod(doc_id, 5) == 0


def classify(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """(doc_id, score, predicted) for every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        features, own = Features(), shared.value
        for batch in batches:
            scores = [own.score(own.margin(features.slots(t.as_py()))) for t in batch.column(1).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= cut) for s in scores], pa.int32())], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    found = classify(docs, fitted(docs, labels))
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")
