"""Quality classifier: hashed word n-gram logistic regression, fitted with follow-the-regularised-leader."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from parasol.llm.features import features_of, fitted, hasher, labelled, logistic, sample_texts, score, score_texts
from parasol.session import small_batches

#: Labelled documents that the fit uses at most, those with the smallest hashes of their ids.
SAMPLE = 8000
BITS, ORDER = 18, 2
MODULUS, HELD_OUT = 5, 0
THRESHOLD = 0.3


class Ftrl:
    """FTRL-proximal with a learning rate of its own for each coordinate."""

    def __init__(self, size: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.0, l2: float = 0.05) -> None:
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)  # the last is the bias, without penalty

    def solve(self, z: np.ndarray, n: np.ndarray, l1: float, l2: float) -> np.ndarray:
        return -np.sign(z) * np.maximum(np.abs(z) - l1, 0.0) / ((self.beta + np.sqrt(n)) / self.alpha + l2)

    def step(self, at: np.ndarray, value: float, weights: np.ndarray, slope: float) -> None:
        z, n, g = self.z[at], self.n[at], slope * value
        self.z[at] = z + g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * weights
        self.n[at] = n + g * g

    def fit(self, x: list[np.ndarray], y: np.ndarray, cost: np.ndarray, epochs: int = 4, seed: int = 0) -> Ftrl:
        """One update an example, in a shuffled order; ``cost`` weighs examples."""
        rng, last = np.random.default_rng(seed), np.array([len(self.z) - 1])
        for _ in range(epochs):
            for i in rng.permutation(len(x)):
                at, value = x[i], 1.0 / max(len(x[i]), 1) ** 0.5
                w, b = self.solve(self.z[at], self.n[at], self.l1, self.l2), self.solve(self.z[last], self.n[last], 0.0, 0.0)
                slope = float(logistic(b[0] + value * w.sum()) - y[i]) * cost[i]
                self.step(at, value, w, slope)
                self.step(last, 1.0, b, slope)
        return self

    @property
    def weights(self) -> np.ndarray:
        return self.solve(self.z[:-1], self.n[:-1], self.l1, self.l2).astype(np.float32)

    @property
    def bias(self) -> float:
        return float(self.solve(self.z[-1:], self.n[-1:], 0.0, 0.0)[0])


def best_cut(z: np.ndarray, y: np.ndarray) -> float:
    """The logit that splits the labels with the best balanced accuracy: the middle of the best gap."""
    order = np.argsort(z, kind="stable")
    z, y = z[order], y[order]
    low = np.concatenate([[0.0], np.cumsum(y == 0)]) / max((y == 0).sum(), 1)  # caught below the cut
    high = 1 - np.concatenate([[0.0], np.cumsum(y == 1)]) / max((y == 1).sum(), 1)
    i = np.flatnonzero((low + high) >= (low + high).max() - 1e-12)
    edges = np.concatenate([[z[0] - 1], z, [z[-1] + 1]])
    return float(np.mean([(edges[k] + edges[k + 1]) / 2 for k in i[[0, -1]]]))


def fit(x: list[np.ndarray], y: np.ndarray, size: int) -> tuple[np.ndarray, float]:
    """Weights and bias, shifted so that the best cut of two-fold predictions has the score THRESHOLD.

    Both labels cost the same in total. With one label only, the bias alone says
    which; without examples every score is one half.
    """
    if len({*y.tolist()}) < 2:
        return np.zeros(size, dtype=np.float32), float(np.mean(y) * 8 - 4) if len(y) else 0.0
    cost = np.where(y == 1, 0.5 / (y == 1).mean(), 0.5 / (y == 0).mean())
    half, z = np.arange(len(y)) % 2, np.zeros(len(y))
    cut = 0.0
    if all(len({*y[half == k].tolist()}) == 2 for k in (0, 1)):
        for k in (0, 1):
            part = np.flatnonzero(half != k)
            m = Ftrl(size).fit([x[i] for i in part], y[part], cost[part])
            w, b = m.weights, m.bias
            for i in np.flatnonzero(half == k):
                z[i] = score(w, b, x[i])
        cut = best_cut(z, y)
    m = Ftrl(size).fit(x, y, cost)
    return m.weights, m.bias - cut + float(np.log(THRESHOLD / (1 - THRESHOLD)))


def quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Fits on at most ``sample`` labelled documents whose crc32(doc_id) mod 5 is
    not 0, and scores every whole text. A null text is empty, and an empty one
    has the score of the bias. Null and repeated ids are scored row by row; a
    null id's fold is that of the empty text. Null labels don't count; of
    several labels of one id the mean decides. Without labels every score is one
    half. Other columns are ignored; an empty table gives an empty result. The
    model that tasks get has a fixed size, 2**BITS weights.
    """
    ids = labelled(labels, "quality", MODULUS, HELD_OUT, F.avg).withColumn("y", (F.col("y") >= 0.5).cast("double"))
    small_batches(docs.sparkSession)
    features = features_of(sample_texts(docs, ids, sample), lambda: hasher(BITS, ORDER).buckets)
    shared = docs.sparkSession.sparkContext.broadcast(fitted(features, lambda x, y: fit(x, y, 1 << BITS), "quality-model"))

    def scorer():
        w, b = shared.value
        buckets = hasher(BITS, ORDER).buckets
        return lambda text: float(logistic(score(w, b, buckets(text))))

    return score_texts(docs, scorer, MODULUS, HELD_OUT, THRESHOLD)
