"""Hashed word n-gram features, and bounded samples of them for fitting."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from parasol.llm.bpe import Cache
from parasol.llm.common import fold
from parasol.session import save_table, small_batches

#: Letters and digits of any script in one run, other visible characters in another.
_TOKEN = re.compile(rb"[a-z0-9\x80-\xff]+|[^a-z0-9\x80-\xff\x09-\x0d\x20]+").findall
#: Distinct tokens that a Python worker remembers before it starts anew.
CACHE_ENTRIES = 500_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Hasher:
    """Maps a text to the distinct buckets, of 2**bits, of its word n-grams up to ``order``."""
    def __init__(self, bits: int, order: int) -> None:
        self.shift, self.order = np.uint64(64 - bits), order
        self.words = Cache(xxhash.xxh3_64_intdigest)

    def buckets(self, text: bytes | None) -> np.ndarray:
        """Sorted distinct buckets; null and empty texts have none."""
        found = _TOKEN((text or b"").lower())
        if len(self.words) > CACHE_ENTRIES:
            self.words.clear()
        h = np.fromiter(map(self.words.__getitem__, found), dtype=np.uint64, count=len(found))
        grams, gram = [h], h
        for n in range(1, self.order):
            if len(h) <= n:
                break
            gram = gram[:-1] * _MIX + h[n:]
            grams.append(gram)
        return np.unique((np.concatenate(grams) * _MIX) >> self.shift).astype(np.int32)


@lru_cache(maxsize=4)
def hasher(bits: int, order: int) -> Hasher:
    """One hasher a worker process, so that its cache lasts over tasks."""
    return Hasher(bits, order)


def score(weights: np.ndarray, bias: float, buckets: np.ndarray) -> float:
    """The sparse dot product of the weights and a text's unit vector, as a logit."""
    return bias + (float(weights[buckets].sum()) / len(buckets) ** 0.5 if len(buckets) else 0.0)


def logistic(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35.0, 35.0)))


def labelled(labels: DataFrame, column: str, modulus: int, held_out: int, agg) -> DataFrame:
    """(doc_id, y, h) of the labelled documents outside the held-out fold, one row an id."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & (fold(F.col("doc_id"), modulus) != held_out))
    return rows.groupBy("doc_id").agg(agg(F.col(column).cast("double")).alias("y")).withColumn("h", F.xxhash64("doc_id"))


def sample_texts(docs: DataFrame, ids: DataFrame, bound: int) -> DataFrame:
    """(doc_id, y, text) of at most ``bound`` of ``ids`` (doc_id, y, h), those with the smallest hashes.

    The sample's ids are broadcast, at most ``bound`` of them. Of an id with
    several texts the first in code point order counts.
    """
    chosen = ids.orderBy("h", "doc_id").limit(bound).select("doc_id", "y")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))


def features_of(rows: DataFrame, of) -> DataFrame:
    """The columns of ``rows`` but for text, and x: the text's features, as 32-bit integers; ``of`` makes a function of bytes in a worker."""
    kept = [c for c in rows.columns if c != "text"]

    def extract(batches):
        f = of()
        for b in batches:
            x = pa.array([f(t).astype("<i4").tobytes() for t in b.column(len(kept)).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], x], [*kept, "x"])

    types = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in kept)
    return rows.select(*kept, F.col("text").cast("binary").alias("text")).mapInArrow(extract, f"{schema}, x binary")


def fitted(features: DataFrame, fit, name: str) -> tuple[np.ndarray, float]:
    """Weights and bias that ``fit(x, y)`` makes, in one task, from a bounded sample of features in the order of ids.

    The driver gets the model alone, from the table that the task writes.
    """
    def run(batches):
        rows = [(y, np.frombuffer(x, "<i4")) for b in batches for y, x in zip(b.column("y").to_pylist(), b.column("x").to_pylist(), strict=True)]
        weights, bias = fit([x for _, x in rows], np.array([y for y, _ in rows], dtype=np.float64))
        yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary()), pa.array([bias], pa.float64())], ["weights", "bias"])

    model = save_table(features.repartition(1).sortWithinPartitions("doc_id", "x").mapInArrow(run, "weights binary, bias double"), name)
    row = model.first()
    if row is None:  # no task runs where there are no rows
        return fit([], np.zeros(0))
    return np.frombuffer(row["weights"], dtype=np.float32), row["bias"]


def score_texts(docs: DataFrame, of, modulus: int, held_out: int, threshold: float) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``; ``of`` makes, in a worker, a function from bytes to a score."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))

    def run(batches):
        f = of()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f(t) for t in b.column(1).to_pylist()], pa.float64())], ["doc_id", "score"])

    scored = rows.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (fold(F.col("doc_id"), modulus) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
