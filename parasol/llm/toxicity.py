"""Toxicity by non-negative positive-unlabelled learning.

The positives are confirmed toxic documents, the rest is unlabelled text. With
the class prior p the risk of a linear model is p R+(P) + max(0, R-(U) - p
R-(P)): where the second term falls below zero the model has begun to learn its
positives by heart, and the step goes back.

Features are words and word beginnings, present once and present at least
twice. Only those that positives show clearly more often than unlabelled text
are kept, so a text's score is a sum over the few that it has.

Every text outside the held-out fold counts as unlabelled, however many there
are: one pass counts the positives' features in all of them, a second reduces
each text to its kept features, a few bytes. The risk is minimised in chunks of
such rows, one task each, and the chunks' models are averaged by their rows. The
cut is found on a histogram of all rows. The driver sees counts, weights and
bins, all of a size that the table's does not change.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from parasol.llm.bpe import Cache
from parasol.llm.common import fold, groups, together
from parasol.llm.features import CACHE_ENTRIES, features_of, labelled, logistic, sample_texts
from parasol.session import save_table, small_batches

#: Documents labelled toxic that the fit uses at most, those with the smallest hashes of their ids.
POSITIVES = 3000
#: Unlabelled rows of a chunk, on average.
CHUNK = 50_000
BITS = 20
#: Characters of the word beginnings that count as features, besides whole words.
PREFIXES = (4, 5, 6, 7)
#: A feature is kept if so many positives have it, so many standard errors more than unlabelled text.
LEAST, ERRORS = 4, 5.0
MODULUS, HELD_OUT = 4, 2
THRESHOLD = 0.3
#: Bins of a logit's histogram, for one unit, and the logits beyond which all are alike.
BINS, EDGE = 100, 40
#: The score's logit of every text when nothing tells toxic texts apart.
FLAT = -4.0

_WORD = re.compile(rb"[a-z0-9\x80-\xff]+").findall


def _parts(word: bytes) -> list[int]:
    """Buckets of a word and its beginnings, even numbers below 2**BITS."""
    text = word.decode("utf-8", "replace")
    names = [text + "$", *(text[:k] for k in PREFIXES if len(text) >= k)]
    return [xxhash.xxh3_64_intdigest(n) >> (64 - BITS + 1) << 1 for n in names]


class Words:
    """Maps texts to features; ``kept``: ascending buckets that count (default: all), as which features are then numbered."""

    def __init__(self, kept: np.ndarray | None = None) -> None:
        self.place = None
        if kept is not None:
            self.place = np.full(1 << BITS, -1, dtype=np.int32)
            self.place[kept] = np.arange(len(kept), dtype=np.int32)
        self.words = Cache(self._packed)

    def _packed(self, word: bytes) -> bytes:
        """The buckets of a word that may count, as bytes, which join faster than numbers."""
        parts = np.array(_parts(word), dtype="<i4")
        if self.place is not None:
            parts = parts[(self.place[parts] >= 0) | (self.place[parts + 1] >= 0)]
        return parts.tobytes()

    def features(self, text: bytes | None) -> np.ndarray:
        """Sorted: b for a bucket that occurs, b + 1 too if it occurs again; by their places if only some are kept."""
        if len(self.words) > CACHE_ENTRIES:
            self.words.clear()
        found = np.frombuffer(b"".join(map(self.words.__getitem__, _WORD((text or b"").lower()))), dtype="<i4")
        at, times = np.unique(found, return_counts=True)
        out = np.sort(np.concatenate([at, at[times > 1] + 1]))
        if self.place is None:
            return out
        places = self.place[out]
        return places[places >= 0]


@lru_cache(maxsize=2)
def _words() -> Words:
    return Words()


def select(p: np.ndarray, u: np.ndarray, positives: int, unlabelled: int) -> np.ndarray:
    """Which features positives have clearly more often, from how many positives and unlabelled texts have each."""
    share = u / max(unlabelled, 1)
    error = np.sqrt(share * (1 - share) / positives + 1 / positives**2)
    return (p >= LEAST) & (p / positives - share >= ERRORS * error)


def dense(rows: list[np.ndarray], width: int) -> np.ndarray:
    """0/1 matrix of the features."""
    out = np.zeros((len(rows), width), dtype=np.float32)
    for i, r in enumerate(rows):
        out[i, r] = 1
    return out


def nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], width: int, prior: float, steps: int = 400, rate: float = 0.05, l2: float = 0.01, batch: tuple[int, int] = (256, 1024), seed: int = 0) -> np.ndarray:
    """Minimises the non-negative risk with logistic loss by Adam; the weights, and the bias behind them.

    Rows are lists of features; only those of a step are dense at a time.
    """
    rng = np.random.default_rng(seed)
    w, m, v = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, steps + 1):
        p = dense([positive[i] for i in rng.integers(0, len(positive), min(batch[0], len(positive)))], width)
        u = dense([unlabelled[i] for i in rng.integers(0, len(unlabelled), min(batch[1], len(unlabelled)))], width)
        zp, zu = p @ w[:-1] + w[-1], u @ w[:-1] + w[-1]
        sp, su = logistic(zp), logistic(zu)
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        gp, gu = (np.full(len(p), -prior) / len(p), su / len(u)) if negative >= 0 else (prior * sp / len(p), -su / len(u))
        g = np.append(gp @ p + gu @ u + l2 * w[:-1], gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def best_cut(bins: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> float:
    """The logit with the best F1 that positives and unlabelled texts (counts by ascending bin) allow to estimate; half way to the bin below."""
    recall, share = (c[::-1].cumsum()[::-1] / max(c.sum(), 1) for c in (p, u))
    i = int(np.argmax(2 * prior * recall / (prior + share)))
    below = np.flatnonzero(u[:i] > 0)
    return float((bins[i] + bins[below[-1]]) / 2) if len(below) else float(bins[i])


def _bucket_counts(batches, features, width: int):
    """Rows (bucket, n) of a task's texts."""
    n = np.zeros(width, dtype=np.int64)
    for b in batches:
        for t in b.column(0).to_pylist():
            n[features(t)] += 1
    at = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["bucket", "n"])


def count_features(texts: DataFrame, kept: np.ndarray | None) -> DataFrame:
    """(bucket, n): how many of ``texts`` (one binary column) have each feature; each task sends its sums."""
    width = 1 << BITS if kept is None else len(kept)

    def run(batches):
        yield from _bucket_counts(batches, (_words() if kept is None else Words(kept)).features, width)

    return texts.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def _numbers(frame: DataFrame) -> list[np.ndarray]:
    """The columns of a frame whose size is bounded."""
    t = frame.toArrow()
    return [c.to_numpy() for c in t.columns]


def kept_features(positive: DataFrame, unlabelled: DataFrame, positives: int, total: int) -> np.ndarray:
    """The buckets to keep, ascending; at most 2**BITS. ``positive``, ``unlabelled``: one binary column of texts."""
    bucket, p = _numbers(count_features(positive, None).where(F.col("n") >= LEAST))
    if not len(bucket) or not total:
        return np.zeros(0, dtype=np.int64)
    by = np.argsort(bucket)
    bucket, p, u = bucket[by], p[by], np.zeros(len(bucket), dtype=np.int64)
    at, n = _numbers(count_features(unlabelled, bucket))
    u[at] = n
    return bucket[select(p, u, positives, total)]


def _rows_of(column) -> list[np.ndarray]:
    return [np.frombuffer(x, "<i4") for x in column.to_pylist()]


def mean_model(rows: DataFrame, positive: list[np.ndarray], width: int, prior: float, chunks: int) -> np.ndarray:
    """The chunks' models of ``rows`` (h, x: unlabelled texts), averaged by their rows; weights, and the bias behind them."""
    def run(batches):
        for t in groups(batches, ["chunk"]):
            model, n = nnpu(positive, _rows_of(t.column("x")), width, prior), t.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width + 1)), pa.array(model * n), pa.array(np.full(width + 1, n))], ["at", "w", "n"])

    chunked = rows.withColumn("chunk", F.pmod("h", F.lit(chunks)))
    dealt = chunked.repartition("chunk").sortWithinPartitions("chunk", "h", "x").select("chunk", "x")
    summed = dealt.mapInArrow(run, "at long, w double, n long").groupBy("at").agg((F.sum("w") / F.sum("n")).alias("w")).orderBy("at")
    return _numbers(save_table(summed, "toxicity-model").orderBy("at"))[1]


def toxicity(docs: DataFrame, labels: DataFrame, prior: float | None = None, positives: int = POSITIVES, chunk: int = CHUNK, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted, and the columns of ``carry``.

    Learns from at most ``positives`` documents labelled toxic and from all texts,
    whatever their labels, as unlabelled ones, those with crc32(doc_id) mod 4 other
    than 2. ``prior`` is the share of toxic documents; by default that of the
    labelled ones in the same folds. Scores every whole text; a null text is
    empty, and an empty one has the score of the bias. Null and repeated ids are
    scored row by row; a null id's fold is that of the empty text. Null labels
    don't count, and an id that any label calls toxic is toxic. Other columns are
    ignored; an empty table gives an empty result. Without positives or a feature
    that tells them apart every text gets the same low score.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = labelled(labels, "toxic", MODULUS, HELD_OUT, F.max)
    if prior is None:
        prior = known.agg(F.avg("y")).first()[0] or 0.0
    prior = min(max(prior, 1e-6), 1.0)
    more = list(carry)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), *more)
    held_out: Column = fold(F.col("doc_id"), MODULUS) == HELD_OUT
    chosen = save_table(sample_texts(docs, known.where("y > 0"), positives), "toxicity-positives")
    n_positive, n_unlabelled = chosen.count(), texts.where(~held_out).count()
    kept = kept_features(chosen.select(F.col("text").cast("binary")), texts.where(~held_out).select("text"), n_positive, n_unlabelled) if n_positive else np.zeros(0, dtype=np.int64)
    if not len(kept):
        score = float(logistic(FLAT))
        return texts.select("doc_id", held_out.alias("held_out"), F.lit(score).alias("score"), F.lit(int(score >= THRESHOLD)).alias("predicted"), *more)

    places = spark.sparkContext.broadcast(kept)
    rows = features_of(texts, lambda: Words(places.value).features)
    rows = save_table(rows.select("doc_id", held_out.alias("held_out"), F.xxhash64("doc_id", F.lit(1)).alias("h"), *more, "x"), "toxicity-rows")
    bearing = features_of(chosen, lambda: Words(places.value).features).orderBy("doc_id").select("x").toArrow()
    positive = _rows_of(bearing.column("x"))
    model = mean_model(rows.where(~F.col("held_out")).select("h", "x"), positive, len(kept), prior, max(1, -(-n_unlabelled // chunk)))

    def logits(batches):
        for b in batches:
            z = [float(model[:-1][x].sum() + model[-1]) for x in _rows_of(b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *b.columns[3:], pa.array(z, pa.float64())], ["doc_id", "held_out", *more, "z"])

    carried = "".join(f", `{c}` {t}" for c, t in rows.dtypes if c in more)
    scored = rows.select("doc_id", "held_out", "x", *more).mapInArrow(logits, f"doc_id long, held_out boolean{carried}, z double")
    binned = F.round(F.greatest(F.lit(-EDGE), F.least(F.lit(EDGE), F.col("z"))) * BINS).cast("long")
    bins, u = _numbers(scored.where("not held_out").groupBy(binned.alias("bin")).agg(F.count("*").alias("n")).orderBy("bin"))
    mine, p = np.unique(np.clip(np.round([(model[:-1][x].sum() + model[-1]) * BINS for x in positive]), -EDGE * BINS, EDGE * BINS), return_counts=True)
    every = np.union1d(bins, mine)
    full = [np.bincount(np.searchsorted(every, at), weights=n, minlength=len(every)) for at, n in ((mine, p), (bins, u))]
    shift = float(np.log(THRESHOLD / (1 - THRESHOLD))) - best_cut(every / BINS, *full, prior)
    score = 1 / (1 + F.exp(-F.greatest(F.lit(-35.0), F.least(F.lit(35.0), F.col("z") + shift))))
    return scored.select("doc_id", "held_out", score.alias("score"), *more).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
