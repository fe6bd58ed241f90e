"""Language model, classifiers and mixing."""

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F, types as T

from parasol.llm.mixing import MOST, WEIGHTS, mix
from parasol.llm.ngram_lm import Block, ngram_scores
from parasol.llm.quality import Ftrl, best_cut, quality
from parasol.llm.toxicity import best_cut as cut_of, nnpu, toxicity
from tests.llm.helpers import awkward, clashing, crc, docs, words

LABELS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()), T.StructField("toxic", T.IntegerType())])


def brute_scores(rows, order, mass, share=0.0):
    tokens = [[w.encode().lower() for w in words(t)] + [None] for _, t, _ in rows]
    learns = [crc(d) % 7 != 2 for d, _, _ in rows]
    counts = Counter()
    for toks, ok in zip(tokens, learns, strict=True):
        for k in range(1, order + 1):
            if ok:
                counts.update(tuple(toks[i : i + k]) for i in range(len(toks) - k + 1))
    n = sum(c for g, c in counts.items() if len(g) == 1)
    v = sum(len(g) == 1 for g in counts)

    def p(gram):
        if len(gram) == 1:
            return (counts[gram] + 1) / (n + v + 1)
        if len(gram) > 2 and any(counts[(w,)] < 0.9 * share * n for w in gram[:-1]):
            return p(gram[1:])
        return (counts[gram] + mass * p(gram[1:])) / (counts[gram[:-1]] + mass)

    out = []
    for (d, _, _), toks, ok in zip(rows, tokens, learns, strict=True):
        grams = [tuple(toks[max(0, i - order + 1) : i + 1]) for i in range(len(toks))]
        out.append((str(d), not ok, len(toks), sum(counts[(t,)] > 0 for t in toks), n, sum(math.log10(p((t,))) for t in toks), sum(math.log10(p(g)) for g in grams)))
    return sorted(out)


@pytest.mark.parametrize("order,block,share", [(1, 1 << 24, 0.0), (2, 2000, 0.0), (3, 5000, 0.0), (3, 1 << 24, 0.01), (4, 1 << 24, 0.008)])
def test_scores_equal_the_smoothed_model(spark, order, block, share):
    rows = awkward()
    frame = clashing(docs(spark, rows))
    got = ngram_scores(frame.repartition(1) if share else frame, order=order, mass=7.0, share=share, block_bytes=block).collect()
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got)
    for g, w in zip(got, brute_scores(rows, order, 7.0, share), strict=True):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], abs=1e-6)


def test_rare_words_are_contexts_too(spark):
    """By default no context is left out, however rare its words: a pair of words seen a few times among 18,000 tokens counts."""
    filler = " ".join(f"w{i % 40}" for i in range(300))
    rows = [(i, filler + (" rare pair follows" if i in (3, 5) else ""), None) for i in range(60)] + [(99, "rare pair follows", None)]
    got = sorted((str(r.doc_id), r.score) for r in ngram_scores(docs(spark, rows), block_bytes=3000).collect())
    want = sorted((r[0], r[-1]) for r in brute_scores(rows, 3, 300.0))
    assert [g[0] for g in got] == [w[0] for w in want]
    assert [g[1] for g in got] == pytest.approx([w[1] for w in want], abs=1e-9)


def test_a_share_does_not_depend_on_blocks(spark):
    """The word x has a little over nine tenths of the share, some of it in a block where it is rare."""
    learnt = [i for i in range(20) if crc(i) % 7 != 2][:2]
    texts = ["x " * 860 + "a b " * 70, "x " * 45 + "a b " * 477]
    rows = [(i, t, None) for i, t in zip(learnt, texts, strict=True)]
    want = sorted((r[0], r[-1]) for r in brute_scores(rows, 3, 300.0, 0.5))
    for block in (1000, 1 << 24):
        got = sorted((str(r.doc_id), r.score) for r in ngram_scores(docs(spark, rows).coalesce(1), share=0.5, block_bytes=block).collect())
        assert [g[1] for g in got] == pytest.approx([w[1] for w in want], abs=1e-6)


def test_scores_of_an_empty_table(spark):
    assert ngram_scores(docs(spark, [])).count() == 0
    one = ngram_scores(docs(spark, [(2, None)])).collect()
    assert len(one) == 1 and one[0].n_tokens == 1


def test_model_sums_to_one(spark):
    """Over all words after one context: the scores of two-word texts differ by their last word only."""
    texts = ["a b", "a c", "b a", "a b c", "c c a b"]
    vocabulary = ["a", "b", "c", "zzz"]
    learnt = next(i for i in range(100) if crc(i) % 7 != 2)
    held = [i for i in range(2000, 3000) if crc(i) % 7 == 2]
    rows = [(learnt, " ".join(texts))] + [(held[i], f"a {w}") for i, w in enumerate(vocabulary)] + [(held[10], "a"), (held[11], "")]
    got = {r.doc_id: r for r in ngram_scores(docs(spark, rows), order=2, mass=3.0).collect()}
    # p(text "a") = p(a) p(end | a); for "a w" the end's share after w is divided out by the text "w" less its start
    alone = {r.doc_id: r.score for r in ngram_scores(docs(spark, [rows[0]] + [(held[20 + i], w) for i, w in enumerate(vocabulary)]), order=2, mass=3.0).collect()}
    start = {r.doc_id: r.base_score for r in ngram_scores(docs(spark, [rows[0]] + [(held[20 + i], w) for i, w in enumerate(vocabulary)]), order=2, mass=3.0).collect()}
    end = got[held[11]].base_score
    single = {w: start[held[20 + i]] - end for i, w in enumerate(vocabulary)}
    after = {w: got[held[i]].score - single["a"] - (alone[held[20 + i]] - single[w]) for i, w in enumerate(vocabulary)}
    total = sum(10**x for x in after.values()) + 10 ** (got[held[10]].score - single["a"])
    assert total == pytest.approx(1.0)


def test_block_numbers_its_grams():
    b = Block(pa.array([b"A b a", None, b"b a b"], pa.binary()), 2)
    assert b.tokens.tolist() == [1, 2, 1, 0, 0, 2, 1, 2, 0]
    assert b.counts(0, np.array([True, True, False])).tolist() == [2, 2, 1]
    assert len(b.grams[1]) == 4


def label_rows(spark, n=240):
    """Clean, junk and toxic texts with labels, in every fold."""
    rng = np.random.default_rng(0)
    vocabulary = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        w = [vocabulary[k] for k in rng.integers(0, 300, 40)]
        good, toxic = i % 4 != 0, i % 5 == 0
        if not good:
            w = [x.upper() + "!!" for x in w]
        if toxic:
            w = [*w[:20], "grubnik", *w[20:], "vexhead"]
        rows.append((i, " ".join(w)))
        labels.append((i, int(good), int(toxic)))
    rows += [(None, "no id"), (n, None), (n + 1, ""), (3, "again " * 3000)]
    labels += [(None, 1, 1), (n, None, None), (0, 1, None), (10**6, 1, 1)]
    return rows, labels


@pytest.mark.parametrize("name", ["quality", "toxic"])
def test_classifiers_on_held_out_rows(spark, name):
    rows, labels = label_rows(spark)
    frame, marks = clashing(docs(spark, rows)), clashing(spark.createDataFrame(labels, LABELS).drop("x"))
    of, modulus, fold = (quality, 5, 0) if name == "quality" else (toxicity, 4, 2)
    got = of(frame, marks).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (crc(r.doc_id) % modulus == fold) for r in got)
    want = {d: (q if name == "quality" else t) for d, q, t in labels[:240]}
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 240 and r.doc_id != 3]
    right = [r.predicted == want[r.doc_id] for r in held]
    assert len(right) > 30 and np.mean(right) >= 0.9
    again = {(r.doc_id, r.score) for r in of(frame, marks).collect()}
    assert again == {(r.doc_id, r.score) for r in got}


def test_classifiers_without_rows_or_labels(spark):
    empty, none = docs(spark, []), spark.createDataFrame([], LABELS)
    some = docs(spark, [(1, "a b"), (2, None)])
    for of in (quality, toxicity):
        assert of(empty, none).count() == 0
        assert len({r.score for r in of(some, none).collect()}) == 1
        assert of(some, spark.createDataFrame([(1, 1, 1), (2, 1, 1)], LABELS)).count() == 2


def test_ftrl_separates():
    x, y = [np.array([i % 2, 2]) for i in range(40)], np.array([float(i % 2) for i in range(40)])
    m = Ftrl(3).fit(x, y, np.ones(40))
    assert m.weights[1] > 0 > m.weights[0]
    assert best_cut(np.array([-2.0, -1.0, 3.0, 4.0]), np.array([0.0, 0.0, 1.0, 1.0])) == 1.0


def plain_ftrl(x, y, cost, size, epochs, alpha, beta, l1, l2):
    """FTRL-proximal as its paper writes it, one coordinate after the other; the last is the bias, without penalty."""
    z, n = [0.0] * (size + 1), [0.0] * (size + 1)

    def weight(i):
        a, b = (l1, l2) if i < size else (0.0, 0.0)
        return 0.0 if abs(z[i]) <= a else -(z[i] - math.copysign(a, z[i])) / ((beta + math.sqrt(n[i])) / alpha + b)

    rng = np.random.default_rng(0)
    for _ in range(epochs):
        for k in rng.permutation(len(x)):
            value = 1 / math.sqrt(max(len(x[k]), 1))
            w = {int(i): weight(int(i)) for i in x[k]} | {size: weight(size)}
            p = 1 / (1 + math.exp(-(w[size] + value * sum(w[int(i)] for i in x[k]))))
            for i in w:
                g = (p - y[k]) * cost[k] * (value if i < size else 1.0)
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha
                z[i] += g - sigma * w[i]
                n[i] += g * g
    return [weight(i) for i in range(size + 1)]


@pytest.mark.parametrize("l1", [0.0, 0.4])
def test_ftrl_equals_its_plain_form(l1):
    rng = np.random.default_rng(3)
    x = [np.unique(rng.integers(0, 20, rng.integers(0, 8))) for _ in range(60)]
    y, cost = (rng.random(60) < 0.4).astype(float), rng.random(60) + 0.5
    m = Ftrl(20, alpha=0.7, beta=1.0, l1=l1, l2=0.05).fit(x, y, cost, epochs=3)
    want = plain_ftrl(x, y, cost, 20, 3, 0.7, 1.0, l1, 0.05)
    assert m.weights == pytest.approx(want[:20], abs=1e-5) and m.bias == pytest.approx(want[20])


def plain_nnpu(positive, unlabelled, width, prior, steps, rate, l2, batch):
    """The risk's gradient by finite sums, and Adam, one number after the other."""
    rng = np.random.default_rng(0)
    w, m, v = [0.0] * (width + 1), [0.0] * (width + 1), [0.0] * (width + 1)
    for t in range(1, steps + 1):
        p = [positive[i] for i in rng.integers(0, len(positive), min(batch[0], len(positive)))]
        u = [unlabelled[i] for i in rng.integers(0, len(unlabelled), min(batch[1], len(unlabelled)))]
        z = lambda r: w[-1] + sum(w[int(i)] for i in r)
        soft, sig = (lambda a: math.log1p(math.exp(a))), (lambda a: 1 / (1 + math.exp(-a)))
        second = sum(soft(z(r)) for r in u) / len(u) - prior * sum(soft(z(r)) for r in p) / len(p)
        g = [l2 * a for a in w[:-1]] + [0.0]
        for rows, of in ((p, lambda a: -prior * sig(-a) - prior * sig(a) if second >= 0 else prior * sig(a)), (u, lambda a: sig(a) if second >= 0 else -sig(a))):
            for r in rows:
                s = of(z(r)) / len(rows)
                for i in [*r, width]:
                    g[int(i)] += s
        for i in range(width + 1):
            m[i], v[i] = 0.9 * m[i] + 0.1 * g[i], 0.999 * v[i] + 0.001 * g[i] ** 2
        w = [a - rate * (m[i] / (1 - 0.9**t)) / (math.sqrt(v[i] / (1 - 0.999**t)) + 1e-8) for i, a in enumerate(w)]
    return w


@pytest.mark.parametrize("prior", [0.1, 0.9])
def test_nnpu_equals_its_plain_form(prior):
    rng = np.random.default_rng(4)
    positive = [np.unique(np.append(0, rng.integers(0, 6, 2))) for _ in range(20)]
    unlabelled = [np.unique(rng.integers(0, 6, rng.integers(0, 3))) for _ in range(50)]
    got = nnpu(positive, unlabelled, 6, prior, steps=30, batch=(8, 16))
    assert got == pytest.approx(plain_nnpu(positive, unlabelled, 6, prior, 30, 0.05, 0.01, (8, 16)), abs=1e-5)


def test_nnpu_risk_does_not_learn_positives_by_heart():
    rng = np.random.default_rng(1)
    positive = np.concatenate([np.ones((50, 1)), rng.integers(0, 2, (50, 30))], axis=1)
    unlabelled = np.concatenate([(rng.random((800, 1)) < 0.1).astype(float), rng.integers(0, 2, (800, 30))], axis=1)
    w = nnpu([np.flatnonzero(r) for r in positive], [np.flatnonzero(r) for r in unlabelled], 31, 0.1)
    assert w[0] > 3 * np.abs(w[1:-1]).max()


def test_cut_of_histograms():
    bins = np.array([-2.0, -1.0, 3.0, 4.0])
    assert cut_of(bins, np.array([0, 0, 5, 5]), np.array([80, 10, 5, 5]), 0.1) == 1.0
    assert cut_of(bins[2:], np.array([5, 5]), np.array([1, 1]), 0.5) == 3.0


def test_toxicity_takes_all_unlabelled_rows_in_chunks(spark):
    """Chunks of 40 rows give nearly the model of one chunk, and a row column is carried along."""
    rows, labels = label_rows(spark)
    frame, marks = docs(spark, rows).withColumn("nr", F.monotonically_increasing_id()), spark.createDataFrame(labels, LABELS)
    got = {r.nr: r for r in toxicity(frame, marks, carry=("nr",), chunk=40).collect()}
    whole = {r.nr: r for r in toxicity(frame, marks, carry=("nr",)).collect()}
    assert len(got) == len(rows) and np.mean([got[k].predicted == whole[k].predicted for k in got]) > 0.97


def water(sizes):
    """Targets by sharing again until none is above its limit."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: WEIGHTS[i % 3] for i, s in enumerate(order)}
    full, total = set(), sum(sizes.values())
    while True:
        left = total - sum(MOST * sizes[s] for s in full)
        open_w = sum(weight[s] for s in order if s not in full)
        share = {s: MOST * sizes[s] if s in full else left * weight[s] / open_w for s in order}
        more = {s for s in order if s not in full and share[s] > MOST * sizes[s]}
        if not more:
            return share
        full |= more


def test_mix_of_awkward_rows(spark):
    rows = awkward(n=300) + [(5000 + i, "tiny text", "rare") for i in range(3)] + [(6000, "", "zero"), (6001, None, "zero")] + [(77, "rep eat", "a")] * 200
    frame = clashing(docs(spark, rows))
    got = mix(frame).collect()
    assert sorted((str(r.doc_id), r.size, str(r.source)) for r in got) == sorted((str(d), len(words(t)), str(s)) for d, t, s in rows)
    sizes, largest = defaultdict(int), defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(words(t))
        largest[s] = max(largest[s], len(words(t)))
    targets, taken = water(dict(sizes)), defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source])
        assert r.taken == r.size * r.copies and 0 <= r.copies <= MOST
        rate = r.target / r.source_size if r.source_size else 0
        assert math.floor(rate) <= r.copies <= math.ceil(rate)
        taken[r.source] += r.taken
    for s, t in targets.items():
        assert abs(taken[s] - t) <= largest[s] / 2 + 1e-6
    key = lambda r: (str(r.doc_id), r.size, str(r.source), r.taken)
    assert sorted(map(key, mix(frame.repartition(7)).collect())) == sorted(map(key, got))
    assert mix(docs(spark, [])).count() == 0


def test_mix_keeps_probabilities(spark):
    """Over seeds each document is taken as often as its rate says."""
    rows = [(i, "w " * (1 + i % 9), "ab"[i % 2]) for i in range(40)]
    sums, rate = Counter(), {}
    for seed in range(12):
        for r in mix(docs(spark, rows), seed=seed).collect():
            sums[r.source] += r.copies
            rate[r.source] = r.target / r.source_size
    for s, n in sums.items():
        assert n / (12 * 20) == pytest.approx(rate[s], abs=0.12)
