"""Spelling variants against brute force on all words."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings, strategies as st

from parasol.llm.spelling import keys, rarest, spelling_variants
from tests.llm.helpers import awkward, clashing, docs


def plain_words(rows, every=31):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if every and h % every == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
            if len(word) >= 7:
                counts[word] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and a in {b[:i] + b[i + 1 :] for i in range(len(b))}


def plain(rows, every=31):
    words = plain_words(rows, every)
    cut = defaultdict(set)
    for w in words:
        cut[w].add(w)
        for i in range(len(w)):
            cut[w[:i] + w[i + 1 :]].add(w)
    near = defaultdict(set)
    for some in cut.values():
        for a in some:
            near[a] |= {b for b in some if one_edit(a, b)}
    form = {}
    for w, n in words.items():
        if near[w]:
            best = min(near[w], key=lambda b: (-words[b], b))
            if words[best] >= 10 * n:
                form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), words.get(form.get(w))))
    return sorted(out, key=lambda r: r[0])


def got(frame):
    assert frame.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(map(tuple, frame.collect()), key=lambda r: r[0])


@settings(max_examples=2000, deadline=None)
@given(st.text("abÿ", min_size=4, max_size=12), st.integers(0, 2), st.integers(0, 11), st.sampled_from("abcÿ"), st.integers(0, 10**6))
def test_words_one_edit_apart_share_a_key(a, kind, at, letter, seed):
    at %= len(a)
    b = a[:at] + (letter if kind else "") + a[at + (kind != 1) :]
    if len(b) < 4 or a == b:
        return
    order = np.random.default_rng(seed).permutation(1 << 16)
    word, key, role = (x.tolist() for x in keys([a, b], *rarest(order, [a, b])))
    own = [{k for w, k, r in zip(word, key, role, strict=True) if w == i and r == 0} for i in (0, 1)]
    less = [{k for w, k, r in zip(word, key, role, strict=True) if w == i and r == 1} for i in (0, 1)]
    assert own[0] & own[1] if len(a) == len(b) else own[0] & less[1] if len(a) < len(b) else own[1] & less[0]


def test_awkward_texts_and_hubs(spark):
    rng = random.Random(5)
    rows = [(r[0], r[1]) for r in awkward()]
    base = ["reading", "paintings", "élégances", "abababababab", "aaaaaaaaa", "mississippi", "x" * 40, "×÷×÷×÷×÷"]
    for w in base:
        rows += [(rng.choice([None, rng.randint(0, 500)]), f"{w.upper()} {w}; {w}\n{w.title()}") for _ in range(40)]
        for _ in range(30):
            i = rng.randrange(len(w))
            v = w[:i] + rng.choice(["", "e", "é", w[i] + "a"]) + w[i + 1 :]
            rows += [(rng.randint(0, 500), f"{v} {v}")] * rng.choice([1, 1, 3])
            v = v[:-1] + "q"
            rows.append((7, f"{v} {v}"))
    result = spelling_variants(clashing(docs(spark, rows).repartition(6)))
    expected = plain(rows)
    assert got(result) == expected
    assert any(r[1] and r[2] != r[1] for r in expected) or any(r[1] for r in expected)


def test_chains_of_forms(spark):
    rows = [(1, "paintxngz " * 2), (2, "paintingz " * 30), (3, "paintings " * 400), (4, "painting " * 5000)]
    result = got(spelling_variants(docs(spark, rows), every=0))
    assert result == plain(rows, every=0)
    assert {r[0]: r[2] for r in result} == dict.fromkeys(["paintxngz", "paintingz", "paintings", "painting"], "painting")


def test_very_long_words(spark):
    long = "x" * 200_000
    rows = [(1, f"{long} {long}"), (2, f"{long}y {long}y"), (3, f"y{long}z y{long}z")]
    result = {r.word: r.n_near for r in spelling_variants(docs(spark, rows), every=0).collect()}
    assert result == {long: 1, f"{long}y": 1, f"y{long}z": 0}


def test_no_words(spark):
    assert spelling_variants(docs(spark, [])).collect() == []
    assert spelling_variants(docs(spark, [(1, None), (2, ""), (3, "short words"), (None, "lonesome")])).collect() == []


def test_query(spark):
    from parasol.llm.queries import op13_spelling_variants

    sf_dir = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert got(op13_spelling_variants(spark, sf_dir)) == plain(rows)
