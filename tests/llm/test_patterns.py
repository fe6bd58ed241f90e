"""Pattern packing against the library's ids and bounds on sequences."""

import json
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from parasol.llm.bpe import letters
from parasol.llm.pattern_packing import WordEncoder, best_fit, fit, letter_ranks, pack_patterns, patterns, places, plan, rounded
from tests.llm.helpers import awkward, clashing, docs

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def library(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def encoder():
    return WordEncoder(PATH)


def ids(encoder, text):
    return np.frombuffer(encoder.packed(text), dtype="<u4").tolist()


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from([*" \n\t\r\x0b\x1c\x85\xa0ab1!éÉΣ漢́'st", "  ", "'ll", "<|endoftext|>", "<|", "é"]), max_size=30).map("".join))
def test_ids_equal_the_library(encoder, text):
    assert encoder.local
    assert ids(encoder, text) == library(text)


def test_ids_around_every_character(encoder):
    points = [chr(c) for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(points), 64):
        text = "".join(f"a {c} b{c} {c}c  {c}\n{c}" for c in points[i : i + 64])
        assert ids(encoder, text) == library(text), hex(ord(points[i]))


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from([*"abcdeinorstzABTßàéïöüÿÀÉÖÞ÷×µ'.%*"]), max_size=24))
def test_words_of_letters_and_marks_equal_the_library(encoder, word):
    for text in (word, f"{word} {word}.", f"in {word}%%% {word}\n{word}"):
        assert ids(encoder, text) == library(text)


def test_words_of_letters_do_not_need_the_library(monkeypatch):
    encoder, asked = WordEncoder(PATH), []
    monkeypatch.setattr(encoder, "ids", lambda texts: asked.extend(texts) or [np.array(library(t), dtype="<u4").tobytes() for t in texts])
    text = "Onhatily grüße déjà vu*** Thansha... an2d"
    assert ids(encoder, text) == library(text)
    assert {*asked} <= {"an2d", "***", "...", ""}


def test_ranks_that_say_something_else_are_refused():
    """The list makes b of `a b c` join c before a, so no neighbours a and bc may join to a token that the list only makes of ab and c."""
    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    assert letter_ranks(spec)
    model = spec["model"]
    singles = [c + end for c in letters().values() for end in ("", "</w>")]

    def file(*merges):
        vocab = {t: i for i, t in enumerate([*singles, *("".join(m) for m in merges)])}
        return spec | {"model": model | {"vocab": vocab, "merges": [list(m) for m in merges]}, "added_tokens": []}

    assert letter_ranks(file(("b", "c"), ("a", "bc")))
    assert letter_ranks(file(("b", "c"), ("a", "b"), ("ab", "c"))) is None


def test_other_files_go_to_the_library():
    other = WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert not other.local
    assert ids(other, "two  words\n") == Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode("two  words\n").ids


def occurrences(contents, limit):
    out = np.zeros(limit + 1, dtype=np.int64)
    for content, n in contents:
        assert sum(length * each for length, each in content) <= limit
        for length, each in content:
            out[length] += n * each
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=13, max_size=61))
def test_plans_hold_the_histogram(counts):
    histogram = np.array([0, *counts])
    contents = plan(histogram)
    limit = len(histogram) - 1
    assert (occurrences(contents, limit) == histogram).all()
    table = places(contents)
    spans = defaultdict(list)
    for key, each, sequence, offset in table.tolist():
        assert key >> 48 and each and 0 <= offset < limit and 0 <= sequence < sum(n for _, n in contents)
        spans[key >> 48].append(key & ((1 << 48) - 1))
    assert all(first[0] == 0 and first == sorted(set(first)) for first in spans.values())


def test_best_fit_on_counts_is_best_fit_on_pieces():
    rng = random.Random(3)
    for _ in range(40):
        limit = rng.choice([10, 50, 200])
        lengths = sorted((rng.randint(1, limit) for _ in range(rng.randint(1, 300))), reverse=True)
        rooms = []
        for length in lengths:
            fits = [i for i, r in enumerate(rooms) if r >= length]
            if fits:
                rooms[min(fits, key=lambda i: rooms[i])] -= length
            else:
                rooms.append(limit - length)
        contents = best_fit(np.bincount(lengths, minlength=limit + 1))
        assert sum(n for _, n in contents) == len(rooms)


def test_fit_solves_least_squares():
    rng = np.random.default_rng(0)
    shapes = patterns(np.ones(25, dtype=bool), 24)
    assert all(s.sum() == 24 and (np.diff(s[s > 0]) >= 0).all() for s in shapes)
    truth = rng.integers(0, 50, len(shapes)).astype(float)
    histogram = np.bincount(shapes.ravel(), np.repeat(truth, 3), 25)
    histogram[0] = 0
    x = fit(shapes, histogram, 3000)
    sums = np.bincount(shapes.ravel(), np.repeat(x, 3), 25)
    assert (x >= 0).all() and np.abs(sums - histogram)[1:].max() < 0.02 * histogram.max()
    left = histogram.astype(np.int64)
    used = rounded(shapes, x, left)
    assert (left >= 0).all() and (occurrences(used, 24) + left == histogram).all()


def test_plans_come_near_the_bound():
    rng = np.random.default_rng(1)
    for scale in (1, 20, 3000):
        lengths = np.minimum(rng.lognormal(5.5, 1.2, 20_000).astype(int) + 1, 2048)
        histogram = np.bincount(lengths, minlength=2049) * scale
        bound = max(-(-int(histogram @ np.arange(2049)) // 2048), int(histogram[1025:].sum()))
        assert sum(n for _, n in plan(histogram)) <= 1.002 * bound + 1


def check(rows, result, limit=2048):
    expected = defaultdict(list)
    for doc_id, text in rows:
        whole = [*library(text), 0]
        expected[doc_id].append([(p, s, len(c := whole[s : s + limit]), zlib.crc32(np.array(c, dtype="<u4"))) for p, s in enumerate(range(0, len(whole), limit))])
    assert sorted(map(repr, ((d, *piece) for d, all_ in expected.items() for pieces in all_ for piece in pieces))) == sorted(repr(tuple(r)[:5]) for r in result)
    sequences = defaultdict(list)
    for r in result:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places_ in sequences.values():
        at = 0
        for offset, length in sorted(places_):
            assert offset == at
            at += length
        assert at <= limit
    return len(sequences)


def test_pieces_and_places(spark):
    rows = [(r[0], r[1]) for r in awkward()] + [(1000 + i, None) for i in range(500)] + [(5, "word " * 7000)] * 2
    result = pack_patterns(clashing(docs(spark, rows).repartition(7)), PATH, 0, 2048)
    assert result.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    n = check(rows, result.collect())
    total = sum(len(library(t)) + 1 for _, t in rows)
    assert n <= -(-total // 2048) + 1


def test_no_rows(spark):
    assert pack_patterns(docs(spark, []), PATH, 0, 2048).collect() == []


def test_query(spark):
    from parasol.llm.queries import op12_pattern_packing

    sf_dir = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    check(rows, op12_pattern_packing(spark, sf_dir).collect())
