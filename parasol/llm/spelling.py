"""Spelling variants of words, by a rare-first filter on positional bigrams.

Words that are one edit apart share a bigram among the three rarest of each, at
places that differ by one at most: an edit destroys two bigrams at most, so one
of a word's first three in the global order of bigrams is left, and the other
word's bigrams up to its own third include it, if the order is shared and a
third bigram that a word has several times counts with its first five places, as
an edit puts two more before one of the first three at most. So only those are
joined, by bigram, place and length. An edit that leaves a bigram alone also
leaves all alone but one of three pieces beside it, so the hash of the rest is
part of the key, without which common syllables bring together many words that
are nothing alike. What meets is verified.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from parasol.llm.common import release_memory
from parasol.session import save_table, small_batches

#: Bigrams of a word that are joined: one more than an edit can destroy; and places of the last of them, two more.
RAREST, PLACES = 3, 5
#: Distinct words that a task holds before it passes their counts on.
HELD_WORDS = 200_000
#: Spark's edit distance takes time by the square of the length; words with more letters are verified in linear time.
LONG_WORD = 64
#: Words that are cut up at a time, and their code points at most.
CHUNK = 20_000
RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: An odd base of hashes and its inverse modulo 2**64, and an odd number that mixes.
BASES = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
MIX, ONE = np.uint64(0xD6E8FEB86659FD93), np.uint64(1)
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def damaged(doc_id: int | None, text: str, least: int, every: int, counts: Counter) -> None:
    """Counts the runs of letters of a text that have ``least`` code points or more.

    A run whose checksum with the id ``every`` divides loses one code point first;
    0 leaves all runs as they are.
    """
    before = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in Counter(RUN.findall(text.translate(LOWER) if not text.isascii() else text.lower())).items():
        if len(run) < least:
            continue
        if every:
            h = zlib.crc32(run.encode(), before)
            if not h % every:
                i = h % len(run)
                run = run[:i] + run[i + 1 :]
                if len(run) < least:
                    continue
        counts[run] += n


def word_counts(docs: DataFrame, id_col: str, text_col: str, least: int, every: int) -> DataFrame:
    """Words of at least ``least`` code points with their occurrences, added up in each task and then by word."""

    def count(batches):
        counts: Counter = Counter()

        def drain():
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
            counts.clear()
            return out

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if text:
                    damaged(doc_id, text, least, every, counts)
            if len(counts) > HELD_WORDS:
                yield drain()
        yield drain()
        release_memory()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def bigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bigrams of words of Latin-1 letters as numbers, the word that each lies in, and its place there."""
    letters = np.frombuffer("\n".join(words).encode("latin-1"), dtype=np.uint8).astype(np.int32)
    ends = np.flatnonzero(letters == ord("\n"))
    inside = np.ones(max(len(letters) - 1, 0), dtype=bool)
    inside[ends] = False
    inside[ends - 1] = False
    at = np.flatnonzero(inside)
    word = np.searchsorted(ends, at)
    begin = np.append(0, ends + 1)[word]
    return (letters[at] << 8) | letters[at + 1], word, at - begin


def _chunks(column: pa.Array):
    """The words of a batch in lists of a bounded number of code points, each with its first row."""
    words, held, size, first = column.to_pylist(), [], 0, 0
    for i, w in enumerate(words):
        held.append(w)
        size += len(w)
        if size > CHUNK * 10 or len(held) >= CHUNK:
            yield first, held
            held, size, first = [], 0, i + 1
    if held:
        yield first, held


def bigram_counts(words: DataFrame) -> np.ndarray:
    """How many words' places each bigram has; there are 90 letters, so at most 8,100 rows reach the driver."""

    def count(batches):
        total = np.zeros(1 << 16, dtype=np.int64)
        for b in batches:
            for _, some in _chunks(b.column(0)):
                total += np.bincount(bigrams(some)[0], minlength=1 << 16)
        kept = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(kept.astype(np.int64)), pa.array(total[kept])], ["gram", "n"])

    out = np.zeros(1 << 16, dtype=np.int64)
    for gram, n in words.select("word").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n")).collect():
        out[gram] = n
    return out


def rarest(order: np.ndarray, words: list[str], keep: int = RAREST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first ``keep`` bigrams of each word in ``order`` (rank by bigram), and the first PLACES places of the last one: bigram, word, place."""
    gram, word, place = bigrams(words)
    ranks = order[gram]
    by = np.lexsort((place, ranks, word))
    gram, word, place, ranks = gram[by], word[by], place[by], ranks[by]
    start = np.searchsorted(word, np.arange(len(words)))
    stop = np.searchsorted(word, np.arange(len(words)), side="right")
    last = np.minimum(start + keep, stop) - 1  # every word has a bigram, as words have two letters at least
    new = np.append(True, (word[1:] != word[:-1]) | (gram[1:] != gram[:-1]))
    nth = np.arange(len(gram)) - np.maximum.accumulate(np.where(new, np.arange(len(gram)), 0))
    kept = (ranks < ranks[last][word]) | ((ranks == ranks[last][word]) & (nth < PLACES))
    return gram[kept], word[kept], place[kept]


def beside(place: np.ndarray, size: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Three pieces beside a bigram, of which the longer side makes two: begin, end, and whether before it."""
    rest = size - place - 2
    left = place >= rest
    first = np.where(left, place // 2, place)
    second = np.where(left, place, place + 2 + rest // 2)
    return [(np.zeros_like(place), first, np.ones_like(left)), (np.where(left, first, place + 2), second, left), (np.where(left, place + 2, second), size, np.zeros_like(left))]


def keys(words: list[str], gram: np.ndarray, word: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word, key and role of each bigram and piece beside it, for bigrams as ``rarest`` gives them.

    An edit that leaves a bigram alone lies in one piece, so what else there is
    has one hash in both words. Role 0: the word itself, to be compared with its
    like and with longer words; role 1: a word as one with a letter less.
    """
    letters = np.frombuffer("".join(words).encode("latin-1"), dtype=np.uint8).astype(np.uint64)
    size = np.array([len(w) for w in words], dtype=np.int64)
    begin, size = (np.cumsum(size) - size)[word], size[word]
    power, inverse = (np.cumprod(np.append(ONE, np.full(len(letters), b, dtype=np.uint64))) for b in BASES)
    sums = np.append(np.uint64(0), np.cumsum(letters * power[:-1]))

    def part(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (sums[stop] - sums[start]) * inverse[start]

    def key(x: np.ndarray, y: np.ndarray, at: np.ndarray, long: np.ndarray, q: int, more: int) -> np.ndarray:
        h = part(begin, begin + x) * MIX + part(begin + y + more, begin + size)
        for n in (gram, at, long, np.full_like(at, q)):
            h = (h ^ (h >> np.uint64(29))) * MIX + n.astype(np.uint64)
        return (h ^ (h >> np.uint64(32))).view(np.int64)

    rows = []
    for q, (x, y, _) in enumerate(beside(place, size)):
        rows.append((word, key(x, y, place, size, q, 0), np.zeros(len(word), dtype=np.int8)))
    for before in (True, False):
        at, long = place - before, size - 1
        for q, (x, y, left) in enumerate(beside(at, long)):
            ok = (at >= 0) & (at + 2 <= long) & (left == before)
            x, y = np.where(ok, x, 0), np.where(ok, y, 0)
            rows.append((word[ok], key(x, y, at, long, q, 1)[ok], np.ones(int(ok.sum()), dtype=np.int8)))
    return tuple(np.concatenate(c) for c in zip(*rows, strict=True))


def near_pairs(words: DataFrame) -> DataFrame:
    """Pairs (a, n_a, b, n_b) of distinct words of ``words(word, n)`` that are one edit apart, each once; ``words`` is a written table."""
    counts = bigram_counts(words)
    order = np.empty(1 << 16, dtype=np.int32)
    order[np.lexsort((np.arange(1 << 16), counts))] = np.arange(1 << 16)
    ranks = words.sparkSession.sparkContext.broadcast(order)

    def cut(batches):
        for b in batches:
            for first, some in _chunks(b.column(0)):
                word, key, role = keys(some, *rarest(ranks.value, some))
                rows = pa.array(word + first)
                size = np.array([len(w) for w in some], dtype=np.int32)[word]
                columns = [b.column(0).take(rows), b.column(1).take(rows), pa.array(key), pa.array(role), pa.array(size)]
                yield pa.RecordBatch.from_arrays(columns, ["word", "n", "key", "role", "size"])

    grams = save_table(words.select("word", "n").mapInArrow(cut, "word string, n long, key long, role byte, size int"), "spelling-grams")
    left = grams.where("role = 0").select(F.col("word").alias("a"), F.col("n").alias("n_a"), "key", F.col("size").alias("s"))
    right = grams.select(F.col("word").alias("b"), F.col("n").alias("n_b"), "key", "role", F.col("size").alias("t"))

    def met(of: str) -> DataFrame:
        pairs = left.where(f"s {of} {LONG_WORD}").join(right.where(f"t - role {of} {LONG_WORD}"), "key")
        return pairs.where((F.col("role") == 1) | (F.col("a") < F.col("b"))).select("a", "n_a", "b", "n_b")

    short = met("<=").where(F.levenshtein("a", "b", 1) == 1)

    def verify(batches):
        for b in batches:
            near = [one_edit(x, y) for x, y in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield b.filter(pa.array(near, pa.bool_()))

    long = met(">").mapInArrow(verify, "a string, n_a long, b string, n_b long")
    return short.unionByName(long).distinct()


def one_edit(a: str, b: str) -> bool:
    """Whether ``b`` has one letter more than ``a`` or another one in one place; in time that is linear in their lengths."""
    x, y = (np.frombuffer(w.encode("latin-1"), dtype=np.uint8) for w in (a, b))
    unlike = np.flatnonzero(x != y[: len(x)])
    if len(y) == len(x):
        return len(unlike) == 1
    at = unlike[0] if len(unlike) else len(x)
    return len(y) == len(x) + 1 and bool((x[at:] == y[at + 1 :]).all())


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for ``forms(word, form)``, a written table: where following forms ends.

    One round a level; counts grow tenfold from a word to its form, so there are
    few. A form has no more words than lie one edit from it.
    """
    ends = forms.select(F.col("form").alias("word")).distinct().join(forms, "word", "left_anti")
    known = save_table(ends.select("word", F.col("word").alias("root")), "spelling-roots")
    out = None
    while True:
        level = forms.join(known.select(F.col("word").alias("form"), "root"), "form").select("word", "root")
        known = save_table(level, "spelling-roots")
        if known.isEmpty():
            return out if out is not None else known
        out = known if out is None else out.unionByName(known)


def spelling_variants(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = 7, least_count: int = 2, times: int = 10, every: int = 31
) -> DataFrame:
    """The words of all texts with their near words: word, form, root, n, n_near, form_n.

    Words are runs of Latin letters, A-Z in lower case, of ``least_letters`` code
    points (at least four) and ``least_count`` occurrences or more; of runs whose
    checksum ``every`` divides, one letter is lost beforehand (0: of none). Two
    words are near if one inserted, deleted or replaced letter makes them equal.
    The form is the commonest near word (of equally common ones the first in
    code-point order) if it is at least ``times`` as common, else null; the root
    is where forms lead, the word itself without one. ``times`` must be above 1.

    Null texts have no words; null ids count as the empty text in checksums;
    repeated rows count again. Other columns are ignored. Tables without words
    give an empty result.
    """
    if least_letters < 4 or times <= 1:
        raise ValueError("least_letters must be at least 4 and times above 1")
    small_batches(docs.sparkSession)
    words = save_table(word_counts(docs, id_col, text_col, least_letters, every).where(F.col("n") >= least_count), "spelling-words")
    pairs = save_table(near_pairs(words), "spelling-pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("m"))
    both = both.unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("m")))
    best = F.min(F.struct((-F.col("m")).alias("less"), "other")).alias("best")
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), best)
    joined = words.join(near, "word", "left")
    takes = -F.col("best.less") >= times * F.col("n")
    named = save_table(
        joined.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(takes, F.col("best.other")).alias("form"), F.when(takes, -F.col("best.less")).alias("form_n")
        ),
        "spelling-forms",
    )
    forms = named.where("form is not null").select("word", "form")
    return named.join(roots(forms), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
