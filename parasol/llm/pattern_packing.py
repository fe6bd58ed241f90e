"""Best-fit packing by length patterns whose repeat counts are fitted by non-negative least squares.

A training sequence holds whole documents; only documents longer than a sequence
are cut. How often each length occurs is all that the plan depends on. Patterns
of two or three lengths that fill a sequence exactly are enumerated, their repeat
counts are fitted to the histogram, and rounded so that no length is used more
often than it occurs. What is left is packed by best fit on the histogram, not
on documents, so planning costs the same at every size of the corpus. Documents
then take the places of their length by rank: a task numbers what it reads, and
sums over tasks make its numbers global.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from bisect import bisect_left, insort
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from tokenizers import Tokenizer

from parasol.llm.bpe import CACHE_ENTRIES, letters
from parasol.session import save_table, small_batches

#: Patterns that are fitted at most. With more, smallest parts are taken at even distances, so that the plan stays bounded.
MOST_PATTERNS = 400_000
#: Steps of the fit; each costs a few milliseconds.
FIT_STEPS = 250
#: A rank has fewer bits than this, a length fewer than 15.
RANK_BITS = 48
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"
#: Fixed value: the pattern of word-end vocabularies' pre-tokenizer, no part of which matches white space.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Marks between a letter and a space or the end are a piece of their own, so they may stand apart, which leaves fewer distinct words.
MARK = re.compile(r"(?<=[A-Za-zß-öø-ÿ])([!-&(-/:-@\[-`{-~]+)(?: |\Z)")

#: Words that lower case and composition leave one run of letters, each of one or two bytes.
LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
SUFFIX = "</w>"


class WordEncoder:
    """Ids of whole texts as the library gives them, from the remembered ids of their words.

    Where the file says that no token, composition or normalisation reaches over
    white space, a text is cut at spaces and line feeds, and the ids of distinct
    words are remembered; those unused for long are forgotten. New words of Latin letters are merged by
    ranks if these say the same as the file (``letter_ranks``). Texts with added tokens, and texts of other
    files, go to the library whole. Ids are little-endian unsigned 32-bit.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.local = words_apart(spec)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        table = letter_ranks(spec) if self.local else None
        self.merge = table and tiktoken.Encoding("letters", pat_str="(?s).+", mergeable_ranks=table, special_tokens={}).encode_ordinary

    def words(self, new: list[str]) -> list[bytes]:
        """The ids of each word (a text without white space)."""
        if not self.merge:
            return self.ids(new)
        merge, fits = self.merge, LETTERS.fullmatch
        out = [array("I", merge(coded(w))).tobytes() if fits(w) else None for w in new]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(rest, self.ids([new[i] for i in rest]), strict=True):
            out[i] = x
        return out

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text (or word), by the library."""
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def packed(self, text: str | None, end: bytes = b"") -> bytes:
        """The ids of a text (null: none), then ``end``."""
        if not text:
            return end
        if not self.local or any(s in text for s in self.special):
            return self.ids([text])[0] + end
        words = MARK.sub(r" \1 ", text.replace("\n", " ")).split(" ")
        if len(self.known) > CACHE_ENTRIES // 2:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        try:
            return b"".join([known[w] for w in words]) + end
        except KeyError:
            new = [w for w in {*words} if w not in known]
        known.update((w, older[w]) for w in new if w in older)
        new = [w for w in new if w not in older]
        known.update(zip(new, self.words(new), strict=True))
        return b"".join([known[w] for w in words]) + end


def words_apart(spec: dict) -> bool:
    """Whether the file's ids of a text are those of its words between spaces and line feeds, one after the other."""
    normalizers = (spec.get("normalizer") or {}).get("normalizers", [])
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    if [n["type"] for n in normalizers] != ["NFC", "Replace", "Lowercase"] or [s["type"] for s in steps] != ["Split", "ByteLevel"]:
        return False
    spaces, (cut, byte) = normalizers[1], steps
    odd = any(t.get(k) for t in spec.get("added_tokens", []) for k in ("lstrip", "rstrip", "single_word", "normalized"))
    return (
        not odd
        and (spaces["pattern"], spaces["content"]) == ({"Regex": r"\s+"}, " ")
        and (cut["pattern"], cut["behavior"], cut["invert"]) == ({"Regex": WORD_PATTERN}, "Removed", True)
        and not (byte["add_prefix_space"] or byte["use_regex"])
        and spec["model"]["type"] == "BPE"
        and not spec["model"].get("dropout")
    )


def _codes() -> tuple[dict[int, str], dict[int, str]]:
    """An ASCII character for each byte of small letters up to U+00FF, inside a word and at its end."""
    free = iter([chr(c) for c in range(128) if not chr(c).isalpha()])
    small = range(ord("a"), ord("z") + 1)
    inside = {b: chr(b) for b in small} | {b: next(free) for b in (0xC3, *range(0x9F, 0xC0))}
    return inside, {b: chr(b).upper() for b in small} | {b: next(free) for b in range(0x9F, 0xC0)}


_INSIDE, _LAST = _codes()
_AT_START = {c: "".join(_INSIDE[b] for b in chr(c).encode()) for c in range(0xDF, 0x100)}
_AT_END = {chr(b): c for b, c in _LAST.items() if b < 0x80} | {chr(c): _INSIDE[0xC3] + _LAST[chr(c).encode()[1]] for c in range(0xDF, 0x100)}


def coded(word: str) -> str:
    """A word of LETTERS in lower case, one character a byte, the last one marked."""
    word = word.lower()
    head = word[:-1]
    return (head if head.isascii() else head.translate(_AT_START)) + _AT_END[word[-1]]


def letter_ranks(spec: dict) -> dict[bytes, int] | None:
    """Ids of the file's tokens of small letters, ``coded``, if merging by lowest id is what its merge list says; else None.

    Results of merges must ascend after the single bytes, and each token must be
    what the list makes of its own bytes. Then no other two neighbours ever
    join to it: within its ends, merges went as they go on it alone.
    """
    model = spec["model"]
    if any(model.get(k) for k in ("unk_token", "byte_fallback", "ignore_merges", "continuing_subword_prefix")) or model.get("end_of_word_suffix") != SUFFIX:
        return None
    vocab, byte = model["vocab"], {c: b for b, c in letters().items()}
    pairs = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    merged = [vocab.get("".join(p)) for p in pairs]
    singles = [vocab.get(c + end) for c in byte for end in ("", SUFFIX)]
    if not merged or None in merged or None in singles or merged != sorted({*merged}) or merged[0] <= max(singles):
        return None
    if len(merged) + len(singles) != len(vocab.keys() - {t["content"] for t in spec.get("added_tokens", [])}):
        return None

    def code(token: str) -> str | None:
        body, end = (token[: -len(SUFFIX)], True) if token.endswith(SUFFIX) and token != SUFFIX else (token, False)
        raw = [byte.get(c) for c in body]
        out = [_INSIDE.get(b) for b in raw[:-1]] + [(_LAST if end else _INSIDE).get(raw[-1])]
        return None if None in out else "".join(out)

    table = {c: vocab[t] for t in vocab if (c := code(t)) is not None}
    rank = {(code(a), code(b)): i for (a, b), i in zip(pairs, merged, strict=True) if code(a + b) in table}
    first = min(merged)
    for token, own in table.items():
        parts = list(token)
        while len(parts) > 1:
            best, at = min((rank.get(p, own + 1), i) for i, p in enumerate(zip(parts, parts[1:], strict=False)))
            if best > own:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if own < first and len(token) > 1:
            return None
    return {t.encode(): i for t, i in table.items()}


@lru_cache(maxsize=4)
def word_encoder(path: str) -> WordEncoder:
    """One encoder a worker process, so that its words last over tasks."""
    return WordEncoder(path)


def patterns(present: np.ndarray, limit: int, most: int = MOST_PATTERNS) -> np.ndarray:
    """Rows of three lengths that add up to ``limit``, ascending, 0 for none; only lengths that are ``present``."""
    small = np.arange(1, limit // 2 + 1)
    pairs = np.stack([np.zeros_like(small), small, limit - small], axis=1)
    pairs = pairs[present[pairs[:, 1]] & present[pairs[:, 2]]]
    firsts = np.flatnonzero(present[: limit // 3 + 1])
    firsts = firsts[firsts > 0]
    seconds = sum(max((limit - a) // 2 - a + 1, 0) for a in firsts.tolist())
    firsts = firsts[:: max(-(-seconds // most), 1)]
    triples = [pairs]
    for a in firsts.tolist():
        b = np.arange(a, (limit - a) // 2 + 1)
        b = b[present[b] & present[limit - a - b]]
        triples.append(np.stack([np.full_like(b, a), b, limit - a - b], axis=1))
    return np.concatenate(triples)


def fit(shapes: np.ndarray, histogram: np.ndarray, steps: int = FIT_STEPS) -> np.ndarray:
    """Repeat counts x >= 0 of the patterns that bring their lengths' sums nearest to the histogram.

    Least squares weighted by length, since a long document that is left over
    costs most. Accelerated projected gradient steps; the matrix has three ones
    a row and is never made.
    """
    size = len(histogram)
    weight = np.arange(size) / (size - 1)
    weight[0] = 0.0
    columns = [np.ascontiguousarray(c) for c in shapes.T]

    def sums(x: np.ndarray) -> np.ndarray:
        return sum(np.bincount(c, x, size) for c in columns)

    def back(r: np.ndarray) -> np.ndarray:
        return sum(r[c] for c in columns)

    v = np.ones(len(shapes))
    for _ in range(12):  # the largest eigenvalue, by powers
        v = back(weight * sums(v))
        v /= np.linalg.norm(v)
    rate = 1.0 / (1.05 * np.linalg.norm(back(weight * sums(v))))
    x, y, t, last = np.zeros(len(shapes)), np.zeros(len(shapes)), 1.0, np.inf
    for _ in range(steps):
        r = sums(y) - histogram
        new = np.maximum(y - rate * back(weight * r), 0.0)
        loss = float((weight * r * r).sum())
        if loss > last:
            t, y = 1.0, x
            last = np.inf
            continue
        after = (1.0 + (1.0 + 4.0 * t * t) ** 0.5) / 2.0
        y, x, t, last = new + (t - 1.0) / after * (new - x), new, after, loss
    return x


def rounded(shapes: np.ndarray, x: np.ndarray, left: np.ndarray) -> list[tuple[tuple, int]]:
    """Whole repeat counts; what a count loses is carried to the next one, and none takes more than is ``left``, which is reduced."""
    whole = np.diff(np.floor(np.append(0.0, np.cumsum(x)) + 0.5)).astype(np.int64)
    out = []
    for i in np.flatnonzero(whole).tolist():
        need: dict[int, int] = {}
        for length in shapes[i].tolist():
            if length:
                need[length] = need.get(length, 0) + 1
        n = min(int(whole[i]), *(int(left[length]) // k for length, k in need.items()))
        if n > 0:
            for length, k in need.items():
                left[length] -= n * k
            out.append((tuple(sorted(need.items(), reverse=True)), n))
    return out


def best_fit(left: np.ndarray) -> list[tuple[tuple, int]]:
    """Best fit from the longest length down, on counts: sequences with one content are one row (content, count)."""
    limit = len(left) - 1
    rooms: list[int] = []
    at: dict[int, list[tuple[tuple, int]]] = {}

    def put(room: int, content: tuple, n: int) -> None:
        if room not in at:
            at[room] = []
            insort(rooms, room)
        at[room].append((content, n))

    for length in np.flatnonzero(left)[::-1].tolist():
        count = int(left[length])
        while count:
            i = bisect_left(rooms, length)
            if i == len(rooms):
                room, content, n = limit, (), count
            else:
                room = rooms[i]
                content, n = at[room].pop()
                if not at[room]:
                    del at[room], rooms[i]
            each = min(room // length, count)
            used = min(n, count // each)
            if content and n > used:
                put(room, content, n - used)
            put(room - each * length, (*content, (length, each)), used)
            count -= used * each
    return [row for room in rooms for row in at[room]]


def plan(histogram: np.ndarray) -> list[tuple[tuple, int]]:
    """Contents ((length, how many), ...) and how many sequences have each; together they hold the histogram exactly."""
    left = histogram.astype(np.int64).copy()
    limit = len(left) - 1
    full = [(((limit, 1),), int(left[limit]))] if left[limit] else []
    left[limit] = 0
    shapes = patterns(left > 0, limit)
    fitted = rounded(shapes, fit(shapes, left.astype(np.float64)), left) if len(shapes) else []
    return full + fitted + best_fit(left)


def places(contents: list[tuple[tuple, int]]) -> np.ndarray:
    """Rows (length and first rank in one number, how many a sequence has, first sequence, offset), ascending.

    A document of that length and of a rank from the first on lies in the sequence that many further on.
    """
    rows, ranks, sequence = [], {}, 0
    for content, n in contents:
        offset = 0
        for length, each in content:
            rank = ranks.get(length, 0)
            rows.append(((length << RANK_BITS) + rank, each, sequence, offset))
            ranks[length] = rank + n * each
            offset += length * each
        sequence += n
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)


def pack_patterns(docs: DataFrame, path: str, end_id: int, max_tokens: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs every text of ``docs``, with ``end_id`` after it, into few sequences of at most ``max_tokens``; one row a piece.

    Columns: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Null
    texts are empty, so the document is ``end_id`` alone. Null and repeated ids
    are packed as documents of their own. Other columns are ignored; an empty
    table gives an empty result.

    Texts are encoded once, into a table of pieces. The driver sees one count a
    length, and broadcasts a plan whose size depends on ``max_tokens`` alone.
    Of one length, however common, each task holds what it read; the shuffle
    is by task and length.
    """
    if not 2 <= max_tokens < 1 << 15:
        raise ValueError("max_tokens must lie between 2 and 32767")
    spark = docs.sparkSession
    small_batches(spark)
    end = np.array([end_id], dtype="<u4").tobytes()
    names = [c.split()[0] for c in PIECES.split(", ")]

    def cut(batches):
        encode, part, seen = word_encoder(path).packed, TaskContext.get().partitionId(), [0] * (max_tokens + 1)
        for b in batches:
            out = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = memoryview(encode(text, end))
                for piece, at in enumerate(range(0, len(ids) // 4, max_tokens)):
                    own = ids[4 * at : 4 * (at + max_tokens)]
                    length = len(own) // 4
                    out.append((doc_id, piece, at, length, zlib.crc32(own), part, seen[length]))
                    seen[length] += 1
            columns = zip(*out, strict=True) if out else [[] for _ in names]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = save_table(rows.mapInArrow(cut, PIECES), "pattern-pieces")
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = np.zeros(max_tokens + 1, dtype=np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("n")).collect():  # one row a length
        histogram[length] = n
    table = spark.sparkContext.broadcast(places(plan(histogram)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = pieces.join(starts, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))

    def place(batches):
        keys, each, first, offset = table.value.T
        for b in batches:
            length, rank = (b.column(i).to_numpy() for i in (3, 5))
            i = np.searchsorted(keys, (length << RANK_BITS) + rank, side="right") - 1
            nth = rank - (keys[i] & ((1 << RANK_BITS) - 1))
            sequence, place_in = first[i] + nth // each[i], offset[i] + nth % each[i] * length
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(place_in)], out_names)

    out_names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
