"""Token ids of whole texts, equal to those of the tokenizers library, at a fraction of its cost.

A byte-level file whose merge results are numbered in the order of the merges
says the same as a table of ranks, and a rank merger needs no offsets or
normalised copies. ``ranks`` proves this for the file at hand; other files, and
texts that hold an added token's string, go to the library as they are. The
library itself, even when it gets each distinct word once, takes three times the
CPU seconds, more than the budget of the operators that write ids.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache

import numpy as np
import tiktoken
from tokenizers import Tokenizer

# One task has one core; the library must not start threads of its own.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Distinct pieces that a Python worker remembers before it starts anew.
CACHE_ENTRIES = 400_000
#: The pre-tokenizer's pattern of byte-level vocabularies, and the bytes that stand for themselves.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
#: White space of Latin-1 other than the space and the line feed.
_ODD = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"
_RUN = re.compile(r"[^\S ] | \s")


class Cache(dict):
    """Calls ``fill`` for keys that it does not hold yet."""

    def __init__(self, fill) -> None:
        super().__init__()
        self.fill = fill

    def __missing__(self, key):
        value = self[key] = self.fill(key)
        return value


class Vocabulary:
    """The file at ``path``: the library's tokenizer, the same merges as ranks if they agree, and whether texts may be cut at spaces (``local``)."""

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.spec = json.load(f)
        self.special = [t["content"] for t in self.spec.get("added_tokens", [])]
        self.local = cuts_at_spaces(self.spec)

    def whole(self, text: str) -> list[int]:
        """The ids of a text by the library itself."""
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def each(self, texts: list[str]) -> list[list[int]]:
        """The ids of several texts."""
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def has_special(self, text: str) -> bool:
        return any(s in text for s in self.special)


class Encoder:
    """Encodes with the file at ``path``; ids are held as little-endian bytes of ``dtype``."""

    def __init__(self, path: str) -> None:
        self.vocabulary = Vocabulary(path)
        self.code = "H" if self.vocabulary.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.dtype = np.dtype("<u2" if self.code == "H" else "<u4")
        table = ranks(self.vocabulary.spec)
        self.merge = table and tiktoken.Encoding("byte_level", pat_str=PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary

    def packed(self, texts: list[str | None], end: int | None = None) -> list[bytes]:
        """The ids of each text (null: empty), then ``end`` if given, as bytes of ``self.dtype``."""
        v, last = self.vocabulary, [] if end is None else [end]
        ids = ((self.merge(t) if self.merge and not v.has_special(t) else v.whole(t)) if t else [] for t in texts)
        return [array(self.code, x + last).tobytes() for x in ids]

    def ids(self, text: str | None, end: int | None = None) -> np.ndarray:
        return np.frombuffer(self.packed([text], end)[0], dtype=self.dtype)


def split(text: str) -> tuple[str, list[str]]:
    """The first piece of ``text`` and the others, each without the space that it begins with."""
    words = spaced(text)
    if words is None:
        words = pieces(text)
        return words[0], [w[1:] for w in words[1:]]
    return words[0], words[1:]


def spaced(text: str) -> list[str] | None:
    """``text`` split at its spaces; None if a space has white space beside it."""
    if "  " in text or " \n" in text or "\n " in text:
        return None
    if not text.isascii():
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return None if _RUN.search(text) else text.split(" ")
    if any(c in text for c in _ODD) and _RUN.search(text):
        return None
    return text.split(" ")


def pieces(text: str) -> list[str]:
    """Splits before each single space between other characters; the pieces join to ``text``."""
    words = text.split(" ")
    out, held = [], words[0]
    for w in words[1:]:
        if w and not w[0].isspace() and held and not held[-1].isspace():
            out.append(held)
            held = " " + w
        else:
            held += " " + w
    out.append(held)
    return out


def letters() -> dict[int, str]:
    """The letter that stands for each byte: itself if printable, else the next free one from U+0100."""
    free = iter(range(0x100, 0x200))
    return {b: chr(b) if b in PRINTABLE else chr(next(free)) for b in range(0x100)}


def cuts_at_spaces(spec: dict) -> bool:
    """Whether the file has a byte-level pre-tokenizer with the usual pattern and no prefix space, no normaliser, and plain added tokens."""
    pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    odd = any(t.get(k) for t in spec.get("added_tokens", []) for k in ("lstrip", "rstrip", "single_word"))
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))
    return plain and not odd and not spec.get("normalizer") and pre.get("type") == "ByteLevel" and bool(pre.get("use_regex")) and not pre.get("add_prefix_space")


def ranks(spec: dict) -> dict[bytes, int] | None:
    """Token bytes by id if merging by lowest id is what the file's merge list says; else None.

    Besides ``cuts_at_spaces`` this needs merge results whose ids ascend in the
    order of the merges, after the single bytes.
    """
    model = spec.get("model") or {}
    if not cuts_at_spaces(spec) or any(model.get(k) for k in ("unk_token", "byte_fallback", "ignore_merges")):
        return None
    vocab, byte = model["vocab"], {c: b for b, c in letters().items()}
    merged = [vocab.get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    singles = [vocab.get(c) for c in byte]
    if None in merged or None in singles or merged != sorted(merged) or merged[0] <= max(singles):
        return None
    added = {t["content"] for t in spec.get("added_tokens", [])}
    if len(merged) + len(singles) != len(vocab.keys() - added) or len({*merged}) != len(merged):
        return None
    return {bytes(byte[c] for c in t): i for t, i in vocab.items() if t not in added}


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder a worker process, so that its cache lasts over tasks."""
    return Encoder(path)
