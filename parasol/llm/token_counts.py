"""Token counts of whole texts by the whole-token shortcut.

Offline, on the driver and once, every vocabulary string is encoded on its own;
those that come out as their own single id form the set of whole tokens, so a
pre-token found in it counts one without a merge. The set is as large as the
vocabulary at most and is broadcast. Only the rest is merged, by the library.
Texts are cut at spaces that no pre-token can cross, and the count of each
distinct piece is kept.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from parasol.llm.bpe import CACHE_ENTRIES, PATTERN, Cache, Vocabulary, letters, split
from parasol.session import small_batches


class Counter:
    """Counts tokens as the library of the file at ``path`` gives them, without added begin or end tokens.

    ``.json`` files are of the tokenizers library, ``.model`` files of
    sentencepiece. The shortcut holds for byte-level merge files; others are
    counted by their library.
    """

    def __init__(self, path: str, whole: frozenset[str] | None = None) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_file=path) if path.endswith(".model") else None
        self.vocabulary = None if self.model else Vocabulary(path)
        self.split = regex.compile(PATTERN).findall
        self.whole = whole_tokens(path) if whole is None else whole
        self.rest = Cache(lambda pre: len(self.vocabulary.whole(pre)))
        self.counts = Cache(lambda word: self.piece(" " + word))

    def piece(self, text: str) -> int:
        """The tokens of a text or of a piece cut at a space."""
        whole, rest = self.whole, self.rest
        return sum(1 if pre in whole else rest[pre] for pre in self.split(text))

    def count(self, text: str | None) -> int:
        """The tokens of ``text``; null and the empty text have none."""
        if not text:
            return 0
        if self.model:
            return len(self.model.encode(text))
        if not self.vocabulary.local:
            return len(self.vocabulary.whole(text))
        if self.vocabulary.has_special(text):
            return len(self.vocabulary.whole(text))
        if len(self.counts) > CACHE_ENTRIES or len(self.rest) > CACHE_ENTRIES:
            self.counts.clear()
            self.rest.clear()
        first, words = split(text)
        return self.piece(first) + sum(map(self.counts.__getitem__, words))


@lru_cache(maxsize=4)
def whole_tokens(path: str) -> frozenset[str]:
    """The vocabulary strings that are one pre-token and that the library encodes as their own single id."""
    vocabulary = None if path.endswith(".model") else Vocabulary(path)
    if not vocabulary or not vocabulary.local:
        return frozenset()
    split_up, byte, strings = regex.compile(PATTERN).findall, {c: b for b, c in letters().items()}, {}
    for token, number in vocabulary.tokenizer.get_vocab(with_added_tokens=False).items():
        try:
            text = bytes(byte[c] for c in token).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        if split_up(text) == [text] and not vocabulary.has_special(text):
            strings[text] = number
    encoded = vocabulary.each(list(strings))
    return frozenset(t for (t, number), ids in zip(strings.items(), encoded, strict=True) if ids == [number])


@lru_cache(maxsize=4)
def counter(path: str, whole: frozenset[str] | None = None) -> Counter:
    """One counter a worker process, so that its tables last over tasks."""
    return Counter(path, whole)


def token_counts(docs: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    A null text counts as empty: 0 bytes, 0 tokens. Null and repeated ids pass
    through, one row each. Other columns of ``docs`` are ignored. An empty table
    gives an empty result. One pass, no shuffle; texts are never cut.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long").alias("n_bytes"),
        F.col(text_col).alias("text"),
    )

    whole = docs.sparkSession.sparkContext.broadcast(whole_tokens(path))

    def count(batches):
        of = counter(path, whole.value).count
        for b in batches:
            n = pa.array([of(t) for t in b.column(2).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), n], ["doc_id", "n_bytes", "n_tokens"])

    counted = rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
