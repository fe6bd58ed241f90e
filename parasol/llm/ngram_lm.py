"""Language-model scores from a weighted backoff automaton over smoothed word n-grams.

Each n-gram's probability is smoothed with that of its shorter suffix, by a
prior of MASS observations: p(w | c) = (n(c w) + MASS p(w | c')) / (n(c) + MASS),
down to p(w) = (n(w) + 1) / (N + V + 1), whose last share is for unknown words.
Contexts become states. A state has an arc for every word seen after it, and a
failure arc, of weight MASS / (n(c) + MASS), to the state of its suffix; what a
text takes are always the same weights, so its probability sums to one. Contexts
of one word are all states, and so are longer ones. A caller who wants a smaller
model may name a ``share``: then longer contexts are states only if each of their
words has nine tenths of it in the whole corpus, by exact counts, so the model
depends on the corpus alone and not on how it was dealt to blocks.

Documents are packed into blocks, one row each. A block sends its distinct n-gram
hashes, with counts from its training documents, to shards of the hash space;
shards add them up over all blocks and send the counts back in the same order.
From them each block builds the automaton of just the n-grams that its texts can
take, and reads them from left to right. Counts cover the whole corpus, no task
holds more than a block or a shard, and nothing but N and V is broadcast.

There are as many shards as blocks, so messages are blocks squared. A block grows
with the square root of the corpus, so their number is in proportion to it, one
for every MESSAGE bytes of text: 6 MB to 36 GB of text, 320 MB at 100 TB.
"""

from __future__ import annotations

from math import isqrt

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from parasol.llm.common import fold, groups, release_memory, tokenize
from parasol.session import save_table, small_batches

ORDER, MASS = 3, 300.0
MODULUS, HELD_OUT = 7, 2
#: Bytes of text of a block at least, and of text for each message between a block and a shard.
BLOCK_BYTES, MESSAGE = 6 << 20, 1 << 10
#: Tokens that are read one after the other; longer texts are cut, each part starting from the state of the tokens before it.
SEGMENT = 512

_MIX = np.uint64(0x9E3779B97F4A7C15)
_END = 0


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


class Block:
    """The tokens of a block's texts by a numbering of its own, and its n-grams of every order.

    ``grams[k]`` are the distinct (k+1)-grams as a context's place among the
    k-grams (shifted by 32) and a word, sorted; ``hashes[k]`` their hashes,
    ``sent[k]`` the order in which they go to the shards, and ``live[k]``
    whether they are contexts of the model. ``common``: sorted hashes of the
    words of which longer contexts are made (default: all words).
    """

    def __init__(self, texts: pa.Array, order: int, common: np.ndarray | None = None) -> None:
        codes, lengths, words = tokenize(texts)
        self.order = order
        self.ends = np.cumsum(lengths + 1) - 1
        self.starts = self.ends - lengths
        self.tokens = np.zeros(len(codes) + len(lengths), dtype=np.int64)  # 0 is the end
        inner = np.ones(len(self.tokens), dtype=bool)
        inner[self.ends] = False
        self.tokens[inner] = codes + 1
        hashes = hash_words(words)
        # The end's hash is no word's: words are hashed as they are, the end as an empty one.
        first = np.append(np.uint64(xxhash.xxh3_64_intdigest(b"")), hashes)
        self.at = [self.tokens]  # of each token, the place of the k-gram that it ends; -1 if the block has none
        self.grams, self.hashes = [np.arange(len(first))], [_mix(first)]
        is_common = np.ones(len(first), dtype=bool) if common is None else np.isin(first, common)
        self.live = [np.ones(len(first), dtype=bool)]
        behind = np.arange(len(self.tokens)) - np.repeat(self.starts, lengths + 1)
        common_gram = is_common  # of k-grams: all their words are common
        for k in range(1, order):
            before = np.append(-1, self.at[k - 1][:-1].astype(np.int64))
            ok = (behind >= k) & (before >= 0)
            ok[ok] = self.live[k - 1][before[ok]]
            keys = before[ok] << 32 | self.tokens[ok]
            grams, place = np.unique(keys, return_inverse=True)
            at = np.full(len(self.tokens), -1, dtype=np.int32)
            at[ok] = place
            context, word = grams >> 32, grams & 0xFFFFFFFF
            common_gram = common_gram[context] & is_common[word]
            self.at.append(at)
            self.grams.append(grams)
            self.live.append(common_gram)
            self.hashes.append(_mix(self.hashes[k - 1][context] * _MIX + self.hashes[0][word]))
        self.sent = [np.argsort(h, kind="stable") for h in self.hashes]

    def counts(self, k: int, training: np.ndarray) -> np.ndarray:
        """How often training texts (a flag a text) have each (k+1)-gram."""
        used = np.repeat(training, self.ends - self.starts + 1) & (self.at[k] >= 0)
        return np.bincount(self.at[k][used], minlength=len(self.grams[k]))


def _press(data: bytes) -> bytes:
    return zstandard.compress(data, 1)


def _release(data: bytes) -> bytes:
    return zstandard.decompress(data)


def planes(values: np.ndarray) -> bytes:
    """The bytes of numbers, plane by plane, which compresses their common beginnings."""
    return _press(values.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes())


def unplanes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(_release(data), dtype=np.uint8).reshape(8, -1).T).view("<u8").ravel()


def gaps(hashes: np.ndarray) -> bytes:
    """Sorted hashes as the steps between them, whose high planes are nearly empty."""
    return planes(np.diff(hashes, prepend=np.uint64(0)))


def ungaps(data: bytes) -> np.ndarray:
    return np.cumsum(unplanes(data), dtype=np.uint64)


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Equal ranges of the hash space."""
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


class Automaton:
    """States, arcs and failure arcs of the n-grams of a block that the model has.

    State 0 knows nothing; then come the words, then longer contexts, each in
    the order of the block's n-grams. ``counts[k]`` are the corpus counts.
    """

    def __init__(self, block: Block, counts: list[np.ndarray], total: int, vocabulary: int, mass: float) -> None:
        order, grams = block.order, block.grams
        first = np.concatenate([[1], 1 + np.cumsum([len(g) for g in grams])])  # the state of the first n-gram of each order
        self.unknown = -np.log10(total + vocabulary + 1)
        p = (counts[0] + 1) / (total + vocabulary + 1)
        seen = counts[0] > 0
        keys, weights, to = [np.flatnonzero(seen)], [np.log10(p[seen])], [np.flatnonzero(seen) + 1 if order > 1 else np.zeros(seen.sum(), dtype=np.int64)]
        states = int(first[order - 1]) if order > 1 else 1
        self.fail_to, self.fail_weight = np.zeros(states, dtype=np.int64), np.zeros(states)
        suffix = np.zeros(len(p), dtype=np.int64)  # the place of each n-gram without its first word, one order lower
        for k in range(1, order):
            context, word = grams[k] >> 32, grams[k] & 0xFFFFFFFF
            lower = word if k == 1 else np.searchsorted(grams[k - 1], suffix[context] << 32 | word)
            here = counts[k - 1][context]
            p = (counts[k] + mass * p[lower]) / (here + mass)
            span = slice(first[k - 1], first[k])
            self.fail_weight[span] = np.where(block.live[k - 1], np.log10(mass / (counts[k - 1] + mass)), 0.0)
            self.fail_to[span] = 0 if k == 1 else suffix + first[k - 2]
            seen = counts[k] > 0
            keys.append((context[seen] + first[k - 1]) << 32 | word[seen])
            weights.append(np.log10(p[seen]))
            to.append((np.flatnonzero(seen) + first[k]) if k < order - 1 else lower[seen] + first[k - 1])
            suffix = lower
        # Words end in a state of their own only if the model goes on from them; the end never does.
        keys, weights, to = map(np.concatenate, (keys, weights, to))
        by = np.argsort(keys)
        self.keys, self.weights, self.to = np.append(keys[by], np.iinfo(np.int64).max), np.append(weights[by], 0.0), np.append(to[by], 0)

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Reads one word from each state: the states that follow and the log10 weights on the way."""
        weight, out = np.zeros(len(state)), np.zeros(len(state), dtype=np.int64)
        todo, at = np.arange(len(state)), state
        while len(todo):
            key = at << 32 | word[todo]
            place = np.searchsorted(self.keys, key)
            hit = self.keys[place] == key
            weight[todo[hit]] += self.weights[place[hit]]
            out[todo[hit]] = self.to[place[hit]]
            lost = ~hit & (at == 0)
            weight[todo[lost]] += self.unknown
            rest = ~hit & (at != 0)
            todo, at = todo[rest], at[rest]
            weight[todo] += self.fail_weight[at]
            at = self.fail_to[at]
        return out, weight

    def read(self, block: Block) -> np.ndarray:
        """The log10 probability of each text, read from left to right, all segments side by side."""
        lengths = block.ends - block.starts + 1
        parts = -(-lengths // SEGMENT)
        text = np.repeat(np.arange(len(lengths)), parts)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
        start = block.starts[text] + nth * SEGMENT
        size = np.minimum(SEGMENT, block.ends[text] + 1 - start)
        by = np.argsort(-size, kind="stable")  # those still being read come first
        start, size, text = start[by], size[by], text[by]
        state = np.zeros(len(start), dtype=np.int64)
        for back in range(block.order - 1, 0, -1):  # the state at a segment's start follows from the tokens just before it
            warm = start - back >= block.starts[text]
            state[warm], _ = self.step(state[warm], block.tokens[start[warm] - back])
        sums = np.zeros(len(start))
        live = np.searchsorted(-size, -np.arange(1, int(size.max()) + 1), side="right") if len(size) else []
        for t, n in enumerate(live):
            state[:n], weight = self.step(state[:n], block.tokens[start[:n] + t])
            sums[:n] += weight
        return np.bincount(text, weights=sums, minlength=len(lengths))


BLOCK_SCHEMA = "block long, size long, ids binary, training binary, lengths binary, texts binary"


def training_words(texts: pa.Array, training: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words (hash, count) of a block's training texts; hash 0: their ends."""
    used = texts.filter(pa.array(training))
    codes, _, words = tokenize(used)
    return np.append(np.uint64(0), hash_words(words)), np.append(len(used), np.bincount(codes, minlength=len(words)))


def pack_block(number: int, rows: list[tuple]) -> pa.RecordBatch:
    """One row for a block of (doc_id, training, text); a length of -1 stands for a null text, a flag of 2 for a null id."""
    ids, training, texts = zip(*rows, strict=True)
    flags = np.array([t + 2 * (i is None) for i, t in zip(ids, training, strict=True)], dtype=np.uint8)
    lengths = np.array([-1 if t is None else len(t) for t in texts], dtype="<i8")
    joined = zstandard.ZstdCompressor(level=9).compress(b"".join(t for t in texts if t))
    columns = [np.array([i or 0 for i in ids], dtype="<i8").tobytes(), flags.tobytes(), lengths.tobytes(), joined]
    size = int(lengths.clip(0).sum()) + 16 * len(rows)
    return pa.RecordBatch.from_arrays(
        [*(pa.array([x], pa.int64()) for x in (number, size)), *(pa.array([c], pa.binary()) for c in columns)],
        ["block", "size", "ids", "training", "lengths", "texts"],
    )


def unpack_blocks(rows):
    """(number, doc ids, training flags, texts) of each packed block."""
    for i in range(rows.num_rows):
        number, ids, flags, lengths, joined = (rows.column(c)[i].as_py() for c in ("block", "ids", "training", "lengths", "texts"))
        flags, lengths = np.frombuffer(flags, np.uint8), np.frombuffer(lengths, "<i8")
        whole, ends = zstandard.ZstdDecompressor().decompress(joined), np.cumsum(lengths.clip(0))
        offsets = np.append(0, ends).astype("<i4" if len(whole) < 1 << 31 else "<i8")
        kind = pa.BinaryArray if offsets.itemsize == 4 else pa.LargeBinaryArray
        texts = kind.from_buffers(pa.binary() if offsets.itemsize == 4 else pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(whole)])
        yield number, pa.array(np.frombuffer(ids, "<i8"), mask=(flags & 2) > 0), (flags & 1) > 0, texts


def ngram_scores(
    docs: DataFrame,
    order: int = ORDER,
    mass: float = MASS,
    share: float = 0.0,
    block_bytes: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are words (ASCII letters in lower case) and one end a text, so a null
    or empty text has one token. The model learns from the rows whose
    crc32(doc_id) mod 7 is not 2 (a null id's fold is that of the empty text);
    n_known counts tokens that it has seen. base_score is the log10 probability
    by single tokens, score the automaton's; with order 1 they agree. Null and
    repeated ids and repeated rows count as documents of their own. Other
    columns are ignored; an empty table gives an empty result.

    A text longer than a block makes a block of its own length. ``block_bytes``:
    text of a block; by default the larger of BLOCK_BYTES and the root of MESSAGE
    times the corpus. ``share``: if above 0, contexts of two and more words are
    those whose words each have nine tenths of it; by default they all are.
    """
    spark = docs.sparkSession
    small_batches(spark)
    if block_bytes is None:
        corpus = docs.agg(F.sum(F.octet_length(text_col).cast("long") + 16)).first()[0] or 0
        block_bytes = max(BLOCK_BYTES, isqrt(MESSAGE * int(corpus)))
    learns = fold(F.col(id_col).cast("long"), MODULUS) != HELD_OUT
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), learns.alias("training"), F.col(text_col).cast("binary").alias("text"))

    def gather(batches):
        base, held, size, n = TaskContext.get().partitionId() << 32, [], 0, 0
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.append(row)
                size += len(row[2] or b"") + 16
                if size >= block_bytes:
                    yield pack_block(base + n, held)
                    held, size, n = [], 0, n + 1
                    release_memory()
        if held:
            yield pack_block(base + n, held)

    # Written once, so that both passes below see the same blocks whatever the source does.
    packed = save_table(texts.mapInArrow(gather, BLOCK_SCHEMA), "lm-blocks", codec="none")
    shards = max(1, -(-int(packed.agg(F.sum("size")).first()[0] or 0) // block_bytes))

    def words(batches):
        for _, _, training, texts in (row for batch in batches for row in unpack_blocks(batch)):
            h, n = training_words(texts, training)
            yield pa.RecordBatch.from_arrays([pa.array(h.view("<i8")), pa.array(n)], ["h", "n"])

    common = None
    if share > 0 and order > 2:
        counted = save_table(packed.mapInArrow(words, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "lm-words")
        learnt = int(counted.agg(F.sum("n")).first()[0] or 0)
        frequent = counted.where((F.col("h") != 0) & (F.col("n") >= 0.9 * share * learnt))
        common = np.sort(frequent.select("h").toArrow().column(0).to_numpy().view(np.uint64))

    def send(batches):
        for block, _, training, texts in (row for batch in batches for row in unpack_blocks(batch)):
            b = Block(texts, order, common)
            for k in range(order):
                by = b.sent[k]
                hashes, counts = b.hashes[k][by], b.counts(k, training)[by]
                cuts = np.searchsorted(shard_of(hashes, shards), np.arange(shards + 1))
                used = np.flatnonzero(np.diff(cuts))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(used), block, dtype=np.int64)),
                        pa.array(used.astype(np.int32)),
                        pa.array(np.full(len(used), k, dtype=np.int32)),
                        pa.array([gaps(hashes[cuts[s] : cuts[s + 1]]) for s in used], pa.binary()),
                        pa.array([planes(counts[cuts[s] : cuts[s + 1]]) for s in used], pa.binary()),
                    ],
                    ["block", "shard", "k", "hashes", "counts"],
                )
            del b, hashes, counts
            release_memory()

    def merge(batches):
        """Adds up the counts of a shard; block -1: tokens and distinct tokens of its single tokens."""
        for t in groups(batches, ["shard", "k"]):
            parts = [ungaps(h.as_py()) for h in t.column("hashes")]
            sizes, hashes = [len(h) for h in parts], np.concatenate(parts)
            counts = np.concatenate([unplanes(c.as_py()) for c in t.column("counts")])
            distinct, inverse = np.unique(hashes, return_inverse=True)
            sums = np.bincount(inverse, weights=counts, minlength=len(distinct)).astype("<u8")
            cuts = np.append(0, np.cumsum(sizes))
            back = [planes(sums[inverse[i:j]]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
            shard, k, n = t.column("shard")[0].as_py(), t.column("k")[0].as_py(), len(sizes)
            block = t.column("block").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [pa.array([*block, -1], pa.int64()), pa.array([shard] * (n + 1), pa.int32()), pa.array([k] * (n + 1), pa.int32()), pa.array([*back, None], pa.binary()), pa.array([None] * n + [int(sums.sum())], pa.int64()), pa.array([None] * n + [int((sums > 0).sum())], pa.int64())],
                ["block", "shard", "k", "sums", "tokens", "words"],
            )

    sent = packed.mapInArrow(send, "block long, shard int, k int, hashes binary, counts binary")
    answers = _dealt(sent, ["shard", "k"], shards, by=["shard"]).mapInArrow(merge, "block long, shard int, k int, sums binary, tokens long, words long")
    answers = save_table(answers, "lm-counts")
    total, vocabulary = (int(x or 0) for x in answers.where("block = -1 and k = 0").agg(F.sum("tokens"), F.sum("words")).first())

    # A block's counts come before its texts, in the order of order and shard.
    none = F.lit(None).cast("binary")
    first = answers.where("block >= 0").select("block", "k", "shard", "sums", none.alias("ids"), none.alias("training"), none.alias("lengths"), none.alias("texts"))
    last = packed.select("block", F.lit(order).alias("k"), F.lit(0).alias("shard"), none.alias("sums"), "ids", "training", "lengths", "texts")

    def read(batches):
        for t in groups(batches, ["block"]):
            k = t.column("k").to_numpy()
            _, ids, training, texts = next(unpack_blocks(t.slice(int((k < order).sum()))))
            b = Block(texts, order, common)
            counts = []
            for n in range(order):
                # A block of texts without words has no longer n-grams.
                back = [np.zeros(0, dtype="<u8"), *map(unplanes, t.filter(pa.array(k == n)).column("sums").to_pylist())]
                got = np.zeros(len(b.grams[n]), dtype=np.int64)
                got[b.sent[n]] = np.concatenate(back).astype(np.int64)
                counts.append(got)
            scores = Automaton(b, counts, total, vocabulary, mass).read(b)
            single = np.log10((counts[0] + 1) / (total + vocabulary + 1))
            sizes = b.ends - b.starts + 1
            base = np.add.reduceat(single[b.tokens], b.starts)
            known = np.add.reduceat((counts[0] > 0)[b.tokens].astype(np.int64), b.starts)
            train = np.full(len(sizes), total)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(~training), *map(pa.array, (sizes, known, train, base, scores))],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )
            del t, b, counts, got, scores, texts
            release_memory()

    both = _dealt(first.unionByName(last), ["block", "k", "shard"], shards, by=["block"])
    return both.mapInArrow(read, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _dealt(rows: DataFrame, keys: list[str], parts: int, by: list[str] | None = None) -> DataFrame:
    """Brings rows of equal ``by`` (default: keys) together, sorted by ``keys``; as many partitions as there are blocks, evenly."""
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(least, parts), *(by or keys)).sortWithinPartitions(*keys)
