"""Binary token shards: one concatenated id array a shard, with Elias-Fano coded document boundaries.

A shard is a byte string in the format below, and a dataset is a Parquet table
whose rows carry one shard each. Spark's commit protocol makes the write safe
against lost executors, and any store that Spark reads will do.

Shard, little-endian:

====================  =====================================================
``PTSHARD2``          8 bytes
width                 u8: bytes an id; 7 zero bytes
n_docs, n_ids         two u64
n_null, least         u64, i64: documents without id, which come first; the least id
doc ids               sequence of the others' ids less ``least``, ascending
boundaries            sequence of the starts of the documents
ids                   n_ids unsigned integers of ``width`` bytes
====================  =====================================================

A sequence of ascending integers is in Elias-Fano form: u64 n and universe, then

====================  =====================================================
``low``               the low bits of each value, ceil(n * low_bits / 8) bytes
``high``              the upper parts in unary, ceil((n + (universe >> low_bits) + 1) / 8) bytes
``places``            u32 position in ``high`` of every STEP-th one
====================  =====================================================

where low_bits = floor(log2(universe / n)). Value i is ``select(i)``: the
position of the i-th one, less i, shifted, plus its low bits. ``places`` says
where to begin to look, so a select reads a few hundred bytes at most on average
and no table of values is ever built. That is about ``2 + log2(universe / n)``
bits a value instead of 64.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from parasol.llm.bpe import encoder
from parasol.session import drop_table, save_table, small_batches

MAGIC = b"PTSHARD2"
_HEAD = struct.Struct("<8sB7xQQQq")
_SEQUENCE = struct.Struct("<QQ")
#: A shard is closed when it holds so many ids or documents; a longer document gets a shard of its own length.
SHARD_IDS, SHARD_DOCS = 1 << 21, 1 << 17
SCHEMA = "part int, seq int, part_offset long, n_docs long, n_ids long, shard binary"


class EliasFano:
    """An ascending sequence of integers of 0..universe."""

    #: Ones between two remembered positions of the select structure.
    STEP = 512

    def __init__(self, n: int, universe: int, low: np.ndarray, high: np.ndarray, places: np.ndarray) -> None:
        self.n, self.universe, self.low, self.high, self.places = n, universe, low, high, places
        self.low_bits = self.low_bits_for(n, universe)

    @staticmethod
    def low_bits_for(n: int, universe: int) -> int:
        return max(0, (universe // n).bit_length() - 1) if n else 0

    @classmethod
    def encode(cls, values: np.ndarray, universe: int) -> EliasFano:
        n, k = len(values), cls.low_bits_for(len(values), universe)
        values = values.astype(np.int64)
        ones = (values >> k) + np.arange(n)
        bits = np.zeros(n + (universe >> k) + 1, dtype=np.uint8)
        bits[ones] = 1
        # Pieces of a multiple of 8 values fill whole bytes, so that they join; they bound the bits that are spread out at a time.
        parts = [np.packbits((values[i : i + 8192, None] >> np.arange(k) & 1).astype(np.uint8).ravel(), bitorder="little") for i in range(0, n, 8192)]
        low = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
        return cls(n, universe, low, np.packbits(bits, bitorder="little"), ones[:: cls.STEP].astype("<u4"))

    def to_bytes(self) -> bytes:
        return b"".join((_SEQUENCE.pack(self.n, self.universe), self.low.tobytes(), self.high.tobytes(), self.places.astype("<u4").tobytes()))

    @classmethod
    def at(cls, data, offset: int) -> tuple[EliasFano, int]:
        """The sequence that lies at ``offset`` of a buffer, as views of it, and where it ends."""
        n, universe = _SEQUENCE.unpack_from(data, offset)
        k, offset, parts = cls.low_bits_for(n, universe), offset + _SEQUENCE.size, []
        for count, dtype in (((n * k + 7) // 8, "u1"), ((n + (universe >> k) + 1 + 7) // 8, "u1"), (-(-n // cls.STEP), "<u4")):
            parts.append(np.frombuffer(data, dtype=dtype, count=count, offset=offset))
            offset += parts[-1].nbytes
        return cls(n, universe, *parts), offset

    def _low(self, first: int, last: int) -> np.ndarray:
        """The low bits of the values first..last-1."""
        k = self.low_bits
        begin = first * k >> 3
        bits = np.unpackbits(self.low[begin : (last * k + 7) >> 3], bitorder="little")[first * k - 8 * begin :][: (last - first) * k]
        return bits.reshape(last - first, k).astype(np.int64) @ (np.int64(1) << np.arange(k, dtype=np.int64))

    def _ones(self, first: int, last: int) -> np.ndarray:
        """Positions of the ones number first..last-1, which lie between two remembered ones."""
        block = first // self.STEP
        at = int(self.places[block])
        end = int(self.places[block + 1]) if block + 1 < len(self.places) else 8 * len(self.high)
        begin, skip, want = at >> 3, first - block * self.STEP, last - block * self.STEP
        found, seen = [], 0
        while seen < want:  # a stretch without ones may be long: read on in pieces
            piece = np.flatnonzero(np.unpackbits(self.high[begin : begin + 4096], bitorder="little")) + 8 * begin
            piece = piece[(piece >= at) & (piece <= end)]
            found.append(piece)
            seen, begin = seen + len(piece), begin + 4096
        return np.concatenate(found)[skip:want]

    def select(self, first: int, last: int | None = None) -> np.ndarray | int:
        """The value number ``first``, or the values first..last-1, one block of the select structure at a time."""
        if not 0 <= first < self.n or (last is not None and not first <= last <= self.n):
            raise IndexError(first)
        stop, out = first + 1 if last is None else last, []
        while first < stop:
            upto = min(stop, (first // self.STEP + 1) * self.STEP)
            out.append(((self._ones(first, upto) - np.arange(first, upto)) << self.low_bits) + self._low(first, upto))
            first = upto
        return int(out[0][0]) if last is None else np.concatenate([np.zeros(0, np.int64), *out])


def pack_shard(doc_ids: list[int | None], lengths: list[int], ids: bytes, width: int) -> bytes:
    """A shard of documents in ascending order of ids, nulls first."""
    lengths = np.array(lengths, dtype=np.int64)
    starts, total = np.cumsum(lengths) - lengths, int(lengths.sum())
    known = [d for d in doc_ids if d is not None]
    least = known[0] if known else 0
    head = _HEAD.pack(MAGIC, width, len(lengths), total, len(lengths) - len(known), least)
    numbers = np.array([d - least for d in known], dtype=np.uint64)
    if len(numbers) and int(numbers[-1]) >> 62:
        raise ValueError("document ids of one shard must lie within 2**62 of each other")
    named = EliasFano.encode(numbers, int(numbers[-1]) if len(numbers) else 0)
    return b"".join((head, named.to_bytes(), EliasFano.encode(starts, total).to_bytes(), ids))


class Shard:
    """Reads a shard; boundaries and ids of documents come from selects, the token ids are a view."""

    def __init__(self, data) -> None:
        magic, width, self.n_docs, self.n_ids, self.n_null, self.least = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        self.named, at = EliasFano.at(data, _HEAD.size)
        self.starts, at = EliasFano.at(data, at)
        self.ids = np.frombuffer(data, dtype=f"<u{width}", count=self.n_ids, offset=at)

    def doc_id(self, i: int) -> int | None:
        return None if i < self.n_null else self.named.select(i - self.n_null) + self.least

    def document(self, i: int) -> np.ndarray:
        """The token ids of the i-th document, by two selects."""
        end = self.starts.select(i + 1) if i + 1 < self.n_docs else self.n_ids
        return self.ids[self.starts.select(i) : end]

    def documents(self) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
        """Document ids, starts and ends, by selects over one block of documents after the other."""
        for first in range(0, self.n_docs, EliasFano.STEP):
            last = min(first + EliasFano.STEP, self.n_docs)
            starts = self.starts.select(first, last)
            end = self.starts.select(last) if last < self.n_docs else self.n_ids
            a, b = max(first - self.n_null, 0), max(last - self.n_null, 0)
            named = (self.named.select(a, b) + self.least).tolist() if b > a else []
            yield [None] * (last - first - len(named)) + named, starts, np.append(starts[1:], end)


def encode_texts(docs: DataFrame, path: str, end_id: int | None, id_col: str, text_col: str) -> DataFrame:
    """doc_id, h (a hash of the text), r (a row number), ids: the token ids of each text, written once."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("h"), F.monotonically_increasing_id().alias("r"), F.col(text_col).alias("text"))

    def encode(batches):
        of = encoder(path)
        for b in batches:
            ids = pa.array(of.packed(b.column(3).to_pylist(), end_id), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), ids], ["doc_id", "h", "r", "ids"])

    return save_table(rows.mapInArrow(encode, "doc_id long, h long, r long, ids binary"), "token-ids")


def write_shards(docs: DataFrame, path: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encodes every text, sorts documents by id and writes shards; returns the table of shards.

    A null text is empty; null ids come first. Repeated ids stay, in the order
    of a hash of their texts; repeated rows are equal, so their order among
    themselves doesn't show. Other columns are ignored. An empty table gives an
    empty dataset. Texts are encoded where they are read, and only their ids are
    sorted. The sort deals documents out by ranges of (id, hash, row), so that
    even one id that is repeated without end is split over tasks; each task
    holds one shard at a time.
    """
    spark = docs.sparkSession
    small_batches(spark)
    encoded = encode_texts(docs, path, end_id, id_col, text_col)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = encoded.repartitionByRange(parts, "doc_id", "h", "r").sortWithinPartitions("doc_id", "h", "r").select("doc_id", "ids")

    def write(batches):
        width, part = encoder(path).dtype.itemsize, TaskContext.get().partitionId()
        seq = offset = held = 0
        doc_ids, lengths, ids, least = [], [], [], None

        def shard():
            data = pack_shard(doc_ids, lengths, b"".join(ids), width)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), *(pa.array([v], pa.int64()) for v in (offset, len(lengths), held)), pa.array([data], pa.binary())],
                ["part", "seq", "part_offset", "n_docs", "n_ids", "shard"],
            )

        for b in batches:
            for doc_id, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n = len(packed) // width
                far = least is not None and doc_id - least >> 62
                if lengths and (held + n > shard_ids or len(lengths) >= SHARD_DOCS or far):
                    yield shard()
                    seq, offset, held, doc_ids, lengths, ids, least = seq + 1, offset + held, 0, [], [], [], None
                least = doc_id if least is None else least
                doc_ids.append(doc_id)
                lengths.append(n)
                ids.append(packed)
                held += n
        if lengths:
            yield shard()

    shards = save_table(ordered.mapInArrow(write, SCHEMA), "token-shards")
    drop_table(encoded)
    return shards


def read_shards(shards: DataFrame) -> DataFrame:
    """One row per document of a table of shards: doc_id, start (over all shards), n_tokens, ids_crc32.

    Boundaries come from selects. Only one row a written partition is summed in
    one place; shards carry their offset within their partition.
    """
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    over = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("part", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("base"))
    placed = shards.join(F.broadcast(bases), "part").select((F.col("base") + F.col("part_offset")).alias("base"), "shard")

    def read(batches):
        for b in batches:
            for base, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                s = Shard(data.as_buffer())
                for doc_ids, starts, ends in s.documents():
                    crc = [zlib.crc32(s.ids[i:j].astype("<u4")) for i, j in zip(starts.tolist(), ends.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(starts + base), pa.array(ends - starts), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
