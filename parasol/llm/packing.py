"""Packing of documents into training sequences by vector bin packing.

Every piece of a document demands tokens, one segment and loss-bearing tokens,
and a sequence has a limit on each. The open sequence takes, again and again,
the waiting piece whose demand has the largest dot product with what is left of
the limits. When nothing fits any more, a waiting piece is cut to fill the rest.
A sequence that can't be filled is cut back to a power of two, which needs no
padding, and what was cut off waits on.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from parasol.llm.bpe import encoder
from parasol.session import small_batches

#: Pieces that wait at once; a task's memory is this many pieces and one batch.
POOL = 512
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


class Packer:
    """Places pieces one sequence at a time; ``out`` collects tuples in the order of SCHEMA, sequence ids local."""

    def __init__(self, tokens: int, segments: int, loss: int) -> None:
        if min(tokens, segments, loss) < 1:
            raise ValueError("limits must be positive")
        self.limits = np.array([tokens, segments, loss], dtype=np.float64)
        self.tokens, self.loss = tokens, loss
        self.demand = np.zeros((POOL + 64, 3))
        self.waiting: list[tuple] = []
        self.sequences = 0
        self.out: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray, prompt: int = 0) -> None:
        """Takes a document whose first ``prompt`` ids bear no loss."""
        self.cut(doc_id, ids, 0, prompt)
        if len(self.waiting) >= POOL:
            while len(self.waiting) > POOL // 2:
                self.fill()

    def cut(self, doc_id: int | None, ids: np.ndarray, start: int, prompt: int) -> None:
        """Cuts from ``start`` on into pieces that fit an empty sequence; full ones are done, others wait."""
        while start < len(ids):
            length = self.fits(start, len(ids) - start, prompt, self.tokens, self.loss)
            if length == self.tokens:
                self.place([(doc_id, ids, start, length, prompt)])
            else:
                self.wait((doc_id, ids, start, length, prompt))
            start += length

    @staticmethod
    def borne(start: int, length: int, prompt: int) -> int:
        return max(0, start + length - max(start, prompt))

    @staticmethod
    def fits(start: int, length: int, prompt: int, tokens: int, loss: int) -> int:
        """The longest part from ``start`` on within both limits."""
        return max(0, min(length, tokens, max(0, prompt - start) + loss))

    def wait(self, piece: tuple) -> None:
        if len(self.waiting) == len(self.demand):
            self.demand = np.concatenate([self.demand, np.zeros_like(self.demand)])
        self.demand[len(self.waiting)] = piece[3], 1, self.borne(piece[2], piece[3], piece[4])
        self.waiting.append(piece)

    def take(self, i: int) -> tuple:
        piece, last = self.waiting[i], self.waiting.pop()
        if i < len(self.waiting):
            self.waiting[i] = last
            self.demand[i] = self.demand[len(self.waiting)]
        return piece

    def fill(self) -> None:
        """Fills one sequence from the waiting pieces."""
        left, chosen = self.limits.copy(), []
        while self.waiting and left[0] and left[1]:
            need = self.demand[: len(self.waiting)]
            ok = (need <= left).all(axis=1)
            if not ok.any():
                break
            score = np.where(ok, need @ (left / self.limits**2), -1.0)
            i = int(score.argmax())
            left -= need[i]
            chosen.append(self.take(i))
        if left[0] and left[1] and self.waiting:
            rooms = [self.fits(p[2], p[3], p[4], int(left[0]), int(left[2])) for p in self.waiting]
            i = max(range(len(rooms)), key=rooms.__getitem__)
            if room := rooms[i]:
                doc_id, ids, start, length, prompt = self.take(i)
                chosen.append((doc_id, ids, start, room, prompt))
                self.wait((doc_id, ids, start + room, length - room, prompt))
        self.place(chosen)

    def place(self, pieces: list[tuple]) -> None:
        """Closes a sequence, cut back to a power of two if it isn't full."""
        total = sum(p[3] for p in pieces)
        surplus = 0 if total == self.tokens else total - (1 << total.bit_length() - 1)
        while surplus:
            doc_id, ids, start, length, prompt = pieces.pop()
            off = min(surplus, length)
            self.wait((doc_id, ids, start + length - off, off, prompt))
            if off < length:
                pieces.append((doc_id, ids, start, length - off, prompt))
            surplus -= off
        offset = 0
        for doc_id, ids, start, length, prompt in pieces:
            crc = zlib.crc32(ids[start : start + length].astype("<u4"))
            self.out.append((doc_id, start, length, crc, len(ids), self.sequences, offset, self.borne(start, length, prompt)))
            offset += length
        self.sequences += 1

    def finish(self) -> None:
        while self.waiting:
            self.fill()


def pack(
    docs: DataFrame,
    path: str,
    end_id: int,
    max_tokens: int,
    max_segments: int,
    max_loss: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    prompt_col: str | None = None,
) -> DataFrame:
    """Packs every text of ``docs``, with ``end_id`` after it, into sequences; one row per piece.

    ``prompt_col``: the number of first ids that bear no loss (null: 0; default:
    every id bears loss). Null texts are empty, so the document is ``end_id``
    alone. Null and repeated ids are packed as documents of their own. Other
    columns are ignored; an empty table gives an empty result.

    Each task packs what it reads and cuts its last sequences to powers of two,
    so there is no shuffle and no padding however the table is split. Sequence
    ids are the task's number times 2**33 plus a running number.
    """
    small_batches(docs.sparkSession)
    prompt = F.coalesce(F.col(prompt_col).cast("long"), F.lit(0)) if prompt_col else F.lit(0).cast("long")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), prompt.alias("prompt"))

    def place(batches):
        of, packer, base = encoder(path), Packer(max_tokens, max_segments, max_loss), TaskContext.get().partitionId() << 33
        names = [c.split()[0] for c in SCHEMA.split(", ")]

        def drain():
            columns = list(zip(*packer.out, strict=True)) or [[] for _ in names]
            packer.out = []
            columns[5] = [base + s for s in columns[5]]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

        for b in batches:
            doc_ids, texts, firsts = (c.to_pylist() for c in b.columns)
            for doc_id, ids, first in zip(doc_ids, of.packed(texts, end_id), firsts, strict=True):
                packer.add(doc_id, np.frombuffer(ids, dtype=of.dtype), first)
            yield drain()
        packer.finish()
        yield drain()

    return rows.mapInArrow(place, SCHEMA)
