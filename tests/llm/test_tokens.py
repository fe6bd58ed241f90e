"""Token counts, token shards and packing against the library itself."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from parasol.llm.bpe import encoder, pieces, spaced
from parasol.llm.packing import Packer, pack
from parasol.llm.token_counts import counter, token_counts
from parasol.llm.token_output import EliasFano, Shard, pack_shard, read_shards, write_shards
from tests.llm.helpers import awkward, clashing, docs

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def library(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*" \n\t\r\x0b\x1c\x85\xa0　ab1!é漢'st", "  ", "'ll", "<|endoftext|>"]), max_size=30).map("".join))
def test_ids_and_counts_equal_the_library(text):
    assert encoder(PATH).ids(text).tolist() == library(text)
    assert counter(PATH).count(text) == len(library(text))


def test_ids_around_every_space_like_character():
    """Each code point of Unicode's planes 0 and 1 beside spaces and letters, as the library cuts and encodes it."""
    points = [chr(c) for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(points), 64):
        text = "".join(f"a {c} b{c} {c}c  {c}" for c in points[i : i + 64])
        assert encoder(PATH).ids(text).tolist() == library(text), hex(ord(points[i]))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=" \n\t\x85 ab", max_size=25))
def test_pieces_join_to_the_text(text):
    assert "".join(pieces(text)) == text
    parts = spaced(text)
    assert parts is None or " ".join(parts) == text


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "word_bpe_49k.json"])
def test_counts_of_other_vocabularies(name):
    import sentencepiece

    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        of = sentencepiece.SentencePieceProcessor(model_file=path).encode
    else:
        of = lambda t: Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids
    for text in ("Hello  world, it's 1", "é漢 \n x", ""):
        assert counter(path).count(text) == len(of(text))


def test_token_counts_of_awkward_rows(spark):
    rows = awkward()
    got = token_counts(clashing(docs(spark, rows)), PATH, 1024).collect()
    want = sorted(((str(r[0]), len((r[1] or "").encode()), len(library(r[1])), len(library(r[1])) > 1024) for r in rows))
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want
    assert token_counts(docs(spark, []), PATH, 1024).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3000), max_size=80), st.integers(0, 500))
def test_elias_fano_selects_what_was_put_in(values, more):
    values = sorted(values)
    universe = (values[-1] if values else 0) + more
    ef = EliasFano.encode(np.array(values, dtype=np.int64), universe)
    again, end = EliasFano.at(b"x" + ef.to_bytes() + b"yy", 1)
    assert end == 1 + len(ef.to_bytes())
    assert [again.select(i) for i in range(len(values))] == values
    if values:
        assert again.select(0, len(values)).tolist() == values
        assert again.select(len(values) // 2, len(values)).tolist() == values[len(values) // 2 :]
        # 2 + log2(u / n) bits a value, the rounding of two arrays and the select structure
        assert 8 * (ef.low.nbytes + ef.high.nbytes) <= len(values) * (3 + max(0, np.log2(max(universe / len(values), 1)))) + 17
    with pytest.raises(IndexError):
        again.select(len(values))


def test_select_over_many_blocks_and_gaps():
    rng = np.random.default_rng(0)
    for values in (np.sort(rng.integers(0, 1 << 40, 5000)), np.sort(rng.integers(0, 300, 5000)), np.append(np.zeros(2000, int), 10**9 + np.arange(600) * 3)):
        ef = EliasFano.encode(values, int(values[-1]) + 7)
        assert ef.select(0, len(values)).tolist() == values.tolist()
        assert [ef.select(int(i)) for i in range(0, len(values), 97)] == values[::97].tolist()
        assert ef.places.nbytes <= 4 * (len(values) // EliasFano.STEP + 1)


def test_reading_needs_the_select_structure():
    """Without the remembered positions a shard of several blocks can't be read."""
    ids = np.arange(3000, dtype="<u2")
    s = Shard(pack_shard(list(range(1500)), [2] * 1500, ids.tobytes(), 2))
    assert [a for _, starts, _ in s.documents() for a in starts.tolist()] == list(range(0, 3000, 2))
    s.starts.places = np.zeros(0, "<u4")
    with pytest.raises(IndexError):
        list(s.documents())


def test_shard_round_trip():
    ids = [np.array(x, dtype="<u2") for x in ([1, 2, 3], [], [65535], [7] * 1000)]
    s = Shard(pack_shard([None, -5, -5, 9], [len(x) for x in ids], b"".join(x.tobytes() for x in ids), 2))
    assert [s.document(i).tolist() for i in range(4)] == [x.tolist() for x in ids]
    assert [s.doc_id(i) for i in range(4)] == [None, -5, -5, 9] and s.starts.select(0, 4).tolist() == [0, 3, 3, 4]
    with pytest.raises(ValueError):
        Shard(b"x" * 64)


def test_shards_of_awkward_rows(spark):
    rows = awkward()
    got = read_shards(write_shards(clashing(docs(spark, rows)), PATH, 0, shard_ids=500)).collect()
    assert len(got) == len(rows)
    got.sort(key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda d: (d is not None, d or 0))
    at, texts = 0, defaultdict(list)
    for doc_id, text, _ in rows:
        a = np.array([*library(text), 0], dtype="<u4")
        texts[doc_id].append((len(a), zlib.crc32(a.tobytes())))
    for r in got:
        assert r.start == at
        texts[r.doc_id].remove((r.n_tokens, r.ids_crc32))
        at += r.n_tokens
    assert read_shards(write_shards(docs(spark, []), PATH, 0)).count() == 0


def check_packed(rows, pieces_, limits, prompt=lambda d: 0):
    by_seq, by_doc = defaultdict(list), defaultdict(int)
    for r in pieces_:
        by_seq[r.sequence_id].append(r)
        by_doc[r.doc_id] += r.length
        assert r.length > 0
    for group in by_seq.values():
        group.sort(key=lambda r: r.offset)
        assert [r.offset for r in group] == np.cumsum([0] + [r.length for r in group])[:-1].tolist()
        total = sum(r.length for r in group)
        assert total <= limits[0] and len(group) <= limits[1] and sum(r.loss_tokens for r in group) <= limits[2]
        assert total == limits[0] or total & (total - 1) == 0
    want = defaultdict(int)
    for doc_id, text, _ in rows:
        want[doc_id] += len(library(text)) + 1
    assert by_doc == want


@pytest.mark.parametrize("limits", [(2048, 256, 2048), (64, 3, 64), (64, 8, 40), (1, 1, 1)])
def test_packing_of_awkward_rows(spark, limits):
    rows = [r for r in awkward(n=30) if limits[0] > 1 or len(r[1] or "") < 100]
    got = pack(clashing(docs(spark, rows)), PATH, 1, *limits).collect()
    check_packed(rows, got, limits)
    single = {r[0]: np.array([*library(r[1]), 1], dtype="<u4") for r in rows if sum(x[0] == r[0] for x in rows) == 1}
    for r in got:
        if r.doc_id in single:
            assert r.ids_crc32 == zlib.crc32(single[r.doc_id][r.start : r.start + r.length].tobytes())
            assert r.doc_tokens == len(single[r.doc_id])


def test_packing_counts_loss_behind_the_prompt(spark):
    from pyspark.sql import functions as F

    rows = [(i, "a b c d e f g h " * (1 + i % 7), "s") for i in range(50)]
    frame = docs(spark, rows).withColumn("prompt", F.when(F.col("doc_id") % 3 > 0, 10))
    got = pack(frame, PATH, 1, 128, 16, 60, prompt_col="prompt").collect()
    check_packed(rows, got, (128, 16, 60))
    for r in got:
        first = 10 if r.doc_id % 3 else 0
        assert r.loss_tokens == sum(r.start + k >= first for k in range(r.length))
    assert pack(docs(spark, []), PATH, 1, 8, 8, 8).count() == 0


def test_packer_needs_limits():
    with pytest.raises(ValueError):
        Packer(0, 1, 1)


def test_packer_fills_sequences():
    rng = random.Random(3)
    p = Packer(256, 32, 256)
    lengths = [rng.randint(1, 600) for _ in range(2000)]
    for i, n in enumerate(lengths):
        p.add(i, np.arange(n, dtype="<u2"))
    p.finish()
    assert sum(x[2] for x in p.out) == sum(lengths)
    assert p.sequences <= sum(lengths) / 256 + 8  # the last ones are powers of two
