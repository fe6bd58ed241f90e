"""Pieces that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable
from contextlib import suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from parasol.session import drop_table, save_table

#: A key that holds more than one in HOT_SHARE of all rows counts as hot. At most HOT_SHARE keys can.
HOT_SHARE = 1000
#: Rows of fixed size that a join may broadcast whole; what is larger is shuffled, as the optimizer takes compressed tables to be small.
SMALL = 50_000


def documents(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def word_count(text: Column) -> Column:
    """The number of runs of characters other than the six ASCII white-space ones; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus


def bounded(rows: DataFrame, total: int) -> DataFrame:
    """``rows``, at most ``total``, never broadcast by the join that they are put into if they may be many."""
    return rows.hint("merge") if total > SMALL else rows


def attach(rows: DataFrame, classes: DataFrame, key: list[str], size: str, total: int, how: str = "left") -> DataFrame:
    """Joins ``classes`` (one row a key, ``size``: its rows in ``rows``) to ``rows``, left or inner.

    Keys with over 1/HOT_SHARE of ``total`` rows number at most HOT_SHARE, so they are
    broadcast; no task of the shuffled join then holds more than that share for one key.
    Classes of few rows are broadcast whole, if they hold numbers only.
    """
    if total <= SMALL and all(kind in ("bigint", "int", "boolean") for _, kind in classes.dtypes):
        return rows.join(F.broadcast(classes), key, how)
    limit = max(total // HOT_SHARE, 1)
    hot = classes.where(F.col(size) > limit)
    cold = classes.where(F.col(size) <= limit)
    tried = rows.join(F.broadcast(hot.withColumn("__hot", F.lit(True))), key, "left")
    added = [c for c in classes.columns if c not in key]
    done = tried.where(F.col("__hot")).drop("__hot")
    rest = tried.where(F.col("__hot").isNull()).drop("__hot", *added).join(bounded(cold, total), key, how)
    return done.unionByName(rest)


def meeting(rows: DataFrame, key: list[str], size: str, label: str | None = None) -> DataFrame:
    """The rows whose ``key`` others have too, with the number of its rows as ``size``. ``rows`` is read twice.

    Keys that occur once, mostly the larger part, are dropped by a filter before
    rows are sent; with ``label`` also those whose rows have the same label.
    """
    spread = [F.min(label).alias("__low"), F.max(label).alias("__high")] if label else []
    counts = rows.groupBy(*key).agg(F.count("*").alias(size), *spread).where("__low <> __high" if label else F.col(size) > 1)
    counts = save_table(counts.select(*key, size), "meeting-keys")
    n, total = counts.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    filters = key_filter(counts.select(F.xxhash64(*key).alias("__k")), "__k", n)
    likely = may_match(rows.withColumn("__k", F.xxhash64(*key)), save_table(filters, "meeting-filter"), "__k", n).drop("__k")
    return attach(likely, counts, key, size, total, "inner")


#: Bits of a key filter: so many for each key, but never more than MOST_BITS (half a million words, which bounds
#: the broadcast). A filter that fills up lets more rows through, never fewer.
KEY_BITS, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 25
#: Filters of more bits are broadcast as arrays of BLOCK_WORDS words: a row a word takes the driver some ten times the bits.
WORD_BITS, BLOCK_WORDS = 1 << 22, 64


def _bits(keys: int) -> int:
    return min(max(1 << (KEY_BITS * max(keys, 1) - 1).bit_length(), LEAST_BITS), MOST_BITS)


def _word(key: str, keys: int) -> Column:
    """The place of a key's bit, without the last six bits."""
    return F.shiftright(F.pmod(F.col(key), F.lit(_bits(keys))), 6)


def _mask(key: str) -> Column:
    """The three bits of a key in its word, which keep a filter with few bits a key selective."""
    return F.expr(" | ".join(f"shiftleft(1L, cast(shiftrightunsigned({key}, {n}) & 63 as int))" for n in (0, 40, 52)))


def key_filter(rows: DataFrame, key: str, keys: int, *by: str) -> DataFrame:
    """A sparse bitmap of the hashed ``key`` (long), sized for ``keys`` of them: rows (word, bits), for each of ``by``."""
    return rows.select(*by, _word(key, keys).alias("word"), _mask(key).alias("mask")).groupBy(*by, "word").agg(F.bit_or("mask").alias("bits"))


def marked(rows: DataFrame, filters: DataFrame, key: str, keys: int, how: str) -> DataFrame:
    """Adds __hit: whether the filter has ``key``. The filter is broadcast."""
    placed = rows.withColumn("__word", _word(key, keys))
    if _bits(keys) > WORD_BITS:
        at, of = F.floor(F.col("word") / BLOCK_WORDS), F.pmod("word", F.lit(BLOCK_WORDS))
        entries = F.map_from_entries(F.collect_list(F.struct(of.alias("i"), "bits")))
        blocks = filters.groupBy(at.alias("__at")).agg(entries.alias("__m"))
        words = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(BLOCK_WORDS - 1).cast("long")), lambda i: F.coalesce(F.try_element_at("__m", i), F.lit(0).cast("long")))
        blocks = blocks.select("__at", words.alias("__words"))
        joined = placed.withColumn("__at", F.floor(F.col("__word") / BLOCK_WORDS)).join(F.broadcast(blocks), "__at", how)
        bits = F.element_at("__words", (F.pmod("__word", F.lit(BLOCK_WORDS)) + 1).cast("int"))
        return joined.withColumn("__hit", F.coalesce(bits.bitwiseAND(_mask(key)) == _mask(key), F.lit(False))).drop("__at", "__words")
    joined = placed.join(F.broadcast(filters.select(F.col("word").alias("__word"), F.col("bits").alias("__bits"))), "__word", how)
    return joined.withColumn("__hit", F.coalesce(F.col("__bits").bitwiseAND(_mask(key)) == _mask(key), F.lit(False)))


def may_match(rows: DataFrame, filters: DataFrame, key: str, keys: int) -> DataFrame:
    """The rows whose ``key`` the filter has, and perhaps a few others; the filter is broadcast."""
    return marked(rows, filters, key, keys, "inner").where("__hit").select(*rows.columns)


def without(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose ``keys`` are not in ``gone`` (a written table of those columns); nulls are equal.

    Rows that the filter of ``gone`` doesn't have go past the join, so about as
    many rows are sent as there are matches.
    """
    n = gone.count()
    filters = save_table(key_filter(gone.select(F.xxhash64(*keys).alias("__k")), "__k", n), "anti-filter")
    all_rows = marked(rows.withColumn("__k", F.xxhash64(*keys)), filters, "__k", n, "left").select(*rows.columns, "__hit")
    likely = all_rows.where("__hit").drop("__hit")
    left = likely.join(bounded(gone.select(*(F.col(k).alias(f"__gone_{k}") for k in keys)), n), [F.col(k).eqNullSafe(F.col(f"__gone_{k}")) for k in keys], "left_anti")
    return all_rows.where("not __hit").drop("__hit").unionByName(left.select(*rows.columns))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)`` (long, a != b): one row (id, comp), comp the smallest id.

    Two-phase star contraction: every node points at its smallest known neighbour, then
    chains are shortened, until nothing changes. State is one row an edge; each half of
    a round is a written table, and the driver only sees two sums. A node with many
    neighbours, as the root of a large component is, is joined by broadcast.
    An empty ``edges`` gives an empty result.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    edges, seen = save_table(edges, "links"), None
    while True:
        n = edges.count()
        # Large star: neighbours above a node are attached to the smallest node around it.
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("c"))
        large = attach(both, low, ["a"], "c", 2 * n).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = save_table(large.where("a <> b").distinct(), "links")
        # Small star: a node and its neighbours below it are attached to the smallest of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("c"))
        small = attach(large, low, ["a"], "c", n).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        after = save_table(small.select("e.*").where("a <> b").distinct(), "links")
        now = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop_table(edges)
        drop_table(large)
        edges = after
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("comp")).distinct()
    return edges.groupBy("a").agg(F.min("b").alias("comp")).withColumnRenamed("a", "id").unionByName(roots)


class Trees:
    """The trees that links between 0..n-1 join to; ``roots`` names each member's by its least member or label."""

    def __init__(self, labels: np.ndarray | int) -> None:
        """``labels``: members with equal ones are joined from the start; or how many members there are."""
        labels = np.arange(labels) if isinstance(labels, int) else np.unique(labels, return_inverse=True)[1]
        self.roots, self.links = labels.astype(np.int64), []

    def join(self, i: int, j: int) -> None:
        a, b = self.roots[i], self.roots[j]
        if a != b:
            self.roots[self.roots == max(a, b)] = min(a, b)
            self.links.append((i, j))


def groups(batches, keys: list[str]):
    """Yields one Arrow table per run of rows with equal ``keys`` (not null), which sorted input keeps together."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        columns = [b.column(b.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(b.num_rows, dtype=bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), b.num_rows]
        for i, j in zip(starts[:-1], starts[1:], strict=True):
            now = tuple(c[i] for c in columns)
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(i, j - i))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def tiles(members: DataFrame, size: str, member: str, most: int) -> DataFrame:
    """Deals the members of each key to tiles of at most about 2 * ``most`` rows; adds ti, tj, block.

    ``members`` has one row per key and member. A key with more than ``most`` rows (column ``size``) is cut into blocks by a
    hash, and each two blocks meet in one tile, so every pair of members still
    meets. Smaller keys are one tile.
    """
    blocks = F.ceil(F.col(size) / most).cast("int")
    own = F.pmod(F.xxhash64(member), blocks).cast("int")
    cut_up = members.withColumn("__own", F.when(F.col(size) > most, own).otherwise(0))
    other = F.explode(F.when(F.col(size) > most, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(F.lit(0))))
    dealt = cut_up.withColumn("__other", other)
    own_other = F.least("__own", "__other").alias("ti"), F.greatest("__own", "__other").alias("tj")
    return dealt.select(*members.columns, *own_other, F.col("__own").alias("block"))


#: What ``linked`` deals members out by.
TILE = ["key", "ti", "tj"]


def linked(members: DataFrame, most: int, salts: int, edges: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Edges (a, b) that join what hangs together in each key of members (key, cid, label, m: the key's rows), a written table.

    ``edges`` takes rows (TILE, cid, label) and gives, for each tile, edges that
    join its members' trees, those with equal labels counting as joined. A key of
    up to ``most`` rows is one tile. A larger one is cut into blocks, ``salts``
    times differently, of which each is a tile; what they joined gets one label.
    Of the members with other labels than the commonest of their key, each still
    meets every one. So copies without end cost a few rows each, and no pair
    that may link is left out.
    """
    blocks = F.ceil(F.col("m") / most)
    small = members.where(F.col("m") <= most).select("key", F.lit(0).alias("ti"), F.lit(0).alias("tj"), "cid", "label")
    large = members.where(F.col("m") > most)
    n_large = large.count()
    if not n_large:
        return save_table(edges(small), "tile-links")
    named, first = large.select("key", "cid", "label"), small
    if salts:
        dealt = large.withColumn("ti", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        first = small.unionByName(dealt.select("key", "ti", F.pmod(F.xxhash64("cid", "key", "ti"), blocks).cast("int").alias("tj"), "cid", "label"))
    first = save_table(edges(first), "tile-links")
    if salts:
        named = named.join(bounded(components(first).withColumnRenamed("id", "cid"), n_large), "cid", "left").select("key", "cid", F.coalesce("comp", "label").alias("label"))
    named = save_table(named, "tile-labels")
    counts = named.groupBy("key", "label").agg(F.count("*").alias("n"))
    main = counts.groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.max("n").alias("most_n"), F.sum("n").alias("m")).where("most_n < m")
    left = save_table(attach(named, main, ["key"], "m", named.count(), "inner"), "tile-rest")
    n_odd = F.ceil((F.col("m") - F.col("most_n")) / most).cast("int")
    n_main = F.ceil(F.col("most_n") / most).cast("int")
    mine = F.pmod(F.xxhash64("cid"), F.when(F.col("label") == F.col("main"), n_main).otherwise(n_odd)).cast("int")
    is_main = F.col("label") == F.col("main")
    common = left.where(is_main).select("key", mine.alias("ti"), F.explode(F.sequence(F.lit(0), n_odd - 1)).alias("tj"), "cid", "label")
    odd = left.where(~is_main)
    others = odd.select("key", F.explode(F.sequence(F.lit(0), n_main - 1)).alias("ti"), mine.alias("tj"), "cid", "label")
    # Blocks of odd members meet each other too; ti below zero keeps these tiles apart.
    pairs = tiles(odd.where(n_odd > 1).withColumn("odd", F.col("m") - F.col("most_n")), "odd", "cid", most).select("key", (-1 - F.col("ti")).alias("ti"), "tj", "cid", "label")
    return save_table(first.unionByName(edges(common.unionByName(others).unionByName(pairs))), "tile-links")


def together(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Brings rows of equal ``keys`` together, in order, for ``groups``."""
    return rows.repartition(*keys).sortWithinPartitions(*keys)


def release_memory() -> None:
    """Gives the free memory of a worker back to the machine; it would otherwise keep what its largest piece took."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # not every libc can
        ctypes.CDLL(None).malloc_trim(0)


def tokenize(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Words of each text (binary), ASCII letters in lower case: numbers of all words, how many each text has, and the distinct words by number."""
    if texts.null_count:
        texts = pc.fill_null(texts, b"")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.view(pa.string())))
    ends, words = lists.offsets.to_numpy(), lists.flatten().view(pa.binary())
    real = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)  # white space at an end leaves an empty one
    before = np.append(0, np.cumsum(real))
    coded = words.filter(pa.array(real)).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), np.diff(before[ends - ends[0]]), coded.dictionary.to_pylist()
