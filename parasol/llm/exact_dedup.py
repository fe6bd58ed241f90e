"""Exact deduplication with a log-structured merge index, in DataFrame operations only.

* Log: every row is keyed by a 64-bit digest of its normalised text.
* Memtables: the log is cut into tables of at most MEMTABLE rows. Each is flushed
  as one run: sorted by digest, one entry a digest, the row that stays and how
  many there are.
* Compaction: while there are more than FAN runs, about FAN of them at a time
  merge to one on the next level; an entry keeps the least of its rows.
* Filters: each of the last runs has a bitmap of its digests. A digest whose bit
  only one run has, and that occurs once there, is unique: it goes through no
  last merge, no verification and no join.
* Byte verification: texts that hit are compared byte for byte, by the least
  and the greatest normalised text of each digest, which map-side aggregation
  reduces to a few rows a task. Digests that cover different texts are grouped
  again by the texts themselves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from parasol.llm.common import attach, key_filter, marked, may_match
from parasol.session import drop_table, save_table

#: Rows of a memtable, a power of two, and runs that merge to one and that remain at last.
MEMTABLE, FAN = 1 << 20, 8


def normalised(text: Column) -> Column:
    """The text without the six ASCII white-space characters; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def keyed(docs: DataFrame, digest: Callable[[Column], Column], id_col: str, text_col: str, *more: Column) -> DataFrame:
    """doc_id, n_chars, norm (the normalised text), digest, and ``more``."""
    norm = normalised(F.col(text_col))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.char_length(text_col), F.lit(0)).alias("n_chars"), norm.alias("norm"), *more)
    return rows.withColumn("digest", digest(F.col("norm")).cast("long"))


def _order() -> Column:
    """Sorts the row that stays first: most characters, then the smallest id (null last), then the first row."""
    return F.struct((-F.col("n_chars")).alias("c"), F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("row").alias("r"))


def write_log(docs: DataFrame, digest: Callable[[Column], Column] = F.xxhash64, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: digest, doc_id, n_chars, text_sha256, row (a number of its own) and ``carry``."""
    rows = keyed(docs, digest, id_col, text_col, F.monotonically_increasing_id().alias("row"), *map(F.col, carry))
    return save_table(rows.select("digest", "doc_id", "n_chars", F.sha2("norm", 256).alias("text_sha256"), "row", *carry), "dedup-log")


def flush(log: DataFrame, memtable: int = MEMTABLE) -> DataFrame:
    """The runs of a log's memtables: run, digest, best (the order of the row that stays), group_size, sorted.

    A row's number says which table it is in: rows of one task are numbered one after the other.
    """
    run = F.shiftright("row", memtable.bit_length() - 1).alias("run")
    entries = log.groupBy(run, "digest").agg(F.min(_order()).alias("best"), F.count("*").alias("group_size"))
    return save_table(entries.sortWithinPartitions("run", "digest"), "dedup-runs")


def _merged(entries: DataFrame, *key: str | Column) -> DataFrame:
    return entries.groupBy(*key).agg(F.min("best").alias("best"), F.sum("group_size").alias("group_size"))


def compact(runs: DataFrame, fan: int = FAN) -> DataFrame:
    """Merges runs, about ``fan`` at a time and level by level, until at most ``fan`` are left."""
    while (n := runs.select("run").distinct().count()) > fan:
        level = -(-n // fan)
        after = _merged(runs, F.pmod(F.xxhash64("run"), F.lit(level)).alias("run"), "digest")
        after = save_table(after.sortWithinPartitions("run", "digest"), "dedup-runs")
        drop_table(runs)
        runs = after
    return runs


def hits(runs: DataFrame) -> DataFrame:
    """Of at most FAN runs, one entry (digest, best, group_size) for each digest that occurs more than once in all."""
    n = runs.count()
    each = save_table(key_filter(runs, "digest", n, "run"), "dedup-filters")
    # Bits that two runs have at least: the bits so far are folded with the next run's.
    fold = "aggregate(collect_list(bits), named_struct('once', 0L, 'twice', 0L), (a, b) -> named_struct('once', a.once | b, 'twice', a.twice | (a.once & b))).twice"
    shared = each.groupBy("word").agg(F.expr(fold).alias("bits")).where("bits <> 0")
    likely = marked(runs, save_table(shared, "dedup-shared"), "digest", n, "left").where("__hit or group_size > 1")
    return _merged(likely, "digest").where("group_size > 1")


def merge(*indexes: DataFrame) -> DataFrame:
    """The runs of several batches as those of one index; their row numbers must come from one numbering."""
    out = indexes[0]
    for other in indexes[1:]:
        out = out.unionByName(other)
    return out


def exact_dedup(
    docs: DataFrame,
    digest: Callable[[Column], Column] = F.xxhash64,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: tuple[str, ...] = (),
    memtable: int = MEMTABLE,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, and the columns of ``carry``.

    Texts are equal when they are the same bytes without ASCII white space; null
    counts as empty. Of equal texts the row with the most code points stays,
    then the smallest doc_id (null ids last); of repeated rows exactly one
    stays. Other columns are ignored. An empty table gives an empty result.

    ``digest`` maps the normalised text to a long; a weak one costs time, never
    correctness. A digest with over a thousandth of the rows is joined by
    broadcast (there are at most a thousand), the others by shuffle.
    """
    log = write_log(docs, digest, id_col, text_col, carry)
    total = log.count()
    index = save_table(hits(compact(flush(log, memtable))), "dedup-hits")
    n = index.count()
    filters = save_table(key_filter(index, "digest", n), "dedup-filter")
    suspects = may_match(keyed(docs, digest, id_col, text_col).select("digest", "norm"), filters, "digest", n)
    compared = suspects.groupBy("digest").agg((F.min("norm") != F.max("norm")).alias("differs"))
    mixed = save_table(compared.where("differs").select("digest"), "dedup-mixed")

    looked_up = marked(log, filters, "digest", n, "left").select(*log.columns, "__hit")
    found, parts = attach(looked_up.where("__hit").drop("__hit"), index, ["digest"], "group_size", total), []
    if not mixed.isEmpty():
        found = found.join(mixed, "digest", "left_anti")
        rows = keyed(docs, digest, id_col, text_col, F.monotonically_increasing_id().alias("row"), *map(F.col, carry))
        rows = save_table(rows.join(mixed, "digest", "left_semi").withColumn("text_sha256", F.sha2("norm", 256)), "dedup-mixed-rows")
        index = rows.groupBy("digest", "norm").agg(F.min(_order()).alias("best"), F.count("*").alias("group_size"))
        parts = [attach(rows, index, ["digest", "norm"], "group_size", total)]
    alone = looked_up.where("not __hit").withColumn("best", _order()).withColumn("group_size", F.lit(1).cast("long"))
    columns = ["doc_id", F.coalesce("best", _order())["d"].alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.coalesce(F.col("row") == F.col("best.r"), F.lit(True)).alias("kept"), "text_sha256", *carry]
    out = found.select(*columns)
    for part in (alone, *parts):
        out = out.unionByName(part.select(*columns))
    return out
