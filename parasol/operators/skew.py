"""Joins that no frequent key can hold up."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: A key with more than one in HOT_SHARE of all rows is broadcast; at most HOT_SHARE keys are.
HOT_SHARE = 1000


def shuffled(rows: DataFrame) -> DataFrame:
    """``rows``, never broadcast by the join that they are put into.

    The optimizer takes an explode to make as many rows as it gets, and compressed
    tables to be small, so what it would broadcast may be the larger part of the job.
    """
    return rows.hint("merge")


def look_up(rows: DataFrame, key: str, table: DataFrame, value: str, total: int) -> DataFrame:
    """``rows`` with ``value`` of ``table`` (one row a ``key``), null where it has none. ``rows``, ``total`` of them, are read three times.

    Keys are counted first, with partial sums; those of over a thousandth of all
    rows are joined by broadcast, so no task of the shuffled join gets them.
    """
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__n"))
    hot = shuffled(table.select(key, value)).join(F.broadcast(counts.where(F.col("__n") * HOT_SHARE > total).select(key)), key, "right")
    tried = rows.join(F.broadcast(hot.withColumn("__hot", F.lit(True))), key, "left")
    rest = tried.where(F.col("__hot").isNull()).drop("__hot", value).join(shuffled(table.select(key, value)), key, "left")
    return tried.where("__hot").drop("__hot").unionByName(rest)
