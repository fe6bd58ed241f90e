"""Orders, picks and copies on DataFrames: the clamp of route ladders, top lists, samples and first or best copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: What a shade may fall short of the best one so far and still stand.
SLACK = 1e-9


def rank(rows: DataFrame, by: list[str], *order, name: str = "r") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def first_of(rows: DataFrame, by: list[str], *order) -> DataFrame:
    """The first row of each group."""
    return rank(rows, by, *order, name="__r").where("__r = 1").drop("__r")


def monotone(rows: DataFrame, by: list[str], order: list[str], shade: str, carried: list[str]) -> DataFrame:
    """``rows`` in which shade never falls along ``order``: where it does, ``carried`` come from the best row so far.

    A row stands if its shade is at least the best so far less SLACK, and is then
    the best, so of equal ones the latest. Rows keep their other columns.
    """
    placed = rank(rows, by, *order, name="__place")
    upto = Window.partitionBy(*by).orderBy("__place").rowsBetween(Window.unboundedPreceding, 0)
    best = placed.withColumn("__top", F.max(shade).over(upto))
    stands = F.col(shade) >= F.col("__top") - SLACK
    shown = F.last(F.when(stands, F.struct(*carried)), ignorenulls=True).over(upto)
    out = best.withColumn("__shown", shown)
    return out.select(*(F.col(f"__shown.{c}").alias(c) if c in carried else F.col(c) for c in rows.columns))


def largest_remainders(strata: DataFrame, n: str, total: int, least: int) -> DataFrame:
    """Adds picks: ``total`` dealt in proportion to ``n`` (one row a stratum), what is left over by the largest remainders, ``least`` at least."""
    everything = Window.partitionBy()
    quota = strata.withColumn("__q", F.lit(float(total)) * F.col(n) / F.sum(n).over(everything))
    left = F.lit(total) - F.sum(F.floor("__q")).over(everything)
    names = [c for c in strata.columns if c != n]
    ranked = quota.withColumn("__left", left).withColumn("__r", F.row_number().over(Window.orderBy((F.col("__q") - F.floor("__q")).desc(), *names)))
    picks = F.greatest(F.lit(least), F.floor("__q") + (F.col("__r") <= F.col("__left")).cast("int")).cast("long")
    return ranked.select(*strata.columns, picks.alias("picks"))


def sample_order(key: Column, by: int = 7919, within: int = 10007) -> Column:
    """A fixed order without pattern, for samples that agree between reruns and engines."""
    return F.pmod(key * by, F.lit(within))


def top_up(rows: DataFrame, by: list[str], order: list, each: int, total: int) -> DataFrame:
    """``each`` rows of every group, and, while fewer than ``total`` of the first of ``by`` are picked, more of its other rows in order."""
    ranked = rank(rows, by, *order, name="__r").withColumn("__more", (F.col("__r") > each).cast("int"))
    return rank(ranked, by[:1], "__more", *order, name="__n").where((F.col("__more") == 0) | (F.col("__n") <= total)).drop("__r", "__more", "__n")


def best_copy(rows: DataFrame, key: list[str], score: Column, place: str, ties: list[str], kept: list[str]) -> DataFrame:
    """One row a key: the columns ``kept`` of the copy with the highest score (of equal ones the first), at the place of the first copy."""
    first = F.min(place).over(Window.partitionBy(*key))
    return first_of(rows.withColumn("__score", score).withColumn("__place", first), key, F.col("__score").desc(), place, *ties).select(*key, *kept, F.col("__place").alias("place"))


def undirected(line: Column) -> Column:
    """A geometry's text without direction: the lesser of it and its reverse (an array of point texts)."""
    return F.least(F.array_join(line, ","), F.array_join(F.reverse(line), ","))


def distinct_geometry(rows: DataFrame, by: list[str], line: str, order: str) -> DataFrame:
    """The first row of each geometry in either direction, with ``geometry``."""
    return first_of(rows.withColumn("geometry", undirected(F.col(line))), [*by, "geometry"], order)
