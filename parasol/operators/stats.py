"""Distributions and agreement measures on DataFrames.

Percentiles by index or weight are selected: equal values are summed first,
ranges of values are summed next, and only those ranges in which a percentile
lies are ordered. So neither a large group nor a frequent value meets in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from parasol.session import cut


def selected(rows: DataFrame, by: list[str], value: str, weight: Column, **targets) -> DataFrame:
    """One row a group: for each name the first value, ascending, at which the running weight reaches what a function of the whole weight gives.

    Adds ``whole``, that weight. Weights are not negative; null ones don't count. Null values come first. Where
    rounding keeps the running weight below a target, it is the last value.
    """
    summed = rows.select(*by, F.col(value).alias("__v"), weight.alias("__w")).groupBy(*by, "__v").agg(F.coalesce(F.sum("__w"), F.lit(0)).alias("__w"))
    ranged = cut(summed.repartitionByRange(*by, "__v").withColumn("__p", F.spark_partition_id()))
    order = Window.partitionBy(*by).orderBy("__p")
    # One row a group and range from here on.
    parts = ranged.groupBy(*by, "__p").agg(F.sum("__w").alias("__in"))
    parts = parts.withColumns({
        "__before": F.coalesce(F.sum("__in").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "whole": F.sum("__in").over(Window.partitionBy(*by)),
        "__last": F.lead("__p").over(order).isNull(),
    })
    holds = [(F.col("__before") < t(F.col("whole"))) & ((t(F.col("whole")) <= F.col("__before") + F.col("__in")) | F.col("__last")) for t in targets.values()]
    # The first range stands for targets of nothing, the last one for the group.
    wanted = parts.where(reduce(lambda a, b: a | b, holds) | F.col("__last") | (F.col("__before") == 0))
    keyed = wanted.select(*(F.col(c).alias(f"__k{i}") for i, c in enumerate(by)), F.col("__p").alias("__kp"), "__before", "whole")
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(by)), F.col("__p") == F.col("__kp"))
    near = ranged.join(keyed, same).select(*by, "__p", "__v", "__w", "__before", "whole")
    run = Window.partitionBy(*by, "__p").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    acc = near.withColumn("__acc", F.col("__before") + F.sum("__w").over(run))
    # Among values that reach a target the least struct is the first one; a value that adds nothing is behind the one it equals.
    place = F.struct("__acc", "__v")
    first = lambda t: F.coalesce(F.min(F.when(F.col("__acc") >= t(F.col("whole")), place)), F.max(place))["__v"]
    return acc.groupBy(*by).agg(F.first("whole").alias("whole"), *(first(t).alias(name) for name, t in targets.items()))


def index_percentiles(rows: DataFrame, by: list[str], value: str, **places) -> DataFrame:
    """One row a group: for each name the value at the place that a function of (n) gives, counted from 0 in ascending order."""
    def target(at):
        return lambda n: at(n) + 1

    return selected(rows, by, value, F.lit(1), **{name: target(at) for name, at in places.items()}).drop("whole")


def interpolated_percentiles(rows: DataFrame, by: list[str], value: str, **shares: float) -> DataFrame:
    """One row a group: percentiles at the place share * (n - 1), in proportion between the two values beside it. Null values don't count."""
    def beside(p: float, rounded):
        return lambda n: rounded(p * (n - 1)) + 1

    places = {f"{name}__{k}": beside(p, f) for name, p in shares.items() for k, f in (("low", F.floor), ("high", F.ceil))}
    found = selected(rows.where(F.col(value).isNotNull()), by, value, F.lit(1), **places)

    def between(name: str, p: float) -> Column:
        low, high, at = F.col(f"{name}__low"), F.col(f"{name}__high"), p * (F.col("whole") - 1)
        return low + (high - low) * (at - F.floor(at))

    return found.select(*by, *(between(name, p).alias(name) for name, p in shares.items()))


def share_of(p: float):
    """The place floor(n * p), the last at most."""
    return lambda n: F.least(n - 1, F.floor(n * p))


def quarter(k: int):
    return lambda n: F.floor(k * n / 4)


def nearest_rank(p: float):
    """The place p * (n - 1), halves to the even place."""
    return lambda n: F.rint(p * (n - 1)).cast("long")


def weighted_percentiles(rows: DataFrame, by: list[str], value: str, weight: str, **shares: float) -> DataFrame:
    """The first value whose running weight reaches a share of the whole."""
    def target(share: float):
        return lambda whole: share * whole

    return selected(rows, by, value, F.col(weight), **{name: target(s) for name, s in shares.items()}).drop("whole")


def zero_intercept(x: Column, y: Column) -> Column:
    """Aggregate: the slope of the least-squares line through the origin."""
    return F.sum(x * y) / F.sum(x * x)


def binned_median_slope(rows: DataFrame, by: list[str], share: Column, value: str, bins: int = 10, least: int = 50) -> DataFrame:
    """Slope through the origin of the medians of bins of ``share`` (0..1) that have enough rows, and how many those are."""
    placed = rows.withColumn("__bin", F.least(F.floor(share * bins).cast("long"), F.lit(bins - 1)))
    medians = placed.groupBy(*by, "__bin").agg(F.median(value).alias("__m"), F.count("*").alias("__n")).where(F.col("__n") >= least)
    middle = F.col("__bin") + 0.5
    return medians.groupBy(*by).agg(zero_intercept(middle, F.col("__m")).alias("slope"), F.count("*").alias("bins"))


def share_where(condition: Column) -> Column:
    """Aggregate: the share of rows for which ``condition`` holds, of those where it is known."""
    return F.avg(condition.cast("double"))


def confusion(rows: DataFrame, by: list[str], bucket: str, weight: str) -> DataFrame:
    """Rows and weight a bucket, and the bucket's share of its group's weight."""
    sums = rows.groupBy(*by, bucket).agg(F.count("*").alias("n"), F.sum(weight).alias("length"))
    return sums.withColumn("share", F.col("length") / F.sum("length").over(Window.partitionBy(*by)))


def lopsided(left: Column, right: Column) -> Column:
    """The larger side's share of both."""
    return F.greatest(left, right) / (left + right)


def canopy_share(classes: Column, tree: int = 1, nothing: int = 0, least: int = 30) -> Column:
    """Aggregate: the share of tree pixels among valid ones; null for too few."""
    valid = classes != nothing
    return F.when(F.count_if(valid) >= least, F.avg(F.when(valid, (classes == tree).cast("double"))))


def raster_fraction(strips: DataFrame, pixels: DataFrame, half_width: float, size: float) -> DataFrame:
    """(edge_id, fraction, valid): tree share of the pixels (col, row, class) whose centres lie within a strip about a segment.

    ``strips``: edge_id, ax, ay, bx, by in pixels' metres. Pixel ranges of a strip's box are joined by equality;
    a window of fewer than two pixels either way gives null.
    """
    from parasol.functions.geometry import cell, segment_distance

    low = lambda a, b: cell(F.least(a, b) - half_width, size)
    high = lambda a, b: cell(F.greatest(a, b) + half_width, size)
    x = (low(F.col("ax"), F.col("bx")), high(F.col("ax"), F.col("bx")))
    y = (low(F.col("ay"), F.col("by")), high(F.col("ay"), F.col("by")))
    wide = strips.withColumn("thin", (x[1] - x[0] < 1) | (y[1] - y[0] < 1)).withColumn("col", F.explode(F.sequence(*x))).withColumn("row", F.explode(F.sequence(*y)))
    px, py = (F.col("col") + 0.5) * size, (F.col("row") + 0.5) * size
    inside = wide.where(segment_distance(px, py, *(F.col(c) for c in ("ax", "ay", "bx", "by"))) <= half_width).join(pixels, ["col", "row"])
    out = inside.groupBy("edge_id").agg(F.when(~F.max("thin"), canopy_share(F.col("class"))).alias("fraction"), F.count_if(F.col("class") != 0).alias("valid"))
    return strips.select("edge_id").distinct().join(out, "edge_id", "left").select("edge_id", "fraction", F.coalesce("valid", F.lit(0)).alias("valid"))
