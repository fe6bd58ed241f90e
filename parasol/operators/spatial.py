"""Spatial joins as grid equi-joins: Catalyst sees a hash join on cells and an exact filter, never a cross join.

The line side is replicated to every cell of its box grown by the cap; a point
lies in one cell. Cells are at least as large as the cap, so replicas are few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from parasol.functions.geometry import cell, segment_distance
from parasol.operators.skew import shuffled

SEGMENT = ("ax", "ay", "bx", "by")


def spread(lines: DataFrame, cap: float, size: float) -> DataFrame:
    """Adds a row per cell (cx, cy) that a segment's box, grown by ``cap``, touches."""
    low_x, high_x = F.least("ax", "bx") - cap, F.greatest("ax", "bx") + cap
    low_y, high_y = F.least("ay", "by") - cap, F.greatest("ay", "by") + cap
    wide = lines.withColumn("cx", F.explode(F.sequence(cell(low_x, size), cell(high_x, size))))
    return wide.withColumn("cy", F.explode(F.sequence(cell(low_y, size), cell(high_y, size))))


def within(points: DataFrame, lines: DataFrame, cap: float, size: float | None = None) -> DataFrame:
    """Pairs of points (px, py) and segments no more than ``cap`` apart, with their distance d."""
    size = max(size or 4 * cap, cap)
    placed = points.withColumn("cx", cell(F.col("px"), size)).withColumn("cy", cell(F.col("py"), size))
    d = segment_distance(*(F.col(c) for c in ("px", "py", *SEGMENT)))
    return placed.join(shuffled(spread(lines, cap, size)), ["cx", "cy"]).drop("cx", "cy").withColumn("d", d).where(F.col("d") <= cap)


def nearest(points: DataFrame, lines: DataFrame, cap: float, key: str, target: str, group: str) -> DataFrame:
    """Per point: the nearest line within ``cap`` (ties to the smaller id) and the distance of the nearest of another group."""
    pairs = within(points, lines, cap).groupBy(key, target, group).agg(F.min("d").alias("d"))
    by_group = pairs.groupBy(key, group).agg(F.min(F.struct("d", target)).alias("b"))
    ranked = by_group.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy("b.d", f"b.{target}")))
    top = ranked.where("r <= 2").groupBy(key)
    first = F.when(F.col("r") == 1, F.struct(F.col(f"b.{target}").alias("t"), F.col("b.d").alias("d")))
    two = top.agg(F.max(first).alias("f"), F.max(F.when(F.col("r") == 2, F.col("b.d"))).alias("runner_up_m"))
    return two.select(key, F.col("f.t").alias(target), F.col("f.d").alias("distance_m"), "runner_up_m")


def closest(points: DataFrame, lines: DataFrame, cap: float, key: str, target: str) -> DataFrame:
    """Per point: the nearest line within ``cap`` (ties to the smaller id). A task holds one pair a point, not all of them."""
    best = within(points, lines, cap).groupBy(key).agg(F.min(F.struct("d", target)).alias("b"))
    return best.select(key, f"b.{target}", F.col("b.d").alias("distance_m"))


def slices(lines: DataFrame, step: float) -> DataFrame:
    """Slice centres of straight lines: px, py and the slice's metres; at least one slice each."""
    length = F.sqrt(F.pow(F.col("bx") - F.col("ax"), 2) + F.pow(F.col("by") - F.col("ay"), 2))
    n = F.greatest(F.ceil(length / step), F.lit(1)).cast("int")
    rows = lines.withColumn("n", n).withColumn("metres", length / F.col("n")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    t = (F.col("i") + 0.5) / F.col("n")
    return rows.withColumn("px", F.col("ax") + t * (F.col("bx") - F.col("ax"))).withColumn("py", F.col("ay") + t * (F.col("by") - F.col("ay"))).drop("n", *SEGMENT)


def length_profile(edges: DataFrame, faces: DataFrame, step: float, cap: float) -> DataFrame:
    """(edge_id, face_id, metres): each slice's metres go to the nearest face line within ``cap``, or to none."""
    samples = slices(edges, step).select(F.struct("edge_id", "i").alias("probe"), "px", "py", "metres")
    hits = within(samples, faces, cap).groupBy("probe", "metres").agg(F.min(F.struct("d", "face_id")).alias("b"))
    return hits.groupBy(F.col("probe.edge_id").alias("edge_id"), F.col("b.face_id").alias("face_id")).agg(F.sum("metres").alias("metres"))


def compass_side(vectors: DataFrame, key: str, least: float = 0.8, margin: float = 5.0) -> DataFrame:
    """N, E, S, W or '' from unit vectors (dx, dy): the mean's direction, after one rejection of a minority more than 90 degrees off."""

    def mean(rows: DataFrame) -> DataFrame:
        return rows.groupBy(key).agg(F.sum("dx").alias("sx"), F.sum("dy").alias("sy"), F.count("*").alias("n")).withColumn("r", F.sqrt(F.col("sx") ** 2 + F.col("sy") ** 2) / F.col("n"))

    def angle(x: Column, y: Column) -> Column:
        return F.pmod(F.degrees(F.atan2(x, y)), F.lit(360.0))

    def apart(a: Column, b: Column) -> Column:
        d = F.pmod(F.abs(a - b), F.lit(360.0))
        return F.least(d, 360.0 - d)

    first = mean(vectors)
    again = vectors.join(first.where(F.col("r") < least).select(key, "sx", "sy", F.col("n").alias("all")), key)
    kept = again.where(apart(angle(F.col("dx"), F.col("dy")), angle(F.col("sx"), F.col("sy"))) <= 90).select(key, "dx", "dy", "all")
    second = mean(kept).join(again.select(key, "all").distinct(), key).where(F.col("n") * 2 > F.col("all")).drop("all")
    good = first.where(F.col("r") >= least).unionByName(second.where(F.col("r") >= least))
    way = angle(F.col("sx"), F.col("sy"))
    nearest_quarter = F.pmod(F.round(way / 90.0), F.lit(4.0)).cast("int")
    word = F.when(apart(way, nearest_quarter * 90.0) <= 45.0 - margin, F.element_at(F.array(*map(F.lit, "NESW")), nearest_quarter + 1)).otherwise("")
    return vectors.select(key).distinct().join(good.select(key, word.alias("side")), key, "left").select(key, F.coalesce("side", F.lit("")).alias("side"))


def march(points: DataFrame, grid: DataFrame, size: float, step: float, azimuth: float, tangent: float, reach: float) -> DataFrame:
    """Whether each point (point_id, px, py) is in the shadow of a grid (cx, cy, height): some hop towards the sun is below a cell's height."""
    import math

    hops = int(reach // step)
    sx, sy = math.sin(math.radians(azimuth)), math.cos(math.radians(azimuth))
    h = points.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(hops))))
    h = h.withColumn("cx", cell(F.col("px") + F.col("k") * step * sx, size)).withColumn("cy", cell(F.col("py") + F.col("k") * step * sy, size))
    hit = h.join(shuffled(grid), ["cx", "cy"]).where(F.col("height") >= F.col("k") * step * tangent).select("point_id").distinct()
    return points.join(shuffled(hit.withColumn("hit", F.lit(True))), "point_id", "left").select("point_id", F.coalesce("hit", F.lit(False)).alias("shaded"))


def rasterise(boxes: DataFrame, size: float) -> DataFrame:
    """Cells whose centre lies in a box (x0, y0, x1, y1, height); the tallest wins."""
    grid = boxes.withColumn("cx", F.explode(F.sequence(cell(F.col("x0"), size), cell(F.col("x1"), size)))).withColumn("cy", F.explode(F.sequence(cell(F.col("y0"), size), cell(F.col("y1"), size))))
    mx, my = (F.col("cx") + 0.5) * size, (F.col("cy") + 0.5) * size
    inside = (mx > F.col("x0")) & (mx < F.col("x1")) & (my > F.col("y0")) & (my < F.col("y1"))
    return grid.where(inside).groupBy("cx", "cy").agg(F.max("height").alias("height"))
