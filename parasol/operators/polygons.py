"""Joins of points with polygons: grid equi-joins on bounding boxes, refined by the even-odd rule.

A polygon (a column of rings) is replicated to the cells that its box touches; a
point lies in one. Polygons that cover many cells should come with a cell size of
about their own; the grid's size is a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from parasol.functions.geometry import cell
from parasol.functions.lines import bounds, contains, in_any, shadow_parts
from parasol.operators.skew import shuffled
from parasol.operators.spatial import within


def _cells(rows: DataFrame, box: tuple[Column, Column, Column, Column], size: float) -> DataFrame:
    x0, y0, x1, y1 = box
    wide = rows.withColumn("cx", F.explode(F.sequence(cell(x0, size), cell(x1, size))))
    return wide.withColumn("cy", F.explode(F.sequence(cell(y0, size), cell(y1, size))))


def _placed(points: DataFrame, size: float) -> DataFrame:
    return points.withColumn("cx", cell(F.col("px"), size)).withColumn("cy", cell(F.col("py"), size))


def inside(points: DataFrame, polygons: DataFrame, size: float, rings: str = "polygon") -> DataFrame:
    """Pairs of points (px, py) and polygons that contain them; a boundary is outside."""
    cells = shuffled(_cells(polygons, bounds(F.col(rings)), size))
    return _placed(points, size).join(cells, ["cx", "cy"]).where(contains(F.col(rings), F.col("px"), F.col("py"))).drop("cx", "cy")


def in_boxes(points: DataFrame, boxes: DataFrame, size: float, closed: bool = False) -> DataFrame:
    """Pairs of points and boxes (x0, y0, x1, y1) that they are in."""
    cells = shuffled(_cells(boxes, tuple(F.col(c) for c in ("x0", "y0", "x1", "y1")), size))
    x, y = F.col("px"), F.col("py")
    test = x.between(F.col("x0"), F.col("x1")) & y.between(F.col("y0"), F.col("y1")) if closed else (x > F.col("x0")) & (x < F.col("x1")) & (y > F.col("y0")) & (y < F.col("y1"))
    return _placed(points, size).join(cells, ["cx", "cy"]).where(test).drop("cx", "cy")


def shadow_sweep(points: DataFrame, prisms: DataFrame, azimuth: float, tangent: float, size: float) -> DataFrame:
    """Pairs of points and prisms (ring, height) whose shadow they are in, the sun at an azimuth and a tangent of its elevation."""
    import math

    back = math.radians(azimuth + 180.0)
    dx, dy = (F.col("height") / tangent * f(back) for f in (math.sin, math.cos))
    swept = prisms.withColumn("__parts", shadow_parts(F.col("ring"), dx, dy))
    box = [F.col(f"__{c}") for c in ("x0", "y0", "x1", "y1")]
    swept = swept.withColumns(dict(zip(("__x0", "__y0", "__x1", "__y1"), bounds(F.col("__parts")), strict=True)))
    met = _placed(points, size).join(shuffled(_cells(swept, tuple(box), size)), ["cx", "cy"])
    # Most pairs are told apart by the shadow's box, grown by more than a seam's breadth.
    near = F.col("px").between(box[0] - 1e-3, box[2] + 1e-3) & F.col("py").between(box[1] - 1e-3, box[3] + 1e-3)
    return met.where(F.when(near, in_any(F.col("__parts"), F.col("px"), F.col("py"))).otherwise(False)).drop("cx", "cy", "__parts", "__x0", "__y0", "__x1", "__y1")


def rasterise(prisms: DataFrame, size: float) -> DataFrame:
    """Cells (cx, cy, height) whose centres lie in a prism's ring; the tallest wins."""
    cells = _cells(prisms, bounds(F.array("ring")), size)
    centre = (F.col("cx") + 0.5) * size, (F.col("cy") + 0.5) * size
    return cells.where(contains(F.array("ring"), *centre)).groupBy("cx", "cy").agg(F.max("height").alias("height"))


def by_tile(points: DataFrame, boxes: DataFrame, tile: float, margin: float) -> DataFrame:
    """Points with the boxes that reach their tile or its margin: the pairs that one tile of work needs."""
    grown = (F.col("x0") - margin, F.col("y0") - margin, F.col("x1") + margin, F.col("y1") + margin)
    return _placed(points, tile).join(shuffled(_cells(boxes, grown, tile)), ["cx", "cy"]).withColumnRenamed("cx", "tile_x").withColumnRenamed("cy", "tile_y")


def median_probe_distance(probes: DataFrame, segments: DataFrame, cap: float, line: str, target: str) -> DataFrame:
    """(line, target, d): the upper median of a line's probes' distances to a target, where it is within ``cap``.

    Distances beyond the cap count as larger than all others, so they need not be known.
    probes: line, i, px, py, n (the line's probes); segments: target, ax, ay, bx, by.
    """
    pairs = within(probes, segments, cap).groupBy(line, "n", "i", target).agg(F.min("d").alias("d"))
    ranked = pairs.groupBy(line, "n", target).agg(F.array_sort(F.collect_list("d")).alias("ds"))
    return ranked.where(F.size("ds") > F.floor(F.col("n") / 2)).select(line, target, F.element_at("ds", (F.floor(F.col("n") / 2) + 1).cast("int")).alias("d"))
