"""Areas of unions and overlaps of polygons of any shape, self-crossing ones included.

Boundaries are cut wherever they meet, which is an equi-join of segments on grid
cells. A piece of boundary then has one answer on each of its sides: inside which
shapes. Pieces that two shapes share are one piece. The area of anything that is
said of insides ("in one of them", "in both") is the sum over the pieces at which
the answer changes, so nothing needs to be stitched to rings, and no shape, group
or boundary is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from parasol.functions.geometry import cell
from parasol.functions.lines import bounds, contains, pairs
from parasol.operators.spatial import spread

#: Metres beside a piece at which its sides are tested; what is narrower counts as nothing.
BESIDE_M = 1e-6
PIECE = ["key", "ax", "ay", "bx", "by"]


def boundary(shapes: DataFrame) -> DataFrame:
    """Segments (key, sid, ax, ay, bx, by) of the rings of shapes (key, part, polygon); a ring need not repeat its first point."""
    rings = shapes.select("key", "part", F.posexplode("polygon").alias("r", "ring")).where(F.size("ring") > 2)
    closed = F.concat("ring", F.slice("ring", 1, 1))
    lines = rings.select("key", "part", "r", F.posexplode(pairs(closed)).alias("i", "s")).where(F.col("s.len") > 0)
    return lines.select("key", F.struct("part", "r", "i").alias("sid"), "s.ax", "s.ay", "s.bx", "s.by")


def cuts(segments: DataFrame, size: float) -> DataFrame:
    """(key, sid, ts): the places, between 0 and 1, where other segments of the key meet a segment."""
    here = spread(segments, 0.0, size)
    other = here.select("key", "cx", "cy", *(F.col(c).alias(f"o_{c}") for c in ("sid", "ax", "ay", "bx", "by")))
    met = here.join(other, ["key", "cx", "cy"]).where(F.col("sid") != F.col("o_sid"))
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    ex, ey = F.col("o_bx") - F.col("o_ax"), F.col("o_by") - F.col("o_ay")
    wx, wy = F.col("o_ax") - F.col("ax"), F.col("o_ay") - F.col("ay")
    square = dx * dx + dy * dy
    turn = dx * ey - dy * ex
    parallel = F.abs(turn) <= 1e-12 * F.sqrt(square * (ex * ex + ey * ey))
    t, u = (wx * ey - wy * ex) / F.nullif(turn, F.lit(0.0)), (wx * dy - wy * dx) / F.nullif(turn, F.lit(0.0))
    crossing = F.when((u >= -1e-12) & (u <= 1 + 1e-12), F.array(t)).otherwise(F.array().cast("array<double>"))
    on_line = F.abs(wx * dy - wy * dx) <= 1e-9 * F.sqrt(square)
    shared = F.when(on_line, F.array((wx * dx + wy * dy) / square, ((wx + ex) * dx + (wy + ey) * dy) / square)).otherwise(F.array().cast("array<double>"))
    at = met.select("key", "sid", F.explode(F.when(parallel, shared).otherwise(crossing)).alias("t")).where("t > 1e-12 and t < 1 - 1e-12")
    return at.groupBy("key", "sid").agg(F.collect_set("t").alias("ts"))


def pieces(shapes: DataFrame, size: float) -> DataFrame:
    """The boundary cut wherever it meets itself (PIECE), what several shapes share once."""
    segments = boundary(shapes)
    places = F.concat(F.array(F.lit(0.0)), F.sort_array(F.coalesce("ts", F.array().cast("array<double>"))), F.array(F.lit(1.0)))
    cut_up = segments.join(cuts(segments, size), ["key", "sid"], "left").withColumn("places", places)
    spans = F.zip_with(F.slice("places", F.lit(1), F.size("places") - 1), F.slice("places", F.lit(2), F.size("places") - 1), lambda a, b: F.struct(a.alias("from"), b.alias("to")))
    ends = cut_up.select("key", "ax", "ay", "bx", "by", F.explode(spans).alias("s"))

    def at(a: str, b: str, t: str) -> Column:
        return F.when(F.col(t) == 1, F.col(b)).otherwise(F.col(a) + F.col(t) * (F.col(b) - F.col(a)))

    points = ends.select("key", *(at(a, b, t).alias(n) for a, b, t, n in (("ax", "bx", "s.from", "x0"), ("ay", "by", "s.from", "y0"), ("ax", "bx", "s.to", "x1"), ("ay", "by", "s.to", "y1"))))
    # Ends are ordered as rounded ones, so that what two shapes share is the same piece for both.
    one, two = (F.struct(F.round(x, 6).alias("rx"), F.round(y, 6).alias("ry"), F.col(x).alias("x"), F.col(y).alias("y")) for x, y in (("x0", "y0"), ("x1", "y1")))
    turned = points.select("key", F.least(one, two).alias("p"), F.greatest(one, two).alias("q"))
    same = [F.col(f"{e}.{c}").alias(f"{e}{c}") for e in "pq" for c in ("rx", "ry")]
    once = turned.groupBy("key", *same).agg(F.min(F.struct("p", "q")).alias("e")).where("prx <> qrx or pry <> qry")
    return once.select("key", F.col("e.p.x").alias("ax"), F.col("e.p.y").alias("ay"), F.col("e.q.x").alias("bx"), F.col("e.q.y").alias("by"))


def overlay_areas(shapes: DataFrame, size: float) -> DataFrame:
    """Areas by key of shapes (key, side "a" or "b", part, polygon): area_a, area_b, area_union, area_both.

    ``polygon`` is an array of rings, inside by the even-odd rule, which also
    mends rings that cross themselves; ``part`` names a shape within its key.
    Shapes of one side may overlap and count once. Keys without any area, null
    keys and shapes without rings of three points give no row. ``size`` is the
    side of a grid cell, best about a shape's.
    """
    shapes = shapes.where("key is not null and polygon is not null")
    cut_up = pieces(shapes.select("key", "part", "polygon"), size)
    length = F.sqrt(F.pow(F.col("bx") - F.col("ax"), 2) + F.pow(F.col("by") - F.col("ay"), 2))

    def beside(sign: int) -> Column:
        x = (F.col("ax") + F.col("bx")) / 2 - sign * BESIDE_M * (F.col("by") - F.col("ay")) / length
        y = (F.col("ay") + F.col("by")) / 2 + sign * BESIDE_M * (F.col("bx") - F.col("ax")) / length
        return F.struct(F.lit(sign).alias("sign"), x.alias("px"), y.alias("py"))

    asked = cut_up.select(*PIECE, F.explode(F.array(beside(1), beside(-1))).alias("b")).select(*PIECE, "b.*")
    asked = asked.withColumn("cx", cell(F.col("px"), size)).withColumn("cy", cell(F.col("py"), size))
    x0, y0, x1, y1 = bounds(F.col("polygon"))
    wide = shapes.select("key", "side", "polygon", F.explode(F.sequence(cell(x0, size), cell(x1, size))).alias("cx"), cell(y0, size).alias("cy0"), cell(y1, size).alias("cy1"))
    placed = wide.select("key", "side", "polygon", "cx", F.explode(F.sequence("cy0", "cy1")).alias("cy"))
    hits = asked.join(placed, ["key", "cx", "cy"]).where(contains(F.col("polygon"), F.col("px"), F.col("py")))

    def within(side: str, sign: int) -> Column:
        return F.max(F.when((F.col("side") == side) & (F.col("sign") == sign), 1).otherwise(0))

    sides = hits.groupBy(*PIECE).agg(*(within(s, n).alias(f"{s}{'l' if n > 0 else 'r'}") for s in "ab" for n in (1, -1)))
    twice = F.col("ax") * F.col("by") - F.col("bx") * F.col("ay")

    def area(left: Column, right: Column) -> Column:
        return F.sum((left - right) * twice / 2)

    both = F.col("al") * F.col("bl"), F.col("ar") * F.col("br")
    either = F.greatest("al", "bl"), F.greatest("ar", "br")
    return sides.groupBy("key").agg(
        area(F.col("al"), F.col("ar")).alias("area_a"), area(F.col("bl"), F.col("br")).alias("area_b"), area(*either).alias("area_union"), area(*both).alias("area_both")
    )


def named(polygons: DataFrame, column: str, name: str, listed: int = 100) -> DataFrame:
    """The polygons called ``name``, case and outer spaces aside; an error that lists the first names if there are none."""
    found = polygons.where(F.lower(F.trim(F.col(column))) == name.strip().lower())
    if found.isEmpty():
        known = [r[0] for r in polygons.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).limit(listed).collect()]
        raise ValueError(f"no polygon is named {name!r}; there are {', '.join(map(str, known)) or 'none'}")
    return found
