"""Polylines and rings as column functions: arrays of [x, y], flat metres unless a function says otherwise."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from parasol.functions.geometry import LAT_M, LON_M

#: Metres a probe stands for at least, least probes, half the chord of a local bearing.
PROBE_M, LEAST_PROBES, CHORD_M = 10.0, 3, 2.0


def let(value: Column, of) -> Column:
    """``of(value)`` with the value computed once, whatever ``of`` does with it."""
    return F.element_at(F.transform(F.array(value), of), 1)


def pairs(line: Column) -> Column:
    """Structs (ax, ay, bx, by, len) of a line's segments; none for fewer than two vertices. The line is computed once."""
    def segment(a: Column, b: Column) -> Column:
        return F.struct(a[0].alias("ax"), a[1].alias("ay"), b[0].alias("bx"), b[1].alias("by"), F.sqrt(F.pow(b[0] - a[0], 2) + F.pow(b[1] - a[1], 2)).alias("len"))

    def cut(l: Column) -> Column:
        count = F.greatest(F.size(l) - 1, F.lit(0))
        return F.zip_with(F.slice(l, F.lit(1), count), F.slice(l, F.lit(2), count), segment)

    return let(line, cut)


def length(line: Column) -> Column:
    return F.aggregate(pairs(line), F.lit(0.0), lambda a, s: a + s["len"])


def interpolate(line: Column, metres: Column) -> Column:
    """The point [x, y] so far along a line, its ends beyond them."""
    return let(F.struct(line.alias("line"), metres.cast("double").alias("metres")), lambda a: _interpolate(a["line"], a["metres"]))


def _interpolate(line: Column, metres: Column) -> Column:
    def walk(state: Column, s: Column) -> Column:
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (metres - state["upto"]) / F.nullif(s["len"], F.lit(0.0))))
        here = F.struct((state["upto"] + s["len"]).alias("upto"), (s["ax"] + F.coalesce(t, F.lit(0.0)) * (s["bx"] - s["ax"])).alias("x"), (s["ay"] + F.coalesce(t, F.lit(0.0)) * (s["by"] - s["ay"])).alias("y"))
        return F.when((state["upto"] < metres) | state["x"].isNull(), here).otherwise(state)

    start = F.struct(F.lit(0.0).alias("upto"), F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"))
    end = F.aggregate(pairs(line), start, walk)
    return F.when(F.size(line) > 0, let(end, lambda e: F.array(F.coalesce(e["x"], F.element_at(line, 1)[0]), F.coalesce(e["y"], F.element_at(line, 1)[1]))))


def halfway(line: Column) -> Column:
    """The point half way by length, which is not the middle vertex."""
    return let(line, lambda l: _interpolate(l, length(l) / 2))


def project(line: Column, px: Column, py: Column) -> Column:
    """(d, at): the distance to a line and how far along it the nearest point lies; of equally near points the first."""
    def nearer(state: Column, s: Column) -> Column:
        dx, dy = s["bx"] - s["ax"], s["by"] - s["ay"]
        t = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - s["ax"]) * dx + (py - s["ay"]) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)))), F.lit(0.0))

        def moved(t: Column) -> Column:
            d = F.sqrt(F.pow(px - s["ax"] - t * dx, 2) + F.pow(py - s["ay"] - t * dy, 2))
            closer = d < state["d"]
            return F.struct((state["upto"] + s["len"]).alias("upto"), F.when(closer, d).otherwise(state["d"]).alias("d"), F.when(closer, state["upto"] + t * s["len"]).otherwise(state["at"]).alias("at"))

        return let(t, moved)

    nothing = F.struct(F.lit(0.0).alias("upto"), F.lit(float("inf")).alias("d"), F.lit(0.0).alias("at"))
    return F.aggregate(pairs(line), nothing, nearer, lambda s: F.struct(s["d"].alias("d"), s["at"].alias("at")))


def measured(line: Column) -> Column:
    """The segments of ``pairs`` with ``upto``, the metres before each."""
    def add(state: Column, s: Column) -> Column:
        here = s.withField("upto", state["upto"])
        return F.struct((state["upto"] + s["len"]).alias("upto"), F.array_append(state["kept"], here).alias("kept"))

    none = F.from_json(F.lit("[]"), "array<struct<ax double, ay double, bx double, by double, len double, upto double>>")
    return F.aggregate(pairs(line), F.struct(F.lit(0.0).alias("upto"), none.alias("kept")), add, lambda s: s["kept"])


def probe_count(total: Column) -> Column:
    """How many probes a line of some metres has."""
    return F.greatest(F.lit(LEAST_PROBES), F.floor(total / PROBE_M)).cast("int")


def probes(line: Column) -> Column:
    """Points spread evenly over a line, its ends included: one for ten metres, three at least.

    Each segment gives the probes that lie on it, so the work is in proportion to segments and probes.
    """
    def spread(a: Column) -> Column:
        last = a["n"] - 1
        end = lambda upto: F.floor(upto * last / a["total"]).cast("int")

        def on(s: Column, j: Column) -> Column:
            low = F.when(j == 0, 0).otherwise(end(s["upto"]) + 1)
            high = F.when(j == F.size(a["segments"]) - 1, last).otherwise(end(s["upto"] + s["len"]))

            def at(i: Column) -> Column:
                t = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (a["total"] * i / last - s["upto"]) / F.nullif(s["len"], F.lit(0.0)))), F.lit(0.0))
                return let(t, lambda t: F.array(s["ax"] + t * (s["bx"] - s["ax"]), s["ay"] + t * (s["by"] - s["ay"])))

            return let(F.struct(low.alias("low"), high.alias("high")), lambda r: F.when(r["low"] <= r["high"], F.transform(F.sequence(r["low"], r["high"]), at)).otherwise(F.array().cast("array<array<double>>")))

        return F.when(a["total"] > 0, F.flatten(F.transform(a["segments"], on))).otherwise(F.array_repeat(a["first"], LEAST_PROBES))

    def sized(segments: Column) -> Column:
        tail = F.element_at(segments, -1)
        return let(tail["upto"] + tail["len"], lambda total: let(F.struct(
            segments.alias("segments"), total.alias("total"), probe_count(total).alias("n"),
            F.array(segments[0]["ax"], segments[0]["ay"]).alias("first")), spread))

    return let(measured(line), lambda m: F.when(F.size(m) > 0, sized(m)))


def slice_points(line: Column, step: float, offset: float = 0.0) -> Column:
    """Structs (x, y, metres) of a line's slices, taken at their centres; ``offset``: metres to the left of the line."""
    def cut(line: Column, total: Column) -> Column:
        n = F.greatest(F.ceil(total / step), F.lit(1)).cast("int")

        def point(i: Column) -> Column:
            at = total * (i + 0.5) / n
            def aside(p: Column) -> Column:
                back, on = interpolate(line, at - 0.01), interpolate(line, at + 0.01)
                def turned(d: Column) -> Column:
                    size = F.sqrt(d["x"] * d["x"] + d["y"] * d["y"])
                    return F.struct((p[0] - offset * F.coalesce(d["y"] / F.nullif(size, F.lit(0.0)), F.lit(0.0))).alias("x"), (p[1] + offset * F.coalesce(d["x"] / F.nullif(size, F.lit(0.0)), F.lit(0.0))).alias("y"), (total / n).alias("metres"))

                return let(F.struct((on[0] - back[0]).alias("x"), (on[1] - back[1]).alias("y")), turned)

            return let(interpolate(line, at), aside)

        return F.transform(F.sequence(F.lit(0), n - 1), point)

    return let(line, lambda l: F.when(F.size(l) > 1, let(length(l), lambda total: cut(l, total))))


def local_bearing(line: Column, metres: Column) -> Column:
    """Undirected bearing of the chord of four metres about a place; null where it has no length."""
    ends = let(line, lambda l: F.struct(interpolate(l, F.greatest(metres - CHORD_M, F.lit(0.0))).alias("a"), interpolate(l, metres + CHORD_M).alias("b")))
    return let(ends, lambda c: F.when((c["a"][0] != c["b"][0]) | (c["a"][1] != c["b"][1]), F.pmod(F.degrees(F.atan2(c["b"][0] - c["a"][0], c["b"][1] - c["a"][1])), F.lit(180.0))))


def substring(line: Column, start: Column, end: Column) -> Column:
    """The part of a line between two places along it; backwards if the second comes first."""
    def forward(low: Column, high: Column, line: Column) -> Column:
        def keep(state: Column, s: Column) -> Column:
            at = state["upto"] + s["len"]
            inside = (at > low) & (at < high)
            return F.struct(at.alias("upto"), F.when(inside, F.array_append(state["kept"], F.array(s["bx"], s["by"]))).otherwise(state["kept"]).alias("kept"))

        none = F.struct(F.lit(0.0).alias("upto"), F.array().cast("array<array<double>>").alias("kept"))
        inner = F.aggregate(pairs(line), none, keep, lambda s: s["kept"])
        return F.concat(F.array(interpolate(line, low)), inner, F.array(interpolate(line, high)))

    def turned(a: Column) -> Column:
        return let(forward(F.least(a["start"], a["end"]), F.greatest(a["start"], a["end"]), a["line"]), lambda p: F.when(a["start"] <= a["end"], p).otherwise(F.reverse(p)))

    return let(F.struct(line.alias("line"), start.alias("start"), end.alias("end")), turned)


def stitch(lines: Column) -> Column:
    """One line of several that follow each other, each turned so that its nearer end comes first, the joints once."""
    def near(a: Column, b: Column) -> Column:
        return F.pow(a[0] - b[0], 2) + F.pow(a[1] - b[1], 2)

    first = F.element_at(lines, 1)
    # The first line is turned by the second one's nearer end.
    after = F.try_element_at(lines, F.lit(2))
    gap = lambda p: F.least(near(p, F.element_at(after, 1)), near(p, F.element_at(after, -1)))
    begun = F.when(after.isNotNull() & (gap(F.element_at(first, 1)) < gap(F.element_at(first, -1))), F.reverse(first)).otherwise(first)

    def join(state: Column, line: Column) -> Column:
        end = F.element_at(state, -1)
        turned = F.when(near(F.element_at(line, -1), end) < near(F.element_at(line, 1), end), F.reverse(line)).otherwise(line)
        same = near(F.element_at(turned, 1), end) <= 1e-18
        return F.concat(state, F.when(same, F.slice(turned, 2, F.greatest(F.size(turned) - 1, F.lit(0)))).otherwise(turned))

    whole = F.aggregate(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), begun, join)
    return F.when(F.size(lines) > 0, F.when(F.size(whole) == 1, F.concat(whole, whole)).otherwise(whole))


def simplify(line: Column, tolerance: float, geographic: bool = False) -> Column:
    """Douglas-Peucker: the vertices that a line needs to stay within ``tolerance``; of degrees, longitudes scaled, if ``geographic``.

    Ranges that still have a vertex too far off are halved at it, over and over, on a stack in an ``aggregate``.
    """
    scale = math.cos(math.radians(40.7)) if geographic else 1.0

    def off(p: Column, a: Column, b: Column) -> Column:
        dx, dy = (b[0] - a[0]) * scale, b[1] - a[1]
        ex, ey = (p[0] - a[0]) * scale, p[1] - a[1]
        t = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (ex * dx + ey * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)))), F.lit(0.0))
        return F.sqrt(F.pow(ex - t * dx, 2) + F.pow(ey - t * dy, 2))

    def farthest(lo: Column, hi: Column) -> Column:
        a, b = F.element_at(line, lo), F.element_at(line, hi)
        within = F.when(hi - lo > 1, F.sequence(lo + 1, hi - 1)).otherwise(F.array().cast("array<int>"))
        return F.array_max(F.transform(within, lambda i: F.struct(off(F.element_at(line, i), a, b).alias("d"), (-i).alias("i"))))

    def step(state: Column, _: Column) -> Column:
        top = F.element_at(state["stack"], -1)

        def done(f: Column) -> Column:
            rest = F.slice(state["stack"], 1, F.size(state["stack"]) - 1)
            at = -f["i"]
            more = F.array(F.struct(top["lo"].alias("lo"), at.alias("hi")), F.struct(at.alias("lo"), top["hi"].alias("hi")))
            cut = f.isNotNull() & (f["d"] > tolerance)
            return F.struct(F.when(cut, F.concat(rest, more)).otherwise(rest).alias("stack"), F.when(cut, F.array_append(state["kept"], at)).otherwise(state["kept"]).alias("kept"))

        return F.when(F.size(state["stack"]) > 0, let(farthest(top["lo"], top["hi"]), done)).otherwise(state)

    n = F.size(line)
    start = F.struct(F.array(F.struct(F.lit(1).alias("lo"), n.alias("hi"))).alias("stack"), F.array(F.lit(1), n).alias("kept"))
    kept = F.aggregate(F.sequence(F.lit(1), 2 * n), start, step, lambda s: F.array_sort(F.array_distinct(s["kept"])))
    return F.when(n > 2, F.transform(kept, lambda i: F.element_at(line, i))).otherwise(line)


# Rings: closed or open arrays of vertices; a polygon is an array of rings, holes among them.


def edges_of(ring: Column) -> Column:
    """Segments of a ring, the closing one included."""
    return pairs(F.array_append(ring, F.element_at(ring, 1)))


def crosses(px: Column, py: Column, s: Column) -> Column:
    """Whether a ray to the right of a point crosses a segment."""
    at = (s["bx"] - s["ax"]) * (py - s["ay"]) / F.nullif(s["by"] - s["ay"], F.lit(0.0)) + s["ax"]
    return F.coalesce(((s["ay"] > py) != (s["by"] > py)) & (px < at), F.lit(False))


def on_edge(px: Column, py: Column, s: Column) -> Column:
    """Whether a point lies on a segment, to a billionth of a metre or so for corners that were computed."""
    cross = (s["bx"] - s["ax"]) * (py - s["ay"]) - (s["by"] - s["ay"]) * (px - s["ax"])
    near = F.abs(cross) <= 1e-9 * F.greatest(s["len"], F.lit(1.0))
    pad = 1e-9
    return near & px.between(F.least(s["ax"], s["bx"]) - pad, F.greatest(s["ax"], s["bx"]) + pad) & py.between(F.least(s["ay"], s["by"]) - pad, F.greatest(s["ay"], s["by"]) + pad)


def contains(polygon: Column, px: Column, py: Column) -> Column:
    """Whether a point is inside a polygon by the even-odd rule over all its rings; its boundary is outside."""
    segments = F.flatten(F.transform(polygon, edges_of))
    count = F.aggregate(segments, F.lit(0), lambda a, s: a + crosses(px, py, s).cast("int"))
    return (count % 2 == 1) & ~F.exists(segments, lambda s: on_edge(px, py, s))


def ring_area(ring: Column) -> Column:
    """Signed area by the shoelace, positive against the clock."""
    return F.aggregate(edges_of(ring), F.lit(0.0), lambda a, s: a + (s["ax"] * s["by"] - s["bx"] * s["ay"])) / 2


def area(polygon: Column) -> Column:
    """The outer ring's area less those of the holes, which are the rings after the first."""
    holes = F.aggregate(F.slice(polygon, 2, F.greatest(F.size(polygon) - 1, F.lit(0))), F.lit(0.0), lambda a, r: a + F.abs(ring_area(r)))
    return F.abs(ring_area(F.element_at(polygon, 1))) - holes


def hectares(polygon: Column, lat: float = 40.7) -> Column:
    """The area of a polygon in degrees, by the metres that a degree has at a latitude."""
    return area(polygon) * (LON_M * math.cos(math.radians(lat)) * LAT_M / 10_000)


def clip(ring: Column, convex: Column) -> Column:
    """The part of a ring inside a convex ring that runs against the clock, side after side."""
    def by_side(subject: Column, side: Column) -> Column:
        def inside(x: Column, y: Column) -> Column:
            return (side["bx"] - side["ax"]) * (y - side["ay"]) - (side["by"] - side["ay"]) * (x - side["ax"])

        def part(s: Column) -> Column:
            a, b = inside(s["ax"], s["ay"]), inside(s["bx"], s["by"])
            t = a / F.nullif(a - b, F.lit(0.0))
            cut = F.array(F.array(s["ax"] + t * (s["bx"] - s["ax"]), s["ay"] + t * (s["by"] - s["ay"])))
            end, none = F.array(F.array(s["bx"], s["by"])), F.array().cast("array<array<double>>")
            return F.when((a >= 0) & (b >= 0), end).when((a >= 0) & (b < 0), cut).when((a < 0) & (b >= 0), F.concat(cut, end)).otherwise(none)

        return F.when(F.size(subject) > 0, F.flatten(F.transform(edges_of(subject), part))).otherwise(subject)

    return F.aggregate(edges_of(convex), ring, by_side)


def overlap_ratio(ring: Column, convex: Column) -> Column:
    """The share of a ring's area inside a convex ring."""
    return let(clip(ring, convex), lambda c: F.when(F.size(c) > 2, F.abs(ring_area(c))).otherwise(0.0)) / F.abs(ring_area(ring))


def bounds(polygon: Column) -> tuple[Column, Column, Column, Column]:
    """x0, y0, x1, y1 of all vertices."""
    xs, ys = F.transform(F.flatten(polygon), lambda p: p[0]), F.transform(F.flatten(polygon), lambda p: p[1])
    return F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)


def shadow_parts(ring: Column, dx: Column, dy: Column) -> Column:
    """Rings that together are a prism's shadow: the footprint, the footprint moved by the shadow, and what each side sweeps between."""
    moved = F.transform(ring, lambda p: F.array(p[0] + dx, p[1] + dy))
    swept = F.transform(edges_of(ring), lambda s: F.array(F.array(s["ax"], s["ay"]), F.array(s["bx"], s["by"]), F.array(s["bx"] + dx, s["by"] + dy), F.array(s["ax"] + dx, s["ay"] + dy)))
    return F.concat(F.array(ring, moved), swept)


def in_any(parts: Column, px: Column, py: Column) -> Column:
    """Whether a point is inside the union of rings: in one, or on an edge with the union all around it, as on a seam between two.

    Around a point on an edge four places are looked at, a hair's breadth away.
    """
    def within(x: Column, y: Column) -> Column:
        return F.exists(parts, lambda r: F.aggregate(edges_of(r), F.lit(0), lambda a, s: a + crosses(x, y, s).cast("int")) % 2 == 1)

    edge = F.exists(parts, lambda r: F.exists(edges_of(r), lambda s: on_edge(px, py, s)))
    e, f = 1e-6, 0.37e-6
    around = within(px + e, py + f) & within(px - e, py - f) & within(px + f, py - e) & within(px - f, py + e)
    return F.when(edge, around).otherwise(within(px, py))


def close_enough(px: Column, py: Column, lat: float, lon: float, metres: float) -> Column:
    """The box of degrees that a circle about a place fits in: a cheap test before the exact one, which scans push down."""
    up, aside = metres / LAT_M, metres / (LON_M * math.cos(math.radians(lat)))
    return px.between(lon - aside, lon + aside) & py.between(lat - up, lat + up)
