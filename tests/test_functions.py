"""Column functions on small inputs with known answers."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from parasol.functions import lines as L, moments as M, tags as T, trees as V, wording as W


def values(spark, *columns):
    return spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first()


def lit(*xs):
    return [F.lit(x) for x in xs]


def line(*points):
    return F.array(*(F.array(F.lit(float(x)), F.lit(float(y))) for x, y in points))


def test_tree_values(spark):
    got = values(spark, *(V.tree_value(F.lit(d), F.lit(c)) for d, c in [("60", "Excellent"), ("15", "Good"), ("10", "Dead"), (None, "Good"), ("-3", "Good"), ("x", "Good"), ("NaN", "Fair"), ("30", " Poor "), ("30", None)]))
    assert list(got) == [1.0, pytest.approx(0.425), None, None, None, None, None, 0.3, 0.5]
    assert list(values(spark, V.is_evergreen(F.lit("Pinus strobus - white pine")), V.is_evergreen(F.lit("pinus x")), V.is_evergreen(F.lit(None)))) == [True, False, False]
    assert list(values(spark, V.building_outcome(*lit("20", "Built", "2100")), V.building_outcome(*lit("0", "Demolition", "1003")), V.building_outcome(*lit("1601", "Demolition", "1")), V.building_outcome(*lit("9", "Demolition", "1003")), V.building_outcome(*lit("9", None, "1003")))) == ["usable", "no_height", "too_tall", "demolished", "excluded_code"]
    assert list(values(spark, V.is_real_park(*lit("Parkway", "Garden")), V.is_real_park(*lit("Mall", "Garden")), V.is_real_park(F.lit("Mall"), F.lit(None)), V.is_real_park(F.lit(None), F.lit(None)))) == [False, True, False, True]


@pytest.mark.parametrize(
    "tags,want",
    [
        (("footway", None, None, None), True), (("footway", None, None, "yes"), False), (("footway", "no", None, None), False), (("path", None, "private", None), False),
        (("path", "designated", "private", None), True), (("cycleway", None, None, None), False), (("cycleway", "yes", None, None), True), (("residential", None, None, None), False), ((None, None, None, None), False),
    ],
)
def test_pedestrian_tags(spark, tags, want):
    assert values(spark, T.is_pedestrian(*lit(*tags)))[0] is want


def test_other_tags(spark):
    got = values(spark, T.is_named_street(*lit("A", "residential", None, None)), T.is_named_street(*lit("", "residential", None, None)), T.is_named_street(*lit("A", "service", None, "driveway")), T.kind(*lit("footway", "sidewalk")), T.kind(*lit("", None)), T.is_connector(F.lit("footway/traffic_island")), T.is_park_like(*lit(None, None, None, "wood")), T.is_park_like(*lit("pitch", None, None, None)))
    assert list(got) == [True, False, False, "footway/sidewalk", "?", True, True, False]


def test_month_blends(spark):
    days = {(7, 15): (7, 8, 0.0), (7, 30): (7, 8, 15 / 31), (1, 10): (12, 1, 26 / 31), (2, 29): (2, 3, 0.5), (12, 31): (12, 1, 16 / 31), (3, 14): (2, 3, 27 / 28)}
    for (m, d), want in days.items():
        assert list(values(spark, *M.month_blend(*lit(m, d)))) == [want[0], want[1], pytest.approx(want[2])]


def test_corners_and_night(spark):
    at = M.corners(*lit(7, 8, 0.25, 23, 30))
    dark = F.array(*(F.lit(s % 24 < 6 or s % 24 > 20) for s in range(288)))
    got = values(spark, at, M.dark_share(at, dark), M.is_night(at, dark), M.building_fraction(at, dark, lambda s: s % 256), M.dark_share(M.corners(*lit(7, 8, 0.0, 20, 30)), dark), M.is_night(M.corners(*lit(7, 8, 0.0, 20, 30)), dark))
    assert [(c.slot, c.weight) for c in got[0]] == [(167, 0.375), (144, 0.375), (191, 0.125), (168, 0.125)]
    assert list(got)[1:] == [1.0, True, 1.0, 0.5, False]


def test_shade_and_cost(spark):
    tree = M.tree_fraction(*lit(0.0, 3.3, 100.0, 7, 8, 0.0))
    d = lambda layers, hour: M.edge_density(*lit(layers, 0.5, 0.5, 1.0, hour))
    got = values(spark, tree, M.edge_cost(*lit(100.0, 40.0, 0.033)), M.union(*lit(0.5, 0.5)), d("both", True), d("buildings", True), d("trees", True), d("buildings", False), d("trees", False), d("both", False))
    assert list(got) == pytest.approx([1.0, 100 / 2.32, 0.75, 0.75 * 0.033, 0.5 * 0.033, 0.033, 0.0, 0.5 * 0.033, 0.5 * 0.033])


def test_times(spark):
    got = values(spark, M.leave_time(*lit(3, 1, 0, 5, 10.5)), M.leave_time(*lit(1, 1, 0, 5, 10.4)), M.pinned_now(F.lit("2026-07-15T12:00")), M.pinned_now(F.lit("2026-07-15T12:00-04:00")), M.pinned_now(F.lit("soon")))
    at = datetime.datetime
    assert list(got) == [at(2028, 2, 29, 23, 54), at(2028, 12, 31, 23, 55), at(2026, 7, 15, 16, 0), at(2026, 7, 15, 16, 0), None]
    ok = dict(zip(("arrive", "no_hour", "month", "day", "hour", "minute", "layers", "n_weights", "least_weight", "top_weight"), (False, False, 2, 29, 0, 0, "both", 4, 0.0, 40.0), strict=True))
    cases = [({}, None), ({"arrive": True, "no_hour": True, "month": 13}, "arrive needs an hour"), ({"month": 13}, "month must be 1-12"), ({"day": 30}, "day must be 1-29 for month 2"), ({"hour": 24}, "hour must be 0-23"), ({"minute": -1}, "minute must be 0-59"), ({"layers": "sky"}, "layers must be one of trees, buildings, both"), ({"n_weights": 0}, "tree_weights must include at least one value"), ({"n_weights": 5}, "tree_weights accepts at most 4 values"), ({"top_weight": 41.0}, "tree_weight must be between 0 and 40"), ({"least_weight": -1.0}, "tree_weight must be between 0 and 40")]
    assert list(values(spark, *(M.problem(*lit(*(ok | c).values())) for c, _ in cases))) == [w for _, w in cases]


def test_distances_in_words(spark):
    got = values(spark, *(W.distance_text(F.lit(m)) for m in (999.4, 1000.0, 1250.0, 1350.0, 0.5, 1.5)), *(W.imperial_text(F.lit(m)) for m in (10.0, 160.9, 161.0, 1609.344, 2500.0)), W.spoken_distance(F.lit(161.0)), W.spoken_distance(F.lit(10.0)))
    assert list(got) == [f"{m / 1000:.1f} km" if m >= 1000 else f"{m:.0f} m" for m in (999.4, 1000.0, 1250.0, 1350.0, 0.5, 1.5)] + ["33 ft", "528 ft", "0.1 mi", "1.0 mi", "1.6 mi", "0.1 miles", "33 feet"]
    assert list(values(spark, *(W.eta_text(F.lit(m)) for m in (42.0, 59.6, 139.0, 120.2)), W.spoken_eta(F.lit(61.0)), W.spoken_eta(F.lit(129.0)))) == ["42 min", "1 hr", "2 hr 19 min", "2 hr", "1 hour 1 minute", "2 hours 9 minutes"]


def test_walk_times(spark):
    at = datetime.datetime
    moments = values(spark, *(W.parse_walk_time(F.lit(v)) for v in ("2026-09-27T09:05", "2026-02-29T09:05", "2028-02-29T23:59", "2026-09-27T24:00", "2026-09-27", "x", None)))
    assert list(moments) == [at(2026, 9, 27, 9, 5), None, at(2028, 2, 29, 23, 59), None, None, None, None]
    now, t = F.lit(at(2026, 9, 27, 8, 0)).cast("timestamp_ntz"), lambda *x: F.lit(at(*x)).cast("timestamp_ntz")
    said = values(spark, *(W.describe_walk_time(t(*x), F.lit(a), now) for x, a in [((2026, 9, 27, 13, 0), True), ((2026, 9, 29, 0, 5), True), ((2026, 10, 5, 12, 30), False), ((2026, 9, 26, 13, 0), False)]), W.format_walk_time(t(2026, 9, 7, 9, 5)), W.leave_by(t(2026, 1, 1, 0, 5), F.lit(10.5)))
    assert list(said) == ["Arrive 1:00 PM", "Arrive Tue 12:05 AM", "Depart 10/5, 12:30 PM", "Depart 9/26, 1:00 PM", "2026-09-07T09:05", at(2025, 12, 31, 23, 54)]
    link = values(spark, W.walk_time_of_link(*lit("2026-09-27T09:05", "2026-09-28T09:05")), W.walk_time_of_link(*lit("bad", "2026-09-28T09:05")), W.walk_time_of_link(*lit(None, None)))
    assert link[0].arrive is False and link[1].arrive is True and link[2] is None


def test_turns_links_and_presets(spark):
    assert list(values(spark, *(W.turn_word(F.lit(float(d))) for d in (0, 30, 31, 150, -149, -150)))) == ["continue", "continue", "right", "sharp_right", "left", "sharp_left"]
    assert list(values(spark, *(W.heading_word(F.lit(float(d))) for d in (0, 22.4, 22.5, 359, 180)))) == ["north", "north", "northeast", "north", "south"]
    assert list(values(spark, *(W.preset(F.lit(float(w))) for w in (0, 2.5, 10, 27.5, 28, 90)), W.link_weight(F.lit("x")), W.link_weight(F.lit("7")))) == [0.0, 5.0, 15.0, 40.0, 40.0, 40.0, 40.0, 5.0]
    p = values(spark, W.parse_point(F.lit("40.5,-74")), W.parse_point(F.lit("40.5")), W.parse_point(F.lit("NaN,1")), W.format_point(*lit(40.123456, -74.0)), W.link_label(*lit("Home", "1,x")), W.link_label(*lit("Home", "1,2")))
    assert (p[0].lat, p[0].lon) == (40.5, -74.0) and list(p)[1:] == [None, None, "40.12346,-74.00000", None, "Home"]


def test_labels(spark):
    got = values(spark, W.place_label(*lit("Cafe", "5", "Elm", "Soho", "Manhattan", "New York")), W.place_label(*lit("", "5", "Elm", "Soho", "", "New York")), W.place_label(*lit("Elm", "", "Elm", "", "Elm", "New York")), W.place_label(*lit("", "5", "", "Soho", "X", "Y")), W.reverse_label(*lit("Broadway", "", "", "highway")), W.reverse_label(*lit("Cafe", "", "", "amenity")), W.backup_label(*lit("", "12", "w  5th ST", "Queens")), W.backup_label(F.lit("a"), F.lit(None), F.lit("b"), F.lit(None)), W.capwords(F.lit("  barclay's   5TH ")))
    assert list(got) == ["Cafe, 5 Elm, Manhattan", "5 Elm, New York", "Elm", None, "Broadway", None, "12 W 5th St, Queens", None, "Barclay's 5th"]


def test_street_names(spark):
    forms = {"W  60 ST": "west 60th street", "CRAIG RD S": "craig road south", "ST NICHOLAS AVE": "saint nicholas avenue", "OLD ST JAMES PL": "old saint james place", "AVE N": "avenue n", "11 AVE": "11th avenue", "112 ST": "112th street", "E": "e", "FT HAMILTON PKWY": "fort hamilton parkway"}
    assert list(values(spark, *(W.street_form(F.lit(k), True) for k in forms))) == list(forms.values())
    assert list(values(spark, W.street_form(F.lit("West 60th Street"), False), W.street_form(F.lit("3 Ave."), False), W.street_form(F.lit(None), False))) == ["west 60th street", "3rd ave", ""]
    pairs = [("GRAND CONC", "Grand Concourse", True), ("5TH AVE", "5 AVENUE", True), ("VAN WYCK EXPY", "VAN WYCK EXPRESSWAY SR WEST", True), ("HOPE AVE", "ELM AVENUE", False), ("", "ELM", False)]
    assert list(values(spark, *(W.same_street(W.street_key(F.lit(a)), W.street_key(F.lit(b))) for a, b, _ in pairs))) == [w for *_, w in pairs]
    assert [W.flag(*lit(1.0, 1.0, 1.0))] and list(values(spark, *(c for o, t, a in [(2000.0, 1000.0, 1900.0), (500.0, 1000.0, 900.0), (1000.0, 1000.0, 1.0)] for c in W.flag(*lit(o, t, a))))) == ["longer", "cleared", "shorter", "stands", "ok", "none"]


def test_lines(spark):
    bent = line((0, 0), (3, 0), (3, 4))
    got = values(spark, L.length(bent), L.interpolate(bent, F.lit(5.0)), L.interpolate(bent, F.lit(-1.0)), L.interpolate(bent, F.lit(99.0)), L.halfway(bent), L.project(bent, *lit(5.0, 1.0)), L.local_bearing(bent, F.lit(0.5)), L.local_bearing(bent, F.lit(6.0)), L.length(line((1, 1))))
    assert list(got)[:5] == [7.0, [3.0, 2.0], [0.0, 0.0], [3.0, 4.0], [3.0, 0.5]] and (got[5].d, got[5].at) == (2.0, 4.0) and list(got)[6:] == [90.0, 0.0, 0.0]
    got = values(spark, L.probes(bent), L.probes(line((0, 0), (50, 0))), L.substring(bent, *lit(1.0, 5.0)), L.substring(bent, *lit(5.0, 1.0)), L.slice_points(bent, 2.0))
    assert got[0] == [[0.0, 0.0], [3.0, 0.5], [3.0, 4.0]] and [p[0] for p in got[1]] == [0.0, 12.5, 25.0, 37.5, 50.0]
    assert got[2] == [[1.0, 0.0], [3.0, 0.0], [3.0, 2.0]] and got[3] == got[2][::-1]
    assert len(got[4]) == 4 and sum(p.metres for p in got[4]) == 7.0 and got[4][0].x == 0.875
    aside = values(spark, L.slice_points(line((0, 0), (4, 0)), 2.0, 1.0))[0]
    assert [(round(p.x, 6), round(p.y, 6)) for p in aside] == [(1.0, 1.0), (3.0, 1.0)]


def test_stitching(spark):
    got = values(spark, L.stitch(F.array(line((1, 0), (0, 0)), line((1, 0), (2, 0)), line((3, 0), (2, 0)))), L.stitch(F.array(line((0, 0), (1, 0)))), L.stitch(F.array(line((5, 5)))))
    assert got[0] == [[0.0, 0.0], [1.0, 0.0], [2.0, 0.0], [3.0, 0.0]] and got[1] == [[0.0, 0.0], [1.0, 0.0]] and got[2] == [[5.0, 5.0]] * 2


def plain_simplify(p, tol):
    if len(p) < 3:
        return p
    (ax, ay), (bx, by) = p[0], p[-1]

    def off(q):
        dx, dy = bx - ax, by - ay
        t = max(0.0, min(1.0, ((q[0] - ax) * dx + (q[1] - ay) * dy) / (dx * dx + dy * dy))) if dx or dy else 0.0
        return math.hypot(q[0] - ax - t * dx, q[1] - ay - t * dy)

    i = max(range(1, len(p) - 1), key=lambda k: off(p[k]))
    return [p[0], p[-1]] if off(p[i]) <= tol else plain_simplify(p[: i + 1], tol)[:-1] + plain_simplify(p[i:], tol)


def test_simplifying(spark):
    rng = random.Random(2)
    for n in (2, 3, 12, 40):
        points = [(float(i), rng.random() * 4) for i in range(n)]
        frame = spark.createDataFrame([([list(p) for p in points],)], "line array<array<double>>")
        assert frame.select(L.simplify(F.col("line"), 1.0)).first()[0] == [list(p) for p in plain_simplify(points, 1.0)]


def test_polygons(spark):
    outer, hole = line((0, 0), (10, 0), (10, 10), (0, 10)), line((4, 4), (6, 4), (6, 6), (4, 6))
    polygon = F.array(outer, hole)
    inside = values(spark, *(L.contains(polygon, *lit(float(x), float(y))) for x, y in [(1, 1), (5, 5), (0, 5), (10, 10), (4, 5), (11, 5), (5, 1)]))
    assert list(inside) == [True, False, False, False, False, False, True]
    l_shape = line((0, 0), (4, 0), (4, 1), (1, 1), (1, 4), (0, 4))
    got = values(spark, L.area(polygon), L.area(F.array(l_shape)), L.overlap_ratio(line((5, 5), (15, 5), (15, 15), (5, 15)), outer), L.overlap_ratio(line((20, 20), (21, 20), (21, 21)), outer), *L.bounds(polygon), L.hectares(F.array(line((0, 0), (0.001, 0), (0.001, 0.001), (0, 0.001)))))
    assert list(got)[:8] == [96.0, 7.0, 0.25, 0.0, 0.0, 0.0, 10.0, 10.0] and got[8] == pytest.approx(0.001**2 * 111320 * math.cos(math.radians(40.7)) * 110540 / 1e4)


def test_shadows_of_a_prism(spark):
    """Footprint, moved footprint and what lies between, seams included, against a dense walk along the shadow."""
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 1.0), (1.0, 1.0), (1.0, 3.0), (0.0, 3.0)]
    dx, dy, rng = 2.5, 6.0, random.Random(3)
    points = [(rng.uniform(-1, 8), rng.uniform(-1, 10)) for _ in range(300)] + [(2.5, 0.5), (1.0, 2.0)]

    def within(x, y):
        return sum((ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True)) % 2 == 1

    want = [any(within(x - dx * k / 4000, y - dy * k / 4000) for k in range(4001)) for x, y in points]
    frame = spark.createDataFrame(points, "x double, y double")
    parts = L.shadow_parts(line(*ring), F.lit(dx), F.lit(dy))
    got = [r[0] for r in frame.select(L.in_any(parts, F.col("x"), F.col("y"))).collect()]
    assert sum(a != b for a, b in zip(got, want, strict=True)) == 0 and sum(got) > 50


def test_long_lines_take_linear_time(spark):
    """A part of a line of 500 vertices, its length and its probes, in under a second once the plan is warm."""
    import time

    from parasol.functions import lines

    line = F.transform(F.sequence(F.lit(0), F.lit(499)), lambda i: F.array(i.cast("double"), (i % 2).cast("double")))
    frame = spark.range(1).select(F.when(F.col("id") >= 0, line).alias("line"))
    part = lines.substring(F.col("line"), F.lit(10.0), F.lit(600.0))
    asked = frame.select(lines.length(part).alias("metres"), F.size(lines.probes(part)).alias("n"))
    asked.collect()
    began = time.perf_counter()
    row = asked.collect()[0]
    assert time.perf_counter() - began < 1
    assert abs(row.metres - 590) < 1e-6 and row.n == int(row.metres / 10)


def test_probes_are_the_points_at_even_distances(spark):
    from parasol.functions import lines

    shapes = [[(0, 0), (3, 4), (3, 4), (30, 4)], [(0, 0), (100, 0), (100, 0.5), (7, 3)], [(5, 5), (5, 5)], [(1, 2), (1, 29.99)], [(0.1 * k, (k * 7 % 5) * 0.3) for k in range(200)], [(1, 1)]]
    frame = spark.createDataFrame([(i, [[float(x), float(y)] for x, y in shape]) for i, shape in enumerate(shapes)], "i int, line array<array<double>>")
    one = lambda k, n: lines.interpolate(F.col("line"), lines.length(F.col("line")) * k / (n - 1))
    for row in frame.select("i", lines.probes(F.col("line")).alias("p"), lines.length(F.col("line")).alias("m")).collect():
        if len(shapes[row.i]) < 2:
            assert row.p is None
            continue
        n = max(3, int(row.m // 10))
        assert len(row.p) == n
        expected = frame.where(F.col("i") == row.i).select(*(one(k, n).alias(f"p{k}") for k in range(n))).collect()[0]
        assert all(abs(a - b) < 1e-9 for got, want in zip(row.p, expected, strict=True) for a, b in zip(got, want, strict=True))
