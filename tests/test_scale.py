"""Steps whose cost must follow the input: what joins broadcast, and results of the forms that replaced costly ones."""

import pytest
from pyspark.sql import functions as F

from parasol.operators import polygons, spatial
from parasol.plans import catalog

POINTS = "point_id long, px double, py double"


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def test_sides_that_explode_are_not_broadcast(spark):
    points = spark.range(50).selectExpr("id as point_id", "id * 1.5D as px", "id * 0.5D as py")  # known to be small
    boxes = spark.range(9).selectExpr("id as box", "id * 4D as x0", "id * 1D as y0", "id * 4D + 3 as x1", "id + 3D as y1", "20D as height")
    lines = boxes.select("box", *(F.col(c).alias(n) for c, n in zip(("x0", "y0", "x1", "y1"), spatial.SEGMENT, strict=True)))
    ring = F.array(*(F.array(x, y) for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"))))
    prisms = boxes.select("box", ring.alias("ring"), "height")
    for frame in (
        spatial.within(points, lines, 5.0),
        spatial.march(points, spatial.rasterise(boxes, 3.0), 3.0, 1.5, 180.0, 1.0, 60.0),
        polygons.inside(points, prisms.select("box", F.array("ring").alias("polygon")), 10.0),
        polygons.in_boxes(points, boxes, 10.0),
        polygons.by_tile(points, boxes, 10.0, 2.0),
        polygons.shadow_sweep(points, prisms, 225.0, 1.0, 60.0),
    ):
        assert "SortMergeJoin" in plan(frame) and "Broadcast" not in plan(frame)


def test_the_closest_line_is_the_nearest_one(spark):
    points = spark.createDataFrame([(i, i * 7 % 40 * 1.0, i * 3 % 11 * 1.0) for i in range(60)], POINTS)
    lines = spark.createDataFrame([(i, i * 5.0, 0.0, i * 5.0, 9.0) for i in range(8)] + [(9, 5.0, 0.0, 5.0, 9.0)], "edge_id long, ax double, ay double, bx double, by double")
    near = spatial.nearest(points, lines, 6.0, "point_id", "edge_id", "edge_id").select("point_id", "edge_id", "distance_m")
    got = spatial.closest(points, lines, 6.0, "point_id", "edge_id")
    assert sorted(got.collect()) == sorted(near.collect()) and got.count() > 40


def test_a_tile_of_many_points_is_dealt_in_blocks(spark, monkeypatch):
    from parasol.operators import shadows

    points = spark.range(90).selectExpr("id as point_id", "id % 4 as edge_id", "id % 10 * 7D + 0.3 as px", "id div 10 * 5D + 0.3 as py")
    grid = spark.range(6).selectExpr("id * 3 as cx", "id * 2 as cy", "id * 4D as height")
    towers = spark.range(2).selectExpr("id as tower", "id * 150D + 30 as mx", "20D as my", "8D as r", "120D as height")
    slots = spark.range(3).selectExpr("id as slot", "0.5D + id as t", "sin(id * 1D) as sx", "cos(id * 1D) as sy").collect()
    one = sorted(map(repr, shadows.reached(points, grid, towers, slots, 3.0, 1.5, 60.0, 1000.0).collect()))
    monkeypatch.setattr(shadows, "BLOCK", 7)
    many = shadows.reached(points, grid, towers, slots, 3.0, 1.5, 60.0, 1000.0)
    assert sorted(map(repr, many.collect())) == one and len(one) > 20
    assert any("tower=None" in r for r in one) and "Broadcast" not in plan(many)


def test_probes_are_counted_without_placing_them(spark):
    from parasol.functions import lines as L
    from parasol.plans import catalog

    frame = spark.createDataFrame([([[0.0, 0.0], [m, 0.0], [m, 7.5]],) for m in (1.0, 29.9, 52.5, 1003.0)], "line array<array<double>>")
    for n, placed in frame.select(L.probe_count(L.length(F.col("line"))), F.size(L.probes(F.col("line")))).collect():
        assert n == placed
    assert "sequence(" not in plan(catalog.QUERIES["line_pieces"](spark, "/root/testdata/sf0.001"))


def test_queries_of_the_sun_read_the_events(spark):
    from parasol.plans import catalog

    sf = "/root/testdata/sf0.001"
    events = spark.read.parquet(f"{sf}/events.parquet").count()
    for name in ("daylight_slots", "sun_slots", "sun_positions"):
        frame = catalog.QUERIES[name](spark, sf)
        assert any("events.parquet" in f for f in frame.inputFiles())
        rows = frame.collect()
        assert len({r.event_id for r in rows}) == len(rows) > events / 10
    lit = [r for r in rows if r.elevation is not None]
    assert len(rows) == events and 0 < len(lit) < events and all(0 < r.elevation < 73 and 0 <= r.azimuth < 360 for r in lit)


def test_searches_get_their_own_components_only(spark, monkeypatch):
    from parasol.operators import graph

    monkeypatch.setattr(graph, "PART_EDGES", 3)
    lines = spark.range(40).selectExpr("id as edge_id", "id div 4 * 100 + id % 4 as u", "id div 4 * 100 + id % 4 + 1 as v", "1D as length_m", "id as tree_count", "0D as park_canopy", "array(0D, 0.03D) as densities", "id div 4 as component")
    asked = spark.range(90).selectExpr("id as request", "id % 3 * 100 as src", "id % 3 * 100 + id % 5 as dst", "cast(id % 2 as int) as moment", "id % 3 as component")
    rows, copies = graph.dealt(asked, lines, ["src", "moment"], 8)
    held = {}
    for r in copies.collect():
        held.setdefault((r.big, r.part, r.block), []).append(r.component)
    assert rows.count() == 90 and {r.component for r in copies.select("component").collect()} == {0, 1, 2}
    assert all(len(v) == 4 for v in held.values()) and {(r.big, r.part, r.block) for r in rows.collect()} <= set(held)
    monkeypatch.setattr(graph, "BLOCK", 8)
    far = asked.drop("component").union(spark.createDataFrame([(90, 0, 100, 0), (91, 7777, 0, 1)], "request long, src long, dst long, moment int"))
    got = {(r.request, r.weight): r for r in graph.route_batch(far, lines.drop("component")).collect()}
    assert len(got) == 92 * 4
    for (request, _), r in got.items():
        assert r.edges == (None if request >= 90 else list(range(request % 3 * 4, request % 3 * 4 + request % 5)))


def test_lengths_on_the_ellipsoid_run_on_arrays(spark):
    from parasol.functions.geometry import vincenty

    places = spark.createDataFrame([(144.42486788888888, -37.95103341666667, 143.92649552777778, -37.652821138888886), (1.0, 2.0, 1.0, 2.0), (None, None, 1.0, 2.0), (0.0, 0.0, 1.0, 0.0)], "a double, b double, c double, d double")
    frame = places.select(vincenty(*(F.col(x) for x in "abcd")).alias("m"))
    assert "ArrowEvalPython" in plan(frame) and "aggregate(" not in plan(frame)
    assert [r.m if r.m is None else round(r.m, 3) for r in frame.collect()] == [54972.271, 0.0, None, 111319.491]


def test_halfway_point_gathers_no_way(spark):
    """Ways are summed by windows; arrays of their nodes cost 84 s for 6 million rows."""
    plan = catalog.QUERIES["halfway_point"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "lambdafunction" not in plan


def test_the_graph_sends_a_row_to_its_node_and_to_its_way_once(spark):
    """Rows met nodes, cuts, chains and steps in shuffles of their own, whose files stay on the disk until the query ends."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        frame = catalog.QUERIES["graph_build"](spark, "/root/testdata/sf0.001")
        sent = frame._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
        assert frame.count() > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sent <= 8  # it was 15
