"""Steps, graphs, geometry, sun, sources and streams on small inputs with known answers."""

import heapq
import json
import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from parasol.functions import geometry as g
from parasol.functions.sun import sun_table
from parasol.operators import graph, spatial
from parasol.operators.skew import look_up
from parasol.sources.export import _current, as_json, verify_export, write_export
from parasol.sources.files import cached, read_features, scan_box, write_findings
from parasol.sources.paged import PagedSource, ServiceError, condition, literal, with_retries
from parasol.streaming.requests import answer, failover, limited


def grid_edges(n=6, seed=0):
    rng = random.Random(seed)
    out = []
    for i in range(n * n):
        if i % n < n - 1:
            out.append((len(out), i, i + 1, float(rng.randint(1, 20))))
        if i + n < n * n:
            out.append((len(out), i, i + n, float(rng.randint(1, 20))))
    return [e for e in out if rng.random() > 0.1]


def test_distances_equal_dijkstra(spark):
    edges = grid_edges()
    frame = spark.createDataFrame(edges, "edge_id long, u long, v long, cost double")
    got = {(r.request, r.k): r.d for r in graph.distances(frame, spark.createDataFrame([(0, 0), (1, 35)], "request long, k long"), 1e9).collect()}
    for request, source in ((0, 0), (1, 35)):
        best, queue = {}, [(0.0, source)]
        while queue:
            d, k = heapq.heappop(queue)
            if k not in best:
                best[k] = d
                for _, u, v, c in edges:
                    for a, b in ((u, v), (v, u)):
                        if a == k:
                            heapq.heappush(queue, (d + c, b))
        assert {k: d for (r, k), d in got.items() if r == request} == best
    csr = graph.Csr(pd.DataFrame(edges, columns=["edge_id", "u", "v", "cost"]))
    cost = [e[3] for e in edges]
    assert csr.path(cost, 0, 35)[0] == got[(0, 35)] and csr.path(cost, 0, 999) is None and csr.path(cost, 3, 3) == (0.0, [])


def test_labels(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (10, 11), (12, 11)], "u long, v long")
    assert {r.k: r.component for r in graph.labels(edges).collect()} == {1: 1, 2: 1, 3: 1, 10: 10, 11: 10, 12: 10}


def test_nearest_and_its_runner_up(spark):
    lines = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 0.0), (2, 1, 0.0, 1.0, 10.0, 1.0), (3, 2, 0.0, 4.0, 10.0, 4.0)], "line long, grp long, ax double, ay double, bx double, by double")
    points = spark.createDataFrame([(1, 5.0, -1.0), (2, 5.0, 100.0)], "p long, px double, py double")
    got = spatial.nearest(points, lines, 8.0, "p", "line", "grp").collect()
    assert [(r.p, r.line, r.distance_m, r.runner_up_m) for r in got] == [(1, 1, 1.0, 5.0)]


def test_march_at_45_degrees(spark):
    wall = spark.createDataFrame([(0.0, 0.0, 10.0, 1.0, 10.0)], "x0 double, y0 double, x1 double, y1 double, height double")
    points = spark.createDataFrame([(1, 5.25, 9.9), (2, 5.25, 12.1)], "point_id long, px double, py double")
    got = spatial.march(points, spatial.rasterise(wall, 0.5), 0.5, 0.25, 180.0, 1.0, 60.0)
    assert {r.point_id: r.shaded for r in got.collect()} == {1: True, 2: False}


def test_compass_side_rejects_a_minority(spark):
    v = [(1, 0.0, 1.0), (1, 0.0, 1.0), (1, 0.0, -1.0), (2, 0.7071, 0.7071), (3, 1.0, 0.0), (4, 0.0, 1.0), (4, 0.0, -1.0)]
    got = {r.k: r.side for r in spatial.compass_side(spark.createDataFrame(v, "k long, dx double, dy double"), "k").collect()}
    assert got == {1: "N", 2: "", 3: "E", 4: ""}


def test_known_distances(spark):
    at = lambda *v: [F.lit(float(x)) for x in v]
    row = spark.range(1).select(g.vincenty(*at(144.42486788888888, -37.95103341666667, 143.92649552777778, -37.652821138888886)), g.vincenty(*at(1, 2, 1, 2)), g.haversine(*at(0, 0, 90, 0)), g.feet_position(*at(-74, 40 + 10 / 60))[0], g.feet_position(*at(-74, 40 + 10 / 60))[1]).first()
    assert row[0] == pytest.approx(54972.271, abs=1e-3) and row[1] == 0
    assert row[2] == pytest.approx(6371000 * 3.141592653589793 / 2)
    assert row[3] == pytest.approx(984250.0) and row[4] == pytest.approx(0.0, abs=1e-6)


def test_sun_table(spark):
    rows = {(r.month, r.hour): r for r in sun_table(spark).collect()}
    assert len(rows) == 288
    assert rows[(6, 13)].elevation == pytest.approx(72.6, abs=0.2) and rows[(6, 13)].azimuth == pytest.approx(182.7, abs=1)
    assert rows[(12, 12)].elevation == pytest.approx(26.0, abs=0.2)
    assert rows[(1, 0)].azimuth is None and sum(r.azimuth is not None for r in rows.values()) == pytest.approx(146, abs=2)


def page(params, headers):
    rows = [{"id": i, "name": f"n{i}"} for i in range(25)]
    if "$where" in params:
        rows = [r for r in rows if r["id"] > int(re.search(r"id > (\d+)", params["$where"])[1])]
    return rows[params["$offset"] : params["$offset"] + params["$limit"]]


def test_paged_source(spark):
    spark.dataSource.register(PagedSource)
    read = spark.read.format("paged").schema("id int, name string").option("endpoint", "tests.test_operators:page").option("rows", 25).option("pagesize", 10)
    with pytest.raises(Exception, match="unique order"):
        read.load().collect()
    frame = read.option("order", "id").load()  # a reader keeps its options
    assert sorted(r.id for r in frame.collect()) == list(range(25)) and frame.rdd.getNumPartitions() == 3
    assert frame.where("id > 20").count() == 4
    short = spark.read.format("paged").schema("id int, name string").option("endpoint", "tests.test_operators:page").option("pagesize", 10).option("order", "id")
    assert short.option("rows", 5).load().count() == 25  # too small a number loses nothing
    assert short.option("rows", 90).load().count() == 25


def test_filters_in_the_services_language():
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, IsNotNull, LessThanOrEqual, StringContains

    got = [condition(f) for f in (EqualTo(("a",), "O'Neil"), GreaterThanOrEqual(("a",), 2), LessThanOrEqual(("a",), 2.5), In(("a",), (1, "x")), IsNotNull(("a",)), EqualTo(("a", "b"), 1), StringContains(("a",), "x"))]
    assert got == ["a = 'O''Neil'", "a >= 2", "a <= 2.5", "a IN (1, 'x')", "a IS NOT NULL", None, None]
    assert literal(True) == "true" and literal(object()) is None


def test_files_as_tables(spark, tmp_path):
    ring, hole = [[0, 0], [4, 0], [4, 4], [0, 0]], [[1, 1], [2, 1], [2, 2], [1, 1]]
    features = [{"type": "Feature", "geometry": {"type": t, "coordinates": c}, "properties": {"name": n}} for n, t, c in [("a", "Polygon", [ring, hole]), ("b", "MultiPolygon", [[ring], [hole]]), ("c", "Point", [0, 0]), ("d", "Polygon", [])]]
    (tmp_path / "f.json").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    got = read_features(spark, str(tmp_path / "f.json"), "name: string").orderBy("name").collect()
    assert [(r["name"], len(r.polygon)) for r in got] == [("a", 2), ("b", 1), ("b", 1)]
    calls = []

    def fetch():
        calls.append(1)
        return spark.createDataFrame([(i, i / 10, 40.0 + i / 10) for i in range(10)], "id long, lon double, lat double")

    at = str(tmp_path / "points")
    assert cached(spark, at, fetch).count() == cached(spark, at, fetch).count() == 10 and len(calls) == 1
    assert cached(spark, at, fetch, refresh=True).count() == 10 and len(calls) == 2
    box = scan_box(spark, at, ["id"], 0.2, 40.0, 0.5, 40.4)
    assert sorted(r.id for r in box.collect()) == [2, 3, 4]
    plan = box._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(lon,0.2)" in plan and "PushedFilters" in plan
    write_findings(spark.read.parquet(at), str(tmp_path / "out"), "lon", "lat")
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert len(lines) == 10 and all(x["geometry"]["type"] == "Point" and "id" in x["properties"] for x in lines)


def test_retries():
    waits, tries = [], []

    def failing(status):
        def call():
            tries.append(1)
            raise ServiceError(status)

        return call

    with pytest.raises(ServiceError):
        with_retries(failing(503), sleep=waits.append)
    assert waits == [5.0, 10.0] and len(tries) == 3
    with pytest.raises(ServiceError):
        with_retries(failing(404), sleep=waits.append)
    assert len(tries) == 4


def test_export_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([("a", -74.12345678, 40.7), ("b", -74.0, 40.8)], "id string, lon double, lat double")
    edges = spark.createDataFrame([("a", "b", 0.0, 0.12345, [], bytes(4)), ("b", "a", 9.0, 0.0, ["x", "y", "z", "w"], bytes([0, 9, 0, 0]))], "u string, v string, length_m double, tree_park_canopy double, fold_names array<string>, building_shade binary")
    write_export(nodes, edges, str(tmp_path))
    assert verify_export(spark, str(tmp_path), 2, 2) and not verify_export(spark, str(tmp_path), 2, 3)
    back = spark.read.parquet(f"{_current(spark, str(tmp_path))}/edges").orderBy("u").collect()
    assert back[0].building_shade is None and back[0].fold_names is None and back[1].fold_names == ["x", "y", "z"]
    assert '"building_shade":"AAkAAA=="' in as_json(edges).collect()[1].edge


def test_stream_equals_batch(spark, tmp_path):
    log = spark.createDataFrame([(u, f"2024-01-01 00:0{m}:0{s}") for u in (1, 2) for m in range(3) for s in range(1 + u * m)], "user_id long, at string").select("user_id", F.col("at").cast("timestamp").alias("ts"))
    log.write.parquet(f"{tmp_path}/log")
    want = sorted(map(tuple, limited(log, 2).collect()))
    stream = spark.readStream.schema(log.schema).parquet(f"{tmp_path}/log")
    q = limited(stream, 2).writeStream.outputMode("complete").format("memory").queryName("limited").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.sql("select * from limited").collect())) == want


def test_failover_state(spark, tmp_path):
    calls = [("geo", f"2024-01-01 00:0{i}:00", i not in (1, 2), i == 2, i) for i in range(5)]
    frame = spark.createDataFrame(calls, "service string, at string, main_ok boolean, backup_empty boolean, call_id long").select("service", F.col("at").cast("timestamp").alias("ts"), "main_ok", "backup_empty", "call_id")
    frame.write.parquet(f"{tmp_path}/calls")
    q = failover(spark.readStream.schema(frame.schema).parquet(f"{tmp_path}/calls")).writeStream.format("memory").queryName("answers").start()
    q.processAllAvailable()
    q.stop()
    down, want = None, []
    for i, c in enumerate(calls):
        who, down = answer(down, 60.0 * i, c[2], c[3])
        want.append((c[4], who))
    assert sorted((r.call_id, r.answered_by) for r in spark.sql("select * from answers").collect()) == want
    assert answer(100.0, 130.0, True, True) == ("slow", 100.0)


def test_labels_of_a_star(spark):
    """One label that nearly all nodes share, beside a small component."""
    edges = spark.createDataFrame([(100, 101 + i) for i in range(3000)] + [(7, 8), (9, 8), (4, 4)], "u long, v long")
    found = {r.k: r.component for r in graph.labels(edges).collect()}
    assert found == {**{k: 100 for k in range(100, 3101)}, 7: 7, 8: 7, 9: 7, 4: 4}


def test_look_up_keeps_rows_without_a_value(spark):
    rows = spark.createDataFrame([(1, i) for i in range(50)] + [(2, 50), (None, 51), (3, 52)], "key int, n int")
    table = spark.createDataFrame([(1, "one"), (2, "two")], "key int, value string")
    got = {r.n: r.value for r in look_up(rows, "key", table, "value", 53 * 20).collect()}
    assert got == {**{i: "one" for i in range(50)}, 50: "two", 51: None, 52: None}


def test_nested_labels_equal_union_find(spark):
    rng = random.Random(11)
    edges = [(rng.randrange(400), rng.randrange(400), layer) for layer in range(3) for _ in range(130)]
    # A hub that all of a later layer hangs on, a loop, a repeated edge; the last layer adds none.
    edges += [(500, k, 1) for k in range(0, 400, 7)] + [(900, 900, 0), (901, 902, 2), (902, 901, 2)]
    got = {(r.layer, r.k): r.component for r in graph.nested_labels(spark.createDataFrame(edges, "u long, v long, layer int"), 4).collect()}
    up, want = {}, {}

    def top(k):
        while up.setdefault(k, k) != k:
            k = up[k]
        return k

    for layer in range(4):
        for u, v, at in edges:
            if at == layer:
                a, b = sorted((top(u), top(v)))
                up[b] = a
        want |= {(layer, k): top(k) for k in list(up)}
    assert got == want
