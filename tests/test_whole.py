"""Queries over whole tables, against brute force in numpy: no row, key or id range is left out."""

import random

import numpy as np
import pytest

from parasol.operators import graph
from parasol.plans import catalog
from parasol.plans.adapters import view
from parasol.plans.spatial import _route_requests
from tests.test_operators import grid_edges

SF = "/root/testdata/sf0.01"


def table(spark, name, *columns):
    return view(spark, SF, name).select(*columns).toPandas()


@pytest.fixture(scope="module")
def lines(spark):
    n = table(spark, "nodes", "k", "x", "y").set_index("k")
    e = table(spark, "edges", "edge_id", "u", "v")
    return e, n.loc[e.u].to_numpy(), n.loc[e.v].to_numpy()


def test_trees_snap_to_any_edge(spark, lines):
    e, a, b = lines
    got = {r.tree_id: (r.edge_id, r.distance_m) for r in catalog.QUERIES["knn_snap"](spark, SF).collect()}
    trees = table(spark, "trees", "tree_id", "x", "y")
    want = {}
    for t in trees.itertuples():
        p = np.array([t.x, t.y])
        at = np.clip(((p - a) * (b - a)).sum(1) / ((b - a) ** 2).sum(1), 0, 1)
        d = np.sqrt(((a + at[:, None] * (b - a) - p) ** 2).sum(1))
        if d.min() <= 200:
            want[t.tree_id] = float(d.min()), set(e.edge_id[d <= d.min() + 1e-9])
    assert got.keys() == want.keys()
    assert all(abs(got[k][1] - d) < 2e-6 and got[k][0] in ids for k, (d, ids) in want.items())
    assert any(edge % 5 for edge, _ in got.values())


def test_component_pairs_of_every_request(spark):
    n = table(spark, "nodes", "k", "x", "y").sort_values("k").reset_index(drop=True)
    comp = {r.k: r.component for r in catalog.QUERIES["components"](spark, SF).collect()}
    got = {r.event_id: (r.component, r.sum_m) for r in catalog.QUERIES["snap_component_pair"](spark, SF).collect()}
    xy, size, cache, want = n[["x", "y"]].to_numpy(), int(n.k.max()) + 1, {}, {}

    def near(k):
        if k not in cache:
            d = np.sqrt(((xy - xy[k] - [13, 29]) ** 2).sum(1))
            found = {}
            for i in np.flatnonzero(d <= 200):
                if i in comp:
                    found[comp[i]] = min(found.get(comp[i], np.inf), d[i])
            cache[k] = found
        return cache[k]

    for (i,) in table(spark, "moments", "event_id").itertuples(index=False):
        s, t = near(i * 37 % size), near(i * 53 % size)
        sums = [(s[c] + t[c], c) for c in s.keys() & t.keys()]
        if sums:
            want[i] = min(sums)
    assert got.keys() == want.keys()
    assert all(c == want[i][1] and abs(d - want[i][0]) < 2e-6 for i, (c, d) in got.items())
    assert any(i % 10 for i in got)


def test_shadows_of_every_building_on_every_node(spark):
    keys = table(spark, "nodes", "k").k.to_numpy()
    b = table(spark, "buildings", "building_id", "x0", "y0")
    height, x0, y0 = (b.building_id % 40).to_numpy() * 1.0, b.x0.to_numpy(), b.y0.to_numpy()
    deep = 30 * (int(b.building_id.max()) // 50 + 1) + 20
    px, py = keys * 37 % 1500 + 0.25, keys * 53 % deep + 0.25
    shaded, sweep = {}, {}
    for k, x, y in zip(keys.tolist(), px, py, strict=True):
        hops = np.arange(1, 41) * 1.5
        mx, my = (np.floor((x + hops * np.sin(np.pi)) / 3) + 0.5) * 3, (np.floor((y - hops) / 3) + 0.5) * 3
        shaded[k] = bool(((mx[:, None] > x0) & (mx[:, None] < x0 + 12) & (my[:, None] > y0) & (my[:, None] < y0 + 12) & (height >= hops[:, None])).any())
        n = int(((height > 20) & (x > x0) & (x < x0 + 12) & (y > y0) & (y < y0 + 12 + height)).sum())
        if n:
            sweep[k] = n
    assert {r.point_id: r.shaded for r in catalog.QUERIES["raster_march_small"](spark, SF).collect()} == shaded
    assert {r.point_id: r.shadows for r in catalog.QUERIES["shadow_sweep"](spark, SF).collect()} == sweep
    got = {r.owner: (r.n, r.shaded, r.value) for r in catalog.QUERIES["shaded_bytes"](spark, SF).collect()}
    owned = {o: [v for k, v in shaded.items() if k % 97 == o] for o in range(97)}
    assert got == {o: (len(v), sum(v), round(255 * sum(v) / len(v))) for o, v in owned.items()}


def test_routes_of_every_event(spark):
    sf = "/root/testdata/sf0.001"
    events = {r.event_id for r in view(spark, sf, "moments").select("event_id").collect()}
    n = catalog.QUERIES["route_batch"](spark, sf).groupBy("request").count().collect()
    assert {r.request for r in n} == events and {r["count"] for r in n} == {4}
    ends = _route_requests(spark, SF).agg({"src": "max", "dst": "max"}).first()
    assert min(ends) >= 150  # beyond the nodes of sf0.001


@pytest.mark.parametrize("seed", [0, 1])
def test_large_graphs_route_by_frames(spark, monkeypatch, seed):
    rng = random.Random(seed)
    edges = [(e, u, v, c if seed else 10.0, rng.randint(0, 5), rng.random(), [rng.random() * 0.033 for _ in range(2)] if seed else [0.01, 0.02]) for e, u, v, c in [*grid_edges(4, seed), (900, 3, 3, 1.0), (901, 3, 4, 2.0), (902, 70, 71, 0.0)]]
    edges = spark.createDataFrame(edges, "edge_id long, u long, v long, length_m double, tree_count long, park_canopy double, densities array<double>")
    asked = [(i, rng.randrange(8), rng.randrange(16), i % 2) for i in range(40)] + [(40, 3, 3, 0), (41, 0, 70, 1), (42, 70, 71, 0), (43, 0, 99, 0), (44, 99, 0, 0), (45, 99, 99, 0), (45, 0, 15, 1)]
    asked = spark.createDataFrame(asked, "request long, src long, dst long, moment int")

    def rows():
        out = graph.route_batch(asked, edges).collect()
        return sorted(([r.request, r.weight, r.edges, *(None if v is None else round(v, 9) for v in r[2:7])] for r in out), key=repr)

    want = rows()
    monkeypatch.setattr(graph, "BROADCAST_EDGES", 10)
    assert rows() == want and sum(r[2] is not None for r in want) > 100


@pytest.mark.parametrize("name", ["tree_fraction", "building_fraction", "edge_density_layers", "edge_cost_ladder"])
def test_every_edge_meets_a_moment(spark, name):
    edges = {r.edge_id for r in view(spark, SF, "edges").select("edge_id").collect()}
    moments = {r.event_id for r in view(spark, SF, "valid_moments").select("event_id").collect()}
    got = {(r.edge_id, r.event_id) for r in catalog.QUERIES[name](spark, SF).select("edge_id", "event_id").collect()}
    assert {e for e, _ in got} == edges and {m for _, m in got} == moments


def test_ways_and_events_are_all_read(spark):
    def run(name):
        return catalog.QUERIES[name](spark, SF)

    orders = {r.l_orderkey // 3 for r in spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey").collect()}
    assert sum(r.n for r in run("semi_anti_ways").collect()) == len(orders) > 400
    assert run("coverage_test").count() == spark.read.parquet(f"{SF}/events.parquet").count()
    assert {r.edge_id % 3 for r in run("parent_name_decision").select("edge_id").collect()} == {0, 1, 2}


def test_edges_are_scored_from_what_is_about_them(spark):
    """Trees to their nearest kerbs, slices to theirs, and shares of both, in plain Python."""
    from parasol.plans import composites, frames, spatial as Q

    faces = [(r.face_id, r.segment_id, r.ax, r.ay, r.bx, r.by) for r in Q._faces(spark, SF).collect()]
    walks = [(r.edge_id, r.ax, r.ay, r.bx, r.by) for r in Q._walks(spark, SF).collect()]
    trees = [(r.x, r.y, r.value, r.is_evergreen) for r in frames.trees(spark, SF).collect() if r.value is not None]

    def near(x, y, cap):
        best = None
        for f, _, ax, ay, bx, by in faces:
            t = max(0.0, min(1.0, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2)))
            d = ((x - ax - t * (bx - ax)) ** 2 + (y - ay - t * (by - ay)) ** 2) ** 0.5
            if d <= cap and (best is None or (d, f) < best):
                best = d, f
        return best and best[1]

    totals, profile, pavement = {}, {}, {}
    for x, y, v, ever in trees:
        f = near(x, y, 8.0)
        if f is not None:
            e, de, n = totals.get(f, (0.0, 0.0, 0))
            totals[f] = (e + v * ever, de + v * (not ever), n + 1)
    for k, ax, ay, bx, by in walks:
        length = ((bx - ax) ** 2 + (by - ay) ** 2) ** 0.5
        n = max(1, -int(-length // 2))
        for i in range(n):
            t = (i + 0.5) / n
            f = near(ax + t * (bx - ax), ay + t * (by - ay), 5.0)
            if f is not None:
                profile[k, f] = profile.get((k, f), 0.0) + length / n
                pavement[f] = pavement.get(f, 0.0) + length / n
    got = {r.edge_id: r for r in composites.score_edges(spark, SF).collect()}
    assert got.keys() == {w[0] for w in walks}
    for k, *_ in walks:
        mine = {f: m for (e, f), m in profile.items() if e == k}
        want = [sum(m / pavement[f] * totals.get(f, (0, 0, 0))[i] for f, m in mine.items()) for i in range(3)]
        r = got[k]
        assert [r.evergreen, r.deciduous, r.trees] == pytest.approx(want, abs=2e-6)
        assert r.outcome == ("no_face" if not mine else "scored" if any(f in totals for f in mine) else "treeless_face")
        if mine:
            assert mine[r.face_id] == pytest.approx(max(mine.values()))


def test_shade_bytes_equal_a_plain_march(spark):
    """Every slot and point of a small city: points in buildings left out, low ones marched, towers swept."""
    from parasol.functions.sun import sun_table
    from parasol.operators.scoring import building_shade
    from pyspark.sql import functions as F

    rng = random.Random(3)
    rings = [(x, y, x + rng.uniform(4, 9), y + rng.uniform(4, 9), h) for x, y, h in [(0.3, 0.7, 12.0), (20.1, 5.3, 30.0), (8.2, 24.9, 100.0)]]
    points = [(i, i % 3, rng.uniform(-20, 45), rng.uniform(-20, 60)) for i in range(60)]
    box = lambda a, b, c, d: F.array(*(F.array(F.lit(x), F.lit(y)) for x, y in ((a, b), (c, b), (c, d), (a, d))))
    prisms = spark.range(1).select(F.explode(F.array(*(F.struct(box(*r[:4]).alias("ring"), F.lit(r[4]).alias("height")) for r in rings))).alias("p")).select("p.*")
    sun = sun_table(spark).where("month = 6")
    got = {(r.edge_id, r.slot): (r.samples, r.shaded, r.value) for r in building_shade(spark.createDataFrame(points, "point_id long, edge_id long, px double, py double"), prisms, sun).collect()}
    size, step, reach, want = 3.0, 1.5, 60.0, {}
    grid = {}
    for x0, y0, x1, y1, h in rings[:2]:
        for cx in range(int(x0 // size) - 1, int(x1 // size) + 2):
            for cy in range(int(y0 // size) - 1, int(y1 // size) + 2):
                if x0 < (cx + 0.5) * size < x1 and y0 < (cy + 0.5) * size < y1:
                    grid[cx, cy] = max(grid.get((cx, cy), 0.0), h)
    for s in sun.where("elevation > 0").collect():
        a, t = np.radians(s.azimuth), np.tan(np.radians(s.elevation))
        for i, e, x, y in points:
            if any(x0 < x < x1 and y0 < y < y1 for x0, y0, x1, y1, _ in rings):
                continue
            hops = [k * step for k in range(1, int(reach // step) + 1)]
            hit = any(grid.get((int((x + d * np.sin(a)) // size), int((y + d * np.cos(a)) // size)), -1) >= d * t for d in hops)
            x0, y0, x1, y1, h = rings[2]
            far = np.linspace(0, min(h / t, 1000.0), 4001)
            hit = hit or bool(((x + far * np.sin(a) > x0) & (x + far * np.sin(a) < x1) & (y + far * np.cos(a) > y0) & (y + far * np.cos(a) < y1)).any())
            n, k = want.get((e, s.slot), (0, 0))
            want[e, s.slot] = (n + 1, k + hit)
    assert got.keys() == want.keys() and any(v[1] for v in want.values())
    off = [k for k, (n, h) in want.items() if got[k] != (n, h, round(255 * h / n))]
    assert len(off) <= len(want) // 100, off  # a grazing shadow may slip between two steps of the plain one


def test_the_graph_that_ways_make(spark):
    from parasol.plans import composites
    from parasol.functions import geometry as g
    from pyspark.sql import functions as F

    edges = composites.graph_build(spark, SF)
    chains = {(r.way_id, r.u, r.v, r.key): r.nodes for r in catalog.QUERIES["chain_split"](spark, SF).collect()}
    got = {(r.way_id, r.u, r.v, r.key): (r.points, r.length_m) for r in edges.collect()}
    assert {k: v[0] for k, v in got.items()} == chains
    two = edges.where("points = 2").limit(50)
    n = view(spark, SF, "nodes").select("k", "lon", "lat")
    far = two.join(n.toDF("u", "a", "b"), "u").join(n.toDF("v", "c", "d"), "v").select("length_m", g.vincenty(*(F.col(x) for x in "abcd")).alias("m")).collect()
    assert far and all(abs(r.length_m - r.m) <= 0.11 for r in far)


def test_exact_shadows_of_towers(spark):
    from parasol.plans import composites

    got = {r.point_id: r.shadows for r in composites.polygon_shadow_sweep(spark, "/root/testdata/sf0.001").collect()}
    towers = [(r.ring, r.height) for r in composites.prisms(spark, "/root/testdata/sf0.001").where("height > 20").collect()]
    points = [(r.point_id, r.px, r.py) for r in composites._edge_points(spark, "/root/testdata/sf0.001").collect()]
    s = 0.5**0.5

    def within(ring, x, y):
        crossed = np.zeros(len(x), dtype=int)
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
            if ay != by:
                crossed += ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
        return crossed % 2 == 1

    want = {}
    for i, x, y in points:
        back = [(ring, s * np.linspace(0, h, 20001)) for ring, h in towers if abs(x - ring[0][0]) < 130 and abs(y - ring[0][1]) < 130]
        if n := sum(bool(within(ring, x - d, y - d).any()) for ring, d in back):
            want[i] = n
    assert got == want
