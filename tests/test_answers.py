"""Answers to route requests on a small graph against all ways in plain Python."""

import heapq
import random

import pytest
from pyspark.sql import functions as F

from parasol.operators import answers
from parasol.plans import frames

EDGE = "edge_id long, u long, v long, length_m double, ax double, ay double, bx double, by double, tree_evergreen double, tree_deciduous double, tree_count double, park_canopy double, building_shade binary"
ASKED = "request long, fx double, fy double, tx double, ty double, month int, day int, hour int, minute int, arrive boolean, no_hour boolean, layers string, weights array<double>"


def city(seed=1, n=4):
    """A grid of streets, a loop, a parallel edge, and an island far away."""
    rng, out = random.Random(seed), []
    at = lambda k: (k % n * 100.0, k // n * 100.0) if k < 90 else (5000.0 + k, 0.0)

    def add(u, v):
        out.append((len(out), u, v, 100.0 + rng.randrange(40), *at(u), *at(v), rng.random() * 3, rng.random() * 3, float(rng.randrange(9)), rng.random(), bytes(rng.randrange(256) for _ in range(288)) if rng.random() < 0.8 else None))

    for k in range(n * n):
        if k % n < n - 1 and k != 5:
            add(k, k + 1)
        if k + n < n * n:
            add(k, k + n)
    add(0, 1)
    add(90, 91)
    return out


def cheapest(edges, cost, s, t):
    """Least cost between places (edge, share) by trying both ends of both edges."""
    def node_costs(source):
        best, queue = {}, [(0.0, source)]
        while queue:
            d, k = heapq.heappop(queue)
            if k not in best:
                best[k] = d
                for i, e in enumerate(edges):
                    for a, b in ((e[1], e[2]), (e[2], e[1])):
                        if a == k:
                            heapq.heappush(queue, (d + cost[i], b))
        return best

    (a, x), (b, y) = s, t
    ways = [abs(x - y) * cost[a]] if a == b else []
    for k, p in ((edges[a][1], x), (edges[a][2], 1 - x)):
        found = node_costs(k)
        ways += [p * cost[a] + found[m] + q * cost[b] for m, q in ((edges[b][1], y), (edges[b][2], 1 - y)) if m in found]
    return min(ways) if ways else None


def test_partial_routes_are_cheapest():
    import numpy as np
    import pandas as pd

    edges = city()
    table = pd.DataFrame(edges, columns=[c.split()[0] for c in EDGE.split(", ")])
    places = answers.Places(table, np.array([h < 6 or h > 20 for _ in range(12) for h in range(24)]))
    rng = random.Random(2)
    for _ in range(60):
        density, _ = places.moment(rng.randint(1, 12), rng.randint(1, 28), rng.randrange(24), rng.randrange(60), rng.choice(["both", "trees", "buildings"]))
        cost = (places.length / (1 + rng.choice([0, 15, 40]) * density)).tolist()
        s, t = ((rng.randrange(len(edges)), rng.choice([0.0, 1.0, rng.random()])) for _ in range(2))
        walked, want = answers.PartialSearch(places, cost, *s).to(*t), cheapest(edges, cost, s, t)
        assert (walked is None) == (want is None)
        if walked:
            assert sum(cost[e] * p for e, p in walked) == pytest.approx(want)


def test_answers(spark):
    edges = spark.createDataFrame(city(), EDGE)
    base = (10.0, 12.0, 290.0, 205.0, 7, 15, 12, 30, False, False, "both", [0.0, 40.0, 5.0])
    change = lambda i, **k: (i, *(k.get(c.split()[0], v) for c, v in zip(ASKED.split(", ")[1:], base, strict=True)))
    rows = [change(0), change(1, hour=2), change(2, arrive=True, hour=0, minute=5, day=1, month=3), change(3, fx=-900.0), change(4, tx=9000.0), change(5, tx=5090.5, ty=0.0), change(6, month=13), change(7, weights=[]), change(8, fx=10.0, fy=0.0, tx=60.0, ty=0.0), change(9, arrive=True, no_hour=True)]
    got = {r.request: r for r in answers.answer(spark.createDataFrame(rows, ASKED), edges, frames.stub_sun(spark)).collect()}
    assert [got[i].status for i in range(10)] == [200, 200, 200, 422, 422, 422, 400, 400, 200, 400]
    assert got[3].detail.startswith("Start point") and got[4].detail.startswith("End point") and got[5].detail == answers.NO_PATH
    a = got[0]
    assert [r.weight for r in a.routes] == [0.0, 40.0, 5.0] and a.night is False
    by = sorted(a.routes, key=lambda r: r.weight)
    assert [r.shade_fraction for r in by] == sorted(r.shade_fraction for r in by) and by[0].length_m == min(r.length_m for r in by)
    assert all(r.minutes == pytest.approx(r.length_m / 84, abs=0.06) for r in a.routes)
    assert got[1].night and len({r.length_m for r in got[1].routes}) == 1 and all(r.shade_fraction == 1.0 for r in got[1].routes)
    left = got[2]
    assert (left.month, left.day) == (2, 29) and left.hour == 23 and left.minute == 65 - int(left.routes[0].minutes + 0.5)
    assert len(got[8].routes[0].edges) == 1 and got[8].routes[0].length_m < 70
    assert got[6].routes is None and got[7].detail == "tree_weights must include at least one value"


def test_requests_are_answered_at_their_own_moments(spark):
    """Every request is answered at the day and minute that it asks for; all were taken to the full hour of a 15th."""
    from parasol.plans import catalog

    sf = "/root/testdata/sf0.001"
    asked = {r.event_id: r for r in frames.requested(spark, sf).collect()}
    got = {r.request: r for r in catalog.QUERIES["route_answers"](spark, sf).collect()}
    assert got.keys() == asked.keys()
    found = [i for i, r in got.items() if r.status == 200 and not asked[i].arrive]
    assert found and all((got[i].month, got[i].hour, got[i].minute) == (asked[i].month, asked[i].hour, asked[i].minute) for i in found)
    assert len({got[i].minute for i in found}) > 10
    late = [i for i, r in asked.items() if r.month in (4, 6, 9, 11) and r.day == 31 and not (r.arrive and r.no_hour)]
    assert late and all(got[i].status == 400 and got[i].detail.startswith("day must be") for i in late)
