"""Route requests answered in batches: checks, coverage, snapping, ladders of partial-edge routes, night, and arrivals.

Checks and snapping are DataFrame operations. Routes are searched in the
component that holds both ends, as in ``graph.route_batch``; its requests come
ordered by start and moment, so that those of one start share its searches, and
those of one moment its densities.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from parasol.functions import moments as M
from parasol.functions.geometry import segment_t
from parasol.functions.trees import CANOPY, FULL_DENSITY
from parasol.operators import graph, spatial
from parasol.operators.ranks import monotone
from parasol.operators.skew import shuffled
from parasol.session import save_table

#: Metres that a place may be from the network, and what is said where there is no route.
COVERED_M = 200.0
OUTSIDE = " point is outside our current coverage area — pick a point on land in New York City."
NO_PATH = "No path between these points"
#: Requests of a block, and densities of moments that are remembered: so many moments, and more while they are few values.
BLOCK, MOMENTS, MOMENT_VALUES = 2000, 8, 4_000_000

SCHEMA = "request long, place int, weight double, length_m double, minutes double, tree_count long, shade_fraction double, park_canopy_share double, edges array<long>, night boolean, month int, day int, hour int, minute int"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
_SNAP = ("s_edge", "s_at", "t_edge", "t_at")


def snap_pairs(requests: DataFrame, edges: DataFrame) -> DataFrame:
    """request, s_near, t_near, s_edge, s_at, t_edge, t_at, component: the nearest edges of both ends that hang together, and where on them (0..1).

    Of all components within reach of both ends, the one with the least sum of
    distances; no edges where there is none. ``near``: whether any edge is in reach.
    ``edges`` hold their ``component``. A place that many ask for meets the edges once.
    """
    lines = edges.select("edge_id", "ax", "ay", "bx", "by", "component")
    places = requests.select(F.col("fx").alias("px"), F.col("fy").alias("py")).union(requests.select("tx", "ty")).distinct()
    at = segment_t(*(F.col(c) for c in ("px", "py", *spatial.SEGMENT)))
    best = spatial.within(places, lines, COVERED_M).groupBy("px", "py", "component").agg(F.min(F.struct("d", "edge_id", at.alias("at"))).alias("b"))
    best = save_table(best, "places")

    def nearest(x: str, y: str, end: str) -> DataFrame:
        asked = requests.select("request", F.col(x).alias("px"), F.col(y).alias("py")).join(shuffled(best), ["px", "py"])
        return asked.select("request", "component", F.col("b.d").alias(f"{end}_d"), F.col("b.edge_id").alias(f"{end}_edge"), F.col("b.at").alias(f"{end}_at"))

    s, t = (save_table(nearest(x, y, e), "snap") for x, y, e in (("fx", "fy", "s"), ("tx", "ty", "t")))
    both = s.join(t, ["request", "component"]).groupBy("request").agg(F.min_by(F.struct(*_SNAP, "component"), F.struct(F.col("s_d") + F.col("t_d"), "component")).alias("p"))
    near = [f.select("request", F.lit(True).alias(n)).distinct() for f, n in ((s, "s_near"), (t, "t_near"))]
    out = requests.select("request").join(near[0], "request", "left").join(near[1], "request", "left").join(both, "request", "left")
    return out.select("request", F.coalesce("s_near", F.lit(False)).alias("s_near"), F.coalesce("t_near", F.lit(False)).alias("t_near"), "p.*")


class Places:
    """A multigraph in arrays, with shade for any moment."""

    def __init__(self, edges: pd.DataFrame, dark: np.ndarray) -> None:
        self.csr, self.dark, self.seen = graph.Csr(edges), dark, {}
        self.length = np.maximum(edges.length_m.to_numpy(dtype=float), graph.LEAST_M)
        self.ids, self.at = edges.edge_id.to_numpy(), {int(e): i for i, e in enumerate(edges.edge_id)}
        self.u, self.v = (np.array([self.csr.index[int(k)] for k in edges[c]]) for c in "uv")
        self.ever, self.leafy, self.trees, self.canopy = (edges[c].to_numpy(dtype=float) for c in ("tree_evergreen", "tree_deciduous", "tree_count", "park_canopy"))
        self.shade = np.stack([np.frombuffer(b, np.uint8) if b is not None else np.zeros(288, np.uint8) for b in edges.building_shade])
        self.metres, self.most = self.length.tolist(), max(MOMENTS, MOMENT_VALUES // max(len(self.ids), 1))

    def moment(self, month: int, day: int, hour: int, minute: int, layers: str) -> tuple[np.ndarray, bool]:
        """Density of every edge, and whether it is night; the last few moments are remembered."""
        key = (month, day, hour, minute, layers)
        if key not in self.seen:
            if len(self.seen) >= self.most:
                del self.seen[next(iter(self.seen))]
            self.seen[key] = self._moment(*key)
        return self.seen[key]

    def _moment(self, month, day, hour, minute, layers):
        first = month if day >= 15 else (month + 10) % 12 + 1
        second, days = first % 12 + 1, M.DAYS[first - 1]
        g = (day - 15 if day >= 15 else days - 15 + day) / days
        slots = np.array([(m - 1) * 24 + h for m in (first, second) for h in (hour, (hour + 1) % 24)])
        w = np.array([x * y for x in (1 - g, g) for y in (1 - minute / 60, minute / 60)])
        dark = self.dark[slots]
        tree = np.minimum((self.ever + self.leafy * ((1 - g) * CANOPY[first - 1] + g * CANOPY[second - 1])) / self.length / FULL_DENSITY, 1.0)
        other = float(w @ dark) if layers == "trees" else np.where(dark, 255.0, self.shade[:, slots]) @ w / 255.0
        shade = other if layers == "buildings" else 1 - (1 - tree) * (1 - other)
        return np.broadcast_to(shade, tree.shape) * FULL_DENSITY, bool((dark | (w <= 0)).all())


class PartialSearch(graph.Search):
    """Least costs from a place inside an edge, which both its ends continue."""

    def __init__(self, places: Places, cost: list[float], edge: int, at: float) -> None:
        super().__init__(places.csr, cost, None)
        self.places, self.edge, self.at = places, edge, at
        nodes, first = len(places.csr.nodes), {}
        self.best, self.back, self.done = [np.inf] * nodes, [None] * nodes, bytearray(nodes)
        for k, part in ((int(places.u[edge]), at), (int(places.v[edge]), 1 - at)):
            if part * cost[edge] < self.best[k]:
                first[k] = self.best[k] = part * cost[edge]
                self.back[k] = (None, part)
        self.queue = [(d, k) for k, d in first.items()]
        heapq.heapify(self.queue)

    def settle(self, target: int) -> float:
        """Least cost of a node, infinite where there is no way."""
        arcs, cost, best, back, done, queue, pop, push = self.graph.arcs, self.cost, self.best, self.back, self.done, self.queue, heapq.heappop, heapq.heappush
        while queue and not done[target]:
            d, k = pop(queue)
            if done[k]:
                continue
            done[k] = 1
            for n, e in arcs[k]:
                there = d + cost[e]
                if there < best[n]:  # never of a node that is done, as no cost is negative
                    best[n], back[n] = there, (k, e)
                    push(queue, (there, n))
        return best[target] if done[target] else np.inf

    def to(self, edge: int, at: float) -> list[tuple[int, float]] | None:
        """Edges and walked shares to a place: through either of its edge's ends, or along the one edge that both lie on."""
        ways = []
        for k, part in ((int(self.places.u[edge]), at), (int(self.places.v[edge]), 1 - at)):
            ways.append((self.settle(k) + part * self.cost[edge], k, part))
        least, k, part = min(ways)
        if edge == self.edge and abs(at - self.at) * self.cost[edge] <= least:
            return [(edge, abs(at - self.at))]
        if least == np.inf:
            return None
        out = [(edge, part)]
        while self.back[k][0] is not None:
            k, e = self.back[k]
            out.append((e, 1.0))
        out.append((self.edge, self.back[k][1]))
        return out[::-1]


def measures(places: Places, density: np.ndarray, walked: list[tuple[int, float]]) -> tuple:
    """length, minutes, trees, shade share, park share and edges of a route; every figure is a sum over walked shares."""
    e, part = np.array([x[0] for x in walked], dtype=np.int64), np.array([x[1] for x in walked])
    metres = places.length[e] * part
    total = float(metres.sum())
    per = max(total, graph.LEAST_M)
    shade, park = float((metres * density[e]).sum()) / per / FULL_DENSITY, float((metres * places.canopy[e]).sum()) / per
    return round(total, 1), round(total / graph.WALK_M_S / 60, 1), int(round(float((places.trees[e] * part).sum()))), round(shade, 3), round(park, 3), [int(places.ids[i]) for i, p in walked if p > 0]


def earlier(month: int, day: int, hour: int, minute: int, minutes: float) -> tuple[int, int, int, int]:
    """The moment so many whole minutes, halves up, before a time of a leap year without end."""
    at = pd.Timestamp(M.LEAP, month, day, hour, minute) - pd.Timedelta(minutes=int(np.floor(minutes + 0.5)))
    return at.month, at.day, at.hour, at.minute


def ladders(asked: DataFrame, edges: DataFrame, dark: list[bool]) -> DataFrame:
    """Routes of snapped requests (request, s_edge, s_at, t_edge, t_at, component, month .. minute, layers, arrive, weights), one row a weight in its place."""
    order = ["s_edge", "s_at", "month", "day", "hour", "minute", "layers"]
    rows = asked.select("request", *_SNAP, "component", "month", "day", "hour", "minute", "layers", "arrive", "weights")
    night_slots = np.array(dark)

    def search(mine: pd.DataFrame, table: pd.DataFrame) -> list[tuple]:
        places, kept, now, plain, out = Places(table, night_slots), {}, None, None, []
        for r in mine.sort_values([*order, "request"]).itertuples():
            s, t = (places.at[int(r.s_edge)], float(r.s_at)), (places.at[int(r.t_edge)], float(r.t_at))
            when = (int(r.month), int(r.day), int(r.hour), int(r.minute))
            if r.arrive:
                if plain is None or (plain.edge, plain.at) != s:
                    plain = PartialSearch(places, places.metres, *s)
                if (walked := plain.to(*t)) is not None:
                    when = earlier(*when, measures(places, np.zeros(len(places.length)), walked)[1])
            density, night = places.moment(*when, r.layers)
            if now != (s, when, r.layers):
                now, kept = (s, when, r.layers), {}
            for i, w in enumerate(r.weights):
                used = 0.0 if night else float(w)
                if used not in kept:
                    kept[used] = PartialSearch(places, (places.length / (1 + used * density)).tolist(), *s)
                walked = kept[used].to(*t)
                out.append((r.request, i, w, *(measures(places, density, walked) if walked else [None] * 6), night, *when))
        return out

    return graph.by_part(*graph.dealt(rows, edges, order, BLOCK), search, SCHEMA)


def answer(requests: DataFrame, edges: DataFrame, sun: DataFrame) -> DataFrame:
    """One row a request: request, status, detail, night, month, day, hour, minute, routes (structs in the order of its weights).

    requests: request, fx, fy, tx, ty (flat metres), month .. minute (filled in),
    arrive, no_hour, layers, weights. edges: edge_id, u, v, length_m, ax, ay, bx,
    by, tree_evergreen, tree_deciduous, tree_count, park_canopy, building_shade
    (288 bytes or null). sun: month, hour, azimuth.
    """
    dark = [bool(r.d) for r in sun.orderBy("month", "hour").select(F.col("azimuth").isNull().alias("d")).collect()]  # 288 rows
    w = F.col("weights")
    bad = M.problem(*(F.col(c) for c in ("arrive", "no_hour", "month", "day", "hour", "minute", "layers")), F.size(w), F.coalesce(F.array_min(w), F.lit(0.0)), F.coalesce(F.array_max(w), F.lit(0.0)))
    checked = save_table(requests.withColumn("bad", bad), "requests")
    good = checked.where("bad is null")
    edges = save_table(edges, "edges")
    comp = graph.labels(edges.select("u", "v")).withColumnRenamed("k", "u")
    edges = save_table(edges.join(shuffled(comp), "u"), "edges")
    snapped = save_table(good.join(snap_pairs(good, edges), "request"), "snapped")
    routes = save_table(ladders(snapped.where("s_edge is not null"), edges, dark), "ladders")
    clamped = clamp(routes)
    shown = F.struct("weight", "length_m", "minutes", "tree_count", "shade_fraction", "park_canopy_share", "edges")
    listed = F.transform(F.sort_array(F.collect_list(F.struct("place", shown.alias("r")))), lambda x: x["r"])
    whole = clamped.groupBy("request").agg(listed.alias("routes"), F.min(F.col("length_m").isNotNull()).alias("found"), *(F.first(c).alias(c) for c in ("night", "month", "day", "hour", "minute")))
    detail = F.when(~F.col("s_near"), f"Start{OUTSIDE}").when(~F.col("t_near"), f"End{OUTSIDE}").when(F.col("s_edge").isNull() | ~F.coalesce("found", F.lit(False)), NO_PATH)
    done = snapped.select("request", "s_near", "t_near", "s_edge").join(whole, "request", "left").withColumn("detail", detail)
    ok: Column = F.col("detail").isNull()
    said = done.select("request", F.when(ok, 200).otherwise(422).alias("status"), "detail", *(F.when(ok, F.col(c)).alias(c) for c in ("night", "month", "day", "hour", "minute", "routes")))
    return said.unionByName(checked.where("bad is not null").select("request", F.lit(400).alias("status"), F.col("bad").alias("detail")), allowMissingColumns=True)


def clamp(routes: DataFrame) -> DataFrame:
    """Ladders in which shade never falls as the weight grows; rows keep their places and weights."""
    return monotone(routes, ["request"], ["weight", "place"], "shade_fraction", ["length_m", "minutes", "tree_count", "shade_fraction", "park_canopy_share", "edges"])


def path_edges(routes: DataFrame) -> DataFrame:
    """request, place, seq, edge_id of answered routes."""
    one = routes.select("request", F.posexplode("routes").alias("place", "r"))
    return one.select("request", "place", F.posexplode("r.edges").alias("seq", "edge_id"))


def worst(routes: DataFrame, k: int = 12) -> DataFrame:
    """The k longest first routes: a top list."""
    return routes.where("status = 200").orderBy(F.col("routes")[0]["length_m"].desc(), "request").limit(k)

