"""Graph operators: components, shortest distances as frames, and batches of routes, searched component by component."""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from parasol.operators.skew import HOT_SHARE, look_up, shuffled
from parasol.session import cut, save_table

#: Edges of a component that a task may hold; above, routes go by frames.
BROADCAST_EDGES = 2_000_000
#: Edges in one part, into which components of no more than that are put together.
PART_EDGES = 20_000
#: Walking speed, and an edge's least length.
WALK_M_S, LEAST_M = 1.4, 0.01
#: Requests in one block, more (a request per so many edges) where a part is large.
BLOCK, EDGES_A_REQUEST = 2000, 200
ROUTE_SCHEMA = "request long, weight double, length_m double, minutes double, tree_count long, shade_fraction double, park_canopy_share double, edges array<long>"
ROUTE_COLUMNS = [c.split()[0] for c in ROUTE_SCHEMA.split(", ")]


def _written(frame: DataFrame) -> DataFrame:
    """A table: a checkpoint would keep what the optimizer knows of its columns, which grows from round to round."""
    return save_table(frame, "labels")


def labels(edges: DataFrame) -> DataFrame:
    """(k, component): the smallest node reachable, by pulling labels along edges and then along labels.

    A round that changes no row is the last. Most nodes soon share a label, so labels are looked up as frequent keys are.
    """
    both = _written(edges.select(F.col("u").alias("a"), F.col("v").alias("b")).union(edges.select("v", "u")).distinct())
    now = _written(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("c")))
    total = now.count()
    while True:
        pulled = both.join(shuffled(now.select(F.col("a").alias("b"), F.col("c").alias("cb"))), "b").groupBy("a").agg(F.min("cb").alias("m"))
        moved = _written(now.join(shuffled(pulled), "a").select("a", F.col("c").alias("old"), F.least("c", "m").alias("c")))
        jumped = look_up(moved, "c", now.select(F.col("a").alias("c"), F.col("c").alias("cc")), "cc", total)
        after = _written(jumped.select("a", "old", F.least("c", "cc").alias("c")))
        done = after.where("c <> old").isEmpty()
        now = after.select("a", "c")
        if done:
            return now.select(F.col("a").alias("k"), F.col("c").alias("component"))


def grown_labels(before: DataFrame, edges: DataFrame) -> DataFrame:
    """(k, component) of a graph that ``edges`` (u, v) are added to, from its labels ``before``: the smallest node reachable.

    Only edges between different components, as edges between their labels, are
    labelled anew; labels of nodes follow by a look-up, of frequent ones by broadcast.
    """
    def label(column: str) -> DataFrame:
        return shuffled(before.select(F.col("k").alias(column), F.col("component").alias(f"c{column}")))

    ends = edges.select("u", "v").join(label("u"), "u", "left").join(label("v"), "v", "left")
    ends = _written(ends.select("u", "v", F.coalesce("cu", "u").alias("a"), F.coalesce("cv", "v").alias("b")))
    merged = labels(ends.where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v"))).select(F.col("k").alias("component"), F.col("component").alias("now"))
    met = ends.select(F.col("u").alias("k"), F.col("a").alias("component")).union(ends.select("v", "b")).distinct()
    all_nodes = _written(before.select("k", "component").union(met).distinct())
    found = look_up(all_nodes, "component", merged, "now", all_nodes.count())
    return _written(found.select("k", F.coalesce("now", "component").alias("component")))


def nested_labels(edges: DataFrame, layers: int) -> DataFrame:
    """(layer, k, component): labels of the edges (u, v, layer) of layers 0 to each, each layer's from those of the one before."""
    now, out = None, None
    for layer in range(layers):
        added = edges.where(F.col("layer") == layer).select("u", "v")
        now = labels(added) if now is None else grown_labels(now, added)
        mine = now.select(F.lit(layer).alias("layer"), "k", "component")
        out = mine if out is None else out.unionByName(mine)
    return out


def distances(edges: DataFrame, sources: DataFrame, most: float) -> DataFrame:
    """(request, k, d) for all nodes within ``most``: relaxation of a frontier, round by round, each cut by a checkpoint."""
    arcs = edges.select("u", "v", "cost").union(edges.select("v", "u", "cost")).groupBy("u", "v").agg(F.min("cost").alias("cost"))
    best = cut(sources.select("request", "k", F.lit(0.0).alias("d")))
    front = best
    while True:
        reached = front.join(arcs, front["k"] == arcs["u"]).select("request", F.col("v").alias("k"), (F.col("d") + F.col("cost")).alias("d")).where(F.col("d") <= most)
        reached = reached.groupBy("request", "k").agg(F.min("d").alias("d"))
        front = cut(reached.join(best.withColumnRenamed("d", "old"), ["request", "k"], "left").where("old is null or d < old - 1e-9").select("request", "k", "d"))
        if front.isEmpty():
            return best
        best = cut(best.unionByName(front).groupBy("request", "k").agg(F.min("d").alias("d")))


class Csr:
    """An undirected multigraph in arrays; costs are non-negative."""

    def __init__(self, edges: pd.DataFrame) -> None:
        nodes = np.unique(np.concatenate([edges.u, edges.v]))
        self.nodes, self.index = nodes, {int(k): i for i, k in enumerate(nodes)}
        u, v = np.searchsorted(nodes, edges.u), np.searchsorted(nodes, edges.v)
        a, b, e = np.concatenate([u, v]), np.concatenate([v, u]), np.concatenate([np.arange(len(edges))] * 2)
        by = np.lexsort((e, a))
        start, pairs = np.searchsorted(a[by], np.arange(len(nodes) + 1)).tolist(), list(zip(b[by].tolist(), e[by].tolist(), strict=True))
        #: Of each node, the nodes next to it and the edges to them.
        self.arcs = [pairs[i:j] for i, j in zip(start, start[1:], strict=False)]

    def path(self, cost: list[float], source: int, target: int) -> tuple[float, list[int]] | None:
        """Least cost and its edges; ties go to the smaller node, then the smaller edge."""
        return Search(self, cost, source).path(target)


class Search:
    """Least costs from one source, settled only as far as the targets asked for so far."""

    def __init__(self, graph: Csr, cost: list[float], source: int) -> None:
        self.graph, self.cost, self.source = graph, cost, graph.index.get(source)
        self.best, self.back, self.done = {self.source: 0.0}, {}, set()
        self.queue = [] if self.source is None else [(0.0, self.source)]

    def path(self, target: int) -> tuple[float, list[int]] | None:
        """Least cost and its edges; ties go to the smaller node, then the smaller edge."""
        g, cost, best, back, done, queue = self.graph, self.cost, self.best, self.back, self.done, self.queue
        t = g.index.get(target)
        if t is None:
            return None
        while queue and t not in done:
            d, k = heapq.heappop(queue)
            if k in done:
                continue
            done.add(k)
            for n, e in g.arcs[k]:
                nd = d + cost[e]
                if n not in done and nd < best.get(n, np.inf):
                    best[n], back[n] = nd, (k, e)
                    heapq.heappush(queue, (nd, n))
        if t not in done:
            return None
        d, out = best[t], []
        while t != self.source:
            t, e = back[t]
            out.append(e)
        return d, out[::-1]


def dealt(requests: DataFrame, edges: DataFrame, share: list[str], block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Requests and edges with the part that each belongs to (big, part, block), for a ``cogroup`` of both.

    Both hold ``component``. Small components are put together by hash, larger ones
    are parts of their own; the edges of a part go to each block of its requests, so
    there are at most EDGES_A_REQUEST, or those of a part for every ``block``, a request.
    Requests alike in ``share`` lie in one block, unless they are many.
    """
    asked = requests.groupBy("component").agg(F.count("*").alias("asked"))
    sizes = save_table(edges.groupBy("component").agg(F.count("*").alias("n")).join(shuffled(asked), "component"), "sizes")
    small = F.col("n") <= PART_EDGES
    totals = sizes.agg(F.sum(F.when(small, F.col("n"))).alias("n"), F.sum("asked").alias("asked")).first()
    hashed = F.pmod(F.xxhash64("component"), F.lit(-(-(totals.n or 0) // PART_EDGES) or 1))
    placed = save_table(sizes.select("component", "n", "asked", (~small).alias("big"), F.when(small, hashed).otherwise(F.col("component")).alias("part")), "placed")
    blocks = F.ceil(F.sum("asked") / F.greatest(F.lit(block), F.floor(F.sum("n") / EDGES_A_REQUEST))).alias("blocks")
    parts = save_table(placed.select("component", "big", "part").join(placed.groupBy("big", "part").agg(blocks), ["big", "part"]), "parts")
    many = requests.groupBy(*share).agg(F.count("*").alias("__n")).where(F.col("__n") * HOT_SHARE > (totals.asked or 0)).select(*share, F.lit(True).alias("__hot"))
    tried = requests.join(F.broadcast(many), share, "left").join(shuffled(parts), "component")
    turn = F.pmod(F.when(F.col("__hot"), F.xxhash64(*share, "request")).otherwise(F.xxhash64(*share)), "blocks")
    copies = edges.join(shuffled(parts), "component").select(*edges.columns, F.col("big").alias("big"), F.col("part").alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    # As many tasks as blocks: their work is the searches, which the size of their rows doesn't tell.
    key = -(-(totals.asked or 0) // block) or 1, "big", "part", "block"
    return tried.withColumn("block", turn).drop("__hot", "blocks").repartition(*key), copies.repartition(*key)


def by_part(requests: DataFrame, edges: DataFrame, search: Callable[[pd.DataFrame, pd.DataFrame], list[tuple]], schema: str) -> DataFrame:
    """The rows that ``search`` makes of the requests and the edges of each component, of frames that ``dealt`` made."""
    key, columns = ["big", "part", "block"], [c.split()[0] for c in schema.split(", ")]

    def run(asked: pd.DataFrame, lines: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(asked) and len(lines):
            lines = lines.sort_values("edge_id")
            within = lines.groupby("component").indices
            for component, at in asked.groupby("component").indices.items():
                rows += search(asked.iloc[at], lines.iloc[within[component]])
        return pd.DataFrame(rows, columns=columns)

    return requests.groupBy(key).cogroup(edges.groupBy(key)).applyInPandas(run, schema)


def route_batch(requests: DataFrame, edges: DataFrame, weights: tuple[float, ...] = (0.0, 5.0, 15.0, 40.0)) -> DataFrame:
    """Routes for requests (request, src, dst, moment) on edges (edge_id, u, v, length_m, tree_count, park_canopy) with density(moment).

    ``edges`` holds ``densities``, an array over moments. One row a request and
    weight: length, minutes, tree count, shade and park shares and the edges of
    the path; null measures where there is no path. Shade never falls as the
    weight grows: such a route is replaced by the shadiest one so far. Only ends
    that hang together have a path, so a task searches the components of its
    part; those of more than BROADCAST_EDGES edges go by frames. Requests of one
    source and moment share its searches.
    """
    edges = save_table(edges.select("edge_id", "u", "v", "length_m", "tree_count", "park_canopy", "densities"), "route-edges")
    rows = save_table(requests.select("request", "src", "dst", "moment"), "route-requests")
    total, comp = rows.count(), labels(edges.select("u", "v"))
    for end in ("src", "dst"):
        rows = save_table(look_up(rows, end, comp.select(F.col("k").alias(end), F.col("component").alias(f"c_{end}")), f"c_{end}", total), "route-requests")
    joined = F.coalesce(F.col("c_src") == F.col("c_dst"), F.lit(False))
    none = [F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in ROUTE_SCHEMA.split(", ")[2:]]
    out = rows.where(~joined).select("request", F.explode(F.array(*(F.lit(float(w)) for w in sorted(weights)))).alias("weight"), *none)
    asked = rows.where(joined).select("request", "src", "dst", "moment", F.col("c_src").alias("component"))
    lines = save_table(edges.join(shuffled(comp.withColumnRenamed("k", "u")), "u"), "route-edges")
    large = save_table(lines.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > BROADCAST_EDGES).select("component"), "large")
    if not large.isEmpty():
        large = F.broadcast(large)  # few, as each has many edges
        frames = _routes_by_frames(asked.join(large, "component", "left_semi"), lines.join(large, "component", "left_semi").drop("component"), weights)
        out = out.unionByName(frames)
        asked, lines = (f.join(large, "component", "left_anti") for f in (asked, lines))

    def search(mine: pd.DataFrame, t: pd.DataFrame) -> list[tuple]:
        graph, length = Csr(t), np.maximum(t.length_m.to_numpy(), LEAST_M)
        density = np.stack(t.densities.to_numpy())
        trees, canopy, ids = t.tree_count.to_numpy(), t.park_canopy.to_numpy(), t.edge_id.to_numpy()
        costs: dict[tuple[int, float], list[float]] = {}
        searches: dict[float, Search] = {}
        now, rows = None, []
        for r in mine.sort_values(["src", "moment"]).itertuples():
            if now != (r.src, r.moment):
                now, searches = (r.src, r.moment), {}
            best = None
            for w in sorted(weights):
                key = (int(r.moment), w)
                if key not in costs:
                    costs[key] = (length / (1 + w * density[:, key[0]])).tolist()
                if w not in searches:
                    searches[w] = Search(graph, costs[key], int(r.src))
                found = searches[w].path(int(r.dst))
                e = np.array(found[1], dtype=np.int64)
                row = _measures(float(length[e].sum()), int(trees[e].sum()), float((length[e] * density[e, key[0]]).sum()), float((length[e] * canopy[e]).sum()), ids[e])
                if best is None or row[3] >= best[3] - 1e-9:
                    best = row
                rows.append((r.request, w, *best))
        return rows

    return out.unionByName(by_part(*dealt(asked, lines, ["src", "moment"]), search, ROUTE_SCHEMA))


def _measures(length: float, trees: int, shade: float, park: float, edges: np.ndarray | list[int]) -> tuple:
    """A route's row from its sums; shade and park are weighted by length."""
    per = max(length, LEAST_M)
    return length, length / WALK_M_S / 60, trees, shade / per / 0.033, park / per, edges


def _routes_by_frames(requests: DataFrame, edges: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """The rows of route_batch with no edge on the driver: frontiers relaxed as frames, then paths walked back to their sources."""
    key, edge_of = ["src", "moment", "weight"], edges.withColumn("length", F.greatest("length_m", F.lit(LEAST_M)))
    ladder = F.explode(F.array(*(F.lit(float(w)) for w in sorted(weights)))).alias("weight")
    asked = cut(requests.select("request", "src", "dst", "moment").withColumn("row", F.monotonically_increasing_id()))
    wanted = cut(asked.select("src", "moment", "dst").distinct().select("src", "moment", "dst", ladder))
    arcs = edge_of.select(F.col("u").alias("a"), F.col("v").alias("b"), "edge_id", "length", "densities")
    arcs = cut(arcs.unionByName(arcs.select(F.col("b").alias("a"), F.col("a").alias("b"), "edge_id", "length", "densities")))
    onward = F.col("d") + F.col("length") / (1 + F.col("weight") * F.element_at("densities", F.col("moment") + 1))
    known = arcs.select(F.col("a").alias("src")).distinct()
    best = front = cut(wanted.select(key).distinct().join(known, "src").select(*key, F.col("src").alias("k"), F.lit(0.0).alias("d")))
    while not front.isEmpty():
        # Nothing beyond the farthest of a source's targets, once all are reached, is on a way to them.
        bound = wanted.join(best.withColumnRenamed("k", "dst"), [*key, "dst"], "left").groupBy(key).agg(F.max(F.coalesce("d", F.lit(float("inf")))).alias("most"))
        reached = front.join(arcs, front["k"] == arcs["a"]).select(*key, F.col("b").alias("k"), onward.alias("d")).groupBy(*key, "k").agg(F.min("d").alias("d"))
        nearer = reached.join(bound, key).where("d <= most").join(best.withColumnRenamed("d", "old"), [*key, "k"], "left")
        front = cut(nearer.where("old is null or d < old").select(*key, "k", "d"))
        best = cut(best.unionByName(front).groupBy(*key, "k").agg(F.min("d").alias("d")))
    # Ties as in Search: the predecessor that is settled first, then its smaller edge.
    steps = best.join(arcs, best["k"] == arcs["a"]).select(*key, F.col("b").alias("k"), onward.alias("to"), F.struct("d", "a", "edge_id").alias("p"))
    back = cut(steps.join(best, [*key, "k"]).where("to = d").groupBy(*key, "k").agg(F.min("p").alias("p")).select(*key, "k", "p.a", "p.edge_id"))
    walks = cut(wanted.join(best.select(*key, F.col("k").alias("dst")), [*key, "dst"]).select(*key, "dst", F.col("dst").alias("k"), F.array().cast("array<long>").alias("edges")))
    while not walks.where("k <> src").isEmpty():
        longer = F.when(F.col("edge_id").isNull(), F.col("edges")).otherwise(F.concat(F.array("edge_id"), "edges"))
        walks = cut(walks.join(back, [*key, "k"], "left").select(*key, "dst", F.coalesce("a", "k").alias("k"), longer.alias("edges")))
    parts = walks.select(*key, "dst", F.explode("edges").alias("edge_id")).join(edge_of, "edge_id")
    shade = F.col("length") * F.element_at("densities", F.col("moment") + 1)
    sums = parts.groupBy(*key, "dst").agg(F.sum("length").alias("length"), F.sum("tree_count").alias("trees"), F.sum(shade).alias("shade"), F.sum(F.col("length") * F.col("park_canopy")).alias("park"))
    routes = walks.join(sums, [*key, "dst"], "left").select(*key, "dst", "edges", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("length", "trees", "shade", "park")))

    def clamp(group: pd.DataFrame) -> pd.DataFrame:
        best, rows = None, []
        for r in group.sort_values("weight").itertuples():
            if r.edges is None:
                rows.append((r.request, r.weight, None, None, None, None, None, None))
                continue
            row = _measures(r.length, int(r.trees), r.shade, r.park, list(r.edges))
            if best is None or row[3] >= best[3] - 1e-9:
                best = row
            rows.append((r.request, r.weight, *best))
        return pd.DataFrame(rows, columns=ROUTE_COLUMNS)

    return asked.select("*", ladder).join(routes, [*key, "dst"], "left").groupBy("row").applyInPandas(clamp, ROUTE_SCHEMA)
