"""Queries that run on the DataFrame operators, beside the plain statements that the oracle answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from parasol.functions import geometry as g, sun
from parasol.operators import graph, spatial, steps
from parasol.operators.skew import shuffled
from parasol.plans.adapters import view, with_views
from parasol.session import save_table

_T = "greatest(0e0, least(1e0, ((px - ax) * (bx - ax) + (py - ay) * (bby - ay)) / nullif((bx - ax) * (bx - ax) + (bby - ay) * (bby - ay), 0)))"
_D = f"sqrt((px - ax - {_T} * (bx - ax)) * (px - ax - {_T} * (bx - ax)) + (py - ay - {_T} * (bby - ay)) * (py - ay - {_T} * (bby - ay)))"
_POINTS = f"{with_views('trees', 'faces')}, points as (select tree_id, x as px, y as py from trees)"


def _faces(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "faces").withColumnRenamed("bby", "by")


def _trees(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "trees").select("tree_id", F.col("x").alias("px"), F.col("y").alias("py"))


def nearest_with_runner_up(spark: SparkSession, d: str) -> DataFrame:
    out = spatial.nearest(_trees(spark, d), _faces(spark, d), 8.0, "tree_id", "face_id", "segment_id")
    return out.select("tree_id", "face_id", F.round("distance_m", 6).alias("distance_m"), F.round("runner_up_m", 6).alias("runner_up_m"))


def _walks(spark: SparkSession, d: str) -> DataFrame:
    """A sidewalk beside each kerb, two metres off and five metres longer."""
    f = _faces(spark, d)
    return f.select(F.col("face_id").alias("edge_id"), F.col("ax").alias("ax"), (F.col("ay") + 2.0).alias("ay"), (F.col("bx") + 5.0).alias("bx"), (F.col("by") + 2.0).alias("by"))


_WALKS = f"{with_views('faces')}, walks as (select face_id as edge_id, ax as wx, ay + 2e0 as wy, bx + 5e0 as vx, bby + 2e0 as vy, sqrt((bx + 5e0 - ax) * (bx + 5e0 - ax) + (bby - ay) * (bby - ay)) as len from faces)"


def length_profile(spark: SparkSession, d: str) -> DataFrame:
    out = spatial.length_profile(_walks(spark, d), _faces(spark, d).drop("edge_id"), 2.0, 5.0)
    return out.select("edge_id", "face_id", F.round("metres", 6).alias("metres"))


def _snap(spark: SparkSession, d: str, edges: DataFrame) -> DataFrame:
    n = view(spark, d, "nodes").select("k", "x", "y")
    e = edges.join(shuffled(n.toDF("u", "ax", "ay")), "u").join(shuffled(n.toDF("v", "bx", "by")), "v")
    return spatial.closest(_trees(spark, d), e, 200.0, "tree_id", "edge_id").select("tree_id", "edge_id", F.round("distance_m", 6).alias("distance_m"))


def knn_snap(spark: SparkSession, d: str) -> DataFrame:
    """The edge nearest to each tree, among all edges within 200 m."""
    return _snap(spark, d, view(spark, d, "edges"))


_EDGE_LINES = f"{with_views('edges', 'trees')}, lines as (select edge_id, a.x as ax, a.y as ay, b.x as bx, b.y as bby from edges join nodes a on a.k = u join nodes b on b.k = v ), points as (select tree_id, x as px, y as py from trees)"


def components(spark: SparkSession, d: str) -> DataFrame:
    return graph.labels(view(spark, d, "edges"))


def component_sizes(spark: SparkSession, d: str) -> DataFrame:
    sizes = components(spark, d).groupBy("component").agg(F.count("*").alias("nodes"))
    return sizes.withColumn("is_fragment", F.col("nodes") < 50)


def nested_connectivity(spark: SparkSession, d: str) -> DataFrame:
    """How well sidewalks hang together alone, with crossings, and with all paths: nodes, length, components, the largest, and nodes in fragments."""
    kind = F.when(F.col("edge_id") % 3 == 0, 0).when(F.col("edge_id") % 3 == 1, 1).otherwise(2)
    edges = view(spark, d, "edges").select("u", "v", "length_m", kind.alias("layer"))
    sizes = graph.nested_labels(edges, 3).groupBy("layer", "component").agg(F.count("*").alias("n"))
    shape = sizes.groupBy("layer").agg(F.sum("n").alias("nodes"), F.count("*").alias("components"), F.max("n").alias("largest"), F.sum(F.when(F.col("n") < 50, F.col("n")).otherwise(0)).alias("in_fragments"))
    length = edges.select("length_m", F.explode(F.sequence("layer", F.lit(2))).alias("layer")).groupBy("layer").agg(F.round(F.sum("length_m") / 1000, 6).alias("km"))
    return shape.join(length, "layer").select(F.element_at(F.array(*map(F.lit, "ABC")), F.col("layer") + 1).alias("layer"), "nodes", "km", "components", "largest", "in_fragments")


_REACH = f"""{with_views('edges')}, linked as (select u as a, v as b from edges union all select v, u from edges)"""
_RECURSIVE = _REACH.replace("with ", "with recursive ", 1) + ", reach(a, b) as (select a, b from linked union select r.a, l.b from reach r join linked l on l.a = r.b), comp as (select a as k, least(a, min(b)) as component from reach group by a)"


def _keys(nodes: DataFrame) -> int:
    """The largest key of the nodes and one, by which requests are folded to nodes."""
    return (nodes.agg(F.max("k")).first()[0] or 0) + 1


def _snap_pair(spark: SparkSession, d: str, req: DataFrame) -> DataFrame:
    """For start and end nodes (event_id, s, t), each moved a little: the component with the least sum of distances among those near both."""
    n = view(spark, d, "nodes").select("k", "x", "y")
    comp = components(spark, d)
    near = n.join(shuffled(comp), "k").select(F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("x").alias("bx"), F.col("y").alias("by"), "component")
    ends = [req.join(shuffled(n), req[k] == n["k"]).select("event_id", (F.col("x") + 13).alias("px"), (F.col("y") + 29).alias("py")) for k in "st"]
    found = [spatial.within(p, near, 200.0).groupBy("event_id", "component").agg(F.min("d").alias(c)) for p, c in zip(ends, ("ds", "dt"), strict=True)]
    both = found[0].join(shuffled(found[1]), ["event_id", "component"])
    best = both.groupBy("event_id").agg(F.min(F.struct((F.col("ds") + F.col("dt")).alias("sum"), "component")).alias("b"))
    return best.select("event_id", "b.component", F.round("b.sum", 6).alias("sum_m"))


def _ends(requests: DataFrame, keys: int) -> DataFrame:
    return requests.select("event_id", *(((F.col("event_id") * m) % keys).alias(k) for m, k in ((37, "s"), (53, "t"))))


def snap_component_pair(spark: SparkSession, d: str) -> DataFrame:
    """Component pairs of all requests, between any nodes."""
    return _snap_pair(spark, d, _ends(view(spark, d, "moments"), _keys(view(spark, d, "nodes"))))


def sssp_distance(spark: SparkSession, d: str) -> DataFrame:
    """Least lengths from three nodes, within 500 m."""
    e = view(spark, d, "edges").select("u", "v", F.col("length_m").alias("cost"))
    sources = view(spark, d, "nodes").where("k in (0, 41, 120)").select(F.col("k").alias("request"), "k")
    out = graph.distances(e, sources, 500.0)
    return out.select("request", "k", F.round("d", 6).alias("d"))


_WALK = f"""{with_views('edges').replace('with ', 'with recursive ', 1)}, linked as (select u as a, v as b, length_m as c from edges union all select v, u, length_m from edges),
    walk(request, k, d) as (select k, k, 0e0 from nodes where k in (0, 41, 120) union select w.request, l.b, w.d + l.c from walk w join linked l on l.a = w.k where w.d + l.c <= 500)
    select request, k, round(min(d), 6) as d from walk group by request, k"""


def compass_side(spark: SparkSession, d: str) -> DataFrame:
    v = view(spark, d, "trees").select("face_id", F.radians(F.floor(F.col("face_id") * 13 % 360) + F.when(F.col("tree_id") % 9 == 0, 180).otherwise((F.col("tree_id") * 7) % 50)).alias("a"))
    return spatial.compass_side(v.select("face_id", F.sin("a").alias("dx"), F.cos("a").alias("dy")), "face_id")


_SIDE = f"""{with_views('trees')},
    v as (select face_id, sin(radians(floor(face_id * 13 % 360) + case when tree_id % 9 = 0 then 180 else (tree_id * 7) % 50 end)) as dx, cos(radians(floor(face_id * 13 % 360) + case when tree_id % 9 = 0 then 180 else (tree_id * 7) % 50 end)) as dy from trees),
    m1 as (select face_id, sum(dx) as sx, sum(dy) as sy, count(*) as n from v group by face_id),
    kept as (select v.face_id, dx, dy, m1.n as total from v join m1 on m1.face_id = v.face_id where sqrt(sx * sx + sy * sy) / m1.n < 0.8e0 and dx * sx + dy * sy >= 0),
    m2 as (select face_id, sum(dx) as sx, sum(dy) as sy, count(*) as n from kept group by face_id having count(*) * 2 > max(total)),
    good as (select * from m1 where sqrt(sx * sx + sy * sy) / n >= 0.8e0 union all select * from m2 where sqrt(sx * sx + sy * sy) / n >= 0.8e0),
    way as (select face_id, degrees(atan2(sx, sy)) + case when atan2(sx, sy) < 0 then 360 else 0 end as w from good)
    select f.face_id, coalesce(case when w <= 40 or w >= 320 then 'N' when w between 50 and 130 then 'E' when w between 140 and 220 then 'S' when w between 230 and 310 then 'W' else '' end, '') as side
    from (select distinct face_id from v) f left join way on way.face_id = f.face_id"""


def _boxes(spark: SparkSession, d: str, which: str) -> DataFrame:
    b = view(spark, d, "buildings").where(which).select("x0", "y0", (F.col("x0") + 12).alias("x1"), (F.col("y0") + 12).alias("y1"), (F.col("building_id") % 40 * 1.0).alias("height"))
    return b


def _probes(spark: SparkSession, d: str, which: str, deep: int) -> DataFrame:
    """Points of the nodes, spread over 1,500 by ``deep`` metres."""
    return view(spark, d, "nodes").where(which).select(F.col("k").alias("point_id"), ((F.col("k") * 37) % 1500 + 0.25).alias("px"), ((F.col("k") * 53) % deep + 0.25).alias("py"))


def _depth(spark: SparkSession, d: str) -> int:
    """Metres from the first row of buildings to behind the last; 260 for 400 buildings."""
    return 30 * ((view(spark, d, "buildings").agg(F.max("building_id")).first()[0] or 0) // 50 + 1) + 20


def _march(boxes: DataFrame, points: DataFrame) -> DataFrame:
    """Shadow at 45 degrees from the south, on 3 m cells in hops of 1.5 m."""
    return spatial.march(points, spatial.rasterise(boxes, 3.0), 3.0, 1.5, 180.0, 1.0, 60.0)


def raster_march_small(spark: SparkSession, d: str) -> DataFrame:
    """Shadow of all buildings on all nodes."""
    return _march(_boxes(spark, d, "true"), _probes(spark, d, "true", _depth(spark, d)))


_MARCH = f"""{with_views('buildings', 'nodes')},
    boxes as (select x0, y0, (building_id % 40) * 1e0 as height from buildings ),
    deep as (select 30 * (max(building_id) DIV 50 + 1) + 20 as deep from buildings),
    pts as (select k as point_id, (k * 37) % 1500 + 0.25e0 as px, (k * 53) % deep + 0.25e0 as py from nodes cross join deep),
    hops as (select point_id, px, py, unnest(generate_series(1, 40)) as k from pts),
    centred as (select point_id, k, (floor((px + k * 1.5e0 * sin(radians(180e0))) / 3) + 0.5e0) * 3 as mx, (floor((py + k * 1.5e0 * cos(radians(180e0))) / 3) + 0.5e0) * 3 as my from hops),
    hit as (select distinct point_id from centred join boxes on mx > x0 and mx < x0 + 12 and my > y0 and my < y0 + 12 and height >= k * 1.5e0)
    select p.point_id, h.point_id is not null as shaded from pts p left join hit h on h.point_id = p.point_id"""


def _bytes(marched: DataFrame) -> DataFrame:
    """Shaded samples per owner as a byte, half to even."""
    s = marched.groupBy((F.col("point_id") % 97).alias("owner")).agg(F.count("*").alias("n"), F.count_if("shaded").alias("shaded"))
    return s.select("owner", "n", "shaded", F.rint(255.0 * F.col("shaded") / F.col("n")).cast("long").alias("value"))


def shaded_bytes(spark: SparkSession, d: str) -> DataFrame:
    """Shaded samples per owner over all points."""
    return _bytes(raster_march_small(spark, d))


def _sweep(boxes: DataFrame, points: DataFrame) -> DataFrame:
    """Points in the shadow of a box moved along one direction: in the box, in the moved box, or between."""
    b = boxes.where("height > 20").withColumn("building", F.monotonically_increasing_id())
    tall = b.withColumn("y1", F.col("y1") + F.col("height"))  # the sun due south at 45 degrees moves the box north by its height
    size = 40.0
    placed = points.withColumn("cx", g.cell(F.col("px"), size)).withColumn("cy", g.cell(F.col("py"), size))
    cells = shuffled(tall.withColumn("cx", F.explode(F.sequence(g.cell(F.col("x0"), size), g.cell(F.col("x1"), size)))).withColumn("cy", F.explode(F.sequence(g.cell(F.col("y0"), size), g.cell(F.col("y1"), size)))))
    inside = (F.col("px") > F.col("x0")) & (F.col("px") < F.col("x1")) & (F.col("py") > F.col("y0")) & (F.col("py") < F.col("y1"))
    return placed.join(cells, ["cx", "cy"]).where(inside).groupBy("point_id").agg(F.count("*").alias("shadows"))


def shadow_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Shadows of all buildings on all nodes."""
    return _sweep(_boxes(spark, d, "true"), _probes(spark, d, "true", _depth(spark, d)))


_SWEEP = f"""{with_views('buildings', 'nodes')}, boxes as (select x0, y0, (building_id % 40) * 1e0 as height from buildings where building_id % 40 > 20),
    deep as (select 30 * (max(building_id) DIV 50 + 1) + 20 as deep from buildings),
    pts as (select k as point_id, (k * 37) % 1500 + 0.25e0 as px, (k * 53) % deep + 0.25e0 as py from nodes cross join deep)
    select point_id, count(*) as shadows from pts join boxes on px > x0 and px < x0 + 12 and py > y0 and py < y0 + 12 + height group by point_id"""


def geometry_kernel(spark: SparkSession, d: str) -> DataFrame:
    n = view(spark, d, "nodes")
    a = [F.col(c) for c in ("lon", "lat", "lon2", "lat2")]
    p = n.withColumn("lon2", F.col("lon") + (F.col("k") % 13 - 6) * 0.001).withColumn("lat2", F.col("lat") + (F.col("k") % 17 - 8) * 0.001)
    return p.select(
        "k",
        F.round(g.bearing(*a), 6).alias("bearing"),
        F.round(g.local_distance(*a), 6).alias("local_m"),
        F.round(g.haversine(*a), 6).alias("sphere_m"),
        F.round(g.flat_x(F.col("lon")), 6).alias("flat_x"),
        F.round(g.flat_y(F.col("lat")), 6).alias("flat_y"),
        F.round(g.turn_between(g.undirected(g.bearing(*a)), F.lit(40.0), 180.0), 6).alias("off_40"),
        g.side_of_line(F.col("x"), F.col("y"), F.lit(0.0), F.lit(0.0), F.lit(2000.0), F.lit(1300.0)).cast("long").alias("side"),
    )


_KERNEL = f"""{with_views('nodes')}, p as (select *, lon + (k % 13 - 6) * 0.001e0 as lon2, lat + (k % 17 - 8) * 0.001e0 as lat2 from nodes),
    b as (select *, degrees(atan2((lon2 - lon) * cos(radians((lat + lat2) / 2)), lat2 - lat)) as raw from p), w as (select *, case when raw < 0 then raw + 360 else raw end as bearing from b)
    select k, round(bearing, 6) as bearing,
    round(sqrt(((lon2 - lon) * 111320e0 * cos(radians((lat + lat2) / 2))) * ((lon2 - lon) * 111320e0 * cos(radians((lat + lat2) / 2))) + ((lat2 - lat) * 111320e0) * ((lat2 - lat) * 111320e0)), 6) as local_m,
    round(2 * 6371000e0 * asin(sqrt(pow(sin(radians(lat2 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon) / 2), 2))), 6) as sphere_m,
    round(lon * 111320e0 * cos(radians(40.7e0)), 6) as flat_x, round(lat * 110540e0, 6) as flat_y,
    round(least(abs(bearing % 180 - 40), 180 - abs(bearing % 180 - 40)), 6) as off_40,
    cast(case when 2000e0 * y - 1300e0 * x >= 0 then 1 else -1 end as bigint) as side from w"""


def _route_graph(spark: SparkSession, d: str) -> DataFrame:
    e = view(spark, d, "scored_edges")
    dens = [F.least((F.col("tree_evergreen") + F.col("tree_deciduous") * c) / F.greatest("length_m", F.lit(0.01)) / 0.033, F.lit(1.0)) * 0.033 for c in (0.2, 1.0)]
    return e.select("edge_id", "u", "v", "length_m", F.col("tree_count").cast("long").alias("tree_count"), F.col("tree_park_canopy").alias("park_canopy"), F.array(*dens).alias("densities"))


def _route_requests(spark: SparkSession, d: str) -> DataFrame:
    """A request for every event, between any nodes."""
    keys = _keys(view(spark, d, "nodes"))
    return view(spark, d, "moments").select(F.col("event_id").alias("request"), ((F.col("user_id") * 7) % keys).alias("src"), ((F.col("event_id") * 37) % keys).alias("dst"), (F.col("event_id") / 50 % 2).cast("int").alias("moment"))


def route_batch(spark: SparkSession, d: str) -> DataFrame:
    return graph.route_batch(_route_requests(spark, d), _route_graph(spark, d)).withColumn("edges", F.array_join("edges", ","))


def route_steps(spark: SparkSession, d: str) -> DataFrame:
    """Steps of the routes of route_batch."""
    # Routes and legs are read several times, so they are written.
    found = save_table(graph.route_batch(_route_requests(spark, d), _route_graph(spark, d)).where(F.size("edges") > 0).select("request", "weight", "edges"), "routes")
    routes = found.select("request", "weight", F.posexplode("edges").alias("seq", "edge_id"))
    n = view(spark, d, "nodes").select("k", F.array("lon", "lat").alias("at"))
    e = view(spark, d, "edges").join(n.toDF("u", "a"), "u").join(n.toDF("v", "b"), "v")
    kind = F.when(F.col("edge_id") % 7 == 0, "footway/crossing").otherwise("footway/sidewalk")
    side = F.element_at(F.array(*map(F.lit, ["N", "S", "E", "W", ""])), (F.col("edge_id") % 5 + 1).cast("int"))
    legs = routes.join(e, "edge_id").select("request", "weight", "seq", "name", side.alias("side"), kind.alias("kind"), F.array("name").alias("fold_names"), "length_m", F.array("a", "b").alias("coords"))
    return steps.build_steps(save_table(legs, "legs"))


def sun_positions(spark: SparkSession, d: str) -> DataFrame:
    """Where the sun stands at the time of every event; null at night."""
    azimuth, elevation = sun.position(F.unix_seconds(F.col("ts").cast("timestamp")))
    e = view(spark, d, "moments").select("event_id", F.round(azimuth, 3).alias("azimuth"), F.round(elevation, 3).alias("elevation"))
    return e.select("event_id", *(F.when(F.col("elevation") > 0, F.col(c)).alias(c) for c in ("azimuth", "elevation")))


def geodesic_lengths(spark: SparkSession, d: str) -> DataFrame:
    n = view(spark, d, "nodes").select("k", "lon", "lat")
    e = view(spark, d, "edges").join(n.toDF("u", "lon1", "lat1"), "u").join(n.toDF("v", "lon2", "lat2"), "v")
    x, y = g.feet_position(F.col("lon1"), F.col("lat1"))
    return e.select("edge_id", F.round(g.vincenty(*(F.col(c) for c in ("lon1", "lat1", "lon2", "lat2"))), 1).alias("length_m"), F.round(x, 3).alias("x_ft"), F.round(y, 3).alias("y_ft"))


QUERIES = {f.__name__: f for f in (nearest_with_runner_up, length_profile, knn_snap, components, component_sizes, nested_connectivity, snap_component_pair, sssp_distance, compass_side, raster_march_small, shaded_bytes, shadow_sweep, geometry_kernel, route_batch, route_steps, sun_positions, geodesic_lengths)}

ORACLE_TEXTS = {
    "nearest_with_runner_up": f"""{_POINTS}, pairs as (select tree_id, face_id, segment_id, {_D} as d from points cross join faces),
        close as (select * from pairs where d <= 8), grouped as (select tree_id, segment_id, min(ROW(d, face_id)) as b, min(d) as d from close group by 1, 2),
        first as (select tree_id, min(d) as d from close group by 1), owner as (select c.tree_id, min(face_id) as face_id, min(c.d) as d from close c join first f on f.tree_id = c.tree_id and f.d = c.d group by 1),
        own as (select o.*, f.segment_id from owner o join faces f on f.face_id = o.face_id),
        second as (select o.tree_id, min(c.d) as d from own o join close c on c.tree_id = o.tree_id and c.segment_id <> o.segment_id group by 1)
        select o.tree_id, o.face_id, round(o.d, 6) as distance_m, round(s.d, 6) as runner_up_m from own o left join second s on s.tree_id = o.tree_id""",
    "length_profile": f"""{_WALKS}, n as (select *, cast(greatest(ceil(len / 2), 1) as bigint) as n from walks), i as (select *, unnest(generate_series(0, n - 1)) as i from n),
        points as (select edge_id, i, len / n as metres, wx + (i + 0.5e0) / n * (vx - wx) as px, wy + (i + 0.5e0) / n * (vy - wy) as py from i),
        pairs as (select p.*, face_id, {_D} as d from points p cross join faces),
        ranked as (select *, row_number() over (partition by edge_id, i order by d, face_id) as r from pairs where d <= 5)
        select edge_id, face_id, round(sum(metres), 6) as metres from ranked where r = 1 group by 1, 2""",
    "knn_snap": f"""{_EDGE_LINES}, pairs as (select tree_id, edge_id, {_D} as d from points cross join lines), ranked as (select *, row_number() over (partition by tree_id order by d, edge_id) as r from pairs where d <= 200)
        select tree_id, edge_id, round(d, 6) as distance_m from ranked where r = 1""",
    "nested_connectivity": f"""{with_views('edges').replace('with ', 'with recursive ', 1)}, layered as (select unnest(range(edge_id % 3, 3)) as layer, u, v, length_m from edges),
        linked as (select layer, u as a, v as b from layered union select layer, v, u from layered),
        reach(layer, a, b) as (select layer, a, b from linked union select r.layer, r.a, l.b from reach r join linked l on l.layer = r.layer and l.a = r.b),
        comp as (select layer, a as k, least(a, min(b)) as component from reach group by layer, a),
        sizes as (select layer, component, count(*) as n from comp group by layer, component),
        shape as (select layer, cast(sum(n) as bigint) as nodes, count(*) as components, max(n) as largest, cast(coalesce(sum(n) filter (where n < 50), 0) as bigint) as in_fragments from sizes group by layer),
        far as (select layer, round(sum(length_m) / 1000, 6) as km from layered group by layer)
        select case layer when 0 then 'A' when 1 then 'B' else 'C' end as layer, nodes, km, components, largest, in_fragments from shape join far using (layer)""",
    "components": f"{_RECURSIVE} select k, component from comp",
    "component_sizes": f"{_RECURSIVE} select component, count(*) as nodes, count(*) < 50 as is_fragment from comp group by component",
    "snap_component_pair": f"""{_RECURSIVE.replace(with_views('edges')[5:], with_views('edges', 'moments')[5:])},
        req as (select event_id, (event_id * 37) % (select max(k) + 1 from nodes) as s, (event_id * 53) % (select max(k) + 1 from nodes) as t from moments),
        near as (select r.event_id, e.side, c.component, min(sqrt((p.x + 13 - n.x) * (p.x + 13 - n.x) + (p.y + 29 - n.y) * (p.y + 29 - n.y))) as d
                 from req r cross join (select 's' as side union all select 't') e join nodes p on p.k = case when e.side = 's' then r.s else r.t end join nodes n on abs(n.x - p.x - 13) <= 200 and abs(n.y - p.y - 29) <= 200 join comp c on c.k = n.k
                 where sqrt((p.x + 13 - n.x) * (p.x + 13 - n.x) + (p.y + 29 - n.y) * (p.y + 29 - n.y)) <= 200 group by 1, 2, 3),
        sums as (select a.event_id, a.component, a.d + b.d as d from near a join near b on b.event_id = a.event_id and b.component = a.component and a.side = 's' and b.side = 't'),
        ranked as (select *, row_number() over (partition by event_id order by d, component) as r from sums)
        select event_id, component, round(d, 6) as sum_m from ranked where r = 1""",
    "sssp_distance": _WALK,
    "compass_side": _SIDE,
    "raster_march_small": _MARCH,
    "shaded_bytes": f"with m as ({_MARCH}), s as (select point_id % 97 as owner, count(*) as n, count(case when shaded then 1 end) as shaded from m group by 1) select owner, n, shaded, cast(round_even(255e0 * shaded / n, 0) as bigint) as value from s",
    "shadow_sweep": _SWEEP,
    "geometry_kernel": _KERNEL,
}
