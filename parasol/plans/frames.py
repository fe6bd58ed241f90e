"""The registered queries as DataFrames, made of the library's functions and operators; the oracle's texts are written apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from parasol.functions import moments as M, sun, tags as T, trees as V, wording as W
from parasol.operators import polygons, ranks, scoring, stats, ways
from parasol.operators.skew import shuffled
from parasol.plans.adapters import run, view


def r6(value: Column | str, name: str) -> Column:
    return F.round(value, 6).alias(name)


def long(value: Column | str, name: str) -> Column:
    return (F.col(value) if isinstance(value, str) else value).cast("long").alias(name)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# Trees and their sums


def trees(spark: SparkSession, d: str) -> DataFrame:
    t = view(spark, d, "trees")
    return t.withColumn("value", V.tree_value(F.col("dbh"), F.col("tpcondition"))).withColumn("is_evergreen", V.is_evergreen(F.col("genusspecies")))


def tree_value_by_condition(spark, d):
    by = trees(spark, d).groupBy(V.condition(F.col("tpcondition")).alias("condition"), "is_evergreen")
    return by.agg(F.count("*").alias("n"), F.count("value").alias("n_counted"), r6(F.coalesce(F.sum("value"), F.lit(0.0)), "total"))


def tree_summary_tally(spark, d):
    return trees(spark, d).groupBy(V.tree_bucket(F.col("dbh"), F.col("tpcondition"), F.col("genusspecies")).alias("bucket")).agg(F.count("*").alias("n"))


def face_tree_totals(spark, d):
    faces = view(spark, d, "faces").select("face_id", "street", "side")
    got = faces.join(scoring.face_totals(trees(spark, d)), "face_id", "left")
    return got.select("face_id", "street", "side", *(r6(F.coalesce(c, F.lit(0.0)), c) for c in ("evergreen", "deciduous")), F.coalesce("trees", F.lit(0)).alias("trees"))


def face_density_month(spark, d):
    totals = scoring.face_totals(trees(spark, d)).where("trees > 0").join(scoring.pavement(view(spark, d, "profiles")), "face_id")
    month = F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month")
    shade = F.least((F.col("evergreen") + F.col("deciduous") * V.canopy(F.col("month"))) / F.col("metres") / V.FULL_DENSITY, F.lit(1.0))
    return totals.select("*", month).select("face_id", "month", r6(shade, "density"))


def allocation_shares(spark, d):
    out = scoring.allocate(view(spark, d, "profiles"), scoring.face_totals(trees(spark, d)))
    return out.select("edge_id", r6(F.col("evergreen") + F.col("deciduous"), "value"), r6("trees", "tree_count"), "outcome")


def allocation_conservation(spark, d):
    totals = scoring.face_totals(trees(spark, d)).where("trees > 0")
    shares = scoring.shares(view(spark, d, "profiles")).join(totals, "face_id")
    whole = F.col("evergreen") + F.col("deciduous")
    return shares.groupBy("face_id").agg(r6(F.sum(F.col("share") * whole), "allocated"), r6(F.max(whole), "total"))


def dominant_face(spark, d):
    return scoring.dominant(view(spark, d, "profiles")).select("edge_id", "face_id", r6("metres", "metres"))


def canopy_credit(spark, d):
    e = view(spark, d, "scored_edges").withColumn("canopy", F.when(F.col("edge_id") % 13 != 0, F.col("edge_id") % 21 / 20))
    outcome = F.when(F.col("edge_id") % 5 == 0, "no_face").when(F.col("edge_id") % 5 == 1, "treeless_face").otherwise("scored")
    e = e.withColumn("outcome", outcome).withColumn("credit", scoring.canopy_credit(F.col("canopy"), F.col("length_m"), F.col("edge_id") % 3 == 0, outcome, F.col("edge_id") % 4 / 4))
    return e.select("edge_id", "outcome", r6(F.col("tree_deciduous") + F.col("credit"), "tree_deciduous"), r6("credit", "park_canopy"))


# Moments


def requested(spark, d) -> DataFrame:
    m = view(spark, d, "moments")
    at = M.request_time(*(F.col(c) for c in ("month", "day", "hour", "minute", "ts")))
    return m.select("event_id", "user_id", "arrive", "layers", "n_weights", "top_weight", F.col("hour").isNull().alias("no_hour"), *(c.alias(n) for n, c in at.items()))


def valid(spark, d) -> DataFrame:
    q = requested(spark, d)
    return q.where(F.col("month").between(1, 12) & F.col("hour").between(0, 23) & F.col("layers").isin(*M.LAYERS) & F.col("day").between(1, M.last_day(F.col("month"))))


#: The stub sun table of these queries is dark before six and after 20 o'clock.
def stub_sun(spark) -> DataFrame:
    grid = spark.range(288).select((F.floor(F.col("id") / 24) + 1).cast("int").alias("month"), (F.col("id") % 24).cast("int").alias("hour"))
    day = F.col("hour").between(6, 20)
    return grid.select("month", "hour", F.when(day, F.col("hour") * 15.0).alias("azimuth"), F.when(day, 60.0 - F.abs(F.col("hour") - 13) * 8.0).alias("elevation"))


def blended(spark, d) -> DataFrame:
    m0, m1, g = M.month_blend(F.col("month"), F.col("day"))
    q = valid(spark, d).withColumns({"m0": m0, "m1": m1, "g": g})
    return q.withColumn("at", M.corners(*(F.col(c) for c in ("m0", "m1", "g", "hour", "minute"))))


def request_normalise(spark, d):
    return requested(spark, d).select("event_id", "month", "day", "hour", "minute")


def request_validate(spark, d):
    q = requested(spark, d).withColumn("detail", M.problem(*(F.col(c) for c in ("arrive", "no_hour", "month", "day", "hour", "minute", "layers", "n_weights")), F.lit(0.0), F.col("top_weight")))
    return q.select("event_id", F.when(F.col("detail").isNull(), 200).otherwise(400).alias("status"), "detail")


def slot_index(spark, d):
    return valid(spark, d).select("event_id", M.slot_index(F.col("month"), F.col("hour")).alias("slot"))


def month_blend(spark, d):
    return blended(spark, d).select("event_id", long("m0", "m0"), long("m1", "m1"), r6("g", "g"))


def blend_weights(spark, d):
    return blended(spark, d).select("event_id", F.posexplode("at").alias("corner", "c")).select("event_id", "corner", "c.slot", r6("c.weight", "weight"))


def night_flag(spark, d):
    return blended(spark, d).select("event_id", M.is_night(F.col("at"), M.dark_slots(stub_sun(spark))).alias("is_night"))


def dark_share(spark, d):
    return blended(spark, d).select("event_id", r6(M.dark_share(F.col("at"), M.dark_slots(stub_sun(spark))), "dark_share"))


def shaded_pairs(spark, d) -> DataFrame:
    """Every moment with about ten edges and every edge with some moments, by a remainder that grows with the edges; with the fractions of shade."""
    e = view(spark, d, "scored_edges")
    m = max(101, (e.agg(F.max("edge_id")).first()[0] or 0) // 10)
    pairs = blended(spark, d).join(e, F.col("event_id") % m == F.col("edge_id") % m)
    dark = M.dark_slots(stub_sun(spark))
    byte = lambda slot: (F.col("edge_id") * 31 + slot * 17) % 256
    return pairs.select(
        "event_id",
        "edge_id",
        "layers",
        "length_m",
        M.tree_fraction(*(F.col(c) for c in ("tree_evergreen", "tree_deciduous", "length_m", "m0", "m1", "g"))).alias("tree"),
        M.building_fraction(F.col("at"), dark, byte).alias("building"),
        M.dark_share(F.col("at"), dark).alias("dark"),
    )


def _density(has_hour: bool) -> Column:
    return M.edge_density(*(F.col(c) for c in ("layers", "tree", "building", "dark")), F.lit(has_hour))


def tree_fraction(spark, d):
    return shaded_pairs(spark, d).select("event_id", "edge_id", r6("tree", "tree_fraction"))


def building_fraction(spark, d):
    return shaded_pairs(spark, d).select("event_id", "edge_id", r6("building", "building_fraction"))


def edge_density_layers(spark, d):
    return shaded_pairs(spark, d).select("event_id", "edge_id", "layers", r6(_density(True) + 1e-10, "density"), r6(_density(False) + 1e-10, "density_no_hour"))


def edge_cost_ladder(spark, d):
    rows = shaded_pairs(spark, d).select("event_id", "edge_id", "length_m", _density(True).alias("density"), F.explode(F.array(*map(F.lit, W.PRESETS))).alias("weight"))
    return rows.select("event_id", "edge_id", "weight", r6(M.edge_cost(F.col("length_m"), F.col("weight"), F.col("density")), "cost"))


def lit_moments(spark, d, table_of_sun: DataFrame) -> DataFrame:
    """Valid moments of events in slots with sun, and where it stands: event_id, slot, azimuth, elevation."""
    at = valid(spark, d).select("event_id", M.slot_index(F.col("month"), F.col("hour")).alias("slot"))
    return at.join(F.broadcast(M.daylight_slots(table_of_sun)), "slot").select("event_id", "slot", "azimuth", "elevation")  # at most 288 slots


def daylight_slots(spark, d):
    """Events' moments in the slots of the stub sun table that have sun."""
    return lit_moments(spark, d, stub_sun(spark))


def leave_time(spark, d):
    left = M.leave_time(*(F.col(c) for c in ("month", "day", "hour", "minute")), F.col("event_id") % 173 / 2)
    rows = valid(spark, d).select("event_id", left.alias("t"))
    return rows.select("event_id", *(long(f("t"), n) for n, f in (("month", F.month), ("day", F.day), ("hour", F.hour), ("minute", F.minute))))


# Tags and filters


def usable_buildings_tally(spark, d):
    b = view(spark, d, "buildings").select(V.number(F.col("height_roof")).alias("height"), V.building_outcome(*(F.col(c) for c in ("height_roof", "status", "feature_code"))).alias("outcome"))
    return b.groupBy("outcome").agg(F.count("*").alias("n"), r6(F.coalesce(F.sum("height"), F.lit(0.0)), "total_height"))


def real_park_filter(spark, d):
    return view(spark, d, "parks").select("park_id", V.is_real_park(F.col("typecategory"), F.col("subcategory")).alias("is_park"))


def pedestrian_predicate(spark, d):
    w = view(spark, d, "ways")
    return w.select("way_id", T.is_pedestrian(*(F.col(c) for c in ("highway", "foot", "access", "area"))).alias("is_pedestrian"), T.kind(F.col("highway"), F.col("footway")).alias("kind"), V.text(F.col("name")).alias("name"), T.is_connector(F.col("footway")).alias("is_connector"))


def named_street_predicate(spark, d):
    w = view(spark, d, "ways")
    return w.select("way_id", T.is_named_street(*(F.col(c) for c in ("name", "highway", "area", "service"))).alias("is_named_street"), T.width_class(F.col("way_id") % 60).alias("width_class"))


def fixture_cut(spark, d):
    nodes, kept = ways.fixture_cut(view(spark, d, "nodes").select("k", "x", "y"), view(spark, d, "edges"), (300, 2100), (160, 1600))
    count = lambda f, key, name: f.agg(F.count("*").alias("n"), F.sum(key).alias("ids")).select(F.lit(name).alias("what"), "n", "ids")
    return count(kept, "edge_id", "edge").unionByName(count(nodes, "k", "node"))


# Distributions


def items(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_returnflag").alias("grp"), F.col("l_extendedprice").alias("v"), F.col("l_quantity").alias("w"), "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", F.col("l_discount").alias("d"))


def index_percentiles(spark, d):
    return stats.index_percentiles(items(spark, d), ["grp"], "v", p90=stats.share_of(0.9), q1=stats.quarter(1), q3=stats.quarter(3), p50=stats.nearest_rank(0.5))


def weighted_percentile(spark, d):
    return stats.weighted_percentiles(items(spark, d), ["grp"], "v", "w", p10=0.1, p50=0.5, p90=0.9)


def interpolated_percentile(spark, d):
    out = stats.interpolated_percentiles(items(spark, d), ["grp"], "v", p25=0.25, p50=0.5, p90=0.9)
    return out.select("grp", *(r6(c, c) for c in ("p25", "p50", "p90")))


def zero_intercept_fit(spark, d):
    i = items(spark, d).where("w > 0")
    return i.groupBy("grp").agg(r6(stats.zero_intercept(F.col("w"), F.col("v")), "slope"), r6(F.median(F.col("v") / F.col("w")), "median_ratio"), F.count("*").alias("n"))


def binned_median_slope(spark, d):
    out = stats.binned_median_slope(items(spark, d), ["grp"], F.col("d") * 10, "v")
    return out.select("grp", r6("slope", "slope"), "bins")


def gap_width_slope(spark, d):
    bands = items(spark, d).groupBy("grp", (F.col("l_suppkey") % 10).alias("band")).agg(F.avg("v").alias("m"))
    return bands.groupBy("grp").agg(r6(F.regr_slope("m", "band"), "slope"), r6(F.regr_intercept("m", "band"), "intercept"))


def canopy_fraction(spark, d):
    px = items(spark, d).select(F.col("l_suppkey").alias("strip"), (F.col("l_partkey") % 8).alias("class"))
    return px.groupBy("strip").agg(r6(stats.canopy_share(F.col("class")), "fraction"), F.count_if(F.col("class") != 0).alias("valid"))


def lopsided_share(spark, d):
    side = lambda k: F.sum(F.when(F.col("l_linenumber") % 2 == k, F.col("w")).otherwise(0.0))
    sides = items(spark, d).groupBy(F.col("l_suppkey").alias("street")).agg(side(0).alias("l"), side(1).alias("r")).where("l + r > 0")
    rows = sides.select(T.width_class(F.col("street") % 60).alias("width_class"), stats.lopsided(F.col("l"), F.col("r")).alias("share"), ((F.col("l") == 0) | (F.col("r") == 0)).alias("one_sided"))
    return rows.groupBy("width_class").agg(F.count("*").alias("n"), r6(F.avg("share"), "mean_share"), F.count_if(F.col("share") >= 0.7).alias("n70"), F.count_if(F.col("share") >= 0.9).alias("n90"), F.count_if("one_sided").alias("one_sided"))


def purity_spill(spark, d):
    edge = view(spark, d, "profiles").groupBy("edge_id").agg(F.max("metres").alias("best"), F.sum("metres").alias("total"), F.count("*").alias("faces"))
    return edge.groupBy("faces").agg(F.count("*").alias("edges"), r6(F.avg(F.col("best") / F.col("total")), "purity"), r6(F.sum(F.col("total") - F.col("best")), "spill"))


def extent_ratio(spark, d):
    t = trees(spark, d).withColumn("len", F.coalesce(F.col("dbh").try_cast("double"), F.lit(1.0)))
    span = F.hypot(F.max("x") - F.min("x"), F.max("y") - F.min("y"))
    b = t.groupBy("face_id").agg(F.count("*").alias("n"), F.sum("len").alias("total"), (span + F.avg("len")).alias("extent")).where("extent > 0")
    ratio = F.col("total") / F.col("extent")
    return b.select("face_id", "n", r6(ratio, "ratio"), F.when(ratio >= 1.8, "suspect").when(ratio <= 1.2, "control").otherwise("between").alias("verdict"))


def stale_heights(spark, d):
    newest, past = V.stale(F.col("edit_year"), F.col("year_a"), F.col("year_b"))
    b = view(spark, d, "buildings").select("edit_year", newest.alias("newest"), past.alias("past"))
    return b.groupBy("edit_year").agg(F.count("newest").alias("known"), F.count_if(F.col("past") > 0).alias("stale"), F.count_if(F.col("past").between(1, 5)).alias("recent"), F.count_if(F.col("past") > 5).alias("old"))


def ft_per_floor_bands(spark, d):
    b = view(spark, d, "buildings").withColumn("height", V.number(F.col("height_roof")))
    single = b.withColumn("on_lot", F.count("*").over(Window.partitionBy("bbl"))).where("on_lot = 1 and height > 0 and height <= 1600").withColumn("ft", F.col("height") / F.col("floors"))
    band = F.when(F.col("ft") < 8, "under 8").when(F.col("ft") < 20, "8-20").when(F.col("ft") < 60, "20-60").otherwise("over 60")
    return single.groupBy(band.alias("band")).agg(F.count("*").alias("n"), r6(F.percentile("ft", F.lit(0.1)), "p10"), r6(F.median("ft"), "p50"), r6(F.percentile("ft", F.lit(0.9)), "p90"), r6(F.avg(V.implied_floors(F.col("height"))), "implied_floors"))


def size_species_residuals(spark, d):
    t = trees(spark, d).where("value is not null").withColumn("d", F.col("dbh").try_cast("double"))
    g = t.groupBy("face_id", V.genus(F.col("genusspecies")).alias("genus")).agg(F.sum("value").alias("v"), F.sum(F.col("value") * F.col("d")).alias("vd"))
    top = g.groupBy("face_id").agg(F.sum("v").alias("total"), F.sum("vd").alias("total_vd"))
    one = ranks.first_of(g, ["face_id"], F.col("v").desc(), "genus").join(top, "face_id")
    size = F.col("total_vd") / F.col("total")
    return one.select("face_id", F.col("genus").alias("dominant"), r6(F.col("v") / F.col("total"), "share"), r6(size, "mean_dbh"), F.when(size < 12, "small").when(size < 24, "medium").otherwise("large").alias("size_band"))


def ab_route_delta(spark, d):
    half = lambda k: view(spark, d, "route_results").where(F.col("result_id") % 2 == k).groupBy("request", "weight").agg(F.min("shade").alias(f"shade{k}"), F.min("length_m").alias(f"len{k}"))
    both = half(0).join(half(1), ["request", "weight"]).withColumn("gain", F.col("shade1") - F.col("shade0"))
    return both.groupBy("weight").agg(F.count("*").alias("pairs"), F.count_if(F.col("gain") > 0.005).alias("gained"), F.count_if(F.col("gain") < -0.005).alias("lost"), r6(F.median(F.col("len1") - F.col("len0")), "median_delta"))


def clarity_ratio(spark, d):
    i = items(spark, d).select("grp", F.least("w", F.col("l_linenumber") * 7.0).alias("near"), F.greatest("w", F.col("l_linenumber") * 7.0).alias("far"))
    ratio = F.col("near") / F.col("far")
    return i.groupBy("grp").agg(F.count_if(ratio <= 0.6).alias("clear"), F.count_if(ratio > 0.6).alias("ambiguous"), F.count_if(F.col("near") <= 8).alias("useful"))


def conflation_counts(spark, d):
    return items(spark, d).groupBy("grp").agg(F.count_distinct("l_suppkey").alias("faces"), F.count_distinct("l_partkey").alias("bins"), F.count_if(F.col("l_linenumber") == 1).alias("conflated"), F.count_if(F.col("d") == 0).alias("plain"))


def flag_rule(spark, d):
    p = view(spark, d, "route_results")
    said, verdict = W.flag(F.col("length_m"), F.lit(400.0) + F.col("result_id") * 29 % 1100, F.lit(450.0) + F.col("result_id") * 31 % 1000)
    return p.select("result_id", said.alias("flag"), verdict.alias("verdict"))


# Points, boxes and names


def parks(spark, d) -> DataFrame:
    return view(spark, d, "parks")


def points(spark, d) -> DataFrame:
    return view(spark, d, "nodes").select("k", F.col("x").alias("px"), F.col("y").alias("py"))


PARK_CELL = 500.0


def first_matching_box(spark, d):
    hits = polygons.in_boxes(points(spark, d), parks(spark, d).select("park_id", "x0", "y0", "x1", "y1"), PARK_CELL, closed=True)
    return hits.groupBy("k").agg(F.min("park_id").alias("park_id"))


def in_parks(spark, d) -> DataFrame:
    return polygons.in_boxes(points(spark, d), parks(spark, d).select("park_id", "x0", "y0", "x1", "y1"), PARK_CELL).select("k", "park_id")


def borough_bucketing(spark, d):
    e = view(spark, d, "edges")
    ends = e.select("edge_id", F.col("u").alias("k")).union(e.select("edge_id", "v"))
    pairs = ends.join(in_parks(spark, d), "k").select("edge_id", (F.col("park_id") % 5).alias("borough")).distinct()
    return pairs.groupBy("borough").agg(F.count("*").alias("edges"), F.count_distinct("edge_id").alias("distinct_edges"))


def pip_parks(spark, d):
    per = in_parks(spark, d).groupBy("k").agg(F.count("*").alias("parks"), F.min("park_id").alias("first_park"))
    return view(spark, d, "nodes").select("k").join(per, "k", "left").select("k", F.coalesce("parks", F.lit(0)).alias("parks"), "first_park")


def semi_anti_ways(spark, d):
    w = view(spark, d, "way_nodes").select("way_id", F.col("node_id").alias("k"))
    touched = w.join(in_parks(spark, d).select("k").distinct(), "k", "left_semi").select("way_id").distinct()
    untouched = w.select("way_id").distinct().join(touched, "way_id", "left_anti")
    one = lambda f, name: f.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
    return one(touched, "touched").unionByName(one(untouched, "untouched"))


def achievable_names(spark, d):
    """Streets that have another edge of their name within 100 m either way: a join on name and neighbouring cells."""
    n = view(spark, d, "nodes").select(F.col("k").alias("u"), "x", "y")
    e = view(spark, d, "edges").join(n, "u").select("edge_id", "name", "x", "y")
    cx, cy = F.floor(F.col("x") / 100), F.floor(F.col("y") / 100)
    near = e.select(F.col("edge_id").alias("other"), "name", F.col("x").alias("ox"), F.col("y").alias("oy"), F.explode(F.sequence(cx - 1, cx + 1)).alias("cx"), F.expr("floor(y / 100)").alias("c")).select("other", "name", "ox", "oy", "cx", F.explode(F.sequence(F.col("c") - 1, F.col("c") + 1)).alias("cy"))
    hit = e.withColumns({"cx": cx, "cy": cy}).join(near, ["name", "cx", "cy"]).where((F.col("other") != F.col("edge_id")) & (F.abs(F.col("ox") - F.col("x")) <= 100) & (F.abs(F.col("oy") - F.col("y")) <= 100))
    return hit.select("edge_id", "name").distinct().groupBy("name").agg(F.count("*").alias("n"))


def score_lookup(spark, d):
    s = view(spark, d, "scored_edges")
    plain = s.select("u", "v", F.lit(0).alias("key"))
    graph = plain.unionByName(s.where("edge_id % 9 = 0").select("u", "v", F.lit(1).alias("key")))
    scores = s.select("u", "v", F.lit(0).alias("key"), "edge_id", "tree_deciduous")
    return graph.join(scores, ["u", "v", "key"], "left").groupBy("key").agg(F.count("*").alias("n"), F.count("edge_id").alias("matched"), r6(F.sum(F.coalesce("tree_deciduous", F.lit(0.0))), "deciduous"))


def external_match(spark, d):
    """Items with the buildings that they stand in, which may be several."""
    k = table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    spots = k.select("k", ((F.col("k") % 50) * 30.0 + 3).alias("px"), (F.floor(F.col("k") / 50) * 30.0 + 3).alias("py"), (10.0 + F.col("k") % 500).alias("ft"))
    b = view(spark, d, "buildings").select(V.number(F.col("height_roof")).alias("height"), "x0", "y0", (F.col("x0") + 12).alias("x1"), (F.col("y0") + 12).alias("y1"))
    hit = polygons.in_boxes(spots, b, 60.0).withColumn("ratio", F.try_divide("ft", "height"))
    band = F.when(F.col("height").isNull() | (F.col("height") <= 0), "unknown").when(F.col("ratio") < 0.8, "lower").when(F.col("ratio") > 1.25, "higher").otherwise("same")
    return hit.groupBy(band.alias("band")).agg(F.count("*").alias("n"))


def _cell_counts(spark, d, keep: str, *more: Column) -> DataFrame:
    n = view(spark, d, "nodes").where(keep)
    return n.groupBy(F.floor(F.col("x") / 250).alias("cx"), F.floor(F.col("y") / 250).alias("cy")).agg(F.count("*").alias("n"), *more)


def coverage_grid_verdict(spark, d):
    ped = _cell_counts(spark, d, "k % 3 <> 0 and k % 11 < 8 and row_no % 6 < 4", F.count_if(F.col("k") % 7 != 0).alias("main")).withColumnRenamed("n", "ped")
    street = _cell_counts(spark, d, "k % 5 = 0").withColumnRenamed("n", "street")
    verdict = F.when(F.col("ped").isNull(), "HOLE").when(F.col("main") > 0, "CONNECTED").otherwise("ISLAND")
    return ped.join(street, ["cx", "cy"], "full_outer").select("cx", "cy", verdict.alias("verdict"))


def neighbours(nodes: DataFrame) -> DataFrame:
    """Nodes with those in the nine cells about their own (k, o.*), by equality of row and column."""
    near = nodes.select(*(F.col(c).alias(f"o_{c}") for c in ("k", "x", "y")), F.explode(F.sequence(F.col("col") - 1, F.col("col") + 1)).alias("col"), F.col("row_no").alias("r"))
    near = near.select("o_k", "o_x", "o_y", "col", F.explode(F.sequence(F.col("r") - 1, F.col("r") + 1)).alias("row_no"))
    return nodes.join(shuffled(near), ["col", "row_no"])


def parent_name_decision(spark, d):
    """Names of streets beside each edge, by distance: one or a clear first one is the parent, else up to three go along."""
    n, e = view(spark, d, "nodes").select("k", "x", "y", "col", "row_no"), view(spark, d, "edges")
    near = e.select("edge_id", F.col("name").alias("own"), F.col("u").alias("k")).join(neighbours(n), "k")
    others = e.select(F.col("u").alias("o_k"), "name", F.col("edge_id").alias("other"))
    away = F.hypot(F.col("x") - F.col("o_x"), F.col("y") - F.col("o_y")) + 1 + F.col("other") % 29
    found = near.join(others, "o_k").where("name <> own").groupBy("edge_id", "name").agg(F.min(away).alias("d"))
    return scoring.parents(found, "edge_id", "name", "d")


def crossing_detour_candidates(spark, d):
    """The nearest node of each that no edge leads to, among the cells about it."""
    n, e = view(spark, d, "nodes").select("k", "x", "y", "col", "row_no"), view(spark, d, "edges")
    linked = e.select(F.col("u").alias("k"), F.col("v").alias("o_k")).union(e.select("v", "u"))
    close = neighbours(n).where("k <> o_k").join(linked, ["k", "o_k"], "left_anti").withColumn("d", F.hypot(F.col("x") - F.col("o_x"), F.col("y") - F.col("o_y")))
    return ranks.first_of(close, ["k"], "d", "o_k").select(F.col("k").alias("a"), F.col("o_k").alias("b"), r6("d", "d"))


def edge_invariants(spark, d):
    n = view(spark, d, "nodes").select("k", "x", "y")
    e = view(spark, d, "edges").join(n.toDF("u", "ax", "ay"), "u").join(n.toDF("v", "bx", "by"), "v")
    chord = F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by"))
    return e.groupBy(F.col("name").startswith("Row").alias("is_row")).agg(F.count("*").alias("n"), F.count_if(F.col("length_m") < chord * 0.998 - 2).alias("shorter_than_chord"), r6(F.max("length_m"), "longest"))


def coverage_test(spark, d):
    """Whether events' places lie in the nodes' box, grown by 200 m, and within 200 m of one: cells of 200 m and their neighbours."""
    n = view(spark, d, "nodes").select("x", "y")
    pts = table(spark, d, "events").select("event_id", (F.col("event_id") * 97 % 5200 * 1.0 - 400).alias("px"), (F.col("event_id") * 31 % 3400 * 1.0 - 300).alias("py"))
    box = n.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    cell = lambda c: F.floor(F.col(c) / 200)
    around = n.select("x", "y", F.explode(F.sequence(cell("x") - 1, cell("x") + 1)).alias("cx"), cell("y").alias("c")).select("x", "y", "cx", F.explode(F.sequence(F.col("c") - 1, F.col("c") + 1)).alias("cy"))
    near = pts.withColumns({"cx": cell("px"), "cy": cell("py")}).join(shuffled(around), ["cx", "cy"]).where(F.pow(F.col("px") - F.col("x"), 2) + F.pow(F.col("py") - F.col("y"), 2) <= 40000).select("event_id").distinct()
    placed = pts.crossJoin(F.broadcast(box)).join(shuffled(near.withColumn("near", F.lit(True))), "event_id", "left")  # the box is one row
    return placed.select("event_id", (F.col("px").between(F.col("x0") - 200, F.col("x1") + 200) & F.col("py").between(F.col("y0") - 200, F.col("y1") + 200) & F.col("near").isNotNull()).alias("covered"))


def partial_edge_routes(spark, d):
    """Ends inside edges, over the pairs of ends that two edges share, or along the one edge that both lie on."""
    e = view(spark, d, "edges")
    share = lambda m: F.col("length_m") * (F.col("edge_id") * m % 10) / 10
    a = e.select(F.col("edge_id").alias("ea"), F.explode(F.sequence("edge_id", F.col("edge_id") + 3)).alias("eb"), F.col("u").alias("au"), F.col("v").alias("av"), share(7).alias("a_u"), (F.col("length_m") - share(7)).alias("a_v"))
    b = e.select(F.col("edge_id").alias("eb"), F.col("u").alias("bu"), F.col("v").alias("bv"), share(3).alias("b_u"), (F.col("length_m") - share(3)).alias("b_v"))
    met = a.join(b, "eb")
    via = [F.when(F.col(f"a{x}") == F.col(f"b{y}"), F.col(f"a_{x}") + F.col(f"b_{y}")) for x in "uv" for y in "uv"]
    direct = F.when(F.col("ea") == F.col("eb"), F.abs(F.col("a_u") - F.col("b_u")))
    rows = met.withColumns({"direct": direct, "via": F.least(*via)}).where("direct is not null or via is not null")
    return rows.select("ea", "eb", r6(F.least("direct", "via"), "metres"), F.coalesce(F.col("direct") <= F.coalesce("via", "direct"), F.lit(False)).alias("is_direct"))


# Graph building


def junctions(spark, d):
    return ways.junctions(view(spark, d, "way_nodes"))


def chain_split(spark, d):
    return ways.chains(view(spark, d, "way_nodes"))


def halfway_point(spark, d):
    """The point half way along each way, by running sums of its segments: windows, so no way is gathered into an array."""
    by = Window.partitionBy("way_id").orderBy("rn")
    at = ways.ordered(view(spark, d, "way_nodes")).select("way_id", "rn", ((F.col("node_id") % 40) * 100.0).alias("x"), (F.floor(F.col("node_id") / 40) * 80.0).alias("y"))
    segments = at.withColumns({"dx": F.lead("x").over(by) - F.col("x"), "dy": F.lead("y").over(by) - F.col("y")}).where("dx is not null")
    lens = segments.withColumn("len", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")))
    sums = lens.withColumns({"upto": F.sum("len").over(by.rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("len").over(Window.partitionBy("way_id"))})
    reached = sums.where("upto >= total / 2 and len > 0").withColumn("r", F.row_number().over(by)).where("r = 1")
    t = (F.col("total") / 2 - F.col("upto") + F.col("len")) / F.col("len")
    return reached.select("way_id", r6(F.col("x") + F.col("dx") * t, "x"), r6(F.col("y") + F.col("dy") * t, "y"), r6("total", "total"))


def parallel_edge_key(spark, d):
    l = table(spark, d, "lineitem").withColumn("v", F.col("l_partkey") % 100)  # noqa: E741
    return ways.parallel_key(l, "l_suppkey", "v", "l_orderkey", "l_linenumber", "l_partkey").select("l_orderkey", "l_linenumber", "l_partkey", "lo", "hi", "key")


def running_length(spark, d):
    run_ = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "w", "v").rowsBetween(Window.unboundedPreceding, 0)
    return items(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", r6(F.sum("w").over(run_), "upto"))


# Orders, picks, copies


def shade_clamp(spark, d):
    r = view(spark, d, "route_results").withColumn("shown_id", F.col("result_id"))
    return ranks.monotone(r, ["request"], ["weight", "result_id"], "shade", ["shade", "shown_id", "length_m"]).select("result_id", "request", "weight", "shade", "shown_id", "length_m")


def runs_islands(spark, d):
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").withColumn("starts", F.coalesce((F.col("event_type") != F.lag("event_type").over(by)).cast("long"), F.lit(1)))
    e = e.withColumn("run", F.sum("starts").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return e.groupBy("user_id", "run", "event_type").agg(F.count("*").alias("legs"), F.min("event_id").alias("first_id"))


def tallest_buildings(spark, d):
    b = view(spark, d, "buildings").select("building_id", V.number(F.col("height_roof")).alias("height")).where("height is not null")
    return b.orderBy(F.col("height").desc(), "building_id").limit(20)


def stratified_allocation(spark, d):
    strata = view(spark, d, "trees").groupBy((F.col("face_id") % 5).alias("stratum")).agg(F.count("*").alias("n"))
    return ranks.largest_remainders(strata, "n", 40, 2)


def round_robin_pick(spark, d):
    return ranks.rank(view(spark, d, "trees"), ["face_id"], ranks.sample_order(F.col("tree_id"), within=1009), "tree_id").where("r <= 2").select("tree_id", "face_id", "r")


def banded_sample(spark, d):
    b = view(spark, d, "buildings").select("building_id", F.when(F.col("floors") < 4, "low").when(F.col("floors") < 8, "mid").otherwise("high").alias("band"), (F.col("building_id") % 5).alias("borough"))
    return ranks.rank(b, ["borough", "band"], ranks.sample_order(F.col("building_id")), "building_id").where("r <= 6").select("building_id", "band", "borough")


def edge_dedupe_best(spark, d):
    l = table(spark, d, "lineitem").select((F.col("l_orderkey") % 500).alias("lo"), F.col("l_suppkey").alias("hi"), (F.col("l_linenumber") % 2).alias("key"), F.col("l_quantity").alias("decid"), F.col("l_discount").alias("everg"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ord"), "l_partkey")  # noqa: E741
    return ranks.best_copy(l, ["lo", "hi", "key"], F.col("decid") + F.col("everg"), "ord", ["l_partkey"], ["decid", "everg"])


def geometry_dedupe(spark, d):
    e = view(spark, d, "edges").select(F.col("edge_id").alias("ord"), F.array(F.col("u").cast("string"), F.col("v").cast("string")).alias("line"))
    copies = e.unionByName(e.where("ord % 9 = 0").select((F.col("ord") + 1000000).alias("ord"), F.reverse("line").alias("line")))
    return ranks.distinct_geometry(copies, [], "line", "ord").select("ord", "geometry")


def last_wins(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id")).alias("e")).select("user_id", "e.event_id", "e.event_type")


def overlap_only(spark, d):
    r = view(spark, d, "route_results")
    return r.where("weight = 0").select("request").intersect(r.where("weight = 40").select("request"))


def rate_limit_violations(spark, d):
    hour = 3_600_000_000
    log = table(spark, d, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    nth = F.count("*").over(Window.partitionBy("user_id", F.floor(F.col("us") / hour)).orderBy("us", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    wait = F.greatest(F.lit(1), F.ceil((hour - F.pmod("us", F.lit(hour))) / 1_000_000))
    return log.withColumn("nth", nth).where("nth > 2").select("event_id", "user_id", "nth", wait.alias("retry_after"))


def recents_top5(spark, d):
    label = F.concat(F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise(F.col("event_type")), (F.col("event_id") % 3).cast("string"))
    e = table(spark, d, "events").select("event_id", "user_id", label.alias("label"), F.lower(label).alias("same"), "ts")
    new = ranks.first_of(e, ["user_id", "same"], F.col("ts").desc(), F.col("event_id").desc())
    return ranks.rank(new, ["user_id"], F.col("ts").desc(), F.col("event_id").desc(), name="place").where("place <= 5").select("user_id", "label", "event_id", "place")


def longest_part(spark, d):
    parts = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("face_id"), F.col("l_linenumber").alias("part")).agg(F.sum("l_quantity").alias("len"))
    return parts.groupBy("face_id").agg(F.max_by(F.struct("part", "len"), F.struct("len", -F.col("part"))).alias("p"), r6(F.sum("len"), "total")).select("face_id", "p.part", r6("p.len", "len"), "total")


# Words


def features(spark, d) -> DataFrame:
    from parasol.plans.texts import FEATURES

    return run(spark, d, f"with {FEATURES} select * from features")


def _cols(*names: str) -> list[Column]:
    return [F.col(n) for n in names]


def geocode_label_dedupe(spark, d):
    f = features(spark, d).where("city = 'New York' and state = 'New York'")
    labelled = f.select("ord", "req", W.place_label(*_cols("name", "housenumber", "street", "locality", "district", "city")).alias("label")).where("label is not null")
    return ranks.first_of(labelled, ["req", "label"], "ord")


def reverse_label(spark, d):
    return features(spark, d).select("ord", W.reverse_label(*_cols("name", "housenumber", "street", "osm_key")).alias("label"))


def backup_label(spark, d):
    f = features(spark, d).withColumn("label", W.backup_label(*_cols("name", "housenumber", "street", "borough")))
    full = F.concat(W.some(F.col("housenumber")), F.lit(" "), W.some(F.col("street")))
    near = F.min_by(full, F.when((F.col("distance_km") * 1000 <= W.NEAR_M) & full.isNotNull(), F.struct("distance_km", "ord")))
    return f.groupBy("req").agg(F.count("label").alias("found"), near.alias("nearest_address"))


def query_normalise(spark, d):
    e = table(spark, d, "events")
    raw = F.concat(F.lit("  "), "event_type", F.when(F.col("event_id") % 3 == 0, "   ").otherwise(" x "))
    q = W.squeeze(F.when(F.col("event_id") % 4 != 0, raw))
    return e.select("event_id", q.alias("query"), F.when(q == "", 422).otherwise(200).alias("status"))


def turn_actions(spark, d):
    e = table(spark, d, "events").select("event_id", (F.col("event_id") * 7 % 360).alias("i"), (F.col("event_id") * 53 % 360).alias("o"))
    return e.select("event_id", W.turn_word(F.pmod(F.col("o") - F.col("i") + 180, F.lit(360)) - 180).alias("action"), W.heading_word(F.col("o").cast("double")).alias("heading"))


def preset_snap(spark, d):
    w = table(spark, d, "events").select("event_id", (F.col("event_id") * 3 % 45 * 0.5).alias("w"))
    return w.select("event_id", "w", W.preset(F.col("w")).alias("preset"))


def sun_slots(spark, d):
    """Events' moments in the slots of the computed sun table that have sun."""
    return lit_moments(spark, d, sun.sun_table(spark))


_SKIP = {"r6", "long", "table", "trees", "requested", "valid", "stub_sun", "blended", "shaded_pairs", "items", "parks", "points", "in_parks", "neighbours", "features", "run", "view", "shuffled", "lit_moments"}
QUERIES = {n: f for n, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and not n.startswith("_") and n not in _SKIP}
