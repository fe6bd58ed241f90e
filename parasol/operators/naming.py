"""Names of paths that have none, from the streets that they run along.

A street counts for a path by medians over the path's probes: its distance and
how far its direction is from the path's. Near segments meet probes in grid
cells; only streets near enough are looked at whole, for their directions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from parasol.functions import lines as L
from parasol.functions.tags import is_connector
from parasol.operators import spatial
from parasol.operators.scoring import nearest_names
from parasol.operators.skew import shuffled

#: Metres to a street at most, degrees between its direction and the path's, and metres below which a path has no direction.
NEAR_M, APART_DEG, NUB_M = 30.0, 30.0, 5.0
#: Decimals of a metre to which distances are told apart; equal ones go by name.
PLACES = 6


def bearing_beside(segments: Column, px: Column, py: Column) -> Column:
    """The local bearing of a line, given as ``lines.measured``, where it is nearest to a point; 0 where it has none."""
    def along(s: Column) -> Column:
        dx, dy = s["bx"] - s["ax"], s["by"] - s["ay"]
        return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - s["ax"]) * dx + (py - s["ay"]) * dy) / F.nullif(s["len"] * s["len"], F.lit(0.0)))), F.lit(0.0))

    def place(s: Column) -> Column:
        def at(t: Column) -> Column:
            away = F.pow(px - s["ax"] - t * (s["bx"] - s["ax"]), 2) + F.pow(py - s["ay"] - t * (s["by"] - s["ay"]), 2)
            return F.struct(away.alias("away"), (s["upto"] + t * s["len"]).alias("at"))

        return L.let(along(s), at)

    def point(at: Column) -> Column:
        def on(s: Column) -> Column:
            t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce((at - s["upto"]) / F.nullif(s["len"], F.lit(0.0)), F.lit(0.0))))
            return L.let(t, lambda t: F.struct((s["ax"] + t * (s["bx"] - s["ax"])).alias("x"), (s["ay"] + t * (s["by"] - s["ay"])).alias("y")))

        return L.let(F.element_at(F.filter(segments, lambda s: s["upto"] <= at), -1), on)

    def chord(at: Column) -> Column:
        ends = F.struct(point(F.greatest(at - L.CHORD_M, F.lit(0.0))).alias("a"), point(at + L.CHORD_M).alias("b"))
        # A chord without length has the direction 0 by atan2.
        return L.let(ends, lambda c: F.pmod(F.degrees(F.atan2(c["b"]["x"] - c["a"]["x"], c["b"]["y"] - c["a"]["y"])), F.lit(180.0)))

    # Of equally near places the first along the line is the least struct.
    return L.let(F.array_min(F.transform(segments, place))["at"], chord)


def bend(a: Column, b: Column) -> Column:
    """Degrees between two undirected bearings, at most 90."""
    d = F.abs(a - b)
    return F.least(d, 180.0 - d)


def upper_median(rows: DataFrame, by: list[str], value: str, n: str) -> DataFrame:
    """Of each group the row at the place n div 2, from 0, by ``value``; a group with fewer rows has none.

    With ``n`` the number of rows that there would be without a limit on ``value``,
    this is the median of all of them, if it is within that limit.
    """
    place = F.row_number().over(Window.partitionBy(*by).orderBy(value))
    return rows.withColumn("__r", place).where(F.col("__r") == F.floor(F.col(n) / 2) + 1).drop("__r")


def candidates(paths: DataFrame, streets: DataFrame, parallel: bool = True) -> DataFrame:
    """(edge_id, name, d): streets near each of ``paths`` (edge_id, metres, line), and alongside it unless it is too short for a direction.

    ``streets``: street_id, name, line. Those of one name are one candidate, as far as the nearest.
    """
    named = streets.where("name <> ''")
    spots = paths.select("edge_id", "metres", L.measured(F.col("line")).alias("segments"), L.probes(F.col("line")).alias("ps"))
    spots = spots.select("edge_id", "metres", "segments", F.size("ps").alias("n"), F.posexplode("ps").alias("i", "p"))
    spots = spots.select("edge_id", "metres", "segments", "n", "i", F.col("p")[0].alias("px"), F.col("p")[1].alias("py"))
    pieces = named.select("street_id", F.explode(L.pairs(F.col("line"))).alias("s")).select("street_id", *(f"s.{c}" for c in spatial.SEGMENT))
    near = spatial.within(spots.select("edge_id", "metres", "n", "i", "px", "py"), pieces, NEAR_M)
    near = near.groupBy("edge_id", "street_id", "metres", "n", "i").agg(F.min("d").alias("d"))
    close = upper_median(near, ["edge_id", "street_id"], "d", "n").select("edge_id", "street_id", "metres", F.round("d", PLACES).alias("d"))
    if not parallel:
        return close.join(shuffled(named.select("street_id", "name")), "street_id").groupBy("edge_id", "name").agg(F.min("d").alias("d"))
    own = spots.where(F.col("metres") >= NUB_M).withColumn("own", bearing_beside(F.col("segments"), F.col("px"), F.col("py"))).drop("segments", "metres")
    met = close.where(F.col("metres") >= NUB_M).join(shuffled(own), "edge_id").join(shuffled(named.select("street_id", "name", L.measured(F.col("line")).alias("segments"))), "street_id")
    met = met.select("edge_id", "street_id", "name", "d", "n", bend(F.col("own"), bearing_beside(F.col("segments"), F.col("px"), F.col("py"))).alias("turn"))
    along = upper_median(met, ["edge_id", "street_id"], "turn", "n").where(F.col("turn") <= APART_DEG)
    nubs = close.where(F.col("metres") < NUB_M).join(shuffled(named.select("street_id", "name")), "street_id")
    return along.select("edge_id", "name", "d").unionByName(nubs.select("edge_id", "name", "d")).groupBy("edge_id", "name").agg(F.min("d").alias("d"))


def assign_names(paths: DataFrame, streets: DataFrame, parallel: bool = True) -> DataFrame:
    """One row a path: edge_id, outcome, name, fold_names.

    ``paths``: edge_id (unique), name, kind, line in flat metres. In this order:
    ``own`` keeps a name that is there; ``connector`` gets none; ``too_short`` none
    but streets to go along with; ``no_parent`` has no street; ``derived`` takes the
    only or clearly nearest one; ``ambiguous`` goes along with up to three, joined by '|'.
    A path with fewer than two vertices is too short; a null kind is no connector.
    """
    own = F.coalesce(F.col("name") != "", F.lit(False))
    metres = F.coalesce(F.when(F.size("line") > 1, L.length(F.col("line"))), F.lit(0.0))
    first = F.when(own, "own").when(is_connector(F.col("kind")), "connector")
    sorted_out = paths.select("edge_id", "name", "line", first.alias("first"), metres.alias("metres"))
    found = nearest_names(candidates(sorted_out.where("first is null").select("edge_id", "metres", "line"), streets, parallel), "edge_id", "name", "d")
    decided = F.when(F.col("clear"), "derived").otherwise("ambiguous")
    outcome = F.coalesce("first", F.when(F.col("metres") < NUB_M, "too_short"), F.when(F.col("nearest").isNotNull(), decided), F.lit("no_parent"))
    out = sorted_out.drop("line").join(shuffled(found), "edge_id", "left").withColumn("outcome", outcome)
    name = F.when(F.col("outcome") == "own", F.col("name")).when(F.col("outcome") == "derived", F.col("nearest"))
    along = F.when(F.col("outcome").isin("too_short", "ambiguous"), F.col("names"))
    return out.select("edge_id", "outcome", name.alias("name"), along.alias("fold_names"))
