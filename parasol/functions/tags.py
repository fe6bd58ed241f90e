"""Rules on the tags of ways, as column functions; a missing tag counts as ''."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from parasol.functions.trees import text

#: Tags of ways that people walk, and of streets.
WALKED = ("footway", "path", "steps", "pedestrian")
STREETS = ("primary", "secondary", "tertiary", "residential", "unclassified", "living_street", "trunk", "service", "motorway", "primary_link", "secondary_link")
NO_STREET_SERVICE = ("private", "driveway", "parking_aisle")
#: Kinds that have tree scores, kinds of crossings, and marks of connectors.
SHADED, CONNECTOR_MARKS = ("footway/sidewalk",), ("crossing", "traffic_island")
#: What makes an area park-like.
PARK_LEISURE, PARK_LANDUSE = ("park", "nature_reserve", "garden"), ("recreation_ground", "forest")


def is_pedestrian(highway: Column, foot: Column, access: Column, area: Column) -> Column:
    may = text(foot).isin("yes", "designated")
    return (
        F.when(text(area) == "yes", False)
        .when(text(foot).isin("no", "private"), False)
        .when(text(access).isin("private", "no") & ~may, False)
        .when(text(highway) == "cycleway", may)
        .otherwise(text(highway).isin(*WALKED))
    )


def is_named_street(name: Column, highway: Column, area: Column, service: Column) -> Column:
    return (text(name) != "") & text(highway).isin(*STREETS) & (text(area) != "yes") & ~text(service).isin(*NO_STREET_SERVICE)


def kind(highway: Column, footway: Column) -> Column:
    """The highway, '?' if it has none, and the kind of footway behind a stroke."""
    head = F.when(text(highway) != "", text(highway)).otherwise("?")
    return F.concat(head, F.when(text(footway) != "", F.concat(F.lit("/"), footway)).otherwise(""))


def is_connector(of: Column) -> Column:
    return text(of).rlike("|".join(CONNECTOR_MARKS))


def width_class(feet: Column) -> Column:
    return F.when(feet < 24, "narrow").when(feet < 40, "medium").otherwise("wide")


def is_park_like(leisure: Column, boundary: Column, landuse: Column, natural: Column) -> Column:
    """An area that is green by its tags, whatever the city calls it."""
    return text(leisure).isin(*PARK_LEISURE) | (text(boundary) == "protected_area") | text(landuse).isin(*PARK_LANDUSE) | (text(natural) == "wood")
