"""What a street tree is worth, which buildings and parks count, as column functions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

#: Scores of conditions and of unknown ones, evergreen genera, leaves by month, the largest diameter that counts.
CONDITION_SCORES = {"Excellent": 1.0, "Good": 0.85, "Fair": 0.6, "Poor": 0.3, "Critical": 0.1}
UNKNOWN_SCORE, MOST_DBH = 0.5, 30.0
EVERGREEN = ("Pinus", "Picea", "Abies", "Tsuga", "Juniperus", "Thuja", "Ilex", "Magnolia", "Cedrus", "Chamaecyparis", "Cryptomeria", "Taxus")
CANOPY = (0.2, 0.2, 0.2, 0.35, 0.75, 1.0, 1.0, 1.0, 0.95, 0.8, 0.45, 0.25)
#: Tree value per metre at which shade is full, feet above which a height is an error, status and code of no buildings.
FULL_DENSITY, TOO_TALL_FT = 0.033, 1600.0
GONE, NO_BUILDING = ("Demolition",), ("1003",)
#: Park types that are none, those that need a subcategory, and which.
NO_PARK = ("Parkway", "Strip", "Lot", "Operations", "Retired N/A")
PARK_IF = ("Buildings/Institutions", "Triangle/Plaza", "Mall")
PARK_SUBTYPES = ("Large Park", "Neighborhood Park", "Flagship Park", "Garden", "Neighborhood Plgd")


def text(value: Column) -> Column:
    """A string, '' for null."""
    return F.coalesce(value, F.lit(""))


def number(value: Column) -> Column:
    """A number from a text, null where it is none; NaN is none."""
    n = value.try_cast("double")
    return F.when(~F.isnan(n), n)


def condition(value: Column) -> Column:
    return F.trim(text(value))


def condition_score(value: Column) -> Column:
    scores = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in CONDITION_SCORES.items()))
    return F.coalesce(F.try_element_at(scores, condition(value)), F.lit(UNKNOWN_SCORE))


def tree_value(dbh: Column, state: Column) -> Column:
    """0..1 from condition and diameter; null for dead trees and those without a diameter above zero."""
    d = number(dbh)
    return F.when((condition(state) != "Dead") & (d > 0), condition_score(state) * F.least(d, F.lit(MOST_DBH)) / MOST_DBH)


def genus(species: Column) -> Column:
    """The text before the first space."""
    return F.split_part(text(species), F.lit(" "), F.lit(1))


def is_evergreen(species: Column) -> Column:
    return genus(species).isin(*EVERGREEN)


def tree_bucket(dbh: Column, state: Column, species: Column) -> Column:
    """Why a tree does not count, or which kind it is."""
    kind = F.when(is_evergreen(species), "evergreen").otherwise("deciduous")
    return F.when(condition(state) == "Dead", "dead").when(tree_value(dbh, state).isNull(), "no_diameter").otherwise(kind)


def canopy(month: Column) -> Column:
    """The share of leaves that deciduous trees have in a month, 1..12."""
    return F.element_at(F.array(*map(F.lit, CANOPY)), month.cast("int"))


def building_outcome(height_roof: Column, status: Column, code: Column) -> Column:
    """'usable', or the first rule that a building fails."""
    h = number(height_roof)
    out = F.when(h.isNull() | (h <= 0), "no_height").when(h > TOO_TALL_FT, "too_tall")
    return out.when(F.coalesce(status.isin(*GONE), F.lit(False)), "demolished").when(F.coalesce(code.isin(*NO_BUILDING), F.lit(False)), "excluded_code").otherwise("usable")


def is_real_park(category: Column, subcategory: Column) -> Column:
    kind = text(category)
    return F.when(kind.isin(*NO_PARK), False).when(kind.isin(*PARK_IF), text(subcategory).isin(*PARK_SUBTYPES)).otherwise(True)


def implied_floors(height_ft: Column) -> Column:
    return height_ft / 13


def stale(edit_year: Column, *years: Column) -> tuple[Column, Column]:
    """The newest year that is later than 1600, and by how many years it is past the edit."""
    newest = F.greatest(*(F.when(y > 1600, y) for y in years))
    return newest, newest - edit_year
