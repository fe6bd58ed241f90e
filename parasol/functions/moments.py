"""Time of year and day: request times, month and hour blends, fractions of shade, costs, and times to leave."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from parasol.functions.trees import FULL_DENSITY, canopy

#: Days of the months; the second month has a 29th in requests and 28 days in blends.
DAYS = (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)
#: Layers, the most weights of a request, the largest weight, an edge's least length, and a leap year for arrivals.
LAYERS, MOST_WEIGHTS, MOST_WEIGHT, LEAST_M, LEAP = ("trees", "buildings", "both"), 4, 40.0, 0.01, 2028


def slot_index(month: Column, hour: Column) -> Column:
    return ((month - 1) * 24 + hour).cast("long")


def last_day(month: Column) -> Column:
    """The last day that a request may name, 31 for months out of range."""
    return F.coalesce(F.try_element_at(F.array(*(F.lit(29 if d == 28 else d) for d in DAYS)), F.when(month.between(1, 12), month).cast("int")), F.lit(31))


def request_time(month: Column, day: Column, hour: Column, minute: Column, now: Column) -> dict[str, Column]:
    """What a request means where it leaves parts open: no month is today's, no day the 15th, no hour is now, no minute the full hour."""
    return {
        "month": F.coalesce(month, F.month(now)).cast("long"),
        "day": F.coalesce(day, F.when(month.isNull(), F.day(now)).otherwise(15)).cast("long"),
        "hour": F.coalesce(hour, F.hour(now)).cast("long"),
        "minute": F.coalesce(minute, F.when(hour.isNull(), F.minute(now)).otherwise(0)).cast("long"),
    }


def pinned_now(value: Column, zone: str = "America/New_York") -> Column:
    """A moment from an ISO text: with an offset as it is, without one in ``zone``; null if it is none. Seconds may be left out."""
    offset = r"(Z|[+-]\d\d:?\d\d)$"
    local, shift = F.regexp_replace(value, offset, ""), F.regexp_extract(value, offset, 1)
    full = F.when(local.rlike(r"T\d\d:\d\d$"), F.concat(local, F.lit(":00"))).otherwise(local)
    return F.when(shift != "", F.concat(full, shift).try_cast("timestamp")).otherwise(F.to_utc_timestamp(full.try_cast("timestamp"), zone))


def problem(arrive: Column, no_hour: Column, month: Column, day: Column, hour: Column, minute: Column, layers: Column, n_weights: Column, least_weight: Column, top_weight: Column) -> Column:
    """What is wrong with a request, by the first rule that it breaks; null if nothing is."""
    days = last_day(month)
    return (
        F.when(arrive & no_hour, "arrive needs an hour")
        .when(~month.between(1, 12), "month must be 1-12")
        .when(~day.between(1, days), F.format_string("day must be 1-%d for month %d", days, month))
        .when(~hour.between(0, 23), "hour must be 0-23")
        .when(~minute.between(0, 59), "minute must be 0-59")
        .when(~layers.isin(*LAYERS), f"layers must be one of {', '.join(LAYERS)}")
        .when(n_weights == 0, "tree_weights must include at least one value")
        .when(n_weights > MOST_WEIGHTS, f"tree_weights accepts at most {MOST_WEIGHTS} values")
        .when((least_weight < 0) | (top_weight > MOST_WEIGHT), "tree_weight must be between 0 and 40")
    )


def month_blend(month: Column, day: Column) -> tuple[Column, Column, Column]:
    """The months whose middles a day lies between, and how far it is from the first to the second, 0..1."""
    late = day >= 15
    m0 = F.when(late, month).otherwise(F.pmod(month + 10, F.lit(12)) + 1)
    m1 = F.when(late, F.pmod(month, F.lit(12)) + 1).otherwise(month)
    days = F.element_at(F.array(*map(F.lit, DAYS)), m0.cast("int"))
    return m0, m1, F.when(late, day - 15).otherwise(days - 15 + day) / days


def corners(m0: Column, m1: Column, g: Column, hour: Column, minute: Column) -> Column:
    """Four structs (month, hour, slot, weight): both months at the hour and at the next one, of the same month at midnight."""
    h, after = minute / 60.0, F.pmod(hour + 1, F.lit(24))

    def corner(month: Column, at: Column, weight: Column) -> Column:
        return F.struct(month.cast("long").alias("month"), at.cast("long").alias("hour"), slot_index(month, at).alias("slot"), weight.alias("weight"))

    return F.array(corner(m0, hour, (1 - g) * (1 - h)), corner(m0, after, (1 - g) * h), corner(m1, hour, g * (1 - h)), corner(m1, after, g * h))


def dark_slots(sun: DataFrame) -> Column:
    """A literal array of 288 flags from a sun table (month, hour, azimuth): which slots have no sun. Its shape is checked."""
    rows = sun.select("month", "hour", F.col("azimuth").isNull().alias("dark")).collect()
    flags = {(r.month - 1) * 24 + r.hour: r.dark for r in rows}
    if len(rows) != 288 or sorted(flags) != list(range(288)):
        raise ValueError("a sun table has 12 months of 24 hours")
    return F.array(*(F.lit(flags[s]) for s in range(288)))


def is_dark(dark: Column, slot: Column) -> Column:
    return F.element_at(dark, (slot + 1).cast("int"))


def _sum(of: Column, term) -> Column:
    return F.aggregate(of, F.lit(0.0), lambda a, c: a + c["weight"] * term(c))


def dark_share(at: Column, dark: Column) -> Column:
    """The weight of a moment's corners that lie at night."""
    return _sum(at, lambda c: is_dark(dark, c["slot"]).cast("double"))


def is_night(at: Column, dark: Column) -> Column:
    """Whether every corner that counts is dark."""
    return F.forall(at, lambda c: (c["weight"] <= 0) | is_dark(dark, c["slot"]))


def daylight_slots(sun: DataFrame) -> DataFrame:
    """The slots of a sun table (month, hour, azimuth, elevation) that have sun."""
    return sun.where("azimuth is not null").select(slot_index(F.col("month"), F.col("hour")).alias("slot"), "azimuth", "elevation")


def tree_fraction(evergreen: Column, deciduous: Column, length_m: Column, m0: Column, m1: Column, g: Column) -> Column:
    leaves = (1 - g) * canopy(m0) + g * canopy(m1)
    return F.least((evergreen + deciduous * leaves) / F.greatest(length_m, F.lit(LEAST_M)) / FULL_DENSITY, F.lit(1.0))


def building_fraction(at: Column, dark: Column, byte_of) -> Column:
    """``byte_of(slot)`` is an edge's shade byte; night is full shade."""
    return _sum(at, lambda c: F.when(is_dark(dark, c["slot"]), F.lit(255.0)).otherwise(byte_of(c["slot"]).cast("double"))) / 255.0


def union(a: Column, b: Column) -> Column:
    """Shade by either of two layers that know nothing of each other."""
    return 1 - (1 - a) * (1 - b)


def edge_density(layers: Column, tree: Column, building: Column, dark: Column, has_hour: Column) -> Column:
    """Shade of an edge in tree value a metre; without an hour buildings have none."""
    with_hour = F.when(layers == "both", union(tree, building)).when(layers == "buildings", building).otherwise(union(tree, dark))
    return F.when(has_hour, with_hour).otherwise(F.when(layers == "buildings", F.lit(0.0)).otherwise(tree)) * FULL_DENSITY


def edge_cost(length_m: Column, weight: Column, density: Column) -> Column:
    return length_m / (1 + weight * density)


def leave_time(month: Column, day: Column, hour: Column, minute: Column, walk_minutes: Column) -> Column:
    """When to leave (a timestamp without zone, in a leap year) to arrive at a time of the year; a year has no end."""
    arrival = F.make_timestamp_ntz(F.lit(LEAP), month, day, hour, minute, F.lit(0))
    left = arrival - F.make_dt_interval(F.lit(0), F.lit(0), F.floor(walk_minutes + 0.5).cast("int"), F.lit(0))
    return F.when(F.year(left) < LEAP, left + F.expr("interval 366 days")).otherwise(left)
