"""Words for directions, distances, times, places and links, as column functions; '' and null count as missing."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from parasol.functions.trees import text

#: Words of headings and sides, and degrees of turns.
HEADINGS = ("north", "northeast", "east", "southeast", "south", "southwest", "west", "northwest")
SIDES = {"N": "north", "S": "south", "E": "east", "W": "west"}
STRAIGHT, SHARP = 30.0, 150.0
#: Presets of shade weights, walking speed, metres a foot and feet a mile, and miles from which miles are said.
PRESETS, WALK_M_S, FOOT_M, FEET_MILE, LEAST_MILES = (0.0, 5.0, 15.0, 40.0), 1.4, 0.3048, 5280.0, 0.1
#: What shade is exposed, what park share hides the tree count, and metres within which a backup's address counts.
EXPOSED, HIDES_COUNT, NEAR_M = 0.15, 0.25, 100.0
#: Short forms in the city's street list: anywhere but for 'st', in front of a name, and behind it.
STREET_FORMS = {
    "ave": "avenue", "blvd": "boulevard", "rd": "road", "dr": "drive", "pl": "place", "pkwy": "parkway", "expy": "expressway", "hwy": "highway",
    "tpke": "turnpike", "ln": "lane", "ter": "terrace", "sq": "square", "cir": "circle", "plz": "plaza", "br": "bridge", "pd": "road", "al": "alley",
    "ct": "court", "cres": "crescent", "bl": "boulevard", "pz": "plaza", "pky": "parkway", "expwy": "expressway",
}
LEADING_FORMS = {"w": "west", "e": "east", "n": "north", "s": "south", "st": "saint", "ft": "fort", "mt": "mount"}
DIRECTIONS = {"n": "north", "s": "south", "e": "east", "w": "west"}
#: Words that a comparison of two sources spells out.
COMPARED_FORMS = {
    "AVE": "AVENUE", "AV": "AVENUE", "ST": "STREET", "STR": "STREET", "RD": "ROAD", "DR": "DRIVE", "BLVD": "BOULEVARD", "PL": "PLACE", "LN": "LANE",
    "CT": "COURT", "TER": "TERRACE", "TERR": "TERRACE", "PKWY": "PARKWAY", "PKY": "PARKWAY", "EXPY": "EXPRESSWAY", "EXPWY": "EXPRESSWAY",
    "HWY": "HIGHWAY", "SQ": "SQUARE", "CIR": "CIRCLE", "PLZ": "PLAZA", "BRG": "BRIDGE", "TPKE": "TURNPIKE", "CONC": "CONCOURSE", "BCH": "BEACH",
    "N": "NORTH", "S": "SOUTH", "E": "EAST", "W": "WEST",
}


def some(value: Column) -> Column:
    """null for ''."""
    return F.when(value != "", value)


def heading_word(degrees: Column) -> Column:
    at = F.floor(F.pmod(degrees + 22.5, F.lit(360.0)) / 45.0).cast("int")
    return F.element_at(F.array(*map(F.lit, HEADINGS)), at + 1)


def side_word(side: Column) -> Column:
    out = F.lit("")
    for letter, word in SIDES.items():
        out = F.when(text(side) == letter, word).otherwise(out)
    return out


def turn_word(delta: Column) -> Column:
    """The turn of so many degrees, -180..180, right of straight on."""
    way = F.when(delta > 0, "right").otherwise("left")
    return F.when(F.abs(delta) <= STRAIGHT, "continue").when(F.abs(delta) >= SHARP, F.concat(F.lit("sharp_"), way)).otherwise(way)


def half_up(value: Column) -> Column:
    """Rounded as browsers do: halves go up."""
    return F.floor(value + 0.5)


def tenths(value: Column, even: bool) -> Column:
    """A number of tenths, rounded by the exact binary value; a tie goes to the even number or up.

    Ten times a double is eight times plus twice, both exact; what their sum
    loses decides where it seems to lie half way.
    """
    eight, two = value * 8, value * 2
    s = eight + two
    back = s - eight
    lost = (eight - (s - back)) + (two - back)
    low = F.floor(s)
    f = s - low
    tie_up = (F.pmod(low, F.lit(2)) == 1) if even else F.lit(True)
    up = (f > 0.5) | ((f == 0.5) & ((lost > 0) | ((lost == 0) & tie_up)))
    return low + up.cast("long")


def one_place(value: Column, even: bool) -> Column:
    n = tenths(value, even)
    return F.format_string("%d.%d", F.floor(n / 10), F.pmod(n, F.lit(10)))


def distance_text(metres: Column) -> Column:
    return F.when(metres >= 1000, F.concat(one_place(metres / 1000, True), F.lit(" km"))).otherwise(F.concat(F.rint(metres).cast("long").cast("string"), F.lit(" m")))


def imperial_parts(metres: Column) -> tuple[Column, Column]:
    """Whole feet below a tenth of a mile, else miles with one place."""
    feet = metres / FOOT_M
    far = feet >= FEET_MILE * LEAST_MILES
    return F.when(far, one_place(feet / FEET_MILE, False)).otherwise(half_up(feet).cast("string")), F.when(far, "mi").otherwise("ft")


def imperial_text(metres: Column) -> Column:
    return F.concat_ws(" ", *imperial_parts(metres))


def spoken_distance(metres: Column) -> Column:
    value, unit = imperial_parts(metres)
    return F.concat_ws(" ", value, F.when(unit == "mi", "miles").otherwise("feet"))


def walk_minutes(metres: Column) -> Column:
    return metres / WALK_M_S / 60


def _eta(minutes: Column, hour: str, minute: str, plural: str) -> Column:
    whole = half_up(minutes).cast("long")
    hours, rest = F.floor(whole / 60), F.pmod(whole, F.lit(60))

    def part(n: Column, word: str) -> Column:
        return F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise(plural))

    return F.when(whole < 60, part(whole, minute)).when(rest == 0, part(hours, hour)).otherwise(F.concat(part(hours, hour), F.lit(" "), part(rest, minute)))


def eta_text(minutes: Column) -> Column:
    """Minutes below an hour, else hours and what is left of them; rounded once, before."""
    return _eta(minutes, "hr", "min", "")


def spoken_eta(minutes: Column) -> Column:
    return _eta(minutes, "hour", "minute", "s")


def clock_text(hour: Column, minute: Column) -> Column:
    half = F.when(hour < 12, "AM").otherwise("PM")
    return F.format_string("%d:%02d %s", F.pmod(hour + 11, F.lit(12)) + 1, minute, half)


def parse_walk_time(value: Column) -> Column:
    """The moment of 'YYYY-MM-DDTHH:MM'; null for anything else and for days that don't exist."""
    shaped = value.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}$")
    return F.when(shaped, F.replace(value, F.lit("T"), F.lit(" "))).try_cast("timestamp_ntz")


def format_walk_time(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm")


def walk_time_of_link(at: Column, arrive: Column) -> Column:
    """(moment, arrive) of a link's two parameters; a departure comes before an arrival, null is now."""
    leaves, arrives = parse_walk_time(at), parse_walk_time(arrive)
    return F.when(leaves.isNotNull(), F.struct(leaves.alias("moment"), F.lit(False).alias("arrive"))).when(arrives.isNotNull(), F.struct(arrives.alias("moment"), F.lit(True).alias("arrive")))


def describe_walk_time(moment: Column, arrive: Column, today: Column) -> Column:
    """'Arrive 1:00 PM' today, with the weekday in the next six days, else with month and day."""
    days, clock = F.datediff(moment, today), clock_text(F.hour(moment), F.minute(moment))
    when = F.when(days == 0, clock).when(days.between(1, 6), F.concat_ws(" ", F.date_format(moment, "E"), clock))
    when = when.otherwise(F.concat(F.month(moment).cast("string"), F.lit("/"), F.day(moment).cast("string"), F.lit(", "), clock))
    return F.concat(F.when(arrive, "Arrive ").otherwise("Depart "), when)


def leave_by(moment: Column, minutes: Column) -> Column:
    """When to leave for a walk of so many minutes, rounded as they are shown."""
    return moment - F.make_dt_interval(F.lit(0), F.lit(0), half_up(minutes).cast("int"), F.lit(0))


def preset(weight: Column) -> Column:
    """The nearest preset; of two equally near the larger."""
    tried = F.array(*(F.struct(F.abs(weight - p).alias("off"), F.lit(-p).alias("less")) for p in PRESETS))
    return -F.array_min(tried)["less"]


def is_exposed(shade: Column) -> Column:
    return shade < EXPOSED


def hides_count(park_share: Column) -> Column:
    return park_share >= HIDES_COUNT


def layer_of(value: Column) -> Column:
    return F.when(value.isin("trees", "buildings"), value).otherwise("both")


def parse_point(value: Column) -> Column:
    """(lat, lon) of the first two of a list of numbers; null unless both are finite."""
    parts = F.split(value, ",")
    lat, lon = (F.try_element_at(parts, F.lit(i)).try_cast("double") for i in (1, 2))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.when(finite(lat) & finite(lon), F.struct(lat.alias("lat"), lon.alias("lon")))


def format_point(lat: Column, lon: Column) -> Column:
    return F.format_string("%.5f,%.5f", lat, lon)


def link_weight(value: Column) -> Column:
    """The preset of a link's weight; the largest where it has no number."""
    w = value.try_cast("double")
    return F.when(w.isNotNull() & ~F.isnan(w) & (F.abs(w) < float("inf")), preset(w)).otherwise(F.lit(PRESETS[-1]))


def link_label(label: Column, point: Column) -> Column:
    """A link's label, which means something beside a point that could be read only."""
    return F.when(parse_point(point).isNotNull(), label)


def squeeze(value: Column) -> Column:
    """Text with single spaces only, none at its ends."""
    return F.trim(F.regexp_replace(text(value), r"\s+", " "))


def capwords(value: Column) -> Column:
    """Each word with a capital first letter and small ones after it; null for null."""
    return F.when(value.isNotNull(), F.initcap(squeeze(value)))


def address(number: Column, street: Column) -> Column:
    """Number and street, or the street alone; null without one."""
    return F.coalesce(F.concat(some(number), F.lit(" "), some(street)), some(street))


def place_label(name: Column, number: Column, street: Column, locality: Column, district: Column, city: Column) -> Column:
    """Up to three different parts: the name or the address, the address or the locality beside a name, the district or the city."""
    first = F.coalesce(some(name), address(number, street))
    second = F.when(some(name).isNotNull(), F.coalesce(address(number, street), some(locality)))
    parts = F.array_distinct(F.filter(F.array(first, second, F.coalesce(some(district), some(city))), lambda x: x.isNotNull()))
    return F.when(first.isNotNull(), F.array_join(parts, ", "))


def reverse_label(name: Column, number: Column, street: Column, osm_key: Column) -> Column:
    return F.coalesce(address(number, street), F.when(osm_key == "highway", some(name)))


def backup_label(name: Column, number: Column, street: Column, borough: Column) -> Column:
    """Address or name, and the borough, in capitalised words; null without a borough or either of them."""
    full = F.concat(some(number), F.lit(" "), capwords(some(street)))
    return F.concat(F.coalesce(full, capwords(some(name))), F.lit(", "), some(borough))


def _map(words: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in words.items() for x in pair))


def ordinal(number: Column) -> Column:
    """'60' as '60th'; numbers that end in 11, 12 or 13 have 'th' too."""
    ends = F.create_map(*(F.lit(x) for x in ("1", "st", "2", "nd", "3", "rd")))
    suffix = F.when(number.rlike("1[123]$"), "th").otherwise(F.coalesce(F.try_element_at(ends, F.right(number, F.lit(1))), F.lit("th")))
    return F.concat(number, suffix)


def street_form(name: Column, short: bool) -> Column:
    """A name in small letters with bare numbers as ordinals; ``short``: the source has short forms, which are spelled out by their places.

    'st' is a saint in front of other words and a street at the end. A letter
    behind is a direction, but for lettered avenues ('avenue n').
    """
    words = F.filter(F.split(F.regexp_replace(F.lower(text(name)), "[.']", ""), r"\s+"), lambda w: w != "")
    n = F.size(words)

    def word(w: Column, i: Column) -> Column:
        other = F.when(w.rlike("^[0-9]+$"), ordinal(w)).otherwise(w)
        if not short:
            return other
        last, lead = i == n - 1, F.try_element_at(_map(LEADING_FORMS), w)
        before = F.try_element_at(words, F.when(i > 0, i).otherwise(F.lit(1)).cast("int"))
        lettered = (i == 1) & before.isin("avenue", "ave")
        out = F.when((i == 0) & ~last & lead.isNotNull(), lead).when(w == "st", F.when(last, "street").otherwise("saint"))
        out = out.when(w.isin(*STREET_FORMS), F.try_element_at(_map(STREET_FORMS), w))
        return out.when(last & (i > 0) & w.isin(*DIRECTIONS) & ~lettered, F.try_element_at(_map(DIRECTIONS), w)).otherwise(other)

    return F.array_join(F.transform(words, word), " ")


def street_key(name: Column) -> Column:
    """A name for comparison between sources: capitals, whole words, numbers without endings, no spaces or marks."""
    words = F.filter(F.split(F.regexp_replace(F.upper(text(name)), "[.,'/-]", " "), r"\s+"), lambda w: w != "")
    bare = F.transform(words, lambda w: F.regexp_replace(w, "^([0-9]+)(ST|ND|RD|TH)$", "$1"))
    return F.array_join(F.transform(bare, lambda w: F.coalesce(F.try_element_at(_map(COMPARED_FORMS), w), w)), "")


def same_street(a: Column, b: Column) -> Column:
    """Whether two keys are of one street: one holds the other, and neither is empty."""
    return (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a))


def flag(ours: Column, theirs: Column, arbiter: Column) -> tuple[Column, Column]:
    """How our length compares with another engine's, and what a third one makes of it."""
    said = F.when((ours > 1.25 * theirs) & (ours - theirs > 250), "longer").when((ours < 0.8 * theirs) & (theirs - ours > 200), "shorter").otherwise("ok")
    verdict = F.when(said == "ok", "none").when((ours / arbiter).between(1 / 1.1, 1.1), "cleared").otherwise("stands")
    return said, verdict
