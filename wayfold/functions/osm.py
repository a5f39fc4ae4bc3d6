"""Column functions on street-map tags (map<string, string>)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Speed by road class, metres a second; the default; least and most.
CLASS_SPEED = {
    "motorway": 33.33, "motorway_link": 22.22, "trunk": 27.78, "trunk_link": 19.44, "primary": 19.44, "primary_link": 16.67, "secondary": 16.67,
    "secondary_link": 13.89, "tertiary": 13.89, "tertiary_link": 11.11, "residential": 8.33, "living_street": 8.33, "service": 5.56, "track": 4.17,
}
DEFAULT_SPEED, LEAST_SPEED, MOST_SPEED = 11.11, 4.0, 40.0

# Tags that close a way to a mode, and road classes that are never open to it.
CLOSED = {
    "walk": {"area": ["yes"], "access": ["no", "private"], "foot": ["no", "private", "use_sidepath"], "pedestrian": ["no"]},
    "drive": {"area": ["yes"], "access": ["no", "private"], "motor_vehicle": ["no", "private"], "motorcar": ["no", "private"]},
}
NEVER = {
    "walk": ["motorway", "motorway_link", "trunk", "trunk_link", "construction", "proposed", "raceway", "bus_guideway"],
    "drive": ["footway", "path", "cycleway", "steps", "bridleway", "corridor", "pedestrian", "platform", "construction", "proposed", "raceway", "bus_guideway"],
}


def open_to(tags: Column, mode: str) -> Column:
    """Whether a way is open to ``walk`` or ``drive``, never null. Walkers may also use platforms without a road class."""
    closed = F.lit(False)
    for key, values in CLOSED[mode].items():
        closed = closed | F.coalesce(tags[key].isin(values), F.lit(False))
    platform = F.coalesce(tags["railway"] == "platform", F.lit(False)) | F.coalesce(tags["public_transport"] == "platform", F.lit(False))
    bare = platform if mode == "walk" else F.lit(False)
    return ~closed & F.when(tags["highway"].isNull(), bare).otherwise(~tags["highway"].isin(NEVER[mode]))


def way_name(tags: Column) -> Column:
    """The first present of name, official name and reference, trimmed; null if nothing is left."""
    return F.nullif(F.trim(F.coalesce(tags["name"], tags["official_name"], tags["ref"])), F.lit(""))


def max_speed(text: Column) -> Column:
    """A maxspeed tag in metres a second; null where it has none: the first of a list, in miles or kilometres an hour."""
    first = F.trim(F.substring_index(text, ";", 1))
    number = F.regexp_extract(first, r"([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")
    speed = F.when(F.lower(first).contains("mph"), number * 0.44704).otherwise(number / 3.6)
    return F.when(~first.contains(":"), speed)


def drive_speed(tags: Column) -> Column:
    by_class = F.lit(DEFAULT_SPEED)
    for road, v in CLASS_SPEED.items():
        by_class = F.when(tags["highway"] == road, v).otherwise(by_class)
    signed = max_speed(tags["maxspeed"])
    # least and greatest skip nulls, so a way without a sign must be told apart first
    return F.when(signed.isNotNull(), F.least(F.greatest(signed, F.lit(LEAST_SPEED)), F.lit(MOST_SPEED))).otherwise(by_class)


def directions(tags: Column, mode: str) -> Column:
    """array<string> of forward and reverse: whether a way may be driven so. Walkers go both ways."""
    both = F.array(F.lit("forward"), F.lit("reverse"))
    if mode == "walk":
        return both
    one = F.lower(F.coalesce(tags["oneway"], F.lit("")))
    return F.when(tags["junction"] == "roundabout", F.array(F.lit("forward"))).when(one == "-1", F.array(F.lit("reverse"))).when(one.isin("yes", "true", "1"), F.array(F.lit("forward"))).otherwise(both)


def street_seconds(metres: Column, speed: Column) -> Column:
    return F.least(F.greatest(F.ceil(metres / speed), F.lit(1)), F.lit(65535)).cast("int")
