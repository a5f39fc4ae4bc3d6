"""Column functions on modes, clocks, labels, realtime codes and turns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of a route type that make it a tram or a bus; words of a rapid one.
TRAM_WORDS, BUS_WORDS, RAPID_WORDS = ("tram", "streetcar"), ("bus", "coach", "trolley"), ("Subway", "Rail", "Metro")
#: Names of the schedule relationships of a trip and of the occupancy states, by code.
RELATIONSHIPS = ("SCHEDULED", "ADDED", "UNSCHEDULED", "CANCELED")
OCCUPANCIES = ("EMPTY", "MANY_SEATS_AVAILABLE", "FEW_SEATS_AVAILABLE", "STANDING_ROOM_ONLY", "CRUSHED_STANDING_ROOM_ONLY", "FULL", "NOT_ACCEPTING_PASSENGERS")
#: Fixed value: a turn under this many degrees goes straight on.
STRAIGHT_DEGREES = 20.0
MODES = ("bus", "tram")


def parse_modes(wanted: str | None) -> frozenset[str] | None:
    """A list such as "bus,tram" as a set; None where it filters nothing (nothing asked, or all modes).

    Unknown modes and a list without any are errors.
    """
    if wanted is None:
        return None
    found = [x.strip().lower() for x in wanted.split(",") if x.strip()]
    unknown = sorted(set(found) - set(MODES))
    if unknown:
        raise ValueError(f"unsupported transport mode: {', '.join(unknown)}")
    if not found:
        raise ValueError("no transport mode given")
    return None if set(found) == set(MODES) else frozenset(found)


def mode_of(route_type: Column) -> Column:
    """tram (tested first), bus or other, by words of the route type."""
    has = lambda words: reduce(lambda a, b: a | b, (F.contains(F.lower(route_type), F.lit(w)) for w in words))
    return F.when(has(TRAM_WORDS), "tram").when(has(BUS_WORDS), "bus").otherwise("other")


def mode_allowed(mode: Column, allowed: frozenset[str] | None) -> Column:
    """Other modes pass only where nothing is filtered."""
    return F.lit(True) if allowed is None else mode.isin(*sorted(allowed))


def is_rapid(route_type: Column) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(route_type, F.lit(w)) for w in RAPID_WORDS))


def clock_seconds(text: Column) -> Column:
    """HH:MM or HH:MM:SS as seconds; null where it is no time of day."""
    part = lambda i: F.regexp_extract(text, r"^([0-9]{1,2}):([0-9]{2})(?::([0-9]{2}))?$", i)
    h, m, s = (F.coalesce(F.nullif(part(i), F.lit("")).cast("int"), F.lit(0)) for i in (1, 2, 3))
    return F.when((part(1) != "") & (h < 24) & (m < 60) & (s < 60), h * 3600 + m * 60 + s)


def route_label(short: Column, long: Column, route_id: Column) -> Column:
    """The short name, else the long one, else the id; blank names count as missing."""
    return F.coalesce(F.nullif(F.trim(short), F.lit("")), F.nullif(F.trim(long), F.lit("")), route_id)


def packed_id(feed: Column, kind: Column, number: Column) -> Column:
    """feed << 48 | kind << 40 | number: one 64-bit id for entities of all feeds."""
    return F.shiftleft(feed.cast("long"), 48).bitwiseOR(F.shiftleft(kind.cast("long"), 40)).bitwiseOR(number.cast("long"))


def lookup_bucket(ready: Column, lookback: Column, last_bucket: Column, width: int = 900) -> Column:
    """The bucket where a search for departures from ``ready`` on begins, ``lookback`` seconds earlier for late trips."""
    return F.least(F.floor(F.greatest(ready - lookback, F.lit(0)) / width).cast("int"), last_bucket)


def code_name(code: Column, names: tuple[str, ...]) -> Column:
    """The name of a code, null for unknown ones."""
    return F.get(F.array(*map(F.lit, names)), F.when(code >= 0, code))


def relationship_rank(code: Column) -> Column:
    """Merging keeps the code of the highest rank: cancelled stays, scheduled yields to anything."""
    return F.when(code == 3, 2).when(code == 0, 0).otherwise(1)


def turn(from_lat: Column, from_lon: Column, lat: Column, lon: Column, to_lat: Column, to_lon: Column) -> Column:
    """continue, turn-left or turn-right at (lat, lon); without a way before or after it is continue."""
    shrink = F.cos(F.radians(lat))
    ax, ay, bx, by = (lon - from_lon) * shrink, lat - from_lat, (to_lon - lon) * shrink, to_lat - lat
    cross, along = ax * by - ay * bx, ax * bx + ay * by
    still = ((ax == 0) & (ay == 0)) | ((bx == 0) & (by == 0))
    angle = F.degrees(F.atan2(F.abs(cross), along))
    return F.when(still | (angle < STRAIGHT_DEGREES), "continue").when(cross > 0, "turn-left").otherwise("turn-right")


def snap_cost(metres: Column, kappa: float) -> Column:
    """Metres of a connector with a penalty that grows with the square of its length."""
    return metres * (metres / kappa) + metres


def endpoint_kind(stop: Column, lat: Column, lon: Column) -> Column:
    """stop or coordinate; else what is wrong with the endpoint."""
    both, none = lat.isNotNull() & lon.isNotNull(), lat.isNull() & lon.isNull()
    return (
        F.when(stop.isNotNull() & ~none, "stop and coordinate")
        .when(stop.isNotNull(), "stop")
        .when(none, "missing")
        .when(~both, "half a coordinate")
        .when((F.abs(lat) > 90) | (F.abs(lon) > 180), "out of range")
        .otherwise("coordinate")
    )


def occupancy_severity(code: Column) -> Column:
    """The known codes 0 to 8 rank as they are numbered, unknown ones above all."""
    return F.when(code.between(0, 8), code).otherwise(255)


def virtual_id(lat: Column, lon: Column) -> Column:
    return F.format_string("virtual:%.6f,%.6f", lat, lon)


def virtual_name(role: Column, lat: Column, lon: Column) -> Column:
    return F.format_string("%s %.5f, %.5f", role, lat, lon)


def version_changed(cached: Column, remote: Column) -> Column:
    """Whether a remote (url, etag, modified) differs from the cached one; entity tags count before dates."""
    differs = lambda c: ~cached[c].eqNullSafe(remote[c])
    known = lambda c: cached[c].isNotNull() | remote[c].isNotNull()
    return F.when(cached.isNull() | differs("url"), True).when(known("etag"), differs("etag")).otherwise(differs("modified"))


def merged_version(preferred: Column, fallback: Column) -> Column:
    """The preferred version, its missing tag and date taken from the other."""
    return F.struct(preferred["url"].alias("url"), *(F.coalesce(preferred[c], fallback[c]).alias(c) for c in ("etag", "modified")))


__all__ = [x for x in dir() if not x.startswith("_") and x not in ("annotations", "reduce", "Column", "F")]
