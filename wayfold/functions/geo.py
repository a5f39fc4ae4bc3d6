"""Column functions on coordinates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean earth radius in metres, walking speed in metres a second.
EARTH_M, WALK_MPS = 6371000.0, 1.35


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value worked out once; the bodies of lambdas don't share what they repeat."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def haversine(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat_b - lat_a) / 2), 2) + F.cos(F.radians(lat_a)) * F.cos(F.radians(lat_b)) * F.pow(F.sin(F.radians(lon_b - lon_a) / 2), 2)
    return 2 * F.lit(EARTH_M) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def walk_seconds(metres: Column) -> Column:
    return F.ceil(metres / WALK_MPS).cast("int")


def quantize(value: Column, low: float, high: float) -> Column:
    """A coordinate as a whole number of 32 bits, halves away from zero."""
    return F.round((value - low) / (high - low) * F.lit(4294967295.0)).cast("long")


def spread(x: Column) -> Column:
    """Put a zero bit before each of 16 bits."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


def cell(lat: Column, lon: Column) -> Column:
    """The 28-bit cell of a point: 14 bits an axis interleaved, latitude in the odd bits."""
    axis = lambda v, lo, hi: spread(F.shiftright(quantize(v, lo, hi), 18))
    return F.shiftleft(axis(lat, -90.0, 90.0), 1).bitwiseOR(axis(lon, -180.0, 180.0))


def service_time(day: Column, seconds: Column) -> Column:
    """Seconds after a service day's midnight, also negative or past 24 h, as text."""
    days = F.floor(seconds / 86400).cast("int")
    s = F.pmod(seconds, F.lit(86400))
    two = lambda x: F.lpad(x.cast("int").cast("string"), 2, "0")
    return F.concat_ws("", F.date_format(F.date_add(day, days), "yyyy-MM-dd"), F.lit("T"), two(F.floor(s / 3600)), F.lit(":"), two(F.floor(s / 60) % 60), F.lit(":"), two(s % 60))
