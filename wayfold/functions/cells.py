"""Column functions on overlay cells: 22 bits an axis, interleaved, latitude in the odd bits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import haversine, let, quantize

#: Bits an axis keeps of 32, and metres between the points that a line is sampled at.
AXIS_BITS, STEP_M = 22, 12.0
#: Every second bit.
_EVEN = 0x5555555555555555


def spread(x: Column) -> Column:
    """Put a zero bit before each bit: its binary digits read as digits of base 4."""
    return F.conv(F.bin(x), 4, 10).cast("long")


def compact(x: Column) -> Column:
    """The inverse of ``spread``: every second bit, as the digits of base 4 read in base 2."""
    return F.conv(F.conv(x.bitwiseAND(F.lit(_EVEN)).cast("string"), 10, 4), 2, 10).cast("long")


def join_axes(y: Column, x: Column) -> Column:
    return F.shiftleft(spread(y), 1).bitwiseOR(spread(x))


def overlay_cell(lat: Column, lon: Column) -> Column:
    """The cell of a point; its axes are the upper bits of the quantized coordinates."""
    axis = lambda v, most: F.shiftright(quantize(v, -most, most), 32 - AXIS_BITS)
    return join_axes(axis(lat, 90.0), axis(lon, 180.0))


def dequantize(value: Column, low: float, high: float) -> Column:
    return F.lit(low) + value / F.lit(4294967295.0) * F.lit(high - low)


def center(cell: Column) -> tuple[Column, Column]:
    """Latitude and longitude of a cell's centre."""
    mid = lambda axis: F.shiftleft(axis, 32 - AXIS_BITS) + (1 << (31 - AXIS_BITS))
    y, x = compact(F.shiftright(cell, 1)), compact(cell)
    return dequantize(mid(y), -90.0, 90.0), dequantize(mid(x), -180.0, 180.0)


def neighbours(cell: Column) -> Column:
    """The cell and those around it, clipped at the limits of the axes."""
    y, x = compact(F.shiftright(cell, 1)), compact(cell)
    inside = lambda v: (v >= 0) & (v < (1 << AXIS_BITS))
    ring = F.array(*(F.when(inside(y + a) & inside(x + b), join_axes(y + a, x + b)) for a in (-1, 0, 1) for b in (-1, 0, 1)))
    return F.filter(ring, lambda c: c.isNotNull())


def transition_metres(a: Column, b: Column) -> Column:
    """From the centre of one cell to that of another."""
    return haversine(*center(a), *center(b))


def rasterize(points: Column) -> Column:
    """The cells along an array of (lat, lon), sampled at most 12 m apart, without consecutive repeats.

    Fewer than two points give no cells.
    """

    def segment(i: Column) -> Column:
        a, b = F.get(points, i), F.get(points, i + 1)
        steps = F.greatest(F.ceil(haversine(a["lat"], a["lon"], b["lat"], b["lon"]) / STEP_M), F.lit(1)).cast("int")
        return F.struct(a.alias("a"), b.alias("b"), steps.alias("steps"))

    def sampled(s: Column) -> Column:
        at = lambda c, k: s["a"][c] + (s["b"][c] - s["a"][c]) * (k / s["steps"])
        return F.transform(F.sequence(F.lit(0), s["steps"]), lambda k: overlay_cell(at("lat", k), at("lon", k)))

    every = F.flatten(F.transform(F.transform(F.sequence(F.lit(0), F.size(points) - 2), segment), sampled))
    return without_repeats(F.when(F.size(points) >= 2, every).otherwise(F.array().cast("array<bigint>")))


def without_repeats(values: Column) -> Column:
    """Drop each element that equals the one before it."""

    def kept(v: Column) -> Column:
        at = F.transform(v, lambda x, i: F.struct(x.alias("v"), ((i == 0) | ~x.eqNullSafe(F.get(v, i - 1))).alias("new")))
        return F.transform(F.filter(at, lambda x: x["new"]), lambda x: x["v"])

    return let(values, kept)
