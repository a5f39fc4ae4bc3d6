"""Column functions on paths: arrays of (lat, lon) with the way of each segment."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import haversine, let
from .transit import turn

POINTS = "array<struct<lat:double,lon:double>>"
GEOMETRY = f"struct<points:{POINTS},ways:array<bigint>>"
STEPS = "array<struct<maneuver:string,street:string,metres:double,lat:double,lon:double>>"
#: Points closer than this on both axes are one; unnamed turns closer than this many metres are left out.
SAME_DEGREES, TURN_METRES = 1e-7, 15.0


def straight_line(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    """Two points, or none where a coordinate is missing."""
    known = lat_a.isNotNull() & lon_a.isNotNull() & lat_b.isNotNull() & lon_b.isNotNull()
    point = lambda a, b: F.struct(a.alias("lat"), b.alias("lon"))
    return F.when(known, F.array(point(lat_a, lon_a), point(lat_b, lon_b)).cast(POINTS)).otherwise(F.array().cast(POINTS))


def thin(points: Column) -> Column:
    """Points that repeat the last one kept go."""

    def add(kept: Column, p: Column) -> Column:
        last = F.try_element_at(kept, F.lit(-1))
        same = (F.size(kept) > 0) & (F.abs(last["lat"] - p["lat"]) <= SAME_DEGREES) & (F.abs(last["lon"] - p["lon"]) <= SAME_DEGREES)
        return F.when(F.coalesce(same, F.lit(False)), kept).otherwise(F.concat(kept, F.array(p)))

    return F.aggregate(points, F.array().cast(POINTS), add)


def segment_ways(points: Column, ways: Column) -> Column:
    """One way a segment: cut where there are more, padded with nulls where there are fewer."""
    n = F.greatest(F.size(points) - 1, F.lit(0))
    padded = F.concat(F.coalesce(ways, F.array().cast("array<bigint>")), F.array_repeat(F.lit(None).cast("bigint"), n))
    return F.slice(padded, F.lit(1), n)


def stitch(pieces: Column) -> Column:
    """Walks one after another as one geometry.

    Of each piece but the first the first point goes, of each but the last the last one, where it has more than one
    point. A point that repeats the one before is left out; elsewhere a segment of no way joins the pieces.
    """

    def trimmed(g: Column, i: Column, n: Column) -> Column:
        points, ways = g["points"], segment_ways(g["points"], g["ways"])
        head = ((i > 0) & (F.size(points) > 1)).cast("int")
        tail = ((i < n - 1) & (F.size(points) - head > 1)).cast("int")
        kept = F.slice(points, head + 1, F.size(points) - head - tail)
        return F.struct(kept.alias("points"), F.slice(ways, head + 1, F.greatest(F.size(kept) - 1, F.lit(0))).alias("ways")).cast(GEOMETRY)

    def append(done: Column, g: Column) -> Column:
        meets = F.try_element_at(done["points"], F.lit(-1)) == F.try_element_at(g["points"], F.lit(1))
        rest = F.slice(g["points"], F.lit(2), F.greatest(F.size(g["points"]) - 1, F.lit(0)))
        joined = F.when(meets, F.struct(F.concat(done["points"], rest).alias("points"), F.concat(done["ways"], g["ways"]).alias("ways"))).otherwise(
            F.struct(F.concat(done["points"], g["points"]).alias("points"), F.concat(done["ways"], F.array(F.lit(None).cast("bigint")), g["ways"]).alias("ways"))
        )
        return F.when(F.size(g["points"]) == 0, done).when(F.size(done["points"]) == 0, g).otherwise(joined.cast(GEOMETRY))

    none = F.struct(F.array().cast(POINTS).alias("points"), F.array().cast("array<bigint>").alias("ways")).cast(GEOMETRY)
    return let(pieces, lambda all_of: F.aggregate(F.transform(all_of, lambda g, i: trimmed(g, i, F.size(all_of))), none, append))


def metres_along(points: Column) -> Column:
    """Metres from the first point to each."""
    pairs = F.transform(points, lambda p, i: F.struct(F.get(points, i - 1).alias("a"), p.alias("b")))
    step = lambda p: F.coalesce(haversine(p["a"]["lat"], p["a"]["lon"], p["b"]["lat"], p["b"]["lon"]), F.lit(0.0))
    return F.aggregate(pairs, F.array().cast("array<double>"), lambda done, p: F.concat(done, F.array(F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(0.0)) + step(p))))


def road_label(way: Column, names: Column) -> Column:
    """The trimmed name of a way; null where there is none."""
    return F.nullif(F.trim(F.try_element_at(names, way)), F.lit(""))


def same_road(a: Column, b: Column, names: Column) -> Column:
    """Equal ways, no way on both sides, or ways whose names are equal but for case and outer blanks."""
    alike = F.lower(F.trim(F.try_element_at(names, a))) == F.lower(F.trim(F.try_element_at(names, b)))
    return F.when(a.isNull() & b.isNull(), True).when(a.isNull() | b.isNull(), False).otherwise((a == b) | F.coalesce(alike, F.lit(False)))


def directions(points: Column, ways: Column, names: Column) -> Column:
    """Steps of a walk: depart, a step where the road changes, arrive; none for fewer than two points.

    ``names`` maps ways to names. A change without a name gives a step only if it turns at least 15 m after the step before.
    """
    known = F.struct(segment_ways(points, ways).alias("ways"), metres_along(points).alias("along"))
    step = lambda kind, street, d, p: F.array(F.struct(F.lit(kind) if isinstance(kind, str) else kind, street, d, p["lat"], p["lon"])).cast(STEPS)

    def all_steps(x: Column) -> Column:
        used, along = x["ways"], x["along"]

        def visit(done: Column, i: Column) -> Column:
            a, b, p, q, r = F.get(used, i - 1), F.get(used, i), F.get(points, i - 1), F.get(points, i), F.get(points, i + 1)
            kind = turn(p["lat"], p["lon"], q["lat"], q["lon"], r["lat"], r["lon"])
            street, d = road_label(b, names), F.get(along, i)
            since = d - F.try_element_at(done, F.lit(-1))["metres"]
            silent = a.isNull() | b.isNull() | same_road(a, b, names) | (street.isNull() & ((kind == "continue") | (since < TURN_METRES)))
            return F.when(silent, done).otherwise(F.concat(done, step(kind, street, d, q)))

        named = F.filter(F.transform(used, lambda w: road_label(w, names)), lambda s: s.isNotNull())
        depart = step("depart", F.get(named, F.lit(0)), F.lit(0.0), F.get(points, F.lit(0)))
        inner = F.slice(F.sequence(F.lit(0), F.size(points)), F.lit(2), F.greatest(F.size(points) - 2, F.lit(0)))
        arrive = step("arrive", F.lit(None).cast("string"), F.try_element_at(along, F.lit(-1)), F.try_element_at(points, F.lit(-1)))
        return F.concat(F.aggregate(inner, depart, visit), arrive)

    return F.when(F.size(points) >= 2, let(known, all_steps)).otherwise(F.array().cast(STEPS))


def instruction(maneuver: Column, street: Column, destination: Column) -> Column:
    """The text of a step; the words are fixed values, in the language that the interface speaks."""
    stem = F.when(maneuver == "depart", "Parti a piedi").when(maneuver == "turn-left", "Svolta a sinistra").when(maneuver == "turn-right", "Svolta a destra").otherwise("Continua dritto")
    goal = F.nullif(F.trim(destination), F.lit(""))
    arrive = F.coalesce(F.concat(F.lit("Arrivo a "), goal), F.lit("Arrivo a destinazione"))
    return F.when(maneuver == "arrive", arrive).otherwise(F.coalesce(F.concat(stem, F.lit(" su "), street), stem))
