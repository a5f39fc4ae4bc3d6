"""Operators on timetables, realtime deltas, differences and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine
from ..plans.lineage import written

#: Width of a departure bucket, seconds; the largest delay believed.
BUCKET_S, MOST_DELAY_S = 900, 21600


def first_departures(stop_times: DataFrame) -> DataFrame:
    """Per (line, position, bucket): how many departures come before the bucket's start. Buckets reach past the last."""
    d = stop_times.groupBy("line_index", "pos", F.floor(F.col("dep_s") / BUCKET_S).cast("int").alias("bucket")).agg(F.count("*").alias("n"))
    last = stop_times.groupBy("line_index", "pos").agg((F.floor(F.max("dep_s") / BUCKET_S) + 1).cast("int").alias("last"))
    grid = last.select("line_index", "pos", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("bucket"))
    before = Window.partitionBy("line_index", "pos").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return grid.join(d, ["line_index", "pos", "bucket"], "left").select("line_index", "pos", "bucket", F.coalesce(F.sum(F.coalesce("n", F.lit(0))).over(before), F.lit(0)).alias("first_index"))


def trip_ranks(stop_times: DataFrame) -> DataFrame:
    w = Window.partitionBy("line_index", "service_dow").orderBy("dep_s", "trip_index")
    return stop_times.where("pos = 0").select("line_index", "service_dow", "trip_index", (F.row_number().over(w) - 1).alias("trip_rank"))


def monotone(stop_times: DataFrame) -> DataFrame:
    """Whether departures never decrease in trip order, per (line, day, position)."""
    ranked = stop_times.join(trip_ranks(stop_times).select("trip_index", "trip_rank"), "trip_index")
    w = Window.partitionBy("line_index", "service_dow", "pos").orderBy("trip_rank")
    return ranked.withColumn("falls", F.coalesce(F.col("dep_s") < F.lag("dep_s").over(w), F.lit(False))).groupBy("line_index", "service_dow", "pos").agg((~F.bool_or("falls")).alias("monotone"))


def indirection(stop_times: DataFrame) -> DataFrame:
    """The order of trips by departure at each position, ties by trip rank."""
    ranked = stop_times.join(trip_ranks(stop_times).select("trip_index", "trip_rank"), "trip_index")
    w = Window.partitionBy("line_index", "service_dow", "pos").orderBy("dep_s", "trip_rank")
    return ranked.select("line_index", "service_dow", "pos", "trip_rank", (F.row_number().over(w) - 1).alias("place"))


def propagate_delays(stop_times: DataFrame, deltas: DataFrame) -> DataFrame:
    """The last believable delay of a trip carries on to its later stops."""
    d = deltas.select("trip_index", "pos", "skipped", F.when(F.abs("delay_s") <= MOST_DELAY_S, F.col("delay_s")).alias("delay_s"))
    touched = stop_times.join(d.select("trip_index").distinct(), "trip_index", "left_semi")
    w = Window.partitionBy("trip_index").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    out = touched.join(d, ["trip_index", "pos"], "left").withColumn("carried", F.last("delay_s", ignorenulls=True).over(w))
    return out.select("trip_index", "pos", F.coalesce("carried", F.lit(0)).alias("delay_s"), F.coalesce("skipped", F.lit(0)).alias("skipped"))


def actual_times(stop_times: DataFrame, deltas: DataFrame) -> DataFrame:
    """Departures and arrivals with delays, cancelled trips left out and skipped stops marked."""
    running = stop_times.join(deltas.where("canceled = 1").select("trip_index").distinct(), "trip_index", "left_anti")
    d = propagate_delays(stop_times, deltas)
    out = running.join(d, ["trip_index", "pos"], "left")
    late = F.coalesce("delay_s", F.lit(0))
    return out.select("trip_index", "line_index", "pos", "stop_index", "service_dow", (F.col("arr_s") + late).alias("arr_s"), (F.col("dep_s") + late).alias("dep_s"), F.coalesce("skipped", F.lit(0)).alias("skipped"))


def differences(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Full outer comparison: key, status of added, removed, changed, same."""
    o, n = (x.select(F.col(key), F.struct(*columns).alias(name)) for x, name in ((old, "o"), (new, "n")))
    status = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(~F.col("o").eqNullSafe(F.col("n")), "changed").otherwise("same")
    return o.join(n, key, "full_outer").select(key, status.alias("status"))


def pareto(profiles: DataFrame, keys: list[str]) -> DataFrame:
    """Per key and number of legs, points by latest start: those that arrive before all that start no earlier."""
    w = Window.partitionBy(*keys, "legs").orderBy(F.col("ready_s").desc(), "arr_s").rowsBetween(Window.unboundedPreceding, -1)
    return profiles.withColumn("best", F.min("arr_s").over(w)).where("best IS NULL OR arr_s < best").drop("best")


def search_stops(stops: DataFrame, needle: str, limit: int = 12) -> DataFrame:
    """Score 0 for an equal id, 1 for an equal code, 2 for a prefix of the text to search, 3 for a part of it.

    Equality is with the needle as given, but for case; the rest with its trimmed form. The text is ``search_blob``
    where the table has it, else the name; codes are compared where it has ``stop_code``. A blank needle finds all
    with score 0. ``limit`` is brought between 1 and 50.
    """
    low = needle.strip().lower()
    text = F.col("search_blob") if "search_blob" in stops.columns else F.lower("stop_name")
    equals = lambda c: F.lower(F.col(c).cast("string")) == needle.lower()
    code = equals("stop_code") if "stop_code" in stops.columns else F.lit(False)
    score = F.when(F.lit(low == "") | equals("stop_index"), 0).when(code, 1).when(text.startswith(low), 2).when(text.contains(low), 3)
    return stops.withColumn("score", score).where("score IS NOT NULL").orderBy("score", "stop_index").limit(min(max(limit, 1), 50))


def updated_trips(deltas: DataFrame) -> DataFrame:
    """trip_index of trips with a believed delay, a skipped stop, or cancelled."""
    return deltas.where((F.col("canceled") == 1) | (F.col("skipped") == 1) | (F.abs("delay_s") <= MOST_DELAY_S)).select("trip_index").distinct()


def changed_trips(before: DataFrame | None, now: DataFrame) -> DataFrame:
    """Trips that a refresh may have changed: those updated before it or after it."""
    after = updated_trips(now)
    return after if before is None else updated_trips(before).unionByName(after).distinct()


def relax(edges: DataFrame, sources: DataFrame, most: int) -> DataFrame:
    """Multi-source shortest paths no longer than ``most``: (node, dist, root), ties to the smaller root.

    Runs until no label improves, however many edges a path has; a round expands only the labels that the last one
    improved. Edges must not be negative.
    """
    edges = written(edges)
    best = fresh = written(sources.select("node", F.lit(0).alias("dist"), F.col("node").alias("root")))
    while not fresh.isEmpty():
        step = fresh.withColumnRenamed("node", "src").join(edges, "src").select(F.col("dst").alias("node"), (F.col("dist") + F.col("dur_s")).cast("int").alias("dist"), "root")
        step = step.where(F.col("dist") <= most).groupBy("node").agg(F.min(F.struct("dist", "root")).alias("m"))
        old = best.select("node", F.struct("dist", "root").alias("old"))
        fresh = written(step.join(old, "node", "left").where("old IS NULL OR m < old").select("node", "m.dist", "m.root"))
        best = written(best.join(fresh, "node", "left_anti").unionByName(fresh))
    return best


def affected(old: DataFrame, new: DataFrame, radius_m: float) -> DataFrame:
    """Stops whose walks must be built again: changed ones, and new stops near a changed one's old or new place.

    Both sides meet on a grid whose cells are at least the radius wide (up to 83 degrees of latitude), so a place
    meets its own cell and the eight around it. Stops without coordinates can be changed but not near.
    """
    changed = differences(old, new, "stop_index", ["lat", "lon"]).where("status <> 'same'").select("stop_index")
    places = old.select("stop_index", "lat", "lon").unionByName(new.select("stop_index", "lat", "lon")).join(changed, "stop_index", "left_semi").select("lat", "lon").where("lat IS NOT NULL AND lon IS NOT NULL").distinct()
    size = radius_m / 111000.0
    wide = size * 8.3  # a degree of longitude shrinks to an eighth at 83 degrees
    y, x = F.floor(F.col("lat") / size).alias("y"), F.floor(F.col("lon") / wide).alias("x")
    around = F.explode(F.array(*(F.struct((y + a).alias("y"), (x + b).alias("x")) for a in (-1, 0, 1) for b in (-1, 0, 1)))).alias("g")
    left = places.select(F.col("lat").alias("lat_a"), F.col("lon").alias("lon_a"), around).select("lat_a", "lon_a", "g.*")
    right = new.select("stop_index", "lat", "lon", y, x)
    near = left.join(right, ["y", "x"]).where(haversine(F.col("lat_a"), F.col("lon_a"), F.col("lat"), F.col("lon")) <= radius_m)
    return changed.unionByName(near.select("stop_index")).distinct()


def invalidate(profiles: DataFrame, changed: DataFrame, key: str, trips: str) -> DataFrame:
    """Profile points without those that use a changed trip; points that only walk stay."""
    used = profiles.select(key, F.explode(trips).alias("trip_index"))
    gone = used.join(changed.select("trip_index").distinct(), "trip_index", "left_semi").select(key).distinct()
    return profiles.join(gone, key, "left_anti")
