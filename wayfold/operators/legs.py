"""Operators on the legs of journeys: (query_id, leg_no, kind, from_stop, to_stop, trip_index, dep_s, arr_s)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .journeys import RIDE


def _rest() -> WindowSpec:
    """A leg and those after it."""
    return Window.partitionBy("query_id").orderBy("leg_no").rowsBetween(Window.currentRow, Window.unboundedFollowing)


def profile_points(legs: DataFrame) -> DataFrame:
    """Every leg as a point of the journey's profile: source, start, arrival at the end, rides left, trips left.

    A window over one journey's legs, which are few.
    """
    rides = F.sum((F.col("kind") == RIDE).cast("int")).over(_rest())
    return legs.select("query_id", "leg_no", F.col("from_stop").alias("source"), F.col("dep_s").alias("ready_s"), F.last("arr_s").over(_rest()).alias("arr_s"), rides.cast("int").alias("legs"), F.collect_list("trip_index").over(_rest()).alias("suffix"))


def spatial_points(legs: DataFrame, cell: Column) -> DataFrame:
    """Every leg with the first stop at or after its end that lies in the destination's cell.

    ``cell`` is the cell of ``to_stop``; the destination's is that of the journey's last leg.
    """
    goal = F.last("cell").over(_rest())
    marked = legs.withColumn("cell", cell).withColumn("hit", F.when(F.col("cell") == goal, F.struct("to_stop", "arr_s")))
    marked = marked.withColumn("cut", F.first("hit", ignorenulls=True).over(_rest())).where("cut IS NOT NULL")
    return marked.select("query_id", "leg_no", F.col("from_stop").alias("source"), F.col("dep_s").alias("ready_s"), F.col("cut.to_stop").alias("boundary"), F.col("cut.arr_s").alias("arr_s"))


def anchor_points(points: DataFrame, legs: DataFrame, stop_times: DataFrame, strong: DataFrame) -> DataFrame:
    """Strong stops strictly inside a ride as further sources of its point, ready when the vehicle leaves them."""
    rides = legs.where(F.col("kind") == RIDE).select("query_id", "leg_no", "trip_index", "board_pos", "alight_pos")
    inside = rides.join(stop_times.select("trip_index", "pos", "stop_index", "dep_s"), "trip_index").where("pos > board_pos AND pos < alight_pos")
    inside = inside.join(strong.where("strong").select("stop_index"), "stop_index", "left_semi")
    found = inside.join(points.select("query_id", "leg_no", "boundary", "arr_s"), ["query_id", "leg_no"])
    return found.select("query_id", "leg_no", F.col("stop_index").alias("source"), F.col("dep_s").alias("ready_s"), "boundary", "arr_s")


def cacheable(legs: DataFrame, stops: DataFrame) -> DataFrame:
    """Legs between real stops; those that touch a virtual one go."""
    real = stops.select("stop_index")
    return legs.join(real.withColumnRenamed("stop_index", "from_stop"), "from_stop", "left_semi").join(real.withColumnRenamed("stop_index", "to_stop"), "to_stop", "left_semi").select(*legs.columns)


def dictionary(legs: DataFrame) -> DataFrame:
    """(query_id, entry, stop_index): each stop of a journey once, numbered as first seen."""
    seen = legs.select("query_id", F.posexplode(F.array("from_stop", "to_stop")).alias("side", "stop_index"), "leg_no")
    first = seen.groupBy("query_id", "stop_index").agg(F.min(F.struct("leg_no", "side")).alias("at"))
    return first.select("query_id", (F.row_number().over(Window.partitionBy("query_id").orderBy("at")) - 1).alias("entry"), "stop_index")


def hydrate(legs: DataFrame, scheduled: DataFrame, actual: DataFrame, stops: DataFrame, labels: DataFrame) -> DataFrame:
    """Rides with their labels, stop names, actual times, delay at departure and stops between.

    ``labels`` names trips. Legs of cancelled trips (none in ``actual``) keep scheduled times and a delay of 0. The calls of
    a ride are gathered once, so the timetable is shuffled by trip only.
    """
    rides = legs.where(F.col("kind") == RIDE)
    late = actual.select("trip_index", "pos", F.col("arr_s").alias("real_arr"), F.col("dep_s").alias("real_dep"))
    calls = scheduled.select("trip_index", "pos", "stop_index", F.col("dep_s").alias("plan_dep"), F.col("arr_s").alias("plan_arr")).join(late, ["trip_index", "pos"], "left")
    on = rides.join(calls, "trip_index").where("pos BETWEEN board_pos AND alight_pos")
    at = lambda where, c: F.max(F.when(F.col("pos") == F.col(where), c))
    between = F.array_sort(F.collect_list(F.when((F.col("pos") > F.col("board_pos")) & (F.col("pos") < F.col("alight_pos")), F.struct("pos", "stop_index"))))
    keys = ["query_id", "leg_no", "trip_index", "from_stop", "to_stop"]
    dep, arr = F.coalesce("real_dep", "plan_dep"), F.coalesce("real_arr", "plan_arr")
    out = on.groupBy(*keys).agg(at("board_pos", dep).alias("dep_s"), at("alight_pos", arr).alias("arr_s"), at("board_pos", dep - F.col("plan_dep")).alias("delay_s"), F.transform(between, lambda x: x["stop_index"]).alias("between"))
    name = lambda c: stops.select(F.col("stop_index").alias(c), F.col("stop_name").alias(c.replace("stop", "name")))
    return out.join(labels, "trip_index", "left").join(name("from_stop"), "from_stop", "left").join(name("to_stop"), "to_stop", "left")
