"""Line scans where trips overtake, and journeys as legs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import written
from .routing import board

_LEG = "struct<kind:int,from_stop:int,to_stop:int,trip_index:bigint,board_pos:int,alight_pos:int,dep_s:int,arr_s:int>"
#: Kinds of leg.
WALK, RIDE = 0, 1


def scan_lines(ready: DataFrame, stop_times: DataFrame) -> DataFrame:
    """(query_id, line_index, trip_index, board_pos, last_pos): the vehicles a rider sits in along each line.

    At a position the rider changes to the first trip that can be caught there if it leaves strictly earlier than
    the trip the rider is in (never where that trip does not call); so trips of a line may overtake each other. What can be caught does not depend on
    the ride, so it is an as-of join; only the choice is a fold, over one line's positions, inside an array.
    """
    deps = stop_times.groupBy("trip_index").agg(F.array_sort(F.collect_list(F.struct("pos", "dep_s"))).alias("deps"))
    caught = board(ready, stop_times).select("query_id", "line_index", F.col("board_pos").alias("pos"), "trip.trip_index", "trip.dep_s")
    by_line = caught.join(deps, "trip_index").groupBy("query_id", "line_index").agg(F.array_sort(F.collect_list(F.struct("pos", "trip_index", "dep_s", "deps"))).alias("c"))

    def step(taken: Column, c: Column) -> Column:
        now = F.element_at(taken, -1)
        earlier = (F.size(taken) == 0) | F.coalesce(c["dep_s"] < F.element_at(F.map_from_entries(now["deps"]), c["pos"]), F.lit(False))
        return F.when(earlier, F.concat(taken, F.array(c))).otherwise(taken)

    by_line = by_line.withColumn("taken", F.aggregate("c", F.expr("CAST(array() AS ARRAY<STRUCT<pos:INT,trip_index:BIGINT,dep_s:INT,deps:ARRAY<STRUCT<pos:INT,dep_s:INT>>>>)"), step))
    pieces = F.transform("taken", lambda x, i: F.struct(x["trip_index"].alias("trip_index"), x["pos"].alias("board_pos"), F.get("taken", i + 1)["pos"].alias("last_pos")))
    return by_line.select("query_id", "line_index", F.explode(pieces).alias("p")).select("query_id", "line_index", "p.*")


def scan_arrivals(scanned: DataFrame, stop_times: DataFrame) -> DataFrame:
    """Arrivals at the stops that each scanned vehicle reaches, the stop where the rider changes included."""
    later = stop_times.select("trip_index", "pos", F.col("stop_index").alias("stop"), F.col("arr_s").alias("arr"))
    rode = scanned.join(later, "trip_index").where("pos > board_pos AND (last_pos IS NULL OR pos <= last_pos)")
    return rode.groupBy("query_id", "stop").agg(F.min("arr").alias("arr"))


def _leg(kind: int, a: Column, b: Column, dep: Column, arr: Column, trip: Column | None = None, pos: Column | None = None, to: Column | None = None) -> Column:
    none = F.lit(-1)
    leg = F.struct(F.lit(kind), a, b, none if trip is None else trip, none if pos is None else pos, none if to is None else to, dep, arr)
    return leg.cast(_LEG)


def _least(labels: DataFrame) -> DataFrame:
    return labels.groupBy("query_id", "stop").agg(F.min(F.struct("arr", "legs")).alias("m")).select("query_id", "stop", "m.arr", "m.legs")


def _walk(labels: DataFrame, transfers: DataFrame) -> DataFrame:
    t = transfers.select(F.col("from_stop").alias("stop"), "to_stop", "dur_s")
    arr = (F.col("arr") + F.col("dur_s")).cast("int")
    leg = _leg(WALK, F.col("stop"), F.col("to_stop"), F.col("arr"), arr)
    return labels.join(t, "stop").select("query_id", F.col("to_stop").alias("stop"), arr.alias("arr"), F.concat("legs", F.array(leg)).alias("legs"))


def journeys(queries: DataFrame, stop_times: DataFrame, transfers: DataFrame, n: int) -> DataFrame:
    """query_id, arr, vehicles, legs: the earliest journey of each query with at most n vehicles.

    Of equal arrivals the one with fewest vehicles, then the least array of legs. Labels carry their legs (at
    most 2n + 2), so no parents are followed afterwards. Queries without a journey have no row.
    """
    st, tr = written(stop_times), written(transfers)
    origin = queries.select("query_id", F.col("from_stop").alias("stop"), F.col("dep_s").alias("arr"), F.expr(f"CAST(array() AS ARRAY<{_LEG}>)").alias("legs"))
    one = _least(origin.unionByName(_walk(origin, tr)))
    out = [written(_least(one.unionByName(_walk(one, tr))))]
    for _ in range(n):
        best = out[-1]
        caught = board(best.select("query_id", "stop", "arr"), st).select("query_id", "board_pos", "trip.trip_index", "trip.dep_s")
        on = st.select("trip_index", F.col("pos").alias("board_pos"), F.col("stop_index").alias("from_stop"))
        off = st.select("trip_index", F.col("pos").alias("to_pos"), F.col("stop_index").alias("stop"), F.col("arr_s").alias("arr"))
        ride = caught.join(on, ["trip_index", "board_pos"]).join(off, "trip_index").where("to_pos > board_pos")
        leg = _leg(RIDE, F.col("from_stop"), F.col("stop"), F.col("dep_s"), F.col("arr"), F.col("trip_index"), F.col("board_pos"), F.col("to_pos"))
        # one ride for each stop reached, before its history is joined
        ride = ride.select("query_id", "stop", "arr", "from_stop", leg.alias("leg")).groupBy("query_id", "stop").agg(F.min(F.struct("arr", "leg")).alias("m"))
        ride = ride.select("query_id", "stop", "m.arr", "m.leg", F.col("m.leg.from_stop").alias("from_stop"))
        history = best.select("query_id", F.col("stop").alias("from_stop"), "legs")
        rode = ride.join(history, ["query_id", "from_stop"]).select("query_id", "stop", "arr", F.concat("legs", F.array("leg")).alias("legs"))
        old = best.select("query_id", "stop", F.col("arr").alias("old"))
        better = written(rode.join(old, ["query_id", "stop"], "left").where("old IS NULL OR arr < old").drop("old"))
        walked = _walk(better, tr)
        rank = lambda df, k: df.withColumn("k", F.lit(k))
        merged = reduce(DataFrame.unionByName, [rank(best, 0), rank(better, 1), rank(walked, 2)])
        out.append(written(merged.groupBy("query_id", "stop").agg(F.min(F.struct("arr", "k", "legs")).alias("m")).select("query_id", "stop", "m.arr", "m.legs")))
    goal = queries.select("query_id", F.col("to_stop").alias("stop"))
    found = reduce(DataFrame.unionByName, [x.join(goal, ["query_id", "stop"], "left_semi").withColumn("vehicles", F.lit(i)) for i, x in enumerate(out)])
    best = found.groupBy("query_id").agg(F.min(F.struct("arr", "vehicles", "legs")).alias("m"))
    return best.select("query_id", "m.arr", "m.vehicles", "m.legs")


def merge_walks(legs: DataFrame) -> DataFrame:
    """(query_id, leg_no, kind, ...) -> runs of walking legs as one: first start, last end, the sum of durations."""
    from pyspark.sql import Window

    w = Window.partitionBy("query_id").orderBy("leg_no")
    fresh = F.when((F.col("kind") == WALK) & (F.lag("kind").over(w) == WALK), 0).otherwise(1)
    run = legs.withColumn("run", F.sum(fresh).over(w))
    first, last = (lambda c: F.min_by(c, "leg_no")), (lambda c: F.max_by(c, "leg_no"))
    return run.groupBy("query_id", "run").agg(first("kind").alias("kind"), first("from_stop").alias("from_stop"), last("to_stop").alias("to_stop"), first("trip_index").alias("trip_index"), first("dep_s").alias("dep_s"), last("arr_s").alias("arr_s"), F.sum(F.col("arr_s") - F.col("dep_s")).alias("moving_s")).withColumnRenamed("run", "leg_no")
