"""The library's queries over the derived network, and the SQL that DuckDB answers them with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import journeys, routing, timetable
from ..sources.fixture import _HAV, duck, network

DOW = 3
#: 4,000 m at 1.35 m/s.
FOREST_S = 2963
Query = Callable[[SparkSession, str], DataFrame]
_Q: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None, recursive: bool = False):
    def add(f):
        _Q[f.__name__] = lambda spark, sf_dir: f(network(spark, sf_dir))
        if sql:
            _SQL[f.__name__] = duck(sql, recursive)
        return f

    return add


def _day(n: dict[str, DataFrame]) -> DataFrame:
    return n["d_stop_times"].where(F.col("service_dow") == DOW)


_FOLD = """WITH RECURSIVE c AS (
  SELECT query_id, line_index, pos, arg_min(trip_index, dep_s * 1000000000000 + trip_index) AS trip, min(dep_s) AS dep FROM l0 JOIN st ON stop = stop_index AND dep_s >= arr GROUP BY 1, 2, 3
), f AS (
  SELECT DISTINCT query_id, line_index, -1 AS pos, CAST(NULL AS BIGINT) AS trip, CAST(NULL AS INT) AS stop, CAST(NULL AS INT) AS arr FROM c
  UNION ALL SELECT f.query_id, f.line_index, f.pos + 1, CASE WHEN c.trip IS NULL THEN f.trip WHEN f.trip IS NULL OR c.dep < s.dep_s THEN c.trip ELSE f.trip END, s.stop_index, s.arr_s
  FROM f LEFT JOIN st s ON s.trip_index = f.trip AND s.pos = f.pos + 1 LEFT JOIN c ON c.query_id = f.query_id AND c.line_index = f.line_index AND c.pos = f.pos + 1 WHERE f.pos < 7
) SELECT * FROM f WHERE stop IS NOT NULL"""


def rounds_sql(k: int, select: str, times: str = "SELECT * FROM d_stop_times WHERE service_dow = 3", queries: str = "SELECT * FROM d_queries", fold: bool = False) -> str:
    """Labels l0 .. lk as one chain of common table expressions; with ``fold`` riders change along overtaking lines."""
    best = "SELECT query_id, stop, min(arr) AS arr FROM ({}) u GROUP BY 1, 2"
    walk = "SELECT query_id, to_stop AS stop, arr + dur_s AS arr FROM {0} JOIN d_transfers ON from_stop = stop"
    parts = [f"st AS ({times})", f"qs AS ({queries})", "o AS (SELECT query_id, from_stop AS stop, dep_s AS arr FROM qs)"]
    parts.append("o1 AS (" + best.format("SELECT * FROM o UNION ALL " + walk.format("o")) + ")")
    parts.append("l0 AS (" + best.format("SELECT * FROM o1 UNION ALL " + walk.format("o1")) + ")")
    for i in range(1, k + 1):
        if fold:
            parts.append(f"v{i} AS (SELECT query_id, stop, min(arr) AS arr FROM ({_FOLD.replace('l0', f'l{i - 1}')}) z GROUP BY 1, 2)")
        else:
            parts.append(f"b{i} AS (SELECT query_id, line_index, pos, arg_min(trip_index, dep_s * 1000000000000 + trip_index) AS trip FROM l{i - 1} JOIN st ON stop = stop_index AND dep_s >= arr GROUP BY 1, 2, 3)")
            parts.append(f"v{i} AS (SELECT query_id, s.stop_index AS stop, min(s.arr_s) AS arr FROM b{i} b JOIN st s ON s.trip_index = b.trip AND s.pos > b.pos GROUP BY 1, 2)")
        parts.append(f"w{i} AS (SELECT v.* FROM v{i} v LEFT JOIN l{i - 1} l USING (query_id, stop) WHERE l.arr IS NULL OR v.arr < l.arr)")
        parts.append(f"l{i} AS (" + best.format(f"SELECT * FROM l{i - 1} UNION ALL SELECT * FROM w{i} UNION ALL " + walk.format(f"w{i}")) + ")")
    return f"WITH {', '.join(parts)} {select}"


def _goal_sql(k: int) -> str:
    every = " UNION ALL ".join(f"SELECT query_id, arr, {i} AS vehicles FROM l{i} JOIN qs USING (query_id) WHERE stop = to_stop" for i in range(k + 1))
    return f"SELECT query_id, arr, min(vehicles) AS vehicles FROM ({every}) x JOIN (SELECT query_id, min(arr) AS arr FROM ({every}) y GROUP BY 1) z USING (query_id, arr) GROUP BY 1, 2"


# --- network (P-*, A-*, W-*) -------------------------------------------------------------------------------------


@_query("SELECT stop_index, stop_name, feed_index, round(lat, 6) AS lat, round(lon, 6) AS lon, lower(feed_index || ':' || stop_index || ' ' || stop_name) AS search_blob FROM d_stops")
def stops(n):
    blob = F.lower(F.concat(F.concat_ws(":", "feed_index", "stop_index"), F.lit(" "), "stop_name")).alias("search_blob")
    return n["d_stops"].select("stop_index", "stop_name", "feed_index", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), blob)


@_query("SELECT route_index, stops, count(*) AS n_trips, min(trip_index) AS first_trip FROM (SELECT t.trip_index, t.route_index, string_agg(s.stop_index, ',' ORDER BY s.pos) AS stops FROM d_trips t JOIN d_stop_times s USING (trip_index) GROUP BY 1, 2) x GROUP BY 1, 2")
def lines(n):
    """A-01: trips grouped by route and whole stop sequence."""
    seq = n["d_stop_times"].groupBy("trip_index").agg(F.array_sort(F.collect_list(F.struct("pos", "stop_index"))).alias("s"))
    seq = seq.select("trip_index", F.array_join(F.transform("s", lambda x: x["stop_index"].cast("string")), ",").alias("stops"))
    return n["d_trips"].join(seq, "trip_index").groupBy("route_index", "stops").agg(F.count("*").alias("n_trips"), F.min("trip_index").alias("first_trip"))


@_query("SELECT line_index, service_dow, count(*) AS n_trips, min(dep_s) AS first_s, max(dep_s) AS last_s FROM d_stop_times WHERE pos = 0 GROUP BY 1, 2")
def line_stats(n):
    return n["d_stop_times"].where("pos = 0").groupBy("line_index", "service_dow").agg(F.count("*").alias("n_trips"), F.min("dep_s").alias("first_s"), F.max("dep_s").alias("last_s"))


@_query("""SELECT strftime(d, '%Y-%m-%d') AS service_date, dow AS service_id FROM (SELECT CAST(range AS DATE) AS d, CAST(extract(dow FROM range) AS INT) AS dow
  FROM range(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY)) WHERE NOT (d = DATE '2024-01-10' AND dow = 3) UNION ALL SELECT '2024-01-11', 3""")
def service_days(n):
    """A-05: weekdays expanded, then one removal and one addition."""
    spark = n["d_n"].sparkSession
    days = spark.range(1).select(F.explode(F.expr("sequence(DATE '2024-01-01', DATE '2024-01-30')")).alias("d"))
    week = days.select(F.date_format("d", "yyyy-MM-dd").alias("service_date"), (F.dayofweek("d") - 1).alias("service_id"))
    gone = spark.range(1).select(F.lit("2024-01-10").alias("service_date"), F.lit(3).alias("service_id"))
    more = spark.range(1).select(F.lit("2024-01-11").alias("service_date"), F.lit(3).alias("service_id"))
    return week.join(gone, ["service_date", "service_id"], "left_anti").unionByName(more)


@_query("SELECT trip_index FROM d_trips WHERE service_dow = 3 AND trip_index NOT IN (SELECT trip_index FROM d_rt WHERE canceled = 1)")
def trip_availability(n):
    """P-10: trips of the day, without cancelled ones."""
    gone = n["d_rt"].where("canceled = 1").select("trip_index").distinct()
    return n["d_trips"].where(F.col("service_dow") == DOW).join(gone, "trip_index", "left_anti").select("trip_index")


_CELL = "(SELECT stop_index, CAST(round((lat + 90.0) / 180.0 * 4294967295.0) AS BIGINT) >> 18 AS y, CAST(round((lon + 180.0) / 360.0 * 4294967295.0) AS BIGINT) >> 18 AS x FROM d_stops)"
_INTER = " + ".join(f"(((y >> {i}) & 1) << {2 * i + 1}) + (((x >> {i}) & 1) << {2 * i})" for i in range(14))


@_query(f"SELECT cell, count(*) AS n_stops, min(stop_index) AS first_stop FROM (SELECT stop_index, CAST({_INTER} AS BIGINT) AS cell FROM {_CELL}) GROUP BY 1")
def stop_cells(n):
    """A-07, F-03 .. F-06."""
    return n["d_stops"].withColumn("cell", geo.cell(F.col("lat"), F.col("lon"))).groupBy("cell").agg(F.count("*").alias("n_stops"), F.min("stop_index").alias("first_stop"))


@_query("SELECT feed_index, CAST(floor(lat * 111320 / 150) AS INT) AS y, CAST(floor(lon * 111320 * greatest(0.25, abs(cos(radians(lat)))) / 150) AS INT) AS x, count(*) AS n_stops FROM d_stops GROUP BY 1, 2, 3")
def hub_clusters(n):
    """A-08: a metric grid of a third of the walking radius, within a feed."""
    y = F.floor(F.col("lat") * 111320 / 150).cast("int").alias("y")
    x = F.floor(F.col("lon") * 111320 * F.greatest(F.lit(0.25), F.abs(F.cos(F.radians("lat")))) / 150).cast("int").alias("x")
    return n["d_stops"].groupBy("feed_index", y, x).agg(F.count("*").alias("n_stops"))


# --- geography (J-08 .. J-10, T-02) ------------------------------------------------------------------------------


def _near(n: dict[str, DataFrame]) -> DataFrame:
    """Pairs of stops in neighbouring grid cells (an equi-join), with their distance."""
    at = n["d_stops"].select("stop_index", "lat", "lon", F.floor(F.col("lat") / 0.0045).alias("y"), F.floor(F.col("lon") / 0.006).alias("x"))
    ring = F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))
    a = at.withColumn("dy", ring).withColumn("dx", ring).select(F.col("stop_index").alias("from_stop"), F.col("lat").alias("la"), F.col("lon").alias("lo"), (F.col("y") + F.col("dy")).alias("y"), (F.col("x") + F.col("dx")).alias("x"))
    d = geo.haversine(F.col("la"), F.col("lo"), F.col("lat"), F.col("lon"))
    return a.join(at, ["y", "x"]).where("from_stop <> stop_index").select("from_stop", F.col("stop_index").alias("to_stop"), d.alias("d")).where("d <= 450")


@_query("SELECT from_stop, to_stop, round(d, 3) AS dist_m, CAST(ceil(d / 1.35) AS INT) AS dur_s FROM d_pairs WHERE d <= 450")
def haversine_transfers(n):
    return _near(n).select("from_stop", "to_stop", F.round("d", 3).alias("dist_m"), geo.walk_seconds(F.col("d")).alias("dur_s"))


@_query("SELECT from_stop, to_stop, dur_s, dist_m FROM d_transfers")
def transfer_topk(n):
    w = Window.partitionBy("from_stop").orderBy("dur_s", "to_stop")
    t = _near(n).select("from_stop", "to_stop", geo.walk_seconds(F.col("d")).alias("dur_s"), F.round("d", 3).alias("dist_m"))
    return t.withColumn("r", F.row_number().over(w)).where("r <= 12").drop("r")


@_query("""SELECT query_id, stop_index, dist_m FROM (SELECT query_id, b.stop_index, round(d, 3) AS dist_m, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 3), b.stop_index) AS r FROM (
  SELECT query_id, b.stop_index, 2 * 6371000.0::DOUBLE * atan2(sqrt(h), sqrt(1 - h)) AS d FROM (SELECT query_id, b.stop_index,
    power(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * power(sin(radians(b.lon - a.lon) / 2), 2) AS h
    FROM (SELECT query_id, lat + 0.0007 AS lat, lon + 0.0005 AS lon FROM d_queries JOIN d_stops ON stop_index = from_stop) a CROSS JOIN d_stops b) b) b WHERE d <= 1500) WHERE r <= 5""")
def knn_projection(n):
    """J-10: the five nearest stops within 1,500 m, exactly, from cells no wider than the radius."""
    step_y, step_x = 0.0136, 0.019
    q = n["d_queries"].join(n["d_stops"], F.col("stop_index") == F.col("from_stop")).select("query_id", (F.col("lat") + 0.0007).alias("la"), (F.col("lon") + 0.0005).alias("lo"))
    ring = F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))
    q = q.withColumn("dy", ring).withColumn("dx", ring)
    q = q.select("query_id", "la", "lo", (F.floor(F.col("la") / step_y) + F.col("dy")).alias("y"), (F.floor(F.col("lo") / step_x) + F.col("dx")).alias("x"))
    at = n["d_stops"].select("stop_index", "lat", "lon", F.floor(F.col("lat") / step_y).alias("y"), F.floor(F.col("lon") / step_x).alias("x"))
    d = geo.haversine(F.col("la"), F.col("lo"), F.col("lat"), F.col("lon"))
    near = q.join(at, ["y", "x"]).withColumn("d", d).where("d <= 1500").select("query_id", "stop_index", F.round("d", 3).alias("dist_m"))
    return near.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("dist_m", "stop_index"))).where("r <= 5").drop("r")


# --- departures (W-02 .. W-06, J-03) -----------------------------------------------------------------------------


@_query("SELECT query_id, line_index, pos AS board_pos, min(s.dep_s) AS dep_s, arg_min(trip_index, s.dep_s * 1000000000000 + trip_index) AS trip_index FROM d_queries q JOIN d_stop_times s ON s.stop_index = q.from_stop AND s.dep_s >= q.dep_s AND service_dow = 3 GROUP BY 1, 2, 3")
def first_departure_asof(n):
    ready = n["d_queries"].select("query_id", F.col("from_stop").alias("stop"), F.col("dep_s").alias("arr"))
    return routing.board(ready, _day(n)).select("query_id", "line_index", "board_pos", "trip.dep_s", "trip.trip_index")


@_query("""WITH s AS (SELECT * FROM d_stop_times WHERE service_dow = 3), g AS (SELECT line_index, pos, unnest(range(0, CAST(floor(max(dep_s) / 900) AS BIGINT) + 2)) AS bucket FROM s GROUP BY 1, 2)
SELECT g.line_index, g.pos, CAST(bucket AS INT) AS bucket, count(s.dep_s) AS first_index FROM g LEFT JOIN s ON s.line_index = g.line_index AND s.pos = g.pos AND s.dep_s < 900 * bucket GROUP BY 1, 2, 3""")
def departure_buckets(n):
    return timetable.first_departures(_day(n))


_RANK = "r AS (SELECT line_index, service_dow, trip_index, row_number() OVER (PARTITION BY line_index, service_dow ORDER BY dep_s, trip_index) - 1 AS trip_rank FROM d_stop_times WHERE pos = 0)"


@_query(f"WITH {_RANK} SELECT line_index, service_dow, trip_index, trip_rank FROM r")
def trip_ranks(n):
    return timetable.trip_ranks(n["d_stop_times"])


@_query(f"""WITH {_RANK}, x AS (SELECT s.line_index, s.service_dow, pos, dep_s < lag(dep_s) OVER (PARTITION BY s.line_index, s.service_dow, pos ORDER BY trip_rank) AS falls
FROM d_stop_times s JOIN r USING (trip_index)) SELECT line_index, service_dow, pos, NOT bool_or(coalesce(falls, false)) AS monotone FROM x GROUP BY 1, 2, 3""")
def monotonicity_by_stop(n):
    return timetable.monotone(n["d_stop_times"])


@_query(f"WITH {_RANK} SELECT s.line_index, s.service_dow, pos, trip_rank, row_number() OVER (PARTITION BY s.line_index, s.service_dow, pos ORDER BY dep_s, trip_rank) - 1 AS place FROM d_stop_times s JOIN r USING (trip_index)")
def temporal_indirection(n):
    return timetable.indirection(n["d_stop_times"])


# --- routing (R-*) -----------------------------------------------------------------------------------------------


def _routed(n: dict[str, DataFrame], k: int, times: DataFrame | None = None) -> DataFrame:
    q = n["d_queries"]
    return routing.arrivals(q, routing.rounds(q, times if times is not None else _day(n), transfer_topk(n), k))


@_query(rounds_sql(1, _goal_sql(1)))
def one_ride_earliest_arrival(n):
    return _routed(n, 1)


@_query(rounds_sql(0, _goal_sql(0)))
def route_k0(n):
    return _routed(n, 0)


@_query(rounds_sql(2, _goal_sql(2)))
def route_k2(n):
    return _routed(n, 2)


@_query(rounds_sql(3, _goal_sql(3)))
def route_k3(n):
    return _routed(n, 3)


@_query(rounds_sql(2, "SELECT query_id, stop, arr FROM l2"))
def one_to_all(n):
    return routing.rounds(n["d_queries"], _day(n), transfer_topk(n), 2)[2]


@_query(rounds_sql(3, "SELECT query_id, a.vehicles, a.arr, a.arr - dep_s AS duration_s, greatest(a.vehicles - 1, 0) AS transfers FROM (" + _goal_sql(3) + ") a JOIN qs USING (query_id)"))
def journey_summary(n):
    out = _routed(n, 3).join(n["d_queries"], "query_id")
    return out.select("query_id", "vehicles", "arr", (F.col("arr") - F.col("dep_s")).alias("duration_s"), F.greatest(F.col("vehicles") - 1, F.lit(0)).alias("transfers"))


@_query(rounds_sql(2, " UNION ALL ".join(f"SELECT query_id, {i} AS round, count(*) AS n_stops, min(arr) AS first_arr FROM l{i} GROUP BY 1" for i in range(3))))
def rounds_trace(n):
    every = routing.rounds(n["d_queries"], _day(n), transfer_topk(n), 2)
    counted = [x.groupBy("query_id").agg(F.count("*").alias("n_stops"), F.min("arr").alias("first_arr")).withColumn("round", F.lit(k)) for k, x in enumerate(every)]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


_ACTUAL = """c AS (SELECT DISTINCT trip_index FROM d_rt WHERE canceled = 1), t AS (SELECT DISTINCT trip_index FROM d_rt),
p AS (SELECT s.*, last_value(CASE WHEN abs(delay_s) <= 21600 THEN delay_s END IGNORE NULLS) OVER (PARTITION BY s.trip_index ORDER BY s.pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried,
  coalesce(skipped, 0) AS skip FROM d_stop_times s LEFT JOIN d_rt r ON r.trip_index = s.trip_index AND r.pos = s.pos)"""


@_query(f"WITH {_ACTUAL} SELECT trip_index, pos, coalesce(carried, 0) AS delay_s, skip AS skipped FROM p WHERE trip_index IN (SELECT trip_index FROM t)")
def delay_propagation(n):
    return timetable.propagate_delays(n["d_stop_times"], n["d_rt"])


_TIMES = f"WITH {_ACTUAL} SELECT trip_index, line_index, pos, stop_index, service_dow, arr_s + coalesce(carried, 0) AS arr_s, dep_s + coalesce(carried, 0) AS dep_s, skip AS skipped FROM p WHERE trip_index NOT IN (SELECT trip_index FROM c)"


@_query(_TIMES)
def actual_times(n):
    return timetable.actual_times(n["d_stop_times"], n["d_rt"])


@_query("SELECT DISTINCT trip_index FROM d_stop_times WHERE trip_index IN (SELECT trip_index FROM d_rt WHERE canceled = 1)")
def canceled_trips(n):
    return n["d_stop_times"].join(n["d_rt"].where("canceled = 1").select("trip_index").distinct(), "trip_index", "left_semi").select("trip_index").distinct()


@_query("SELECT count(*) AS deltas, sum(canceled) AS canceled, sum(skipped) AS skipped, min(delay_s) AS least, max(delay_s) AS most, count(DISTINCT trip_index) AS trips FROM d_rt")
def realtime_stats(n):
    return n["d_rt"].agg(F.count("*").alias("deltas"), F.sum("canceled").alias("canceled"), F.sum("skipped").alias("skipped"), F.min("delay_s").alias("least"), F.max("delay_s").alias("most"), F.countDistinct("trip_index").alias("trips"))


@_query("SELECT line_index, max(least_late) AS max_late_s FROM (SELECT trip_index, max(least(greatest(delay_s, 0), 21600)) AS least_late FROM d_rt GROUP BY 1) r JOIN d_trips USING (trip_index) GROUP BY 1")
def line_max_delay(n):
    """A-04."""
    trip = n["d_rt"].groupBy("trip_index").agg(F.max(F.least(F.greatest("delay_s", F.lit(0)), F.lit(21600))).alias("late"))
    return trip.join(n["d_trips"], "trip_index").groupBy("line_index").agg(F.max("late").alias("max_late_s"))


#: Every minute of every request: too much for one SQL statement on whole tables, so tests use it on a small one.
_TRIES = "SELECT CAST(query_id AS BIGINT) * 10000 + back AS query_id, from_stop, to_stop, CAST(dep_s + 7200 - back * 60 AS INT) AS dep_s FROM d_queries CROSS JOIN (SELECT unnest(range(0, 241)) AS back) b"
ARRIVE_BY_SQL = duck(rounds_sql(2, f"""SELECT query_id, max(dep_s) AS dep_s, -max_by(neg, dep_s) AS arr FROM (SELECT a.query_id // 10000 AS query_id, qs.dep_s, -a.arr AS neg FROM ({_goal_sql(2)}) a JOIN qs USING (query_id)
  JOIN d_queries d ON d.query_id = a.query_id // 10000 WHERE a.arr <= d.dep_s + 7200) GROUP BY 1""", queries=_TRIES))


@_query()
def arrive_by_exact(n):
    """R-12: the latest departure that is in time, of every minute up to 240 before the deadline."""
    return routing.arrive_by(n["d_queries"], F.col("dep_s") + 7200, _day(n), transfer_topk(n), 2, 240)


@_query("SELECT t.trip_index, a.pos AS board_pos, 6 AS alight_pos, string_agg(s.stop_index, ',' ORDER BY s.pos) AS stops FROM (SELECT trip_index, CAST(trip_index % 4 AS INT) AS pos FROM d_trips WHERE service_dow = 3) a JOIN d_trips t USING (trip_index) JOIN d_stop_times s ON s.trip_index = t.trip_index AND s.pos > a.pos AND s.pos < 6 GROUP BY 1, 2")
def intermediate_stops(n):
    """W-09: the stops strictly between boarding and alighting."""
    a = n["d_trips"].where(F.col("service_dow") == DOW).select("trip_index", (F.col("trip_index") % 4).cast("int").alias("board_pos"))
    s = a.join(n["d_stop_times"], "trip_index").where("pos > board_pos AND pos < 6").groupBy("trip_index", "board_pos").agg(F.array_sort(F.collect_list(F.struct("pos", "stop_index"))).alias("s"))
    return s.select("trip_index", "board_pos", F.lit(6).alias("alight_pos"), F.array_join(F.transform("s", lambda x: x["stop_index"].cast("string")), ",").alias("stops"))


@_query("SELECT stop_index, stop_name, score FROM (SELECT stop_index, stop_name, CASE WHEN CAST(stop_index AS VARCHAR) = 'supplier#00000001' THEN 0 WHEN starts_with(lower(stop_name), 'supplier#00000001') THEN 2 WHEN contains(lower(stop_name), 'supplier#00000001') THEN 3 END AS score FROM d_stops) WHERE score IS NOT NULL ORDER BY score, stop_index LIMIT 12")
def stop_search(n):
    """T-01."""
    return timetable.search_stops(n["d_stops"], " Supplier#00000001").select("stop_index", "stop_name", "score")


_NEXT = "SELECT stop_index, CASE WHEN stop_index % 10 = 3 THEN lat + 0.001 ELSE lat END AS lat, lon FROM d_stops WHERE stop_index % 7 <> 0 UNION ALL SELECT stop_index + 1000000, lat, lon FROM d_stops WHERE stop_index % 9 = 0"


def _next_stops(n: dict[str, DataFrame]) -> DataFrame:
    s = n["d_stops"]
    moved = s.where("stop_index % 7 <> 0").select("stop_index", F.when(F.col("stop_index") % 10 == 3, F.col("lat") + 0.001).otherwise(F.col("lat")).alias("lat"), "lon")
    return moved.unionByName(s.where("stop_index % 9 = 0").select((F.col("stop_index") + 1000000).alias("stop_index"), "lat", "lon"))


@_query(f"SELECT coalesce(o.stop_index, x.stop_index) AS stop_index, CASE WHEN o.stop_index IS NULL THEN 'added' WHEN x.stop_index IS NULL THEN 'removed' WHEN o.lat <> x.lat OR o.lon <> x.lon THEN 'changed' ELSE 'same' END AS status FROM d_stops o FULL JOIN ({_NEXT}) x ON o.stop_index = x.stop_index")
def stop_differences(n):
    """J-14."""
    return timetable.differences(n["d_stops"], _next_stops(n), "stop_index", ["lat", "lon"])


@_query(f"""WITH x AS ({_NEXT}), c AS (SELECT count(*) FILTER (o.stop_index IS NULL OR x.stop_index IS NULL OR o.lat <> x.lat OR o.lon <> x.lon) AS mutated FROM d_stops o FULL JOIN x ON o.stop_index = x.stop_index)
SELECT mutated, greatest((SELECT count(*) FROM d_stops), (SELECT count(*) FROM x)) AS total FROM c""")
def static_divergence(n):
    """A-10."""
    d = timetable.differences(n["d_stops"], _next_stops(n), "stop_index", ["lat", "lon"])
    count = lambda *s: F.count(F.when(F.col("status").isin(*s), 1))
    return d.agg(count("added", "removed", "changed").alias("mutated"), F.greatest(count("removed", "changed", "same"), count("added", "changed", "same")).alias("total"))


@_query(f"""WITH x AS ({_NEXT}), m AS (SELECT x.stop_index, o.stop_index AS old FROM x LEFT JOIN d_stops o ON o.stop_index = x.stop_index AND o.lat = x.lat AND o.lon = x.lon)
SELECT stop_index, old AS kept_index FROM m WHERE old IS NOT NULL UNION ALL SELECT stop_index, (SELECT max(stop_index) FROM d_stops) + row_number() OVER (ORDER BY stop_index) FROM m WHERE old IS NULL""")
def append_only_merge(n):
    """U-01: unchanged entities keep their index, the others are appended in order."""
    o = n["d_stops"].select("stop_index", F.struct("lat", "lon").alias("o"))
    m = _next_stops(n).select("stop_index", F.struct("lat", "lon").alias("x")).join(o, "stop_index", "left").withColumn("same", F.coalesce(F.col("o") == F.col("x"), F.lit(False)))
    fresh = m.where("NOT same").withColumn("r", F.row_number().over(Window.orderBy("stop_index"))).crossJoin(n["d_stops"].agg(F.max("stop_index").alias("most")))
    return m.where("same").select("stop_index", F.col("stop_index").cast("long").alias("kept_index")).unionByName(fresh.select("stop_index", (F.col("most") + F.col("r")).cast("long").alias("kept_index")))


_POINTS = "SELECT stop_index AS source, CAST(trip_index % 3 AS INT) AS legs, dep_s AS ready_s, CAST(arr_s + (trip_index * 131) % 5000 AS INT) AS arr_s FROM d_stop_times WHERE service_dow = 3 AND pos = 2"


def _points(n: dict[str, DataFrame]) -> DataFrame:
    return _day(n).where("pos = 2").select(F.col("stop_index").alias("source"), (F.col("trip_index") % 3).cast("int").alias("legs"), F.col("dep_s").alias("ready_s"), (F.col("arr_s") + F.col("trip_index") * 131 % 5000).cast("int").alias("arr_s")).distinct()


@_query(f"""SELECT source, legs, ready_s, arr_s FROM (SELECT *, min(arr_s) OVER (PARTITION BY source, legs ORDER BY ready_s DESC, arr_s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM (SELECT DISTINCT * FROM ({_POINTS}))) WHERE best IS NULL OR arr_s < best""")
def profile_pareto(n):
    """W-11."""
    return timetable.pareto(_points(n), ["source"])


@_query(f"SELECT query_id, min(arr_s) AS arr_s FROM d_queries q JOIN ({_POINTS}) p ON p.source = q.from_stop AND p.ready_s >= q.dep_s AND legs <= 1 GROUP BY 1")
def profile_lookup(n):
    """J-16."""
    p = timetable.pareto(_points(n), ["source"]).withColumnRenamed("source", "from_stop")
    return n["d_queries"].join(p, "from_stop").where("ready_s >= dep_s AND legs <= 1").groupBy("query_id").agg(F.min("arr_s").alias("arr_s"))


_EDGES = "SELECT a.stop_index AS src, b.stop_index AS dst, CAST(40 + (a.stop_index * 7 + b.stop_index * 3) % 50 AS INT) AS dur_s FROM d_stops a JOIN d_stops b ON (abs(a.stop_index - b.stop_index) = 1 AND (a.stop_index - a.stop_index % 25) = (b.stop_index - b.stop_index % 25)) OR b.stop_index = a.stop_index + 25"


def _edges(n: dict[str, DataFrame]) -> DataFrame:
    """A grid of streets: both ways within a column of 25, one way to the next column."""
    a = n["d_stops"].select(F.col("stop_index").alias("src"))
    to = F.explode(F.array(F.col("src") - 1, F.col("src") + 1, F.col("src") + 25))
    block = lambda c: F.floor(F.col(c) / 25)
    e = a.withColumn("dst", to).join(a.withColumnRenamed("src", "dst"), "dst").where((block("src") == block("dst")) | (F.col("dst") == F.col("src") + 25))
    return e.select("src", "dst", (40 + (F.col("src") * 7 + F.col("dst") * 3) % 50).cast("int").alias("dur_s"))


@_query(f"""WITH RECURSIVE e AS ({_EDGES}), r AS (SELECT stop_index AS node, 0 AS dist, stop_index AS root FROM d_stops WHERE stop_index % 20 = 1
UNION SELECT dst, dist + dur_s, root FROM r JOIN e ON src = node WHERE dist + dur_s <= 2963)
SELECT node, dist, min(root) AS root FROM r JOIN (SELECT node, min(dist) AS dist FROM r GROUP BY 1) b USING (node, dist) GROUP BY 1, 2""", recursive=True)
def street_forest(n):
    """G-04: every node to its nearest root within the reference's 4,000 m, as seconds on foot; ties to the smaller root."""
    return timetable.relax(_edges(n), n["d_stops"].where("stop_index % 20 = 1").select(F.col("stop_index").alias("node")), FOREST_S)


_OVER = "SELECT trip_index, line_index, pos, stop_index, CAST(arr_s - CASE WHEN trip_index % 5 = 0 THEN 50 * pos ELSE 0 END AS INT) AS arr_s, CAST(dep_s - CASE WHEN trip_index % 5 = 0 THEN 50 * pos ELSE 0 END AS INT) AS dep_s FROM d_stop_times WHERE service_dow = 3"


@_query(rounds_sql(0, f"SELECT query_id, stop, min(arr) AS arr FROM ({_FOLD}) z GROUP BY 1, 2", _OVER))
def overtaking_ride(n):
    """W-08, R-04 .. R-06: one vehicle, changed along its line wherever another leaves earlier."""
    early = F.when(F.col("trip_index") % 5 == 0, F.col("pos") * 50).otherwise(0)
    st = _day(n).withColumn("arr_s", (F.col("arr_s") - early).cast("int")).withColumn("dep_s", (F.col("dep_s") - early).cast("int"))
    ready = routing.start(n["d_queries"], transfer_topk(n))
    return journeys.scan_arrivals(journeys.scan_lines(ready, st), st)


@_query(rounds_sql(2, "SELECT * FROM (" + _goal_sql(2) + ")"))
def journey_arrivals(n):
    """R-11, R-17: journeys with their legs agree with the labels; legs are checked to join end to end."""
    q = n["d_queries"]
    found = journeys.journeys(q, _day(n), transfer_topk(n), 2).join(q.select("query_id", "from_stop", "to_stop", "dep_s"), "query_id")
    before = F.get("legs", F.lit(0))
    ends = (F.size("legs") == 0) | ((before["from_stop"] == F.col("from_stop")) & (F.element_at("legs", -1)["to_stop"] == F.col("to_stop")) & (F.element_at("legs", -1)["arr_s"] == F.col("arr")))
    chain = F.forall(F.transform("legs", lambda x, i: F.coalesce((F.get("legs", i + 1)["from_stop"] == x["to_stop"]) & (F.get("legs", i + 1)["dep_s"] >= x["arr_s"]), F.lit(True)) & (x["arr_s"] >= x["dep_s"])), lambda x: x)
    rides = F.size(F.filter("legs", lambda x: x["kind"] == journeys.RIDE)) == F.col("vehicles")
    return found.where(ends & chain & rides).select("query_id", "arr", "vehicles")


@_query(f"""WITH x AS ({_NEXT}), c AS (SELECT coalesce(o.stop_index, x.stop_index) AS s, o.lat AS la, o.lon AS lo, x.lat AS lb, x.lon AS lp FROM d_stops o FULL JOIN x ON o.stop_index = x.stop_index
  WHERE o.stop_index IS NULL OR x.stop_index IS NULL OR o.lat <> x.lat OR o.lon <> x.lon),
p AS (SELECT la AS lat, lo AS lon FROM c WHERE la IS NOT NULL UNION SELECT lb, lp FROM c WHERE lb IS NOT NULL)
SELECT s AS stop_index FROM c UNION SELECT b.stop_index FROM p a JOIN x b ON 2 * 6371000.0::DOUBLE * atan2(sqrt({_HAV}), sqrt(1 - ({_HAV}))) <= 450""")
def affected_stops(n):
    """J-15: changed stops, and the stops within walking distance of where a changed one was or is."""
    return timetable.affected(n["d_stops"], _next_stops(n), 450.0)


@_query(f"SELECT source, legs, count(*) AS n, min(arr_s) AS first_arr_s FROM (SELECT DISTINCT p.*, trip_index FROM (SELECT stop_index AS source, CAST(trip_index % 3 AS INT) AS legs, dep_s AS ready_s, CAST(arr_s + (trip_index * 131) % 5000 AS INT) AS arr_s, trip_index FROM d_stop_times WHERE service_dow = 3 AND pos = 2) p WHERE trip_index NOT IN (SELECT trip_index FROM d_rt)) GROUP BY 1, 2")
def profile_invalidation(n):
    """U-07: points that use a changed trip go."""
    p = _day(n).where("pos = 2").select(F.col("stop_index").alias("source"), (F.col("trip_index") % 3).cast("int").alias("legs"), (F.col("arr_s") + F.col("trip_index") * 131 % 5000).cast("int").alias("arr_s"), F.array("trip_index").alias("trips"))
    p = p.withColumn("point_id", F.element_at("trips", 1))
    left = timetable.invalidate(p, n["d_rt"].select("trip_index"), "point_id", "trips")
    return left.groupBy("source", "legs").agg(F.count("*").alias("n"), F.min("arr_s").alias("first_arr_s"))


def queries() -> dict[str, Query]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
