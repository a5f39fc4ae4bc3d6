"""More queries over the derived network: modes, identifiers, realtime merges, geometry, routing on late vehicles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, transit
from ..operators import routing, timetable
from .registry import _HAV, _OVER, _TIMES, _day, _goal_sql, _query, rounds_sql, transfer_topk

#: Route types of the derived network, by route.
TYPES = ("Tram", "Streetcar line", "City Bus", "Coach", "Trolleybus", "Rail", "Subway", "Ferry")
_TYPE_SQL = "list_element([" + ", ".join(f"'{x}'" for x in TYPES) + "], CAST({} % 8 AS INT) + 1)"
_MODE_SQL = "CASE WHEN contains(lower({0}), 'tram') OR contains(lower({0}), 'streetcar') THEN 'tram' WHEN contains(lower({0}), 'bus') OR contains(lower({0}), 'coach') OR contains(lower({0}), 'trolley') THEN 'bus' ELSE 'other' END"


def _type(route):
    return F.get(F.array(*map(F.lit, TYPES)), F.pmod(F.col(route), F.lit(8)).cast("int"))


_FIRST_ROUTE = "SELECT line_index, arg_min(route_index, trip_index) AS route_index FROM d_trips GROUP BY 1"


def _line_modes(n) -> DataFrame:
    first = n["d_trips"].groupBy("line_index").agg(F.min(F.struct("trip_index", "route_index")).alias("m")).select("line_index", F.col("m.route_index").alias("route_index"))
    return first.select("line_index", transit.mode_of(_type("route_index")).alias("mode"))


@_query(f"SELECT line_index, {_MODE_SQL.format(_TYPE_SQL.format('route_index'))} AS mode FROM ({_FIRST_ROUTE})")
def line_modes(n):
    """P-08, P-09: the mode of a line is that of its first trip's route."""
    return _line_modes(n)


@_query(rounds_sql(2, _goal_sql(2), f"SELECT s.* FROM d_stop_times s JOIN ({_FIRST_ROUTE}) f USING (line_index) WHERE service_dow = 3 AND {_MODE_SQL.format(_TYPE_SQL.format('f.route_index'))} = 'bus'"))
def mode_filtered_route(n):
    """P-07 .. P-09: routing on the lines of the modes that a request names."""
    lines = _line_modes(n).where(transit.mode_allowed(F.col("mode"), transit.parse_modes("bus"))).select("line_index")
    q = n["d_queries"]
    return routing.arrivals(q, routing.rounds(q, _day(n).join(lines, "line_index", "left_semi"), transfer_topk(n), 2))


@_query("SELECT stop_index, (CAST(feed_index AS BIGINT) << 48) | (2::BIGINT << 40) | CAST(stop_index AS BIGINT) AS gid FROM d_stops")
def global_ids(n):
    """P-06."""
    return n["d_stops"].select("stop_index", transit.packed_id(F.col("feed_index"), F.lit(2), F.col("stop_index")).alias("gid"))


@_query("SELECT o_orderkey, CASE WHEN o_orderkey % 27 < 24 AND o_orderkey % 61 < 60 THEN CAST((o_orderkey % 27) * 3600 + (o_orderkey % 61) * 60 + CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 59 ELSE 0 END AS INT) END AS seconds FROM orders")
def clock_times(n):
    """F-11: texts of clock times, some of which are none."""
    two = lambda m: F.lpad((F.col("o_orderkey") % m).cast("string"), 2, "0")
    text = F.concat(two(27), F.lit(":"), two(61), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit(":"), two(59))).otherwise(""))
    return n["orders"].select("o_orderkey", transit.clock_seconds(text).alias("seconds"))


@_query("SELECT n_nationkey, coalesce(nullif(trim(CASE WHEN n_nationkey % 3 = 0 THEN ' ' WHEN n_nationkey % 3 = 1 THEN 'L' || n_nationkey END), ''), nullif(trim(CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE '' END), ''), 'r' || n_nationkey) AS label FROM nation")
def route_labels(n):
    """F-12."""
    k = F.col("n_nationkey")
    short = F.when(k % 3 == 0, " ").when(k % 3 == 1, F.concat(F.lit("L"), k.cast("string")))
    return n["nation"].select("n_nationkey", transit.route_label(short, F.when(k % 2 == 0, F.col("n_name")).otherwise(""), F.concat(F.lit("r"), k.cast("string"))).alias("label"))


@_query("""SELECT c_custkey, CASE WHEN s IS NOT NULL AND NOT (la IS NULL AND lo IS NULL) THEN 'stop and coordinate' WHEN s IS NOT NULL THEN 'stop' WHEN la IS NULL AND lo IS NULL THEN 'missing'
  WHEN la IS NULL OR lo IS NULL THEN 'half a coordinate' WHEN abs(la) > 90 OR abs(lo) > 180 THEN 'out of range' ELSE 'coordinate' END AS kind
FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_custkey END AS s, CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal / 100 END AS la, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal / 50 END AS lo FROM customer)""")
def endpoint_kinds(n):
    """P-16."""
    k, bal = F.col("c_custkey"), F.col("c_acctbal")
    return n["customer"].select("c_custkey", transit.endpoint_kind(F.when(k % 3 == 0, k), F.when(k % 5 != 0, bal / 100), F.when(k % 7 != 0, bal / 50)).alias("kind"))


_ASKED = "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'g' || (p_partkey % (SELECT n FROM d_n)) WHEN 1 THEN (p_partkey % 25) || ':' || (p_partkey % (SELECT n FROM d_n)) ELSE CAST(p_partkey % (SELECT n FROM d_n) AS VARCHAR) END AS asked FROM part"


@_query(f"SELECT p_partkey, coalesce(g.stop_index, s.stop_index, CASE WHEN (SELECT count(DISTINCT feed_index) FROM d_stops) = 1 THEN b.stop_index END) AS stop_index FROM ({_ASKED}) a LEFT JOIN d_stops g ON a.asked = 'g' || g.stop_index LEFT JOIN d_stops s ON a.asked = s.feed_index || ':' || s.stop_index LEFT JOIN d_stops b ON a.asked = CAST(b.stop_index AS VARCHAR)")
def stop_resolution(n):
    """P-17: by global id, then by feed and local id, then by local id alone where there is one feed only."""
    k, stops = F.col("p_partkey"), n["d_stops"]
    place = (k % F.col("n")).cast("string")
    asked = n["part"].crossJoin(n["d_n"]).select("p_partkey", F.when(k % 3 == 0, F.concat(F.lit("g"), place)).when(k % 3 == 1, F.concat((k % 25).cast("string"), F.lit(":"), place)).otherwise(place).alias("asked"))
    one = stops.agg((F.countDistinct("feed_index") == 1).alias("one_feed"))
    local = F.col("stop_index").cast("string")
    names = [F.struct(F.lit(k).alias("rank"), x.alias("name")) for k, x in ((1, F.concat(F.lit("g"), local)), (2, F.concat_ws(":", "feed_index", "stop_index")), (3, local))]
    known = stops.crossJoin(F.broadcast(one)).select("stop_index", "one_feed", F.explode(F.array(*names)).alias("x")).where("x.rank < 3 OR one_feed")
    found = asked.join(known.select("stop_index", F.col("x.rank").alias("rank"), F.col("x.name").alias("asked")), "asked", "left")
    return found.groupBy("p_partkey").agg(F.min(F.struct("rank", "stop_index")).alias("m")).select("p_partkey", F.col("m.stop_index").alias("stop_index"))


STRONG_SQL = f"""WITH l AS (SELECT stop_index, count(DISTINCT line_index) AS n_lines FROM d_line_stops GROUP BY 1), t AS (SELECT from_stop AS stop_index, count(*) AS n_walks FROM d_transfers GROUP BY 1),
r AS (SELECT DISTINCT s.stop_index FROM d_line_stops s JOIN d_lines USING (line_index) WHERE {_TYPE_SQL.format('route_index')} IN ('Rail', 'Subway'))
SELECT stop_index, coalesce(n_lines, 0) >= 3 OR coalesce(n_walks, 0) >= 4 OR r.stop_index IS NOT NULL AS strong FROM d_stops LEFT JOIN l USING (stop_index) LEFT JOIN t USING (stop_index) LEFT JOIN r USING (stop_index)"""


@_query(STRONG_SQL)
def strong_anchors(n):
    """P-20: stops with three lines, four walks or a rapid line."""
    served = n["d_line_stops"].join(n["d_lines"], "line_index")
    lines = served.groupBy("stop_index").agg(F.countDistinct("line_index").alias("n_lines"), F.max(transit.is_rapid(_type("route_index"))).alias("rapid"))
    walks = transfer_topk(n).groupBy(F.col("from_stop").alias("stop_index")).agg(F.count("*").alias("n_walks"))
    strong = (F.coalesce("n_lines", F.lit(0)) >= 3) | (F.coalesce("n_walks", F.lit(0)) >= 4) | F.coalesce("rapid", F.lit(False))
    return n["d_stops"].join(lines, "stop_index", "left").join(walks, "stop_index", "left").select("stop_index", strong.alias("strong"))


@_query("SELECT service_dow, count(*) AS n_trips, md5(string_agg(CAST(trip_index AS VARCHAR), ',' ORDER BY trip_index)) AS trips_md5 FROM d_trips GROUP BY 1")
def trips_of_services(n):
    """A-06."""
    trips = F.array_join(F.transform(F.array_sort(F.collect_list("trip_index")), lambda x: x.cast("string")), ",")
    return n["d_trips"].groupBy("service_dow").agg(F.count("*").alias("n_trips"), F.md5(trips.cast("binary")).alias("trips_md5"))


_CELLS = "SELECT stop_index, CAST(round((lat + 90.0) / 180.0 * 4294967295.0) AS BIGINT) >> 18 AS y, CAST(round((lon + 180.0) / 360.0 * 4294967295.0) AS BIGINT) >> 18 AS x FROM d_stops"


@_query(f"WITH c AS ({_CELLS}) SELECT a.stop_index, count(b.stop_index) AS n_near FROM c a JOIN c b ON abs(a.y - b.y) <= 2 AND abs(a.x - b.x) <= 2 GROUP BY 1")
def cell_neighbours(n):
    """F-07: stops in the cells around a stop's, two in each direction, clipped at the edges of the axes."""
    axis = lambda c, lo, hi: F.shiftright(geo.quantize(F.col(c), lo, hi), 18)
    at = n["d_stops"].select("stop_index", axis("lat", -90.0, 90.0).alias("y"), axis("lon", -180.0, 180.0).alias("x"))
    ring = lambda c: F.explode(F.sequence(F.greatest(F.col(c) - 2, F.lit(0)), F.least(F.col(c) + 2, F.lit((1 << 14) - 1))))
    around = at.select("stop_index", ring("y").alias("y"), "x").select("stop_index", "y", ring("x").alias("x"))
    return around.join(at.select("y", "x", F.col("stop_index").alias("near")), ["y", "x"]).groupBy("stop_index").agg(F.count("near").alias("n_near"))


_SNAP = f"SELECT query_id, b.stop_index, 2 * 6371000.0::DOUBLE * atan2(sqrt({_HAV}), sqrt(1 - ({_HAV}))) AS d FROM (SELECT query_id, lat + 0.0007 AS lat, lon + 0.0005 AS lon FROM d_queries JOIN d_stops ON stop_index = from_stop) a CROSS JOIN d_stops b"


@_query(f"SELECT query_id, stop_index, dur_s, asymptotic FROM (SELECT query_id, stop_index, CAST(ceil(round(d * (d / 200.0) + d, 3) / 1.35) AS INT) AS dur_s, d > 400 AS asymptotic, row_number() OVER (PARTITION BY query_id ORDER BY ceil(round(d * (d / 200.0) + d, 3) / 1.35), round(d, 3), stop_index) AS r FROM ({_SNAP}) WHERE d <= 700) WHERE r <= 4")
def connectors(n):
    """F-09, T-04: the four cheapest connectors of a place by (duration, distance, stop), long ones penalised."""
    place = n["d_queries"].join(n["d_stops"], F.col("stop_index") == F.col("from_stop")).select("query_id", (F.col("lat") + 0.0007).alias("la"), (F.col("lon") + 0.0005).alias("lo"))
    size_y, size_x = 0.0064, 0.009  # over 700 m each
    ring = F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))
    place = place.withColumn("dy", ring).withColumn("dx", ring).select("query_id", "la", "lo", (F.floor(F.col("la") / size_y) + F.col("dy")).alias("y"), (F.floor(F.col("lo") / size_x) + F.col("dx")).alias("x"))
    at = n["d_stops"].select("stop_index", "lat", "lon", F.floor(F.col("lat") / size_y).alias("y"), F.floor(F.col("lon") / size_x).alias("x"))
    near = place.join(at, ["y", "x"]).withColumn("d", geo.haversine(F.col("la"), F.col("lo"), F.col("lat"), F.col("lon"))).where("d <= 700")
    near = near.withColumn("dur_s", geo.walk_seconds(F.round(transit.snap_cost(F.col("d"), 200.0), 3)))
    best = Window.partitionBy("query_id").orderBy("dur_s", F.round("d", 3), "stop_index")
    return near.withColumn("r", F.row_number().over(best)).where("r <= 4").select("query_id", "stop_index", "dur_s", (F.col("d") > 400).alias("asymptotic"))


_PATH = "SELECT l.line_index, pos, lat + CASE WHEN pos % 2 = 1 THEN 0.0004 ELSE 0 END AS lat, lon FROM d_line_stops l JOIN d_stops USING (stop_index)"


def _path(n) -> DataFrame:
    return n["d_line_stops"].join(n["d_stops"], "stop_index").select("line_index", "pos", (F.col("lat") + F.when(F.col("pos") % 2 == 1, 0.0004).otherwise(0.0)).alias("lat"), "lon")


@_query(f"""WITH p AS ({_PATH}), t AS (SELECT line_index, pos, lat, lon, lag(lat) OVER w AS fa, lag(lon) OVER w AS fo, lead(lat) OVER w AS ta, lead(lon) OVER w AS too FROM p WINDOW w AS (PARTITION BY line_index ORDER BY pos)),
v AS (SELECT line_index, pos, (lon - fo) * cos(radians(lat)) AS ax, lat - fa AS ay, (too - lon) * cos(radians(lat)) AS bx, ta - lat AS byy FROM t WHERE fa IS NOT NULL AND ta IS NOT NULL)
SELECT line_index, pos, CASE WHEN (ax = 0 AND ay = 0) OR (bx = 0 AND byy = 0) OR degrees(atan2(abs(ax * byy - ay * bx), ax * bx + ay * byy)) < 20 THEN 'continue' WHEN ax * byy - ay * bx > 0 THEN 'turn-left' ELSE 'turn-right' END AS turn FROM v""")
def line_turns(n):
    """F-13: the turns along each line."""
    w = Window.partitionBy("line_index").orderBy("pos")
    p = _path(n)
    for c in ("lat", "lon"):
        p = p.withColumn(f"from_{c}", F.lag(c).over(w)).withColumn(f"to_{c}", F.lead(c).over(w))
    p = p.where("from_lat IS NOT NULL AND to_lat IS NOT NULL")
    return p.select("line_index", "pos", transit.turn(*map(F.col, ("from_lat", "from_lon", "lat", "lon", "to_lat", "to_lon"))).alias("turn"))


@_query(f"""WITH p AS ({_PATH}), s AS (SELECT b.line_index, b.pos, round(2 * 6371000.0::DOUBLE * atan2(sqrt({_HAV}), sqrt(1 - ({_HAV}))), 3) AS d FROM p a JOIN p b ON a.line_index = b.line_index AND a.pos + 1 = b.pos)
SELECT line_index, pos, round(sum(d) OVER (PARTITION BY line_index ORDER BY pos), 2) AS metres FROM s""")
def line_lengths(n):
    """A-16: metres along each line."""
    w = Window.partitionBy("line_index").orderBy("pos")
    p = _path(n).withColumn("la", F.lag("lat").over(w)).withColumn("lo", F.lag("lon").over(w)).where("la IS NOT NULL")
    p = p.withColumn("d", F.round(geo.haversine(F.col("la"), F.col("lo"), F.col("lat"), F.col("lon")), 3))
    return p.select("line_index", "pos", F.round(F.sum("d").over(w), 2).alias("metres"))


_LINE_LATE = "SELECT line_index, max(late) AS late FROM (SELECT trip_index, max(least(greatest(delay_s, 0), 21600)) AS late FROM d_rt GROUP BY 1) r JOIN d_trips USING (trip_index) GROUP BY 1"


@_query(f"""WITH late AS ({_LINE_LATE}), last AS (SELECT line_index, pos, CAST(floor(max(dep_s) / 900) AS INT) AS last_bucket FROM d_stop_times WHERE service_dow = 3 GROUP BY 1, 2)
SELECT query_id, l.line_index, l.pos, least(CAST(floor(greatest(dep_s - coalesce(late, 0), 0) / 900) AS INT), last_bucket) AS bucket FROM d_queries q JOIN d_line_stops s ON s.stop_index = q.from_stop JOIN last l ON l.line_index = s.line_index AND l.pos = s.pos LEFT JOIN late ON late.line_index = l.line_index""")
def lookup_buckets(n):
    """W-06: where the search for departures begins, earlier by a line's greatest delay."""
    trip = n["d_rt"].groupBy("trip_index").agg(F.max(F.least(F.greatest("delay_s", F.lit(0)), F.lit(21600))).alias("late"))
    late = trip.join(n["d_trips"], "trip_index").groupBy("line_index").agg(F.max("late").alias("late"))
    last = _day(n).groupBy("line_index", "pos").agg(F.floor(F.max("dep_s") / 900).cast("int").alias("last_bucket"))
    at = n["d_line_stops"].join(last, ["line_index", "pos"]).join(late, "line_index", "left").withColumnRenamed("stop_index", "from_stop")
    found = n["d_queries"].join(at, "from_stop")
    return found.select("query_id", "line_index", "pos", transit.lookup_bucket(F.col("dep_s"), F.coalesce("late", F.lit(0)), F.col("last_bucket")).alias("bucket"))


_UPDATES = "SELECT event_id, (event_id * 31) % (SELECT count(*) FROM orders) AS trip_index, CASE WHEN event_id % 4 <> 0 THEN CAST(user_id % 10 AS INT) END AS seq, CASE WHEN event_id % 3 <> 0 THEN CAST(user_id % (SELECT n FROM d_n) AS INT) END AS stop FROM events"


@_query(f"""WITH u AS ({_UPDATES}) SELECT event_id, coalesce(min(a.pos), min(b.pos)) AS pos FROM u LEFT JOIN d_stop_times a ON a.trip_index = u.trip_index AND a.pos = u.seq
LEFT JOIN d_stop_times b ON b.trip_index = u.trip_index AND b.stop_index = u.stop GROUP BY 1""")
def update_positions(n):
    """J-13: the position an update means: its sequence number if the trip has it, else the first call at its stop."""
    total = n["orders"].agg(F.count("*").alias("total"))
    e = n["events"].crossJoin(total).crossJoin(n["d_n"])
    k, user = F.col("event_id"), F.col("user_id")
    u = e.select(k, (k * 31 % F.col("total")).alias("trip_index"), F.when(k % 4 != 0, (user % 10).cast("int")).alias("seq"), F.when(k % 3 != 0, (user % F.col("n")).cast("int")).alias("stop"))
    calls = u.join(n["d_stop_times"].select("trip_index", "pos", "stop_index"), "trip_index", "left").where("pos IS NULL OR pos = seq OR stop_index = stop OR pos = 0")
    by_seq, by_stop = F.min(F.when(F.col("pos") == F.col("seq"), F.col("pos"))), F.min(F.when(F.col("stop_index") == F.col("stop"), F.col("pos")))
    return calls.groupBy("event_id").agg(F.coalesce(by_seq, by_stop).alias("pos"))


_CODES = "CASE event_type WHEN 'error' THEN 3 WHEN 'view' THEN 0 WHEN 'click' THEN 1 ELSE 2 END"


@_query(f"""WITH r AS (SELECT user_id, {_CODES} AS code, ts, event_id, value FROM events)
SELECT user_id, list_element(['SCHEDULED', 'ADDED', 'UNSCHEDULED', 'CANCELED'], arg_max(code, CASE code WHEN 3 THEN 20 WHEN 0 THEN 0 ELSE 10 + code END) + 1) AS relationship,
  arg_max(event_id, ts) AS vehicle, CAST(sum(CASE WHEN value >= 0 THEN CAST(floor(value) AS BIGINT) ELSE 0 END) // nullif(count(*) FILTER (value >= 0), 0) AS BIGINT) AS mean_load FROM r GROUP BY 1""")
def vehicle_merge(n):
    """F-17 .. F-19, A-11: a vehicle's last event, its merged schedule relationship, its mean load."""
    code = F.when(F.col("event_type") == "error", 3).when(F.col("event_type") == "view", 0).when(F.col("event_type") == "click", 1).otherwise(2)
    rank = F.struct(transit.relationship_rank(code), code.alias("code"))
    load = F.when(F.col("value") >= 0, F.floor("value").cast("long"))
    out = n["events"].groupBy("user_id").agg(F.max(rank).alias("r"), F.max(F.struct("ts", "event_id")).alias("v"), F.sum(load).alias("s"), F.count(load).alias("c"))
    return out.select("user_id", transit.code_name(F.col("r.code"), transit.RELATIONSHIPS).alias("relationship"), F.col("v.event_id").alias("vehicle"), F.expr("s div nullif(c, 0)").alias("mean_load"))


_POINTS3 = "SELECT stop_index AS source, CAST(trip_index % 3 AS INT) AS legs, dep_s AS ready_s, CAST(arr_s + (trip_index * 131) % 5000 AS INT) AS arr_s, trip_index FROM d_stop_times WHERE service_dow = 3"


@_query(f"SELECT source, min(arr_s - ready_s) AS duration_s, min(greatest(legs - 1, 0)) AS transfers, count(*) AS n_points FROM ({_POINTS3}) GROUP BY 1")
def profile_summary(n):
    """A-13, A-14: the shortest duration and fewest transfers of a source's points, and how many it has."""
    legs = (F.col("trip_index") % 3).cast("int")
    arr = (F.col("arr_s") + F.col("trip_index") * 131 % 5000).cast("int")
    return _day(n).groupBy(F.col("stop_index").alias("source")).agg(F.min(arr - F.col("dep_s")).alias("duration_s"), F.min(F.greatest(legs - 1, F.lit(0))).alias("transfers"), F.count("*").alias("n_points"))


@_query(f"""SELECT source, dep_5 AS ready_s, best // 1000000000000 AS n_suffix, best % 1000000000000 AS trip_index FROM (SELECT source, CAST(ready_s - ready_s % 300 AS INT) AS dep_5, min(CAST(legs AS BIGINT) * 1000000000000 + trip_index) AS best FROM ({_POINTS3}) GROUP BY 1, 2)""")
def profile_merge(n):
    """U-06: of points with one key the one with the shortest suffix stays."""
    best = F.min(F.struct((F.col("trip_index") % 3).alias("n_suffix"), "trip_index")).alias("m")
    out = _day(n).groupBy(F.col("stop_index").alias("source"), (F.col("dep_s") - F.col("dep_s") % 300).cast("int").alias("ready_s")).agg(best)
    return out.select("source", "ready_s", "m.n_suffix", "m.trip_index")


@_query(f"SELECT source, legs, ready_s, trip_index FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY arr_s, legs, trip_index) AS r FROM ({_POINTS3}) WHERE ready_s >= 28800) WHERE r <= 6")
def spatial_surface(n):
    """T-06: per source the six points that arrive first at the boundary, ties to fewer legs."""
    arr = (F.col("arr_s") + F.col("trip_index") * 131 % 5000).cast("int")
    p = _day(n).where("dep_s >= 28800").select(F.col("stop_index").alias("source"), (F.col("trip_index") % 3).cast("int").alias("legs"), F.col("dep_s").alias("ready_s"), "trip_index", arr.alias("at"))
    w = Window.partitionBy("source").orderBy("at", "legs", "trip_index")
    return p.withColumn("r", F.row_number().over(w)).where("r <= 6").select("source", "legs", "ready_s", "trip_index")


@_query(rounds_sql(2, "SELECT * FROM (" + _goal_sql(2) + ")", _OVER, fold=True))
def route_overtaking_k2(n):
    """R-01, R-04 .. R-06: rounds over lines whose trips overtake each other."""
    early = F.when(F.col("trip_index") % 5 == 0, F.col("pos") * 50).otherwise(0)
    st = _day(n).withColumn("arr_s", (F.col("arr_s") - early).cast("int")).withColumn("dep_s", (F.col("dep_s") - early).cast("int"))
    q = n["d_queries"]
    return routing.arrivals(q, routing.rounds(q, st, transfer_topk(n), 2, overtaking=True))


@_query(rounds_sql(2, "SELECT * FROM (" + _goal_sql(2) + ")", f"SELECT trip_index, line_index, pos, stop_index, arr_s, dep_s FROM ({_TIMES}) a WHERE service_dow = 3 AND skipped = 0", fold=True))
def route_realtime_k2(n):
    """ST-03, W-07, R-01: rounds over what vehicles really do: late, cancelled, skipping stops."""
    st = timetable.actual_times(n["d_stop_times"], n["d_rt"]).where((F.col("service_dow") == 3) & (F.col("skipped") == 0)).select("trip_index", "line_index", "pos", "stop_index", "arr_s", "dep_s")
    q = n["d_queries"]
    return routing.arrivals(q, routing.rounds(q, st, transfer_topk(n), 2, overtaking=True))
