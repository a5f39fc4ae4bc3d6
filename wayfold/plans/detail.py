"""Queries on legs, street changes, overlay cells, virtual places and merged realtime state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cells, geo, osm, paths, transit
from ..operators import journeys, legs, streets, timetable
from ..sources import gtfs
from .features import _PATH, STRONG_SQL, _path, strong_anchors
from .registry import _CELL, _EDGES, _HAV, _INTER, _NEXT, _TIMES, _edges, _near, _next_stops, _query, transfer_topk

_D = f"2 * 6371000.0::DOUBLE * atan2(sqrt({_HAV}), sqrt(1 - ({_HAV})))"
_ON = "PARTITION BY query_id ORDER BY leg_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING"
_CELL28 = f"(SELECT stop_index AS to_stop, CAST({_INTER} AS BIGINT) AS cell FROM {_CELL})"


# --- legs --------------------------------------------------------------------------------------------------------


@_query(f"""WITH r AS (SELECT *, sum(CASE WHEN kind = {journeys.WALK} AND before = {journeys.WALK} THEN 0 ELSE 1 END) OVER (PARTITION BY query_id ORDER BY leg_no) AS run
  FROM (SELECT *, lag(kind) OVER (PARTITION BY query_id ORDER BY leg_no) AS before FROM d_legs))
SELECT query_id, CAST(run AS BIGINT) AS leg_no, arg_min(kind, leg_no) AS kind, arg_min(from_stop, leg_no) AS from_stop, arg_max(to_stop, leg_no) AS to_stop, arg_min(trip_index, leg_no) AS trip_index,
  arg_min(dep_s, leg_no) AS dep_s, arg_max(arr_s, leg_no) AS arr_s, CAST(sum(arr_s - dep_s) AS BIGINT) AS moving_s FROM r GROUP BY query_id, run""")
def walk_runs(n):
    """W-12: neighbouring walks of a journey as one."""
    return journeys.merge_walks(n["d_legs"])


@_query(f"""SELECT query_id, leg_no, from_stop AS source, dep_s AS ready_s, last_value(arr_s) OVER ({_ON}) AS arr_s, CAST(sum(CASE WHEN kind = {journeys.RIDE} THEN 1 ELSE 0 END) OVER ({_ON}) AS INT) AS legs,
  string_agg(CAST(trip_index AS VARCHAR), ',') OVER ({_ON}) AS suffix FROM d_legs""")
def profile_insertion(n):
    """C-01: every leg of a journey becomes a point of its profile."""
    return legs.profile_points(n["d_legs"]).withColumn("suffix", F.array_join(F.transform("suffix", lambda x: x.cast("string")), ","))


_SPATIAL = f"""WITH c AS (SELECT l.*, cell FROM d_legs l JOIN {_CELL28} USING (to_stop)),
g AS (SELECT *, last_value(cell) OVER ({_ON}) AS goal FROM c), e AS (SELECT *, min(CASE WHEN cell = goal THEN leg_no END) OVER ({_ON}) AS cut FROM g)
SELECT e.query_id, e.leg_no, e.from_stop AS source, e.dep_s AS ready_s, b.to_stop AS boundary, b.arr_s AS arr_s FROM e JOIN e b ON b.query_id = e.query_id AND b.leg_no = e.cut"""


def _spatial(n) -> DataFrame:
    at = n["d_stops"].select(F.col("stop_index").alias("to_stop"), geo.cell(F.col("lat"), F.col("lon")).alias("to_cell"))
    return legs.spatial_points(n["d_legs"].join(at, "to_stop"), F.col("to_cell"))


@_query(_SPATIAL)
def spatial_insertion(n):
    """C-02, Y-31: a suffix is cut at the first stop inside the destination's cell."""
    return _spatial(n)


@_query(f"""SELECT p.query_id, p.leg_no, s.stop_index AS source, s.dep_s AS ready_s, p.boundary, p.arr_s FROM ({_SPATIAL}) p JOIN d_legs l ON l.query_id = p.query_id AND l.leg_no = p.leg_no AND l.kind = {journeys.RIDE}
JOIN d_stop_times s ON s.trip_index = l.trip_index AND s.pos > l.board_pos AND s.pos < l.alight_pos JOIN ({STRONG_SQL}) a ON a.stop_index = s.stop_index AND a.strong""")
def anchor_expansion(n):
    """C-03: strong stops inside a ride become sources too."""
    return legs.anchor_points(_spatial(n), n["d_legs"], n["d_stop_times"], strong_anchors(n))


@_query("SELECT query_id, leg_no, from_stop, to_stop FROM (SELECT query_id, leg_no, CASE WHEN leg_no = 1 THEN -1 - from_stop ELSE from_stop END AS from_stop, to_stop FROM d_legs) WHERE from_stop >= 0")
def cacheable_legs(n):
    """P-21: legs from a virtual place (the first ones here) aren't kept."""
    own = n["d_legs"].select("query_id", "leg_no", F.when(F.col("leg_no") == 1, -1 - F.col("from_stop")).otherwise(F.col("from_stop")).alias("from_stop"), "to_stop")
    return legs.cacheable(own, n["d_stops"])


@_query("""SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY seen) - 1 AS INT) AS entry, stop_index FROM (SELECT query_id, stop_index, min(seen) AS seen FROM
(SELECT query_id, from_stop AS stop_index, leg_no * 2 AS seen FROM d_legs UNION ALL SELECT query_id, to_stop, leg_no * 2 + 1 FROM d_legs) GROUP BY 1, 2)""")
def entity_dictionary(n):
    """A-17: the stops of a journey once, numbered as first seen."""
    return legs.dictionary(n["d_legs"])


@_query(f"""WITH a AS ({_TIMES}) SELECT l.query_id, l.leg_no, l.trip_index, 'L' || t.line_index AS label, f.stop_name AS from_name, g.stop_name AS to_name, coalesce(x.dep_s, b.dep_s) AS dep_s, coalesce(y.arr_s, e.arr_s) AS arr_s,
  coalesce(x.dep_s, b.dep_s) - b.dep_s AS delay_s, coalesce((SELECT string_agg(CAST(m.stop_index AS VARCHAR), ',' ORDER BY m.pos) FROM d_stop_times m WHERE m.trip_index = l.trip_index AND m.pos > l.board_pos AND m.pos < l.alight_pos), '') AS between
FROM d_legs l JOIN d_trips t USING (trip_index) JOIN d_stops f ON f.stop_index = l.from_stop JOIN d_stops g ON g.stop_index = l.to_stop JOIN d_stop_times b ON b.trip_index = l.trip_index AND b.pos = l.board_pos
JOIN d_stop_times e ON e.trip_index = l.trip_index AND e.pos = l.alight_pos LEFT JOIN a x ON x.trip_index = l.trip_index AND x.pos = l.board_pos LEFT JOIN a y ON y.trip_index = l.trip_index AND y.pos = l.alight_pos WHERE l.kind = {journeys.RIDE}""")
def leg_hydration(n):
    """R-17, Y-07: rides with names, labels, actual times, delays and the stops between."""
    labels = n["d_trips"].select("trip_index", F.concat(F.lit("L"), F.col("line_index").cast("string")).alias("label"))
    out = legs.hydrate(n["d_legs"], n["d_stop_times"], timetable.actual_times(n["d_stop_times"], n["d_rt"]), n["d_stops"], labels)
    delay = F.coalesce("delay_s", F.lit(0)).alias("delay_s")
    return out.select("query_id", "leg_no", "trip_index", "label", "from_name", "to_name", "dep_s", "arr_s", delay, F.array_join(F.transform("between", lambda x: x.cast("string")), ",").alias("between"))


@_query(f"SELECT query_id, leg_no, 2 AS n_points, round({_D}, 2) AS metres FROM d_legs JOIN d_stops a ON a.stop_index = from_stop JOIN d_stops b ON b.stop_index = to_stop WHERE kind = {journeys.WALK}")
def leg_lines(n):
    """R-18, Y-03, Y-04: a leg without a stored shape is a straight line."""
    end = lambda c, a, b: n["d_stops"].select(F.col("stop_index").alias(c), F.col("lat").alias(a), F.col("lon").alias(b))
    walks = n["d_legs"].where(F.col("kind") == journeys.WALK).join(end("from_stop", "la", "lo"), "from_stop").join(end("to_stop", "lb", "lp"), "to_stop")
    line = walks.select("query_id", "leg_no", paths.straight_line(*map(F.col, ("la", "lo", "lb", "lp"))).alias("line"))
    return line.select("query_id", "leg_no", F.size("line").alias("n_points"), F.round(F.try_element_at(paths.metres_along(F.col("line")), F.lit(-1)), 2).alias("metres"))


@_query(f"""SELECT line_index, string_agg(pos || ':' || coalesce(CAST(way AS VARCHAR), '-'), ',' ORDER BY pos) AS walk FROM (SELECT line_index, pos, CASE pos WHEN 0 THEN 100 WHEN 5 THEN 105 WHEN 6 THEN 106 END AS way FROM ({_PATH}) WHERE pos IN (0, 1, 3, 5, 6, 7)) GROUP BY 1""")
def walk_stitching(n):
    """R-19, Y-14: three walks along each line (positions 0 to 2, 2 to 4, 4 to 7) as one; each position's way after it."""
    points = F.array_sort(F.collect_list(F.struct("pos", F.col("pos").cast("double").alias("lat"), F.lit(0.0).alias("lon"))))
    line = _path(n).groupBy("line_index").agg(F.transform(points, lambda p: F.struct(p["lat"], p["lon"])).cast(paths.POINTS).alias("p"))
    ways = lambda a, b: F.transform(F.sequence(F.lit(100 + a), F.lit(100 + b - 1)), lambda w: w.cast("bigint"))
    piece = lambda a, b: F.struct(F.slice("p", a + 1, b - a + 1).alias("points"), ways(a, b).alias("ways")).cast(paths.GEOMETRY)
    out = line.select("line_index", paths.stitch(F.array(piece(0, 2), piece(2, 4), piece(4, 7))).alias("g"))
    text = F.transform("g.points", lambda p, i: F.concat_ws(":", p["lat"].cast("int").cast("string"), F.coalesce(F.get("g.ways", i).cast("string"), F.lit("-"))))
    return out.select("line_index", F.array_join(text, ",").alias("walk"))


# --- cells -------------------------------------------------------------------------------------------------------

_INTER22 = " + ".join(f"(((y >> {i}) & 1) << {2 * i + 1}) + (((x >> {i}) & 1) << {2 * i})" for i in range(22))
_AXES22 = "CAST(round((lat + 90.0) / 180.0 * 4294967295.0) AS BIGINT) >> 10 AS y, CAST(round((lon + 180.0) / 360.0 * 4294967295.0) AS BIGINT) >> 10 AS x"


@_query(f"""WITH c AS (SELECT stop_index, {_AXES22} FROM d_stops) SELECT stop_index, CAST({_INTER22} AS BIGINT) AS cell, round(-90 + ((y << 10) + 512) / 4294967295.0 * 180, 9) AS lat, round(-180 + ((x << 10) + 512) / 4294967295.0 * 360, 9) AS lon, 9 AS n_around FROM c""")
def overlay_cells(n):
    """F-03 .. F-05, F-08: the overlay cell of a stop, its centre, the cells around it."""
    c = n["d_stops"].select("stop_index", cells.overlay_cell(F.col("lat"), F.col("lon")).alias("cell"))
    lat, lon = cells.center(F.col("cell"))
    return c.select("stop_index", "cell", F.round(lat, 9).alias("lat"), F.round(lon, 9).alias("lon"), F.size(F.array_distinct(cells.neighbours(F.col("cell")))).alias("n_around"))


@_query(f"""WITH p AS ({_PATH}), s AS (SELECT a.line_index, a.pos, a.lat AS la, a.lon AS lo, b.lat AS lb, b.lon AS lp, greatest(CAST(ceil({_D} / 12) AS INT), 1) AS steps FROM p a JOIN p b ON a.line_index = b.line_index AND b.pos = a.pos + 1),
e AS (SELECT *, unnest(range(0, steps + 1)) AS k FROM s), q AS (SELECT line_index, pos, k, la + (lb - la) * (k / steps) AS lat, lo + (lp - lo) * (k / steps) AS lon FROM e),
c AS (SELECT line_index, pos, k, CAST({_INTER22} AS BIGINT) AS cell FROM (SELECT line_index, pos, k, {_AXES22} FROM q)), d AS (SELECT *, lag(cell) OVER (PARTITION BY line_index ORDER BY pos, k) AS before FROM c)
SELECT line_index, count(*) AS n_cells, md5(string_agg(CAST(cell AS VARCHAR), ',' ORDER BY pos, k)) AS cells_md5 FROM d WHERE before IS NULL OR cell <> before GROUP BY 1""")
def line_raster(n):
    """F-15, Y-23, Y-24: the cells along each line."""
    points = F.array_sort(F.collect_list(F.struct("pos", "lat", "lon")))
    line = _path(n).groupBy("line_index").agg(F.transform(points, lambda p: F.struct(p["lat"], p["lon"])).alias("p"))
    c = line.select("line_index", cells.rasterize(F.col("p")).alias("c"))
    return c.select("line_index", F.size("c").cast("long").alias("n_cells"), F.md5(F.array_join(F.transform("c", lambda x: x.cast("string")), ",").cast("binary")).alias("cells_md5"))


# --- streets -----------------------------------------------------------------------------------------------------


@_query(f"""WITH p AS (SELECT l.pos, p.lat, p.lon, l.line_index, l.stop_index FROM d_line_stops l JOIN ({_PATH}) p ON p.line_index = l.line_index AND p.pos = l.pos),
s AS (SELECT a.stop_index AS src, b.stop_index AS dst, a.line_index AS way_id, round({_D}, 3) AS metres, {_D} AS d FROM p a JOIN p b ON a.line_index = b.line_index AND b.pos = a.pos + 1),
o AS (SELECT src, dst, way_id, metres, least(greatest(CAST(ceil(d / 1.35) AS INT), 1), 65535) AS dur_s FROM s WHERE d > 0) SELECT * FROM o UNION ALL SELECT dst, src, way_id, metres, dur_s FROM o""")
def way_edges(n):
    """G-03, G-07, Y-33: the edges of ways, both ways."""
    node = n["d_line_stops"].select("line_index", "pos", F.col("stop_index").alias("node"))
    points = _path(n).join(node, ["line_index", "pos"]).withColumnRenamed("line_index", "way_id")
    return streets.way_edges(points, F.lit(geo.WALK_MPS)).withColumn("metres", F.round("metres", 3))


@_query(f"""WITH e AS ({_EDGES}), l AS (SELECT way_id, arg_max(action, sequence) AS action FROM d_changes GROUP BY 1)
SELECT src, dst, dur_s FROM e WHERE src NOT IN (SELECT way_id FROM l) UNION ALL SELECT src, dst, dur_s + 7 FROM e WHERE src IN (SELECT way_id FROM l WHERE action <> 'delete')""")
def street_overlay(n):
    """U-08, J-17, G-10: touched ways are blocked; the ones that still exist bring new edges. A street's way is its source."""
    e = _edges(n).withColumn("way_id", F.col("src"))
    return streets.overlay(e, n["d_changes"], e.withColumn("dur_s", F.col("dur_s") + 7)).select("src", "dst", "dur_s")


@_query("SELECT stop_index AS way_id FROM d_stops WHERE stop_index % 3 = 1 AND stop_index % 2 = 1")
def needed_overrides(n):
    """U-10: overrides equal to the base are dropped; here even ways are, and a third of all ways have one."""
    way = F.col("stop_index")
    base = n["d_stops"].select(way.alias("way_id"), F.array(way, way + 1).alias("cells"))
    made = n["d_stops"].where("stop_index % 3 = 1").select(way.alias("way_id"), F.array(way, way + 1 + way % 2).alias("cells"))
    return streets.needed_overrides(base, made).select("way_id")


@_query(f"""WITH RECURSIVE e AS ({_EDGES}), r AS (SELECT stop_index AS root, stop_index AS node, 0 AS dist FROM d_stops UNION SELECT root, dst, dist + dur_s FROM r JOIN e ON src = node WHERE dist + dur_s <= 200),
b AS (SELECT root, node, CAST(min(dist) AS INT) AS dist FROM r WHERE node <> root GROUP BY 1, 2) SELECT root, node, dist FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY dist, node) AS k FROM b) WHERE k <= 12""", recursive=True)
def street_transfers(n):
    """G-01, G-02, T-02: from every stop along streets, at most 200 s, the twelve nearest."""
    found = streets.bounded_paths(_edges(n), n["d_stops"].select(F.col("stop_index").alias("root")), 200).where("root <> node")
    w = Window.partitionBy("root").orderBy("dist", "node")
    return found.withColumn("k", F.row_number().over(w)).where("k <= 12").drop("k")


@_query(f"""WITH RECURSIVE e AS ({_EDGES}), r AS (SELECT DISTINCT from_stop AS root, from_stop AS node, 0 AS dist FROM d_queries UNION SELECT root, dst, dist + dur_s FROM r JOIN e ON src = node WHERE dist + dur_s <= 300),
b AS (SELECT root, node, CAST(min(dist) AS INT) AS dist FROM r GROUP BY 1, 2) SELECT query_id, dist AS dur_s FROM d_queries JOIN b ON root = from_stop AND node = to_stop""", recursive=True)
def street_routes(n):
    """G-08, V-05: the fastest street route of each request, within 300 s; requests from one stop share its search."""
    q = n["d_queries"]
    found = streets.bounded_paths(_edges(n), q.select(F.col("from_stop").alias("root")).distinct(), 300)
    return q.join(found, (F.col("root") == F.col("from_stop")) & (F.col("node") == F.col("to_stop"))).select("query_id", F.col("dist").alias("dur_s"))


@_query(f"""WITH x AS ({_NEXT}), p AS (SELECT a.stop_index AS from_stop, b.stop_index AS to_stop, {_D} AS d FROM x a JOIN x b ON a.stop_index <> b.stop_index)
SELECT from_stop, to_stop, dur_s FROM (SELECT from_stop, to_stop, CAST(ceil(d / 1.35) AS INT) AS dur_s, row_number() OVER (PARTITION BY from_stop ORDER BY ceil(d / 1.35), to_stop) AS r FROM p WHERE d <= 450) WHERE r <= 12""")
def transfer_rebuild(n):
    """U-05: only the walks of affected stops are built again; the SQL builds all."""
    after = _next_stops(n)
    hit = timetable.affected(n["d_stops"], after, 450.0).withColumnRenamed("stop_index", "from_stop")
    w = Window.partitionBy("from_stop").orderBy("dur_s", "to_stop")
    again = _near({"d_stops": after}).join(hit, "from_stop", "left_semi").select("from_stop", "to_stop", geo.walk_seconds(F.col("d")).alias("dur_s"))
    again = again.withColumn("r", F.row_number().over(w)).where("r <= 12").drop("r")
    return transfer_topk(n).select("from_stop", "to_stop", "dur_s").join(hit, "from_stop", "left_anti").unionByName(again)


_HUB = "SELECT stop_index, feed_index || '/' || CAST(floor(lat * 111320 / 150) AS INT) || '/' || CAST(floor(lon * 111320 * greatest(0.25, abs(cos(radians(lat)))) / 150) AS INT) AS hub FROM d_stops"


@_query(f"WITH h AS ({_HUB}) SELECT a.hub AS from_hub, b.hub AS to_hub, from_stop, to_stop, min(dur_s) AS dur_s FROM d_transfers JOIN h a ON a.stop_index = from_stop JOIN h b ON b.stop_index = to_stop GROUP BY 1, 2, 3, 4")
def transfer_tiles(n):
    """A-09: the shortest walk of each pair of stops, by pair of hubs."""
    y, x = F.floor(F.col("lat") * 111320 / 150), F.floor(F.col("lon") * 111320 * F.greatest(F.lit(0.25), F.abs(F.cos(F.radians("lat")))) / 150)
    hub = n["d_stops"].select("stop_index", F.concat_ws("/", "feed_index", y.cast("int"), x.cast("int")).alias("hub"))
    side = lambda name: hub.select(F.col("stop_index").alias(f"{name}_stop"), F.col("hub").alias(f"{name}_hub"))
    t = transfer_topk(n).join(side("from"), "from_stop").join(side("to"), "to_stop")
    return t.groupBy("from_hub", "to_hub", "from_stop", "to_stop").agg(F.min("dur_s").alias("dur_s"))


# --- places ------------------------------------------------------------------------------------------------------


@_query("SELECT query_id, printf('virtual:%.6f,%.6f', lat, lon) AS id, printf('%s %.5f, %.5f', CASE WHEN query_id % 2 = 0 THEN 'Origine GPS' ELSE 'Destinazione GPS' END, lat, lon) AS name FROM d_places")
def virtual_stops(n):
    """Y-05: the stop that stands for a place."""
    role = F.when(F.col("query_id") % 2 == 0, "Origine GPS").otherwise("Destinazione GPS")
    return n["d_places"].select("query_id", transit.virtual_id(F.col("lat"), F.col("lon")).alias("id"), transit.virtual_name(role, F.col("lat"), F.col("lon")).alias("name"))


def _around(n, metres: float) -> DataFrame:
    """Places with the stops within ``metres`` (under 700), met on a grid."""
    size_y, size_x, ring = 0.0064, 0.009, F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))
    p = n["d_places"].withColumn("dy", ring).withColumn("dx", ring).select("query_id", F.col("lat").alias("la"), F.col("lon").alias("lo"), (F.floor(F.col("lat") / size_y) + F.col("dy")).alias("y"), (F.floor(F.col("lon") / size_x) + F.col("dx")).alias("x"))
    at = n["d_stops"].select("stop_index", "lat", "lon", F.floor(F.col("lat") / size_y).alias("y"), F.floor(F.col("lon") / size_x).alias("x"))
    d = geo.haversine(F.col("la"), F.col("lo"), F.col("lat"), F.col("lon"))
    return p.join(at, ["y", "x"]).select("query_id", "stop_index", d.alias("d")).where(F.col("d") <= metres)


_AROUND = f"SELECT query_id, b.stop_index, {_D} AS d FROM d_places a CROSS JOIN d_stops b"


@_query(f"SELECT query_id, stop_index, greatest(1, CAST(ceil(d / 1.35) AS INT)) AS dur_s FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 6), stop_index) AS r FROM ({_AROUND}) WHERE d <= 600) WHERE r <= 5")
def virtual_walks(n):
    """R-16, Y-06, F-02: from a place to its five nearest stops, a second at least."""
    w = Window.partitionBy("query_id").orderBy(F.round("d", 6), "stop_index")
    return _around(n, 600.0).withColumn("r", F.row_number().over(w)).where("r <= 5").select("query_id", "stop_index", F.greatest(F.lit(1), geo.walk_seconds(F.col("d"))).alias("dur_s"))


@_query(f"SELECT query_id, stop_index, round(d, 3) AS metres FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 6), stop_index) AS r FROM ({_AROUND}) WHERE d <= 250) WHERE r = 1")
def nearest_node(n):
    """J-09: the nearest node of a place within 250 m."""
    best = F.min(F.struct(F.round("d", 6).alias("k"), "stop_index")).alias("m")
    return _around(n, 250.0).groupBy("query_id").agg(best).select("query_id", "m.stop_index", F.round("m.k", 3).alias("metres"))


@_query(f"""WITH c AS (SELECT query_id, stop_index, CAST(ceil(d / 1.35) AS INT) AS dur_s, d > 120 AS far, row_number() OVER (PARTITION BY query_id ORDER BY ceil(d / 1.35), round(d, 6), stop_index) AS r FROM ({_AROUND}) WHERE d <= 600)
SELECT query_id, stop_index, dur_s FROM (SELECT *, bool_and(far) FILTER (r <= 2) OVER (PARTITION BY query_id) AS all_far FROM c) WHERE r <= CASE WHEN all_far THEN 8 ELSE 2 END""")
def adaptive_connectors(n):
    """T-05: the two best connectors, or max(4 k, k + 4) of them where both are long."""
    w = Window.partitionBy("query_id")
    c = _around(n, 600.0).withColumn("dur_s", geo.walk_seconds(F.col("d"))).withColumn("r", F.row_number().over(w.orderBy("dur_s", F.round("d", 6), "stop_index")))
    every = F.min(F.when(F.col("r") <= 2, F.col("d") > 120)).over(w)
    return c.withColumn("k", F.when(every, max(4 * 2, 2 + 4)).otherwise(2)).where("r <= k").select("query_id", "stop_index", "dur_s")


@_query("SELECT query_id, line_index, CAST(min(pos) AS INT) AS pos FROM d_queries JOIN d_line_stops ON stop_index = from_stop GROUP BY 1, 2")
def queued_lines(n):
    """J-02: the first position of each line at which a request can board."""
    at = n["d_line_stops"].withColumnRenamed("stop_index", "from_stop")
    return n["d_queries"].join(at, "from_stop").groupBy("query_id", "line_index").agg(F.min("pos").alias("pos"))


@_query(f"SELECT query_id, least(min(l.arr_s + w.dur_s), 1000000000) AS arr_s FROM d_legs l JOIN (SELECT query_id, stop_index, greatest(1, CAST(ceil(d / 1.35) AS INT)) AS dur_s FROM ({_AROUND}) WHERE d <= 600) w USING (query_id) WHERE w.stop_index = l.to_stop GROUP BY 1")
def egress(n):
    """J-07, R-15: the best arrival at a place over the walks from the stops that a journey reaches."""
    w = _around(n, 600.0).select("query_id", F.col("stop_index").alias("to_stop"), F.greatest(F.lit(1), geo.walk_seconds(F.col("d"))).alias("dur_s"))
    return n["d_legs"].join(w, ["query_id", "to_stop"]).groupBy("query_id").agg(F.min(F.col("arr_s") + F.col("dur_s")).alias("arr_s"))


# --- realtime and versions ---------------------------------------------------------------------------------------


@_query("SELECT DISTINCT trip_index FROM d_rt WHERE canceled = 1 OR skipped = 1 OR abs(delay_s) <= 21600")
def updated_trips(n):
    """Y-17, U-11, ST-06: trips with a delay that is believed, a skipped stop, or cancelled, before a refresh (even ones here) or after."""
    half = F.col("trip_index") % 2 == 0
    return timetable.changed_trips(n["d_rt"].where(half), n["d_rt"].where(~half))


@_query("SELECT trip_index, trip_index IN (SELECT trip_index FROM d_rt) OR trip_index IN (SELECT user_id FROM events) AS has_realtime FROM d_trips")
def realtime_flags(n):
    """ST-07: a trip has realtime where an update or only a vehicle was seen."""
    seen = n["d_rt"].select("trip_index").unionByName(n["events"].select(F.col("user_id").cast("long").alias("trip_index"))).distinct().withColumn("seen", F.lit(True))
    return n["d_trips"].join(seen, "trip_index", "left").select("trip_index", F.coalesce("seen", F.lit(False)).alias("has_realtime"))


@_query("""WITH c AS (SELECT user_id, ts, event_id, CAST(event_id % 11 AS INT) AS status FROM events)
SELECT user_id, arg_max(status, CAST(CASE WHEN status < 9 THEN status ELSE 255 END AS BIGINT) * 1000000000000 + event_id) AS worst FROM c GROUP BY 1""")
def carriage_status(n):
    """A-12, Y-18: the worst status over carriages by severity; of equal ones the last; unknown codes are worst."""
    status = (F.col("event_id") % 11).cast("int")
    rank = F.struct(transit.occupancy_severity(status).alias("severity"), "event_id", status.alias("status"))
    return n["events"].groupBy("user_id").agg(F.max(rank).alias("m")).select("user_id", F.col("m.status").alias("worst"))


_VERSIONS = "SELECT p_partkey, CASE WHEN p_partkey % 5 > 0 THEN 'u' || (p_partkey % 4) END AS url, 'u1' AS url_b, CASE WHEN p_partkey % 3 > 0 THEN 'e' || (p_partkey % 2) END AS etag, CASE WHEN p_partkey % 7 > 2 THEN 'e0' END AS etag_b, CASE WHEN p_partkey % 2 > 0 THEN 'm1' END AS modified, CASE WHEN p_partkey % 11 > 4 THEN 'm1' END AS modified_b FROM part"


@_query(f"""SELECT p_partkey, CASE WHEN url IS NULL OR url <> url_b THEN true WHEN etag IS NOT NULL OR etag_b IS NOT NULL THEN etag IS DISTINCT FROM etag_b ELSE modified IS DISTINCT FROM modified_b END AS changed,
coalesce(etag_b, etag) AS etag, coalesce(modified_b, modified) AS modified FROM ({_VERSIONS})""")
def feed_versions(n):
    """S-06, F-16: whether a remote feed differs from the cached one (no url: nothing cached); the merged version."""
    v = n["part"].sparkSession.sql(_VERSIONS)
    cached, remote = (F.struct(*(F.col(f"{c}{s}").alias(c) for c in ("url", "etag", "modified"))) for s in ("", "_b"))
    merged = transit.merged_version(remote, cached)
    return v.select("p_partkey", transit.version_changed(F.when(F.col("url").isNotNull(), cached), remote).alias("changed"), merged["etag"].alias("etag"), merged["modified"].alias("modified"))


@_query("SELECT trip_index, pos, delay_s FROM d_rt WHERE delay_s IS NOT NULL ORDER BY trip_index, pos LIMIT 24")
def realtime_sample(n):
    """T-07, V-06: a sample of updates, ordered; its limit is the feature."""
    return n["d_rt"].where("delay_s IS NOT NULL").select("trip_index", "pos", "delay_s").orderBy("trip_index", "pos").limit(24)


@_query("SELECT (SELECT count(*) FROM d_stops) AS stops, (SELECT count(DISTINCT route_index) FROM d_trips) AS routes, (SELECT count(*) FROM d_trips) AS trips, (SELECT count(*) FROM d_lines) AS lines, (SELECT count(*) FROM d_transfers) AS transfers, 'ok' AS status")
def service_stats(n):
    """V-01, V-02."""
    one = lambda df, name: df.agg(F.count("*").alias(name))
    out = n["d_trips"].agg(F.countDistinct("route_index").alias("routes"), F.count("*").alias("trips"))
    for x in (one(n["d_stops"], "stops"), one(n["d_lines"], "lines"), one(transfer_topk(n), "transfers")):
        out = out.crossJoin(x)  # single rows
    return out.withColumn("status", F.lit("ok"))


@_query("SELECT query_id, leg_no, CAST(to_json(struct_pack(from_stop := from_stop, to_stop := to_stop, trip := trip_index, dep := dep_s, arr := arr_s)) AS VARCHAR) AS body FROM d_legs")
def leg_json(n):
    """K-09: legs as the interface sends them."""
    body = F.to_json(F.struct("from_stop", "to_stop", F.col("trip_index").alias("trip"), F.col("dep_s").alias("dep"), F.col("arr_s").alias("arr")))
    return n["d_legs"].select("query_id", "leg_no", body.alias("body"))


# --- feeds and tags ----------------------------------------------------------------------------------------------

_ON_DAY = "CASE WHEN (n_nationkey >> {}) & 1 = 1 THEN 1 ELSE 0 END"


@_query("""WITH w AS (SELECT CAST(n_regionkey AS INT) AS feed_index, CAST(n_nationkey AS VARCHAR) AS service_id, d::DATE AS day, n_nationkey AS k FROM nation, range(DATE '2024-01-01' + CAST(n_nationkey AS INT), DATE '2024-03-01' - CAST(n_nationkey AS INT), INTERVAL 1 DAY) r(d)),
x AS (SELECT DISTINCT CAST(n_regionkey AS INT) AS feed_index, CAST(n_nationkey AS VARCHAR) AS service_id, DATE '2024-01-10' + CAST(event_id % 40 AS INT) AS day, event_id % 4 AS kind FROM events JOIN nation ON n_nationkey = user_id % 25),
a AS (SELECT feed_index, service_id, day FROM w WHERE (k >> (isodow(day) - 1)) & 1 = 1 UNION SELECT feed_index, service_id, day FROM x WHERE kind = 1)
SELECT feed_index, service_id, strftime(day, '%Y-%m-%d') AS service_date FROM a WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.feed_index = a.feed_index AND x.service_id = a.service_id AND x.day = a.day AND kind IN (0, 2))""")
def feed_calendar(n):
    """A-05, S-03: services by weekday (the bits of the nation's key), with additions and removals of which 0 means 2 and 3 nothing."""
    key = F.col("n_nationkey")
    text = lambda d: F.date_format(d, "yyyyMMdd")
    on = [F.shiftright(key, i).bitwiseAND(F.lit(1)).cast("int").alias(d) for i, d in enumerate(gtfs._DAYS)]
    start = F.date_add(F.to_date(F.lit("2024-01-01")), key.cast("int"))
    end = F.date_sub(F.to_date(F.lit("2024-02-29")), key.cast("int"))
    feed = [F.col("n_regionkey").cast("int").alias("feed_index"), key.cast("string").alias("service_id")]
    calendar = n["nation"].select(*feed, *on, text(start).alias("start_date"), text(end).alias("end_date"))
    day = F.date_add(F.to_date(F.lit("2024-01-10")), (F.col("event_id") % 40).cast("int"))
    dates = n["events"].join(n["nation"], key == F.col("user_id") % 25).select(*feed, text(day).alias("date"), (F.col("event_id") % 4).cast("int").alias("exception_type"))
    days = gtfs.service_days(calendar, gtfs.repair_exceptions(dates))
    return days.select("feed_index", "service_id", F.date_format("service_date", "yyyy-MM-dd").alias("service_date"))


_ROADS = ("motorway", "residential", "footway", "primary", "track", "steps", "service", "unclassified")
_SIGNS = ("50", "30 mph", "none", "70;50", "IT:urban", "5", "400")
_pick = lambda names, of: "list_element([" + ", ".join(f"'{x}'" for x in names) + f"], CAST({of} AS INT) + 1)"
_WAYS = f"SELECT p_partkey, {_pick(_ROADS, 'p_partkey % 8')} AS highway, CASE WHEN p_partkey % 3 > 0 THEN {_pick(_SIGNS, 'p_partkey % 7')} END AS maxspeed, CASE WHEN p_partkey % 5 = 0 THEN 'private' END AS access, CASE WHEN p_partkey % 11 = 0 THEN 'no' END AS foot, CASE p_partkey % 6 WHEN 0 THEN 'yes' WHEN 1 THEN '-1' WHEN 2 THEN 'no' END AS oneway, CASE WHEN p_partkey % 13 = 0 THEN 'roundabout' END AS junction, CASE WHEN p_partkey % 4 = 0 THEN ' ' WHEN p_partkey % 4 = 1 THEN ' ' || p_name END AS name, CASE WHEN p_partkey % 2 = 0 THEN 'R' || p_partkey END AS ref FROM part"


@_query(f"""SELECT p_partkey, access IS NULL AND foot IS NULL AND highway <> 'motorway' AS walk, access IS NULL AND highway NOT IN ('footway', 'steps') AS drive,
  CASE WHEN junction IS NOT NULL OR oneway = 'yes' THEN 'forward' WHEN oneway = '-1' THEN 'reverse' ELSE 'forward,reverse' END AS ways, nullif(trim(coalesce(name, ref)), '') AS name,
  round(CASE maxspeed WHEN '50' THEN 50 / 3.6 WHEN '30 mph' THEN 30 * 0.44704 WHEN '70;50' THEN 70 / 3.6 WHEN '5' THEN 4.0 WHEN '400' THEN 40.0
    ELSE CASE highway WHEN 'motorway' THEN 33.33 WHEN 'residential' THEN 8.33 WHEN 'primary' THEN 19.44 WHEN 'track' THEN 4.17 WHEN 'service' THEN 5.56 ELSE 11.11 END END, 6) AS speed FROM ({_WAYS})""")
def street_tags(n):
    """P-11 .. P-15, P-18, Y-15, Y-28, Y-32: what the tags of a way say."""
    k, pick = F.col("p_partkey"), lambda names, m: F.get(F.array(*map(F.lit, names)), (F.col("p_partkey") % m).cast("int"))
    name = F.when(k % 4 == 0, " ").when(k % 4 == 1, F.concat(F.lit(" "), "p_name"))
    tags = {"highway": pick(_ROADS, 8), "maxspeed": F.when(k % 3 > 0, pick(_SIGNS, 7)), "access": F.when(k % 5 == 0, "private"), "foot": F.when(k % 11 == 0, "no"), "junction": F.when(k % 13 == 0, "roundabout")}
    tags |= {"oneway": F.when(k % 6 == 0, "yes").when(k % 6 == 1, "-1").when(k % 6 == 2, "no"), "name": name, "ref": F.when(k % 2 == 0, F.concat(F.lit("R"), k.cast("string")))}
    pairs = F.array(*(F.struct(F.lit(t).alias("k"), v.alias("v")) for t, v in tags.items()))
    w = n["part"].select(k, F.map_from_entries(F.filter(pairs, lambda x: x["v"].isNotNull())).alias("tags"))
    t = F.col("tags")
    return w.select(k, osm.open_to(t, "walk").alias("walk"), osm.open_to(t, "drive").alias("drive"), F.array_join(osm.directions(t, "drive"), ",").alias("ways"), osm.way_name(t).alias("name"), F.round(osm.drive_speed(t), 6).alias("speed"))


@_query("SELECT event_id, strftime(DATE '2026-03-28' + CAST(floor(s / 86400.0) AS INT), '%Y-%m-%d') || 'T' || lpad(CAST(m // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST(m // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(m % 60 AS VARCHAR), 2, '0') AS clock FROM (SELECT event_id, s, ((s % 86400) + 86400) % 86400 AS m FROM (SELECT event_id, (event_id * 7919) % 300000 - 100000 AS s FROM events))")
def service_times(n):
    """F-10: seconds of a service day, before its midnight and past its end too, as texts."""
    seconds = F.col("event_id") * 7919 % 300000 - 100000
    return n["events"].select("event_id", geo.service_time(F.to_date(F.lit("2026-03-28")), seconds).alias("clock"))


_SEARCHED = "SELECT stop_index, stop_name, 'c' || (stop_index % 40) AS stop_code, lower(feed_index || ':' || stop_index || ' ' || 'c' || (stop_index % 40) || ' ' || stop_name) AS search_blob FROM d_stops"


@_query(f"""SELECT stop_index, score FROM (SELECT stop_index, CASE WHEN lower(CAST(stop_index AS VARCHAR)) = 'c7' THEN 0 WHEN lower(stop_code) = 'c7' THEN 1 WHEN starts_with(search_blob, 'c7') THEN 2 WHEN contains(search_blob, 'c7') THEN 3 END AS score FROM ({_SEARCHED}))
WHERE score IS NOT NULL ORDER BY score, stop_index LIMIT 50""")
def stop_search_codes(n):
    """T-01, V-03: stops by id, code, then the text of all their names; the limit is the feature."""
    code = F.concat(F.lit("c"), (F.col("stop_index") % 40).cast("string"))
    blob = F.lower(F.concat_ws(" ", F.concat_ws(":", "feed_index", "stop_index"), code, "stop_name"))
    return timetable.search_stops(n["d_stops"].withColumn("stop_code", code).withColumn("search_blob", blob), "C7", 99).select("stop_index", "score")


@_query(f"SELECT p.query_id, p.leg_no, p.source, p.legs FROM (SELECT query_id, leg_no, from_stop AS source, CAST(sum(CASE WHEN kind = {journeys.RIDE} THEN 1 ELSE 0 END) OVER ({_ON}) AS INT) AS legs FROM d_legs) p WHERE NOT EXISTS (SELECT 1 FROM d_legs l JOIN d_rt r ON r.trip_index = l.trip_index AND (canceled = 1 OR skipped = 1 OR abs(delay_s) <= 21600) WHERE l.query_id = p.query_id AND l.leg_no >= p.leg_no)")
def refreshed_profiles(n):
    """ST-11, U-07: what stays of the profiles after a refresh."""
    p = legs.profile_points(n["d_legs"]).withColumn("point", F.struct("query_id", "leg_no"))
    return timetable.invalidate(p, timetable.changed_trips(None, n["d_rt"]), "point", "suffix").select("query_id", "leg_no", "source", "legs")
