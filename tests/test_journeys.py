"""Journey operators against DuckDB and a scalar search written independently."""

from __future__ import annotations

import heapq
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from wayfold.functions import geo, osm, transit
from wayfold.operators import routing, timetable
from wayfold.plans import detail, features, registry  # noqa: F401
from wayfold.sources.fixture import TABLES

SF = "/root/testdata/sf0.001"
FAST = ["stops", "lines", "line_stats", "service_days", "stop_cells", "haversine_transfers", "departure_buckets", "delay_propagation", "stop_differences", "profile_pareto", "append_only_merge", "line_modes", "global_ids", "clock_times", "route_labels", "endpoint_kinds", "stop_resolution", "strong_anchors", "trips_of_services", "cell_neighbours", "connectors", "line_turns", "line_lengths", "lookup_buckets", "update_positions", "vehicle_merge", "profile_summary", "profile_merge", "spatial_surface", "mode_filtered_route", "route_overtaking_k2", "route_realtime_k2", "overtaking_ride", "street_forest"]
DETAIL = ["walk_runs", "profile_insertion", "spatial_insertion", "anchor_expansion", "cacheable_legs", "entity_dictionary", "leg_hydration", "leg_lines", "walk_stitching", "overlay_cells", "line_raster", "way_edges", "street_overlay", "needed_overrides", "street_transfers", "street_routes", "transfer_rebuild", "transfer_tiles", "virtual_stops", "virtual_walks", "nearest_node", "adaptive_connectors", "queued_lines", "egress", "updated_trips", "realtime_flags", "carriage_status", "feed_versions", "realtime_sample", "service_stats", "leg_json", "feed_calendar", "street_tags", "service_times", "stop_search_codes", "refreshed_profiles"]


@pytest.mark.parametrize("name", FAST + DETAIL)
def test_same_rows_as_duckdb(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    want = db.execute(f"SELECT {', '.join(cols)} FROM ({registry.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in df.select(*cols).collect()))) == sorted(map(repr, want))


def test_rounds_match_scalar_search(spark):
    times = [(t, line, p, (line * 3 + p * 2) % 9, 100 * t + 50 * p, 100 * t + 50 * p + 5) for line in range(3) for t in range(line * 10, line * 10 + 6) for p in range(4)]
    st = spark.createDataFrame(times, "trip_index long, line_index int, pos int, stop_index int, arr_s int, dep_s int")
    walks = [(a, (a + 1) % 9, 70) for a in range(0, 9, 2)]
    tr = spark.createDataFrame(walks, "from_stop int, to_stop int, dur_s int")
    q = spark.createDataFrame([(i, i, (i + 5) % 9, 40 * i) for i in range(9)], "query_id int, from_stop int, to_stop int, dep_s int")
    got = {(r.query_id, r.stop): r.arr for r in routing.rounds(q, st, tr, 2)[2].collect()}

    def search(origin: int, dep: int) -> dict[int, int]:
        best = {origin: dep}
        for _ in range(2):
            for a, b, d in walks:
                pass
            new = dict(best)
            for a, b, d in walks:
                if a in best:
                    new[b] = min(new.get(b, 1 << 30), best[a] + d)
            best = new
        for _ in range(2):
            rode: dict[int, int] = {}
            for line in range(3):
                rows = [x for x in times if x[1] == line]
                for s, at in best.items():
                    for x in rows:
                        if x[3] == s:
                            trips = sorted((y[5], y[0]) for y in rows if y[2] == x[2] and y[5] >= at)
                            for y in rows:
                                if trips and y[0] == trips[0][1] and y[2] > x[2]:
                                    rode[y[3]] = min(rode.get(y[3], 1 << 30), y[4])
            better = {s: a for s, a in rode.items() if a < best.get(s, 1 << 30)}
            best = best | better
            for a, b, d in walks:
                if a in better:
                    best[b] = min(best.get(b, 1 << 30), better[a] + d)
        return best

    want = {(i, s): a for i in range(9) for s, a in search(i, 40 * i).items()}
    assert got == want


def test_service_time_and_speed(spark):
    row = spark.range(1).select(
        geo.service_time(F.to_date(F.lit("2024-01-01")), F.lit(-5)).alias("a"),
        geo.service_time(F.to_date(F.lit("2024-01-01")), F.lit(90061)).alias("b"),
        osm.max_speed(F.lit("50;30")).alias("c"),
        osm.max_speed(F.lit("30 mph")).alias("d"),
        osm.max_speed(F.lit("DE:urban")).alias("e"),
    ).first()
    assert (row.a, row.b) == ("2023-12-31T23:59:55", "2024-01-02T01:01:01")
    assert abs(row.c - 13.889) < 0.001 and abs(row.d - 13.411) < 0.001 and row.e is None


def test_nearby_points_share_a_cell(spark):
    c = lambda a, b: geo.cell(F.lit(a), F.lit(b))
    r = spark.range(1).select(c(41.9028, 12.4964).alias("a"), c(41.90282, 12.49642).alias("b"), c(41.8, 12.5).alias("c"), c(41.965, 12.455).alias("d")).first()
    assert r.a == r.b and r.c != r.d


def test_empty_tables(spark):
    st = spark.createDataFrame([], "trip_index long, line_index int, pos int, stop_index int, service_dow int, arr_s int, dep_s int")
    assert timetable.trip_ranks(st).count() == 0 and timetable.monotone(st).count() == 0


@pytest.mark.parametrize("name", ["route_k2", "first_departure_asof", "knn_projection", "profile_lookup"])
def test_every_customer_asks(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    every = db.execute(f"SELECT {', '.join(cols)} FROM ({registry.oracle_sql()[name]})").fetchall()
    rows = df.select(*cols).collect()
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, every))
    assert max(r.query_id for r in rows) > 32


def test_arrive_by_equals_its_sql(spark):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = db.execute(f"SELECT query_id, dep_s, arr FROM ({registry.ARRIVE_BY_SQL})").fetchall()
    got = registry.queries()["arrive_by_exact"](spark, SF).select("query_id", "dep_s", "arr").collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(got) > 100


def test_modes_are_parsed():
    assert transit.parse_modes(None) is None and transit.parse_modes("tram, bus") is None
    assert transit.parse_modes(" Bus ") == {"bus"}
    for wrong in ("", " ,", "ship", "bus,ship"):
        with pytest.raises(ValueError, match="mode"):
            transit.parse_modes(wrong)


def test_clock_endpoints_and_codes(spark):
    rows = [("8:05", 29100), ("23:59:59", 86399), ("24:00", None), ("12:60", None), ("1205", None), ("", None), (None, None)]
    df = spark.createDataFrame([(t,) for t, _ in rows], "t string").select(transit.clock_seconds(F.col("t")).alias("s"))
    assert [r.s for r in df.collect()] == [s for _, s in rows]
    codes = spark.createDataFrame([(c,) for c in (-1, 0, 3, 9, None)], "c int").select(transit.code_name(F.col("c"), transit.RELATIONSHIPS).alias("n"))
    assert [r.n for r in codes.collect()] == [None, "SCHEDULED", "CANCELED", None, None]


def test_written_tables_are_deleted(spark):
    import os

    from wayfold.plans import lineage

    path = lineage.run_dir(spark)
    lineage.written(spark.range(3))
    assert os.listdir(path)
    lineage.release(spark)
    assert not os.path.exists(path) and lineage.run_dir(spark) != path


def test_boarding_finds_the_first_departure(spark):
    """Against brute force, with gaps of many buckets, labels on a departure, before the first and after the last."""
    times = [(t, t % 3, t % 2, (t % 3 + t % 2) % 3, 0, (t * 7919) % 86400 - 1000) for t in range(60)]
    st = spark.createDataFrame(times, "trip_index long, line_index int, pos int, stop_index int, arr_s int, dep_s int")
    labels = [(i, i % 3, (i * 4111) % 90000 - 3000) for i in range(40)] + [(100 + x[0], x[3], x[5]) for x in times]
    got = {(r.query_id, r.line_index, r.board_pos): tuple(r.trip) for r in routing.board(spark.createDataFrame(labels, "query_id int, stop int, arr int"), st).collect()}
    want: dict[tuple, tuple] = {}
    for q, stop, arr in labels:
        for t, line, pos, at, _, dep in times:
            if at == stop and dep >= arr:
                want[q, line, pos] = min(want.get((q, line, pos), (1 << 30, 0)), (dep, t))
    assert got == want


def test_arrive_by_tries_every_minute(spark):
    """Against brute force over single departures: between tens, at the deadline itself, over two hours before, and never."""
    times = [(t, t % 2, p, t % 2 * 3 + p, 1000 + 700 * t + 300 * p, 1000 + 700 * t + 300 * p) for t in range(30) for p in range(3)]
    times += [(90, 9, 0, 6, 900, 900), (90, 9, 1, 7, 950, 950)]
    st = spark.createDataFrame(times, "trip_index long, line_index int, pos int, stop_index int, arr_s int, dep_s int")
    tr = spark.createDataFrame([(2, 3, 100), (5, 0, 40), (0, 1, 900)], "from_stop int, to_stop int, dur_s int")
    asked = [(0, 0, 2), (1, 0, 5), (2, 4, 4), (3, 6, 7), (4, 2, 3), (5, 7, 6), (6, 3, 1)]
    q = spark.createDataFrame([(i, a, b, 14000) for i, a, b in asked], "query_id int, from_stop int, to_stop int, until int")
    got = {r.query_id: (r.dep_s, r.arr) for r in routing.arrive_by(q, F.col("until"), st, tr, 2, 240).collect()}
    tries = spark.createDataFrame([(i * 1000 + m, a, b, 14000 - 60 * m) for i, a, b in asked for m in range(241)], "query_id int, from_stop int, to_stop int, dep_s int")
    want: dict[int, tuple[int, int]] = {}
    for r in routing.arrivals(tries, routing.rounds(tries, st, tr, 2)).collect():
        i, dep = r.query_id // 1000, 14000 - 60 * (r.query_id % 1000)
        if r.arr <= 14000:
            want[i] = max(want.get(i, (-1, 0)), (dep, r.arr))
    assert got == want
    assert got[2] == (14000, 14000) and got[3][0] < 14000 - 7200 and 5 not in got
    assert any((14000 - dep) % 600 for dep, _ in got.values())


def test_arrive_by_plans_one_departure_a_query_first(spark, monkeypatch):
    """The last start comes from a search backwards, so most queries are answered by the first departure planned."""
    planned, plain = [], routing.rounds

    def counted(queries, *args, **more):
        planned.append((queries.count(), labels := plain(queries, *args, **more), queries))
        return labels

    monkeypatch.setattr(routing, "rounds", counted)
    df = registry.queries()["arrive_by_exact"](spark, SF)
    n, labels, queries = planned[0]
    assert 100 < n <= spark.read.parquet(f"{SF}/customer.parquet").count()
    assert routing.arrivals(queries, labels).count() > df.count() * 0.6
    assert max(x.count() for x in labels) < 10 * n


@pytest.mark.parametrize("n,seed", [(0, 1), (1, 2), (2, 3), (3, 5)])
def test_arrive_by_on_random_networks(spark, monkeypatch, n, seed):
    """Against every minute: overtaking trips, loops, rides slower than walks, equal times, stops that nothing serves."""
    rng = random.Random(seed)
    times = []
    for line in range(7):
        stops = [rng.randrange(14) for _ in range(4)]
        for trip in range(9):
            t = rng.randrange(1000, 8000)
            for pos, stop in enumerate(stops):
                t += rng.choice([0, 30, 200, 900])
                times.append((line * 100 + trip, line, pos, stop, t, t + rng.choice([0, 20])))
                t = times[-1][-1]
    st = spark.createDataFrame(times, "trip_index long, line_index int, pos int, stop_index int, arr_s int, dep_s int")
    tr = spark.createDataFrame(sorted({(a, b): (a, b, rng.choice([0, 60, 250, 800])) for a, b in [(rng.randrange(16), rng.randrange(16)) for _ in range(26)] if a != b}.values()), "from_stop int, to_stop int, dur_s int")
    asked = [(i, rng.randrange(16), rng.randrange(16), rng.randrange(3000, 11000)) for i in range(60)]
    q = spark.createDataFrame(asked, "query_id int, from_stop int, to_stop int, until int")
    monkeypatch.setattr(routing, "TRIES", 0, raising=False)
    got = {r.query_id: (r.dep_s, r.arr) for r in routing.arrive_by(q, F.col("until"), st, tr, n, 70).collect()}
    tries = spark.createDataFrame([(i * 1000 + m, a, b, u - 60 * m) for i, a, b, u in asked for m in range(71)], "query_id int, from_stop int, to_stop int, dep_s int")
    want: dict[int, tuple[int, int]] = {}
    for r in routing.arrivals(tries, routing.rounds(tries, st, tr, n)).collect():
        i, m = divmod(r.query_id, 1000)
        if r.arr <= asked[i][3]:
            want[i] = max(want.get(i, (-1, 0)), (asked[i][3] - 60 * m, r.arr))
    assert got == want and want


@pytest.mark.parametrize("most", [2963, 150])
def test_forest_matches_dijkstra(spark, most):
    """Paths of many edges, cheap detours longer than the direct edge, ties between roots, and the bound itself."""
    edges = [(i, i + 1, 10) for i in range(30)] + [(0, 8, 81), (40, 20, 10), (40, 41, 150), (41, 42, 1), (50, 0, 5)]
    roots = [0, 40, 60]
    best: dict[int, tuple[int, int]] = {}
    heap = [(0, r, r) for r in roots]
    while heap:
        dist, root, node = heapq.heappop(heap)
        if node not in best:
            best[node] = (dist, root)
            for a, b, d in edges:
                if a == node and dist + d <= most:
                    heapq.heappush(heap, (dist + d, root, b))
    e = spark.createDataFrame(edges, "src int, dst int, dur_s int")
    got = {r.node: (r.dist, r.root) for r in timetable.relax(e, spark.createDataFrame([(r,) for r in roots], "node int"), most).collect()}
    assert got == best
