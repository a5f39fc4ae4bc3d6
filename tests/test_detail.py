"""Paths, cells, street operators and settings against plain Python."""

from __future__ import annotations

import heapq
import math

import pytest
from pyspark.sql import functions as F

from wayfold.functions import cells, paths
from wayfold.operators import streets
from wayfold.sources import config


def metres(a, b):
    h = math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371000 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def walk_steps(points, ways, names):
    """Directions by a loop over the points."""
    if len(points) < 2:
        return []
    ways = (ways + [None] * len(points))[: len(points) - 1]
    label = lambda w: (names.get(w) or "").strip() or None
    along = [0.0]
    for a, b in zip(points, points[1:], strict=False):
        along.append(along[-1] + metres(a, b))
    out = [("depart", next((label(w) for w in ways if label(w)), None), 0.0)]
    for i in range(1, len(points) - 1):
        a, b = ways[i - 1], ways[i]
        alike = a == b or (a in names and b in names and names[a].strip().lower() == names[b].strip().lower())
        if a is None or b is None or alike:
            continue
        k = math.cos(math.radians(points[i][0]))
        u = ((points[i][1] - points[i - 1][1]) * k, points[i][0] - points[i - 1][0])
        v = ((points[i + 1][1] - points[i][1]) * k, points[i + 1][0] - points[i][0])
        cross, dot = u[0] * v[1] - u[1] * v[0], u[0] * v[0] + u[1] * v[1]
        straight = u == (0, 0) or v == (0, 0) or math.degrees(math.atan2(abs(cross), dot)) < 20
        kind = "continue" if straight else "turn-left" if cross > 0 else "turn-right"
        if label(b) is None and (kind == "continue" or along[i] - out[-1][2] < 15):
            continue
        out.append((kind, label(b), along[i]))
    return [*out, ("arrive", None, along[-1])]


def test_directions_match_a_loop(spark):
    names = {1: "Via A", 2: " via a ", 3: "Via B", 4: "  "}
    step = 0.0001  # about 11 m
    cases = [
        ([(41.0, 12.0), (41.0, 12.0 + 5 * step), (41.0 + 5 * step, 12.0 + 5 * step), (41.0 + 5 * step, 12.0)], [1, 3, 4]),
        ([(41.0, 12.0), (41.0, 12.0 + step), (41.0 + step, 12.0 + step), (41.0 + step, 12.0), (41.0, 12.0 - step)], [1, 4, 9, 5]),
        ([(41.0, 12.0), (41.0, 12.001), (41.0, 12.002), (41.0, 12.003)], [1, 2, 3]),
        ([(41.0, 12.0), (41.001, 12.0), (41.001, 12.001), (41.0, 12.001), (41.0, 12.0)], [None, 4, 9]),
        ([(41.0, 12.0)], []),
        ([], [7]),
    ]
    df = spark.createDataFrame([(i, p, w) for i, (p, w) in enumerate(cases)], f"i int, p {paths.POINTS}, w array<bigint>").withColumn("names", F.expr("map(" + ", ".join(f"{k}L, '{v}'" for k, v in names.items()) + ")"))
    got = {r.i: [(s.maneuver, s.street, s.metres) for s in r.s] for r in df.select("i", paths.directions(F.col("p"), F.col("w"), F.col("names")).alias("s")).collect()}
    for i, (p, w) in enumerate(cases):
        want = walk_steps(p, w, names)
        assert [x[:2] for x in got[i]] == [x[:2] for x in want], i
        assert [x[2] for x in got[i]] == pytest.approx([x[2] for x in want])
    kinds = {s[0] for x in got.values() for s in x}
    assert {"turn-left", "turn-right", "continue"} <= kinds
    texts = spark.createDataFrame([("depart", None), ("turn-left", "X"), ("arrive", None)], "m string, s string").select(paths.instruction(F.col("m"), F.col("s"), F.lit(" Y ")).alias("t"))
    assert [r.t for r in texts.collect()] == ["Parti a piedi", "Svolta a sinistra su X", "Arrivo a Y"]


def stitched(pieces):
    points, ways = [], []
    for i, (p, w) in enumerate(pieces):
        w = (w + [None] * len(p))[: max(len(p) - 1, 0)]
        if i > 0 and len(p) > 1:
            p, w = p[1:], w[1:]
        if i < len(pieces) - 1 and len(p) > 1:
            p, w = p[:-1], w[:-1]
        if not p:
            continue
        if not points:
            points, ways = list(p), list(w)
        elif points[-1] == p[0]:
            points, ways = points + p[1:], ways + w
        else:
            points, ways = points + p, [*ways, None, *w]
    return points, ways


def test_stitching_matches_a_loop(spark):
    a, b, c, d, e = ((float(i), 0.0) for i in range(5))
    cases = [
        [([a, b, c], [1, 2]), ([c, d, e], [3])],
        [([a, b], [1]), ([b, c], [2]), ([c, d], [3])],
        [([a], []), ([a, b], [5]), ([], [])],
        [([], []), ([b, c, d], [1, 2, 3])],
        [([a, b, c], [1, 2])],
        [],
    ]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(cases)], f"i int, g array<{paths.GEOMETRY}>")
    for r in df.select("i", paths.stitch(F.col("g")).alias("s")).collect():
        want = stitched(cases[r.i])
        assert ([tuple(p) for p in r.s.points], r.s.ways) == (want[0], want[1]), r.i


def test_cells_round_trip(spark):
    rows = [(41.9, 12.5), (-90.0, -180.0), (90.0, 180.0), (0.0, 0.0), (-33.4, 151.2)]
    df = spark.createDataFrame(rows, "lat double, lon double").withColumn("c", cells.overlay_cell(F.col("lat"), F.col("lon")))
    lat, lon = cells.center(F.col("c"))
    for r in df.select("lat", "lon", "c", lat.alias("a"), lon.alias("b"), cells.neighbours(F.col("c")).alias("near"), cells.transition_metres(F.col("c"), F.col("c")).alias("zero")).collect():
        assert abs(r.lat - r.a) < 180 / 2**22 and abs(r.lon - r.b) < 360 / 2**22 and r.zero == 0
        edge = abs(r.lat) == 90
        assert len(set(r.near)) == (4 if edge else 9) and r.c in r.near
    repeats = spark.range(1).select(cells.without_repeats(F.expr("array(1L, 1L, 2L, 1L, 1L)")).alias("x"), cells.rasterize(F.expr(f"CAST(array() AS {paths.POINTS})")).alias("none"))
    assert [tuple(r) for r in repeats.collect()] == [([1, 2, 1], [])]


def test_thin_and_straight(spark):
    df = spark.createDataFrame([([(1.0, 1.0), (1.0, 1.0 + 5e-8), (1.0, 1.1), (1.0, 1.0)], 1.0, None)], f"p {paths.POINTS}, a double, b double")
    r = df.select(paths.thin(F.col("p")).alias("t"), F.size(paths.straight_line(F.col("a"), F.col("a"), F.col("a"), F.col("b"))).alias("n"), paths.metres_along(F.col("p")).alias("m")).first()
    assert [tuple(x) for x in r.t] == [(1.0, 1.0), (1.0, 1.1), (1.0, 1.0)] and r.n == 0 and len(r.m) == 4 and r.m[0] == 0


def test_bounded_paths_match_dijkstra(spark):
    edges = [(a, (a * 7 + k * 3) % 23, 5 + (a * 11 + k * 13) % 40) for a in range(23) for k in range(3)]
    e = spark.createDataFrame(edges, "src int, dst int, dur_s int")
    roots = spark.createDataFrame([(0,), (5,), (99,)], "root int")
    got = {(r.root, r.node): r.dist for r in streets.bounded_paths(e, roots, 90).collect()}
    want = {}
    for root in (0, 5, 99):
        best, heap = {root: 0}, [(0, root)]
        while heap:
            d, u = heapq.heappop(heap)
            for a, b, w in edges:
                if a == u and d == best[u] and d + w <= 90 and d + w < best.get(b, 1 << 30):
                    best[b] = d + w
                    heapq.heappush(heap, (d + w, b))
        want |= {(root, k): v for k, v in best.items()}
    assert got == want


def test_street_changes_by_hand(spark):
    e = spark.createDataFrame([(1, 2, 10), (2, 3, 20), (3, 4, 30)], "src int, way_id int, dur_s int")
    made = spark.createDataFrame([(1, 2, 11), (2, 3, 21)], "src int, way_id int, dur_s int")
    ch = spark.createDataFrame([(1, 2, "delete"), (2, 2, "modify"), (3, 3, "modify"), (4, 3, "delete")], "sequence int, way_id int, action string")
    assert sorted(map(tuple, streets.overlay(e, ch, made).collect())) == [(1, 2, 11), (3, 4, 30)]
    none = ch.limit(0)
    assert streets.overlay(e, none, made).count() == 3


def test_settings(tmp_path):
    p = tmp_path / "m.toml"
    p.write_text('walk_radius_meters = 300\n[dvni]\nknn_candidates = 99\n[hpf]\nsearch_window = 1\n[osm_diff]\npoll_interval_secs = 5\n[[feeds]]\nid = "a"\nsource = "a.zip"\n[[feeds]]\nid = "b"\nsource = "https://x/b.zip"\ndepends_on = ["a"]\n')
    s = config.from_manifest(p)
    assert (s.walk_radius_meters, s.walk_speed_mps, s.knn_candidates, s.search_window, s.changes_poll_secs) == (300, 1.35, 16, 64, 60)
    assert [f.source for f in s.feeds] == [str(tmp_path / "a.zip"), "https://x/b.zip"]
    assert [config.query_transfers(x, s) for x in (None, -3, 2, 50)] == [4, 0, 2, 8]
    assert [config.reload_policy(m, t, c, s) for m, t, c in ((0, 9, False), (0, 9, True), (5, 100, False), (6, 100, False), (0, 0, False))] == ["reuse", "append", "append", "full", "reuse"]
    env = config.from_environment({"W_FEED_ID": "x", "W_WALK_SPEED_MPS": " 1.5 ", "W_KNN_CANDIDATES": "0"}, "W_")
    assert (env.feeds[0].id, env.walk_speed_mps, env.knn_candidates) == ("x", 1.5, 1)


@pytest.mark.parametrize(
    ("feeds", "says"),
    [([], "no feeds"), ([("", ())], "empty"), ([("a:b", ())], "colon"), ([("a", ()), ("a", ())], "repeated"), ([("a", ("z",))], "unknown feed z"), ([("a", ("b",)), ("b", ("a",)), ("c", ())], "each other: a, b"), ([("a", ("a",))], "each other")],
)
def test_feeds_are_checked(feeds, says):
    with pytest.raises(ValueError, match=says):
        config.check_feeds([config.Feed(i, "s", depends_on=d) for i, d in feeds])
