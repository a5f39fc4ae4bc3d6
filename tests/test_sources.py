"""Feeds, messages and change files from small files written here."""

from __future__ import annotations

import gzip
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from wayfold.functions import osm as tags
from wayfold.operators import journeys
from wayfold.sources import gtfs, osm, realtime
from wayfold.streaming import snapshot

FEED = {
    "stops": "﻿stop_id,stop_name,stop_lat,stop_lon\nb, B ,41.0,12.0\na,,41.1,12.1\nc,C,,\n",
    "routes": "route_id,route_short_name,route_type,route_color\nr,1,3,ff00aa\n",
    "trips": "trip_id,route_id,service_id\nt2,r,s\nt1,r,s\nshort,r,s\n",
    "stop_times": "trip_id,stop_sequence,stop_id,arrival_time,departure_time\nt1,5,b,,25:00:10\nt1,2,a,24:59:00,\nt2,1,a,8:00:00,8:00:05\nt2,2,b,8:10:00,8:10:00\nshort,1,c,1:00:00,1:00:00\n",
    "calendar": "service_id,monday,tuesday,wednesday,thursday,friday,saturday,sunday,start_date,end_date\ns,1,0,0,0,0,0,0,20240101,20240114\n",
    "calendar_dates": "service_id,date,exception_type\ns,20240108,0\ns,20240110,1\ns,20240111,7\n",
}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("feed") / "f.zip")
    with zipfile.ZipFile(path, "w") as z:
        for name, text in FEED.items():
            z.writestr(f"{name}.txt", text)
    return {t: gtfs.read_table(spark, {"x": path, "y": path}, t, batch=2) for t in gtfs.COLUMNS}


def test_feed_becomes_static_model(tables):
    assert tables["shapes"].count() == 0
    m = gtfs.static_model(tables)
    assert [(r.stop_index, r.global_name, r.stop_name) for r in m["stops"].orderBy("stop_index").collect()] == [(0, "x:a", "a"), (1, "x:b", "B"), (2, "x:c", "C"), (3, "y:a", "a"), (4, "y:b", "B"), (5, "y:c", "C")]
    assert {r.route_color for r in m["routes"].collect()} == {"#FF00AA"}
    assert sorted((r.trip_index, r.trip_id, r.line_index) for r in m["trips"].collect()) == [(1, "t1", 1), (2, "t2", 1), (4, "t1", 4), (5, "t2", 4)]
    assert sorted((r.pos, r.stop_index, r.arr_s, r.dep_s) for r in m["stop_times"].where("trip_index = 1").collect()) == [(0, 0, 89940, 89940), (1, 1, 90010, 90010)]


def test_service_days(tables):
    got = {(r.feed_index, str(r.service_date)) for r in gtfs.service_days(tables["calendar"], tables["calendar_dates"]).collect()}
    assert got == {(i, d) for i in (0, 1) for d in ("2024-01-01", "2024-01-10")}


def field(number: int, value) -> bytes:
    def varint(x: int) -> bytes:
        x &= (1 << 64) - 1
        out = b""
        while x > 127:
            out, x = out + bytes([x & 127 | 128]), x >> 7
        return out + bytes([x])

    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    raw = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(raw)) + raw


def test_realtime_messages(spark, tmp_path):
    stop = field(1, 3) + field(4, "b") + field(2, field(1, -90)) + field(3, field(1, 300))
    update = field(2, field(1, "e1") + field(3, field(1, field(1, "t1")) + field(2, stop) + field(5, 60)))
    bare = field(2, field(1, "e2") + field(3, field(1, field(1, "t2") + field(4, 3))))
    car = field(2, field(1, "e3") + field(4, field(1, field(1, "t1")) + field(8, field(1, "bus")) + field(2, field(1, 41.5) + field(2, 12.25)) + field(5, 1700000000)))
    (tmp_path / "m.pb").write_bytes(update + bare + car)
    (tmp_path / "empty.pb").write_bytes(b"")
    got = sorted(map(tuple, realtime.read_messages(spark, "x", str(tmp_path), "updates").collect()))
    assert got == [("x", "e1", "t1", 60, None, 3, "b", -90, 300, None), ("x", "e2", "t2", None, 3, None, None, None, None, None)]
    (v,) = realtime.read_messages(spark, "x", str(tmp_path), "vehicles").collect()
    assert (v.trip_id, v.vehicle_id, v.lat, v.lon, v.ts) == ("t1", "bus", 41.5, 12.25, 1700000000)
    with pytest.raises(ValueError, match="cut short"):
        list(realtime.fields(update[:-3]))


def test_change_files(spark, tmp_path):
    xml = b'<osmChange><create><node id="1" lat="41.5" lon="12.5"/><way id="7"><nd ref="2"/><nd ref="1"/><tag k="highway" v="steps"/></way></create><delete><way id="8"/></delete></osmChange>'
    (tmp_path / "1.osc.gz").write_bytes(gzip.compress(xml))
    got = {r.id: r for r in osm.read_changes(spark, str(tmp_path)).collect()}
    assert (got[7].action, got[7].node_refs, got[7].tags, [tuple(c) for c in got[7].coordinates]) == ("create", [2, 1], {"highway": "steps"}, [(41.5, 12.5)])
    assert (got[8].action, got[8].node_refs, got[8].coordinates) == ("delete", [], [])
    (tmp_path / "state.txt").write_text("#x\nsequenceNumber=3806\ntimestamp=2026-04-05T20\\:20\\:45Z\n")
    s = osm.read_state(spark, str(tmp_path / "state.txt")).withColumn("url", osm.change_url(F.lit("http://h/"), F.col("sequence"))).first()
    assert tuple(s) == (3806, "2026-04-05T20:20:45Z", "http://h/000/003/806.osc.gz")


def test_ways(spark):
    ways = [{"highway": "steps"}, {"highway": "motorway"}, {"railway": "platform"}, {"highway": "primary", "foot": "no"}, {}, {"highway": "service", "access": "private"}]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(ways)], "i int, t map<string,string>")
    got = df.select(tags.open_to(F.col("t"), "walk").alias("w"), tags.open_to(F.col("t"), "drive").alias("d"), tags.drive_speed(F.col("t")).alias("v")).collect()
    assert [(r.w, r.d) for r in got] == [(True, False), (False, True), (True, False), (False, True), (False, False), (False, False)]
    assert [r.v for r in got] == [11.11, 33.33, 11.11, 19.44, 11.11, 5.56]


def test_walks_merge(spark):
    rows = [(1, 0, 0, 1, 2, -1, 10, 20), (1, 1, 0, 2, 3, -1, 25, 30), (1, 2, 1, 3, 4, 9, 40, 50), (1, 3, 0, 4, 5, -1, 50, 60)]
    df = spark.createDataFrame(rows, "query_id int, leg_no int, kind int, from_stop int, to_stop int, trip_index long, dep_s int, arr_s int")
    got = sorted((r.leg_no, r.kind, r.from_stop, r.to_stop, r.dep_s, r.arr_s, r.moving_s) for r in journeys.merge_walks(df).collect())
    assert got == [(1, 0, 1, 3, 10, 30, 15), (2, 1, 3, 4, 40, 50, 10), (3, 0, 4, 5, 50, 60, 10)]


def test_snapshots_replace_whole(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.range(5).coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("id long").parquet(src)
    snapshot.write_snapshots(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert snapshot.read_snapshot(spark, str(tmp_path / "out"), 0).count() == 5


def test_snapshots_are_published_whole(spark, tmp_path):
    out, seen = str(tmp_path / "out"), []
    with pytest.raises(LookupError):
        snapshot.read_snapshot(spark, out)
    spark.range(3).write.parquet(f"{out}/data/0-broken")  # a try that failed before it was published
    source = str(tmp_path / "in")
    for i in (1, 2):
        spark.range(10 * i).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("id long").parquet(source)
        note = lambda before, now, epoch: seen.append((epoch, before and before.count(), now.count()))
        snapshot.write_snapshots(stream, out, str(tmp_path / "cp"), after=note).awaitTermination()
    assert seen == [(0, None, 10), (1, 10, 20)]
    assert snapshot.read_snapshot(spark, out).count() == 20
    assert snapshot.read_snapshot(spark, out, 0).count() == 10
    with pytest.raises(LookupError):
        snapshot.read_snapshot(spark, out, 7)
