"""Timetable feeds: ZIP files of CSV tables, and the static model built from them."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The columns read of each table.
COLUMNS = {
    "stops": "stop_id string, stop_code string, stop_name string, stop_lat double, stop_lon double",
    "routes": "route_id string, route_short_name string, route_long_name string, route_type int, route_color string, route_text_color string",
    "trips": "trip_id string, route_id string, service_id string, shape_id string, trip_headsign string",
    "stop_times": "trip_id string, stop_sequence int, stop_id string, arrival_time string, departure_time string, shape_dist_traveled float",
    "shapes": "shape_id string, shape_pt_sequence int, shape_pt_lat double, shape_pt_lon double, shape_dist_traveled float",
    "calendar": "service_id string, monday int, tuesday int, wednesday int, thursday int, friday int, saturday int, sunday int, start_date string, end_date string",
    "calendar_dates": "service_id string, date string, exception_type int",
}
_DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


def read_table(spark: SparkSession, feeds: dict[str, str], table: str, batch: int = 50_000) -> DataFrame:
    """feed_index, feed_id and the columns of ``table`` from every feed's ZIP; feeds are numbered in their order.

    One task a feed: it streams the CSV out of the ZIP in batches, so a table never stands whole in memory. A
    missing table or column gives no rows or nulls; empty fields are null. Paths must be readable by executors.
    """
    names = [c.split()[0] for c in COLUMNS[table].split(", ")]
    text = ", ".join(f"{c} string" for c in names)

    def unzip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for feed in (r for b in batches for r in b.to_pylist()):
            with zipfile.ZipFile(io.FileIO(feed["path"])) as z:
                inside = next((x for x in z.namelist() if x.rsplit("/", 1)[-1] == f"{table}.txt"), None)
                if inside is None:
                    continue
                with z.open(inside) as raw:
                    rows = csv.DictReader(io.TextIOWrapper(raw, "utf-8-sig", newline=""), skipinitialspace=True)
                    rows.fieldnames = [x.strip() for x in rows.fieldnames or []]
                    part: list[dict] = []
                    for row in rows:
                        part.append(row)
                        if len(part) == batch:
                            yield pack(feed, part)
                            part = []
                    if part:
                        yield pack(feed, part)

    def pack(feed: dict, rows: list[dict]) -> pa.RecordBatch:
        n = len(rows)
        cols = [pa.array([feed["feed_index"]] * n, pa.int32()), pa.array([feed["feed_id"]] * n, pa.string())]
        cols += [pa.array([(r.get(c) or "").strip() or None for r in rows], pa.string()) for c in names]
        return pa.RecordBatch.from_arrays(cols, names=["feed_index", "feed_id", *names])

    listed = spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(feeds.items())], "feed_index int, feed_id string, path string")
    rows = listed.repartition(max(1, len(feeds)), "feed_index").mapInArrow(unzip, f"feed_index int, feed_id string, {text}")
    out = rows.select("feed_index", "feed_id", *(F.col(c.split()[0]).cast(c.split()[1]) for c in COLUMNS[table].split(", ")))
    return repair_exceptions(out) if table == "calendar_dates" else out


def repair_exceptions(dates: DataFrame) -> DataFrame:
    """Exception type 0 means removed; types other than 1 and 2 are dropped."""
    fixed = dates.withColumn("exception_type", F.when(F.col("exception_type") == 0, 2).otherwise(F.col("exception_type")))
    return fixed.where(F.col("exception_type").isin(1, 2))


def seconds(text) -> F.Column:
    """H:MM:SS after the service day's midnight, hours past 24 allowed."""
    part = F.split(text, ":")
    return (part[0].cast("int") * 3600 + part[1].cast("int") * 60 + part[2].cast("int")).cast("int")


def service_days(calendar: DataFrame, dates: DataFrame) -> DataFrame:
    """(feed_index, service_date, service_id): weekdays of each service's range, then additions and removals.

    A service that starts after it ends has no weekdays; a day both added and removed is removed.
    """
    on = F.element_at(F.array(*_DAYS), (F.weekday("service_date") + 1).cast("int"))
    day = lambda c: F.to_date(c, "yyyyMMdd")
    spans = calendar.where(day("start_date") <= day("end_date"))
    week = spans.withColumn("service_date", F.explode(F.sequence(day("start_date"), day("end_date")))).where(on == 1).select("feed_index", "service_date", "service_id")
    ex = dates.select("feed_index", day("date").alias("service_date"), "service_id", "exception_type")
    added = ex.where("exception_type = 1").drop("exception_type")
    gone = ex.where("exception_type = 2").drop("exception_type")
    keys = ["feed_index", "service_date", "service_id"]
    return week.unionByName(added).distinct().join(gone, keys, "left_anti")


def static_model(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """stops, routes, trips, stop_times with dense ids by (feed, local id), and lines.

    A stop's name is its trimmed name, else its id. A missing arrival is the departure and the reverse; a stop
    time with neither, or one naming an unknown stop, raises. Trips with fewer than two stop times are dropped
    after numbering. A line is a route with one sequence of stops. Numbering is two-level (see ``dense``), so no
    window spans all rows.
    """
    full = lambda c: F.concat_ws(":", "feed_id", c)
    name = F.coalesce(F.nullif(F.trim("stop_name"), F.lit("")), F.col("stop_id"))
    blob = F.lower(F.concat_ws(" ", full("stop_id"), "stop_id", F.coalesce("stop_code", F.lit("")), "feed_id", name))
    stops = dense(tables["stops"], "stop_id", "stop_index").select("stop_index", "feed_index", "stop_id", full("stop_id").alias("global_name"), name.alias("stop_name"), F.col("stop_lat").alias("lat"), F.col("stop_lon").alias("lon"), blob.alias("search_blob"))
    colour = lambda c: F.when(F.col(c).isNotNull(), F.concat(F.lit("#"), F.upper(c))).alias(c)
    routes = dense(tables["routes"], "route_id", "route_index").select("route_index", "feed_index", "route_id", "route_short_name", "route_long_name", "route_type", colour("route_color"), colour("route_text_color"))
    known = F.assert_true(F.col("stop_index").isNotNull(), F.lit("a stop time names an unknown stop"))
    timed = F.assert_true(F.coalesce("arrival_time", "departure_time").isNotNull(), F.lit("a stop time has neither arrival nor departure"))
    times = tables["stop_times"].join(stops.select("feed_index", "stop_id", "stop_index"), ["feed_index", "stop_id"], "left").where(known.isNull() & timed.isNull())
    order = Window.partitionBy("feed_index", "trip_id").orderBy("stop_sequence")
    times = times.select("feed_index", "trip_id", "stop_index", "stop_sequence", (F.row_number().over(order) - 1).alias("pos"), seconds(F.coalesce("arrival_time", "departure_time")).alias("arr_s"), seconds(F.coalesce("departure_time", "arrival_time")).alias("dep_s"), F.col("shape_dist_traveled").alias("shape_dist"))
    shape = times.groupBy("feed_index", "trip_id").agg(F.array_sort(F.collect_list(F.struct("pos", "stop_index"))).alias("s")).where(F.size("s") >= 2).select("feed_index", "trip_id", F.transform("s", lambda x: x["stop_index"]).alias("stop_sequence"))
    trips = dense(tables["trips"], "trip_id", "trip_index").join(routes.select("feed_index", "route_id", "route_index"), ["feed_index", "route_id"]).join(shape, ["feed_index", "trip_id"])
    lines = trips.groupBy("route_index", "stop_sequence").agg(F.min("trip_index").alias("line_index"), F.count("*").alias("n_trips"))
    trips = trips.join(lines.select("route_index", "stop_sequence", "line_index"), ["route_index", "stop_sequence"]).select("trip_index", "feed_index", "trip_id", "route_index", "line_index", "service_id", "shape_id", "trip_headsign")
    times = times.join(trips.select("feed_index", "trip_id", "trip_index", "line_index"), ["feed_index", "trip_id"]).select("trip_index", "line_index", "pos", "stop_index", "arr_s", "dep_s", "stop_sequence", "shape_dist")
    return {"stops": stops, "routes": routes, "trips": trips, "lines": lines, "stop_times": times}


def dense(df: DataFrame, local: str, index: str) -> DataFrame:
    """0, 1, 2 ... by (feed_index, local id) in byte order: rows are ranked within their feed and earlier feeds counted."""
    within = F.row_number().over(Window.partitionBy("feed_index").orderBy(local)) - 1
    sizes = df.groupBy("feed_index").agg(F.count("*").alias("n"))
    starts = sizes.withColumn("start", F.coalesce(F.sum("n").over(Window.orderBy("feed_index").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    return df.withColumn("rank", within).join(starts, "feed_index").withColumn(index, (F.col("start") + F.col("rank")).cast("long")).drop("rank", "start")
