"""A timetable network derived from the star-schema tables, as SQL that Spark and DuckDB both read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
_POS = "(VALUES (0), (1), (2), (3), (4), (5), (6), (7)) AS p(pos)"

#: name -> definition; later ones read earlier ones. {dow}: day of week, Sunday 0. Every customer asks.
VIEWS = {
    "d_n": "SELECT CAST(count(*) AS INT) AS n FROM supplier",
    "d_stops": """SELECT CAST(s_suppkey AS INT) AS stop_index, s_name AS stop_name, CAST(s_nationkey AS INT) AS feed_index,
        CAST(41.8 AS DOUBLE) + (s_suppkey % 25) * CAST(0.0019 AS DOUBLE) AS lat,
        CAST(12.4 AS DOUBLE) + ((s_suppkey - s_suppkey % 25) / 25) * CAST(0.0023 AS DOUBLE) AS lon FROM supplier""",
    "d_trips": """SELECT CAST(o_orderkey AS BIGINT) AS trip_index, CAST(c_nationkey AS INT) AS route_index,
        CAST(c_nationkey * 5 + CAST(substr(o_orderpriority, 1, 1) AS INT) - 1 AS INT) AS line_index,
        CAST((o_orderkey * 977) % 86400 AS INT) AS start_s, CAST({dow} AS INT) AS service_dow
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "d_lines": "SELECT line_index, min(route_index) AS route_index FROM d_trips GROUP BY line_index",
    "d_line_stops": f"""SELECT line_index, pos, CAST((line_index * 17 + pos * (1 + line_index % 3)) % n AS INT) AS stop_index
        FROM d_lines CROSS JOIN {_POS} CROSS JOIN d_n""",
    "d_stop_times": """SELECT trip_index, t.line_index, pos, stop_index, service_dow,
        CAST(start_s + pos * 150 + 30 * ((t.line_index + pos) % 3) AS INT) AS arr_s,
        CAST(start_s + pos * 150 + 30 * ((t.line_index + pos) % 3) + CASE WHEN pos BETWEEN 1 AND 6 THEN 20 ELSE 0 END AS INT) AS dep_s
        FROM d_trips t JOIN d_line_stops l ON t.line_index = l.line_index""",
    "d_rt": """SELECT trip_index, pos, max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS canceled,
        max(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS skipped,
        max(CASE WHEN event_type NOT IN ('error', 'view') THEN CAST(floor(value) AS INT) * 10 - 600 END) AS delay_s
        FROM (SELECT (event_id * 31) % (SELECT count(*) FROM orders) AS trip_index, CAST(user_id % 8 AS INT) AS pos, event_type, value FROM events) e
        GROUP BY trip_index, pos""",
    "d_queries": """SELECT CAST(c_custkey AS INT) AS query_id, CAST((c_custkey * 7) % n AS INT) AS from_stop,
        CAST((c_custkey * 13 + 5) % n AS INT) AS to_stop, CAST(21600 + (c_custkey * 1511) % 57600 AS INT) AS dep_s
        FROM customer CROSS JOIN d_n""",
    "d_pairs": """SELECT a.stop_index AS from_stop, b.stop_index AS to_stop,
        2 * CAST(6371000 AS DOUBLE) * atan2(sqrt({hav}), sqrt(1 - ({hav}))) AS d
        FROM d_stops a JOIN d_stops b ON a.stop_index <> b.stop_index AND abs(a.lat - b.lat) < 0.0041 AND abs(a.lon - b.lon) < 0.0055""",
    "d_transfers": """SELECT from_stop, to_stop, dur_s, dist_m FROM (
        SELECT from_stop, to_stop, CAST(ceil(d / 1.35) AS INT) AS dur_s, round(d, 3) AS dist_m,
        row_number() OVER (PARTITION BY from_stop ORDER BY ceil(d / 1.35), to_stop) AS r FROM d_pairs WHERE d <= 450) x WHERE r <= 12""",
    "d_legs": """SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY dep_s, trip_index) AS INT) AS leg_no, kind, from_stop, to_stop,
        trip_index, board_pos, alight_pos, dep_s, arr_s FROM (SELECT CAST(o_custkey AS INT) AS query_id, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 1 END AS kind,
        b.stop_index AS from_stop, a.stop_index AS to_stop, b.trip_index, b.pos AS board_pos, a.pos AS alight_pos, b.dep_s, a.arr_s FROM orders
        JOIN d_stop_times b ON b.trip_index = o_orderkey AND b.pos = o_orderkey % 4 JOIN d_stop_times a ON a.trip_index = o_orderkey AND a.pos = o_orderkey % 4 + 1 + o_orderkey % 3) x""",
    "d_places": """SELECT query_id, lat + CAST(0.0007 AS DOUBLE) AS lat, lon + CAST(0.0005 AS DOUBLE) AS lon FROM d_queries JOIN d_stops ON stop_index = from_stop""",
    "d_changes": """SELECT event_id AS sequence, CAST(user_id % n AS INT) AS way_id, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'modify' END AS action
        FROM events CROSS JOIN d_n""",
}
_HAV = "power(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * power(sin(radians(b.lon - a.lon) / 2), 2)"


def definitions(dialect: str) -> dict[str, str]:
    dow = "dayofweek(o_orderdate) - 1" if dialect == "spark" else "extract(dow FROM o_orderdate)"
    return {k: v.replace("{dow}", dow).replace("{hav}", _HAV) for k, v in VIEWS.items()}


def duck(sql: str, recursive: bool = False) -> str:
    """A DuckDB query with the definitions it needs in front."""
    defs, need, todo = definitions("duckdb"), set(), [sql]
    while todo:
        text = todo.pop()
        for name in defs:
            if name not in need and re.search(rf"\b{name}\b", text):
                need.add(name)
                todo.append(defs[name])
    ctes = ", ".join(f"{k} AS ({v})" for k, v in defs.items() if k in need)
    body = sql.strip()
    if re.match(r"(?i)with\b", body):
        body = re.sub(r"(?i)^with\s+(recursive\s+)?", "", body)
        return f"WITH {'RECURSIVE ' * recursive}{ctes}{', ' if ctes else ''}{body}"
    return f"WITH {ctes} {body}" if ctes else body


def network(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """All tables and derived tables as DataFrames; names are bound to this folder when a table is made."""
    out = {}
    for t in TABLES:
        out[t] = spark.read.parquet(f"{sf_dir}/{t}.parquet")
        out[t].createOrReplaceTempView(t)
    for name, sql in definitions("spark").items():
        out[name] = spark.sql(sql)
        out[name].createOrReplaceTempView(name)
    return out
