"""Realtime feeds: the public protocol-buffer messages, decoded where the files are read."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

UPDATES = "feed_id string, entity_id string, trip_id string, trip_delay int, relationship int, stop_sequence int, stop_id string, arrival_delay int, departure_delay int, stop_relationship int"
VEHICLES = "feed_id string, entity_id string, trip_id string, vehicle_id string, lat float, lon float, stop_sequence int, stop_id string, status int, ts long, occupancy int"


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message; groups are not part of these feeds. A message that is cut short raises."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or varint()
        if at + size > len(data):
            raise ValueError("message is cut short")
        yield key >> 3, data[at : at + size]
        at += size


def message(data: bytes) -> dict[int, list]:
    out: dict[int, list] = {}
    for number, value in fields(data):
        out.setdefault(number, []).append(value)
    return out


def _sub(m: dict, number: int) -> dict:
    return message(m[number][-1]) if number in m else {}


def _text(m: dict, number: int) -> str | None:
    return m[number][-1].decode("utf-8", "replace") if number in m else None


def _int(m: dict, number: int) -> int | None:
    """Whole numbers of 32 bits, negative ones sent as 64 bits."""
    return (m[number][-1] + (1 << 31)) % (1 << 32) - (1 << 31) if number in m else None


def _float(m: dict, number: int) -> float | None:
    return struct.unpack("<f", m[number][-1])[0] if number in m else None


# Fixed values below: field numbers of the public realtime format.
def updates(data: bytes) -> Iterator[tuple]:
    for e in (message(x) for x in message(data).get(2, [])):
        if 3 not in e:
            continue
        u = _sub(e, 3)
        trip = _sub(u, 1)
        head = (_text(e, 1), _text(trip, 1), _int(u, 5), _int(trip, 4))
        stops = [message(s) for s in u.get(2, [])]
        if not stops:
            yield (*head, None, None, None, None, None)
        for s in stops:
            yield (*head, _int(s, 1), _text(s, 4), _int(_sub(s, 2), 1), _int(_sub(s, 3), 1), _int(s, 5))


def vehicles(data: bytes) -> Iterator[tuple]:
    for e in (message(x) for x in message(data).get(2, [])):
        if 4 not in e:
            continue
        v = _sub(e, 4)
        place = _sub(v, 2)
        ts = v[5][-1] if 5 in v else None
        yield (_text(e, 1), _text(_sub(v, 1), 1), _text(_sub(v, 8), 1), _float(place, 1), _float(place, 2), _int(v, 3), _text(v, 7), _int(v, 4), ts, _int(v, 9))


def read_messages(spark: SparkSession, feed_id: str, path: str, kind: str) -> DataFrame:
    """Rows of ``kind`` (updates or vehicles) of all message files under ``path``; an empty file has none."""
    schema, decode = {"updates": (UPDATES, updates), "vehicles": (VEHICLES, vehicles)}[kind]
    names = [c.split()[0] for c in schema.split(", ")]
    types = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "float": pa.float32()}
    arrow = pa.schema([(c.split()[0], types[c.split()[1]]) for c in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for content in (x for b in batches for x in b.column("content").to_pylist()):
            yield pa.RecordBatch.from_pylist([dict(zip(names, (feed_id, *r), strict=True)) for r in decode(content)], schema=arrow)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)
