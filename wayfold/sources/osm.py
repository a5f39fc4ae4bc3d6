"""Street-map change files and their sequence."""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHANGES = "path string, action string, id long, node_refs array<long>, tags map<string,string>, coordinates array<struct<lat:double,lon:double>>"
_ARROW = pa.schema([("path", pa.string()), ("action", pa.string()), ("id", pa.int64()), ("node_refs", pa.list_(pa.int64())), ("tags", pa.map_(pa.string(), pa.string())), ("coordinates", pa.list_(pa.struct([("lat", pa.float64()), ("lon", pa.float64())])))])


def changes(content: bytes) -> Iterator[dict]:
    """Changed ways of one file, coordinates of those of their nodes that the same file has, in order of reference."""
    raw = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
    nodes: dict[int, dict] = {}
    ways: list[dict] = []
    action = None
    for event, e in ElementTree.iterparse(io.BytesIO(raw), events=("start", "end")):
        if event == "start":
            action = e.tag if e.tag in ("create", "modify", "delete") else action
        elif e.tag == "node":
            if "lat" in e.attrib and "lon" in e.attrib:
                nodes[int(e.get("id"))] = {"lat": float(e.get("lat")), "lon": float(e.get("lon"))}
            e.clear()
        elif e.tag == "way":
            ways.append({"action": action, "id": int(e.get("id")), "node_refs": [int(x.get("ref")) for x in e.iter("nd")], "tags": {x.get("k"): x.get("v") for x in e.iter("tag")}})
            e.clear()
    for w in ways:
        yield {**w, "tags": list(w["tags"].items()), "coordinates": [nodes[i] for i in w["node_refs"] if i in nodes]}


def read_changes(spark: SparkSession, path: str) -> DataFrame:
    """Way changes of all .osc and .osc.gz files under ``path``; one file is read whole by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in (r for b in batches for r in b.to_pylist()):
            yield pa.RecordBatch.from_pylist([{"path": r["path"], **c} for c in changes(r["content"])], schema=_ARROW)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, CHANGES)


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """(sequence long, timestamp string) of a state file; null for lines it lacks."""
    text = spark.read.text(path, wholetext=True)
    find = lambda p: F.nullif(F.regexp_extract("value", p, 1), F.lit(""))
    return text.select(find(r"(?m)^sequenceNumber=(\d+)").cast("long").alias("sequence"), F.replace(find(r"(?m)^timestamp=(\S+)"), F.lit("\\:"), F.lit(":")).alias("timestamp"))


def change_url(base: Column, sequence: Column) -> Column:
    """The address of a numbered change file: three groups of three digits."""
    three = lambda x: F.lpad((x % 1000).cast("int").cast("string"), 3, "0")
    return F.concat(F.rtrim(base, F.lit("/")), F.lit("/"), three(F.floor(sequence / 1000000)), F.lit("/"), three(F.floor(sequence / 1000)), F.lit("/"), three(sequence), F.lit(".osc.gz"))
