"""Operators on street graphs: edges of ways, changes laid over them, bounded paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine
from ..plans.lineage import written

#: Fixed value: the longest duration of an edge, seconds.
MOST_EDGE_S = 65535


def way_edges(points: DataFrame, speed: Column) -> DataFrame:
    """(src, dst, way_id, metres, dur_s) both ways along (way_id, pos, node, lat, lon); steps of no length go."""
    w = Window.partitionBy("way_id").orderBy("pos")
    step = points.select("way_id", F.col("node").alias("src"), F.lead("node").over(w).alias("dst"), "lat", "lon", F.lead("lat").over(w).alias("la"), F.lead("lon").over(w).alias("lo"))
    step = step.withColumn("metres", haversine(F.col("lat"), F.col("lon"), F.col("la"), F.col("lo"))).where("metres > 0")
    dur = F.least(F.greatest(F.ceil(F.col("metres") / speed), F.lit(1)), F.lit(MOST_EDGE_S)).cast("int")
    one = step.select("src", "dst", "way_id", "metres", dur.alias("dur_s"))
    return one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "way_id", "metres", "dur_s"))


def latest(changes: DataFrame) -> DataFrame:
    """The last change of each way by its sequence."""
    return changes.groupBy("way_id").agg(F.max(F.struct("sequence", "action")).alias("m")).select("way_id", "m.sequence", "m.action")


def overlay(edges: DataFrame, changes: DataFrame, made: DataFrame) -> DataFrame:
    """Edges after changes: every touched way is blocked, and ways created or modified bring the edges in ``made``."""
    last = latest(changes)
    alive = last.where("action <> 'delete'").select("way_id")
    kept = edges.join(last.select("way_id"), "way_id", "left_anti")
    return kept.unionByName(made.join(alive, "way_id", "left_semi")).select(*edges.columns)


def needed_overrides(base: DataFrame, made: DataFrame) -> DataFrame:
    """Overrides that differ from the base; an override equal to it is dropped. Both: (way_id, cells)."""
    same = base.select("way_id", F.col("cells").alias("base"))
    return made.join(same, "way_id", "left").where(~F.col("cells").eqNullSafe(F.col("base"))).drop("base")


def bounded_paths(edges: DataFrame, roots: DataFrame, most: int) -> DataFrame:
    """(root, node, dist): the shortest paths no longer than ``most`` from every root, all at once.

    Each round expands only the labels that the last one improved, so it ends when none improves. Rows are bounded
    by what each root reaches within ``most``.
    """
    edges = written(edges.groupBy("src", "dst").agg(F.min("dur_s").alias("dur_s")))
    best = fresh = written(roots.select("root", F.col("root").alias("node"), F.lit(0).alias("dist")))
    while not fresh.isEmpty():
        step = fresh.withColumnRenamed("node", "src").join(edges, "src").select("root", F.col("dst").alias("node"), (F.col("dist") + F.col("dur_s")).alias("dist"))
        step = step.where(F.col("dist") <= most).groupBy("root", "node").agg(F.min("dist").cast("int").alias("dist"))
        old = best.withColumnRenamed("dist", "old")
        fresh = written(step.join(old, ["root", "node"], "left").where("old IS NULL OR dist < old").drop("old"))
        best = written(best.join(fresh, ["root", "node"], "left_anti").unionByName(fresh))
    return best
