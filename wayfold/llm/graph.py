"""Connected components without the driver: union-find inside batches, star contraction between them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over each Arrow batch: its edges become (member, smallest member) edges, fewer and shallower."""
    for batch in batches:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            root = x
            while (p := parent.setdefault(root, root)) != root:
                root = p
            while parent[x] != root:
                parent[x], x = root, parent[x]
            return root

        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(u), find(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
        out = [(x, find(x)) for x in list(parent)]
        out = np.array([(x, r) for x, r in out if x != r], np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], names=["u", "v"])


def connected_components(edges: DataFrame) -> DataFrame:
    """(u long, v long) edges -> (id, component): each id that has an edge, and the smallest id it reaches.

    Each round contracts batches by union-find, then does a large-star and a small-star step. Minima are
    aggregated before the shuffle, so a vertex with very many edges sends one row a task; the joins on it
    are plain equi-joins that adaptive execution splits. Edges and components never come to the driver:
    it sees three counts a round. Rounds go on until nothing is left to contract; there are at most about the
    logarithm of the longest chain squared. Self-loops and null ends are ignored; an empty table gives an empty one.
    """
    forest = edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v")
    forest = materialize(forest.mapInArrow(_forest, "u long, v long").distinct())
    while True:
        roots = forest.select(F.col("v").alias("u")).distinct()
        n = forest.agg(F.count("*").alias("rows"), F.countDistinct("u").alias("ids")).first()
        deep = forest.join(roots, "u", "left_semi").count()
        if n["rows"] == n["ids"] and not deep:
            break
        both = forest.unionByName(forest.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
        small = small.select(F.col("e.u").alias("u"), F.col("e.m").alias("v")).where("u <> v")
        forest = materialize(small.mapInArrow(_forest, "u long, v long").distinct())
    return forest.select(F.col("u").alias("id"), F.col("v").alias("component"))
