"""Realtime snapshots: each micro-batch replaces the snapshot as a whole, readers are pinned to an epoch."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

After = Callable[[DataFrame | None, DataFrame, int], None]


def write_snapshots(stream: DataFrame, path: str, checkpoint: str, every: str | None = None, after: After | None = None):
    """foreachBatch sink: a batch is written to a folder of its own, then published by a row that names the folder.

    Readers look at published folders only, so they see a whole snapshot or the one before it. A batch that is tried
    again gets a new folder; folders are never written twice. ``every`` is the time between batches ("45 seconds"),
    without it the stream ends when all is read. ``after(before, now, epoch)`` is called once a snapshot is published.
    """

    def put(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        before = read_snapshot(spark, path) if after and published(spark, path) is not None else None
        folder = f"{epoch}-{uuid.uuid4().hex}"
        batch.write.parquet(f"{path}/data/{folder}")
        row = spark.range(1).select(F.lit(epoch).cast("long").alias("epoch"), F.lit(folder).alias("folder"), F.current_timestamp().alias("at"))
        row.coalesce(1).write.mode("append").parquet(f"{path}/published")
        if after:
            after(before, spark.read.parquet(f"{path}/data/{folder}"), epoch)

    trigger = {"processingTime": every} if every else {"availableNow": True}
    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def published(spark: SparkSession, path: str) -> DataFrame | None:
    """(epoch, folder, at) of every published snapshot; None before the first."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/published")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    return spark.read.schema("epoch long, folder string, at timestamp").parquet(f"{path}/published")


def read_snapshot(spark: SparkSession, path: str, epoch: int | None = None) -> DataFrame:
    """The snapshot of an epoch (the last one tried, of several), or the latest. Raises LookupError if there is none."""
    rows = published(spark, path)
    if rows is not None:
        rows = rows if epoch is None else rows.where(F.col("epoch") == epoch)
        last = rows.agg(F.max(F.struct("epoch", "at", "folder")).alias("m")).first()["m"]
        if last:
            return spark.read.parquet(f"{path}/data/{last['folder']}")
    raise LookupError(f"no snapshot{'' if epoch is None else f' of epoch {epoch}'} is published in {path}")
