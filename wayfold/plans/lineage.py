"""Tables in the folder that driver and executors share: they cut the lineage of iterative plans."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_runs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a temporary folder (one machine, so all share it); on a cluster that
    would be a folder other machines cannot read, so it raises. The session's own settings are never changed.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found and not sc._jsc.sc().isLocal():
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (found or f"{tempfile.gettempdir()}/wayfold-shared").rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """This application's own folder in the shared one; deleted when the driver's JVM ends."""
    app = spark.sparkContext.applicationId
    if app not in _runs:
        _runs[app] = f"{shared_dir(spark)}/wayfold/{app}-{uuid.uuid4().hex[:8]}"
        path = spark._jvm.org.apache.hadoop.fs.Path(_runs[app])
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
    return _runs[app]


def written(df: DataFrame, files: int | None = None) -> DataFrame:
    """Write to this run's shared folder and read back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{uuid.uuid4().hex}"
    (df.coalesce(files) if files else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete all tables of this run now; frames that still read them fail afterwards."""
    found = _runs.pop(spark.sparkContext.applicationId, None)
    if found:
        path = spark._jvm.org.apache.hadoop.fs.Path(found)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
