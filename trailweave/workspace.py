"""Shared-folder tables that cut lineage between the steps of a job.

Small results that many later steps read (the directly-follows graph, the state of
a loop) are written as Parquet below the folder the cluster names in
``spark.checkpoint.dir``.  A written table survives the loss of executors, is computed
exactly once, and gives the optimizer true sizes, so whether a join side is broadcast
is always decided from the size of the data and never by a hint.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables, read from the session.

    Only a local master, as in tests, may fall back to a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="trailweave-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path below the application's own folder, which may go when the application ends."""
    return f"{shared_folder(spark)}/trailweave/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write ``df`` once and return a scan of what was written."""
    path = path or fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize_measured(
    df: DataFrame, label: str, path: str | None = None, **measures: Column
) -> tuple[DataFrame, dict]:
    """Like ``materialize``; the aggregates in ``measures`` come from the same pass."""
    observation = Observation(f"{label}-{uuid.uuid4().hex}")
    watched = df.observe(observation, *[m.alias(name) for name, m in measures.items()])
    return materialize(watched, label, path), observation.get


class TableSeries:
    """Tables of one schema, written round by round, that can be read back as one scan."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.label = spark, label
        self.folder = fresh_path(spark, label)
        self.schema = None
        self.count = 0

    def add(self, df: DataFrame, **measures: Column) -> tuple[DataFrame, dict]:
        self.count += 1
        self.schema = df.schema
        return materialize_measured(df, self.label, f"{self.folder}/round-{self.count:04d}", **measures)

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", True).parquet(self.folder)


def discard(df: DataFrame) -> None:
    """Delete the files below the shared folder that ``df``, made by ``materialize``, scans."""
    spark = df.sparkSession
    own = f"{shared_folder(spark)}/trailweave/{spark.sparkContext.applicationId}/"
    folders = {path.rsplit("/", 1)[0] for path in df.inputFiles()}
    for folder in folders:
        if own.split(":", 1)[-1].lstrip("/") in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
