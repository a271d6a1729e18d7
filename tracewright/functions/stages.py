"""The folder that driver and executors share, and tables written there."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    A local master without the setting (tests) gets a folder of its own; a
    cluster without it is refused, as executors could not read each other's files.
    """
    place = spark.conf.get("spark.checkpoint.dir", None)
    if place:
        return place.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder."""
    return f"{shared_dir(spark)}/tracewright-{uuid.uuid4().hex}/{name}"


def _parent(spark: SparkSession, path: str):
    """The folder above a path, and its file system."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
    return folder, folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def forget_at_exit(spark: SparkSession, path: str) -> None:
    """Has a scratch table removed when the driver ends; lazily read results need it until then."""
    folder, system = _parent(spark, path)
    system.deleteOnExit(folder)


class Stage:
    """A table written to the shared folder and read again: lineage is cut there,
    a lost executor costs only the tasks that read it, and Python work above it
    runs once however often the table is used."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = scratch_path(self.spark, name)
        df.write.option("compression", "zstd").parquet(self.path)
        self.schema = df.schema
        forget_at_exit(self.spark, self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        folder, system = _parent(self.spark, self.path)
        system.delete(folder, True)
