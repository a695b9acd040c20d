"""Where intermediate tables go."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def scratch_folder(spark: SparkSession, folder: str | None = None) -> str:
    """The folder for intermediate tables, which all executors must share.

    The argument decides, then the session's checkpoint directory, then spark.checkpoint.dir.
    Where none is set, a local run gets a temporary folder of its own and any other run an error.
    """
    named = folder or spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master.startswith("local") and not master.startswith("local-cluster"):
        return tempfile.mkdtemp(prefix="dayweave-")
    raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


def scratch_path(spark: SparkSession, name: str, folder: str | None = None) -> str:
    """A fresh path for one written table."""
    return f"{scratch_folder(spark, folder)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Write a table that several later steps read, so that its input is scanned once and
    the loss of an executor does not repeat that scan."""
    spark = df.sparkSession
    path = scratch_path(spark, name, folder)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch_space(spark: SparkSession, name: str, folder: str | None = None) -> Iterator[str]:
    """A folder for the tables of one job, deleted with them when the job is over."""
    path = scratch_path(spark, name, folder)
    try:
        yield path
    finally:
        delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a table or folder that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
