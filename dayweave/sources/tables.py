"""Parquet tables in a real order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F


def write_sorted(df: DataFrame, path: str, folder: str, order: Sequence[str]) -> None:
    """Write one folder per value of `folder`, its files in the order of `order`.

    Rows are range-partitioned by both, so a folder has few files, a large one several, and its
    files in the order of their names hold ascending ranges.
    """
    keys = [folder, *order]
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.partitionBy(folder).parquet(path)


def read_in_order(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table with the `file` and `row` of each row, which give the order it is stored in."""
    read = spark.read.parquet(path)
    return read.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
