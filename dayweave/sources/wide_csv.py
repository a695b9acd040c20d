"""Wide CSV files: one file per panel and score, one column per account, no date column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from dayweave.functions import csv_number

HEADER = -1


def write_wide_csv(series: DataFrame, path: str, file: str = "name") -> None:
    """Write all wide files in one job.

    `series` has one row per value: `name` of the file, `position` and `column` of the
    account, offset `t`, `value`. Each file becomes a folder `name=<file>` with one part:
    a quoted header starting with an empty name, then the quoted row number from 1 and the
    values, NA where an account has no row. A file has one line per calendar day, so one task
    per file is enough.
    """
    quoted = F.concat(F.lit('"'), F.regexp_replace("column", '"', '""'), F.lit('"'))
    # As many entries as the file has columns.
    columns = series.groupBy(file).agg(
        F.sort_array(F.collect_set(F.struct("position", quoted.alias("text")))).alias("columns")
    )
    header = columns.select(file, F.lit(HEADER).alias("t"), F.col("columns.text").alias("cells"))
    cell = F.struct("position", csv_number(F.col("value")).alias("text"))
    body = series.groupBy(file, "t").agg(F.map_from_entries(F.collect_list(cell)).alias("found"))
    filled = F.transform("columns", lambda c: F.coalesce(F.element_at("found", c["position"]), F.lit("NA")))
    body = body.join(columns, file).select(file, "t", filled.alias("cells"))
    number = F.when(F.col("t") == HEADER, "").otherwise((F.col("t") + 1).cast("string"))
    lines = header.unionByName(body).select(
        file,
        "t",
        F.concat_ws(",", F.concat(F.lit('"'), number, F.lit('"')), F.col("cells")).alias("line"),
    )
    (
        lines.repartition(file)
        .sortWithinPartitions(file, "t")
        .select(file, "line")
        .write.partitionBy(file)
        .text(path)
    )


def read_wide_csv(spark: SparkSession, path: str) -> DataFrame:
    """One wide file as written; the row number comes back as column `row`."""
    raw = spark.read.option("header", True).option("nullValue", "NA").csv(path)
    row, *columns = raw.columns
    return raw.select(
        F.col(f"`{row}`").cast("int").alias("row"),
        *[F.col(f"`{c}`").cast("double").alias(c) for c in columns],
    )
