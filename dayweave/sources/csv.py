"""CSV of scored records: UTF-8, header, comma, doubled quotes, NA for missing."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession, functions as F

from dayweave.sources.csv_ranges import csv_records
from dayweave.spec import PanelSpec

# A text no field can equal, so that empty fields and NA stay apart while parsing.
_NO_VALUE = "\u0001"
_FORMAT = {"encoding": "UTF-8", "quote": '"', "escape": '"', "nullValue": _NO_VALUE, "emptyValue": ""}


def read_scored_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    spec: PanelSpec,
    extra: Sequence[str] = (),
    quoted_newlines: bool = True,
    by_ranges: bool = False,
) -> DataFrame:
    """The panel keys, account, scores and time of `spec`, and the `extra` columns.

    Columns are found by header name, wherever they stand; files whose header differs from
    that of the first are an error. Scores are doubles; everything else is text, in which
    NA is missing and an empty field is an empty string. A score that is no number is
    missing.

    Spark's reader does not split a file whose fields may contain line breaks: one task reads it.
    For large files set `by_ranges`, which finds the records of all ranges of a file at once
    (see `csv_records`), or `quoted_newlines=False` if no field has a line break.
    """
    raw = (
        spark.read.options(header=True, enforceSchema=False, multiLine=quoted_newlines, **_FORMAT)
        .csv(path if isinstance(path, str) else list(path))
    )
    if by_ranges:
        raw = _parsed(csv_records(spark, path), raw.columns).select(*raw.columns)
    scores = [m.column for m in spec.measures]
    texts = [*spec.panel, spec.account]

    def text(name):
        value = F.coalesce(name, F.lit(""))
        return F.when(value != "NA", value).alias(name)

    def number(name):
        return F.trim(name).try_cast("double").alias(name)

    return raw.select(
        *[text(c) for c in texts],
        *[number(c) for c in scores],
        text(spec.time),
        *[text(c) for c in extra],
    )


def read_with_position(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Every column as text, NA and empty fields as written, with `file` and `row` (from 1) of each record."""
    columns = spark.read.options(header=True, multiLine=True, **_FORMAT).csv(path if isinstance(path, str) else list(path)).columns
    return _parsed(csv_records(spark, path), columns)


def _parsed(records: DataFrame, columns: list[str]) -> DataFrame:
    """The fields of records below the header; the header of each file must have these columns."""
    schema = ", ".join(f"c{i} string" for i in range(len(columns)))
    fields = F.from_csv("record", schema, _FORMAT)
    wrong = [F.coalesce(F.lower(F.col("__fields")[f"c{i}"]), F.lit("")) != c.lower() for i, c in enumerate(columns)]
    message = F.concat(F.lit("the header differs from that of the first file in "), F.col("file"))
    header = F.when(reduce(or_, wrong), F.raise_error(message).cast("boolean")).otherwise(F.lit(False))
    below = records.withColumn("__fields", fields).where(F.when(F.col("row") == 0, header).otherwise(F.lit(True)))
    return below.select("file", "row", *[F.col("__fields")[f"c{i}"].alias(c) for i, c in enumerate(columns)])


def write_scored_csv(df: DataFrame, path: str) -> None:
    """Write records so that `read_scored_csv` gives them back, but for a text that is NA,
    which comes back missing: the format has no other way to write a missing text."""
    (
        df.write.option("header", True)
        .option("encoding", "UTF-8")
        .option("quote", '"')
        .option("escape", '"')
        .option("nullValue", "NA")
        .option("emptyValue", '""')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
