"""Splitting a table into panels. Panels are key columns of one table, never one
DataFrame per panel, so every later step handles all panels in one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from dayweave.functions import bin_of, day_of
from dayweave.operators.tables import as_table, key_schema
from dayweave.operators.totals import running_totals
from dayweave.spec import PanelSpec


def with_day(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Add the calendar day derived from the time column."""
    from_text = isinstance(df.schema[spec.time].dataType, T.StringType)
    return df.withColumn(spec.day, day_of(spec.time, from_text))


def with_bin(df: DataFrame, spec: PanelSpec, seconds: int) -> DataFrame:
    """Add the number of the bin of the time column, in the place of the day.

    Bins are whole numbers, one for every `seconds`. Spans, windows, means, calendars and
    completion take them like days; `bin_start` gives their times.
    """
    from_text = isinstance(df.schema[spec.time].dataType, T.StringType)
    return df.withColumn(spec.day, bin_of(spec.time, from_text, seconds))


def one_panel(df: DataFrame, spec: PanelSpec, *values) -> DataFrame:
    """The rows of one panel; rows with a missing key belong to none."""
    for key, value in zip(spec.panel, values, strict=True):
        df = df.where(F.col(key) == F.lit(value))
    return df


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def first_seen(
    df: DataFrame, columns: Sequence[str], position: Sequence[str], place: str = "place", folder: str | None = None
) -> DataFrame:
    """The distinct values of `columns` with their `place`, from 1, in the order in which they first occur.

    `position` names the columns that tell where a row stands, such as file and row; rows are
    ordered by them. A missing value is a value. The first position of each value is a partial
    aggregate, and places come from range partitions, so neither a frequent value nor the
    ranking of many values is one task.
    """
    firsts = df.groupBy(*columns).agg(F.min(F.struct(*position)).alias("__first"))
    return running_totals(firsts, [F.col("__first")], {place: F.lit(1)}, "first-seen", folder).drop("__first")


def panel_numbers(df: DataFrame, spec: PanelSpec, position: Sequence[str], number: str = "number") -> DataFrame:
    """The panels with the number they have when panels are listed by first-seen values of the
    panel keys, the last key running fastest; combinations without rows have numbers too."""
    panels = df.select(*spec.panel).distinct()
    count = F.lit(0).cast("long")
    for i, key in enumerate(spec.panel):
        ranked = first_seen(df, [key], position, f"__place{i}").withColumnRenamed(key, f"__key{i}")
        n = ranked.agg(F.max(f"__place{i}").alias("n")).scalar()
        panels = panels.join(ranked, F.col(key).eqNullSafe(F.col(f"__key{i}"))).drop(f"__key{i}")
        count = count * n + F.col(f"__place{i}") - 1
    return panels.select(*spec.panel, (count + 1).alias(number))


def panel_sizes(df: DataFrame, spec: PanelSpec) -> DataFrame:
    return df.groupBy(*spec.panel).agg(F.count(F.lit(1)).alias("n"))


def with_panel_code(
    df: DataFrame, spec: PanelSpec, codes: DataFrame | Sequence[tuple], code: str = "panel"
) -> DataFrame:
    """Name each panel by lookup in `codes` (panel keys, code); unlisted panels are left out."""
    schema = key_schema(df, spec.panel).add(code, "string")
    return df.join(as_table(df, codes, schema), list(spec.panel))


def frequency_table(df: DataFrame, spec: PanelSpec, column: str) -> DataFrame:
    """How often each value of `column` occurs in each panel; missing values are not counted."""
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(*spec.panel, column)
        .agg(F.count(F.lit(1)).alias("n"))
    )
