"""When accounts are active, the window in which all of a panel's accounts are, and
clipping to it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from dayweave.functions import strict
from dayweave.operators.tables import as_table, key_schema
from dayweave.spec import PanelSpec


def account_span(df: DataFrame, spec: PanelSpec, skip_missing: bool = False) -> DataFrame:
    """First and last day of every account; missing if any of its days is, unless skipped."""

    def span(aggregate):
        return aggregate(spec.day) if skip_missing else strict(aggregate, spec.day)

    return df.groupBy(*spec.series).agg(
        span(F.min).alias("min_val"), span(F.max).alias("max_val")
    )


def common_window(
    df: DataFrame, spec: PanelSpec, exclude: DataFrame | Sequence[tuple] = ()
) -> DataFrame:
    """Per panel the days on which all accounts are active: from the latest first day to the
    earliest last day. `exclude` lists (panel keys, account) that must not narrow it, such as
    late starters. Panels whose accounts never overlap give no row."""
    spans = account_span(df, spec, skip_missing=True)
    if isinstance(exclude, DataFrame) or exclude:
        spans = spans.join(as_table(df, exclude, key_schema(df, spec.series)), spec.series, "left_anti")
    return (
        spans.groupBy(*spec.panel)
        .agg(F.max("min_val").alias("lo"), F.min("max_val").alias("hi"))
        .where(F.col("lo") <= F.col("hi"))
    )


def clip_to_window(
    df: DataFrame,
    spec: PanelSpec,
    windows: DataFrame | Sequence[tuple],
    broadcast: bool = False,
) -> DataFrame:
    """Rows whose day lies in the window of their panel, both ends included.

    `windows` has the panel keys, `lo` and `hi`. A panel without a window is dropped, and a
    window with a missing bound holds no row. Windows given as a list also put their overall
    range on the scan as a literal filter, so files and row groups outside all of them are not
    read. Clip daily tables rather than raw rows where both give the same; where raw rows must
    be clipped to a computed window, `broadcast` says that the caller knows the panels to be
    few, and keeps Spark from shuffling the rows before it has seen that.
    """
    day = df.schema[spec.day].dataType
    schema = key_schema(df, spec.panel).add("lo", day).add("hi", day)
    if not isinstance(windows, DataFrame):
        windows = [w for w in windows if None not in w[-2:]]
        if not windows:
            return df.where(F.lit(False))
        lo, hi = min(w[-2] for w in windows), max(w[-1] for w in windows)
        df = df.where(F.col(spec.day).between(F.lit(lo), F.lit(hi)))
    table = as_table(df, windows, schema).withColumnsRenamed({"lo": "__lo", "hi": "__hi"})
    clipped = df.join(F.broadcast(table) if broadcast else table, list(spec.panel))
    return clipped.where(F.col(spec.day).between(F.col("__lo"), F.col("__hi"))).drop("__lo", "__hi")
