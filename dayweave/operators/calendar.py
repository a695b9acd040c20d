"""Gap-free series of days or bins: calendar, completion, zero fill, offset and wide tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from dayweave.functions import series_name
from dayweave.operators.accounts import pick_accounts
from dayweave.operators.tables import as_table, key_schema
from dayweave.spec import PanelSpec


def panel_bounds(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """First and last day of each panel over all its accounts.

    Rows and their daily means have the same bounds; on rows it takes one light scan.
    """
    return (
        df.where(F.col(spec.day).isNotNull())
        .groupBy(*spec.panel)
        .agg(F.min(spec.day).alias("lo"), F.max(spec.day).alias("hi"))
    )


def calendar(bounds: DataFrame, spec: PanelSpec) -> DataFrame:
    """Every day of each panel from its first to its last."""
    return bounds.select(*spec.panel, _each(bounds.schema["lo"].dataType, "lo", "hi").alias(spec.day))


def _each(day: T.DataType, start: str, end: str) -> Column:
    """One row per day, or per bin; needs start <= end. The outer form avoids an emptiness test
    that would build every sequence twice."""
    step = F.lit(1).cast("long") if isinstance(day, T.LongType) else F.expr("interval 1 day")
    return F.explode_outer(F.sequence(start, end, step))


def _since(day: T.DataType, column: str, start: str) -> Column:
    """Days, or bins, from `start` on."""
    return (F.col(column) - F.col(start)).cast("int") if isinstance(day, T.LongType) else F.datediff(column, start)


def complete_days(
    daily: DataFrame,
    spec: PanelSpec,
    bounds: DataFrame | Sequence[tuple],
    accounts: DataFrame | Sequence[tuple] | None = None,
) -> DataFrame:
    """A row for every account and every day of its panel; means are NULL on added days.

    Equal to a left join of the calendar with each account's daily rows, but only rows that
    exist are shuffled: each account's rows, at most one per day, are sorted, and every row
    generates itself and the gap that follows it. An account with rows outside the bounds only
    gets a full empty series; a panel without bounds is dropped. `accounts` (panel keys,
    account, alias) keeps only those accounts, and gives a full empty series to those without
    any row.
    """
    day = daily.schema[spec.day].dataType
    rows = daily.where(F.col(spec.day).isNotNull())
    names = list(spec.series)
    if accounts is not None:
        names.append("alias")
        listed = as_table(daily, accounts, key_schema(daily, spec.series).add("alias", "string"))
        rows = rows.join(listed, spec.series).unionByName(listed, allowMissingColumns=True)
    rows = rows.join(as_table(daily, bounds, _bounds_schema(daily, spec)), list(spec.panel))
    # A row without a day stands for its account alone, and so do rows outside the bounds.
    rows = rows.withColumn(spec.day, F.when(F.col(spec.day).between(F.col("lo"), F.col("hi")), F.col(spec.day)))

    by_day = Window.partitionBy(*names).orderBy(F.col(spec.day).asc_nulls_first())
    own, following = F.col(spec.day), F.lead(spec.day).over(by_day)
    before = F.col("__next") - 1 if isinstance(day, T.LongType) else F.date_sub("__next", 1)
    means = [F.when(F.col("__day") == own, F.col(m)).alias(m) for m in spec.means]
    return (
        rows.withColumns(
            {
                "__first": F.row_number().over(by_day) == 1,
                "__more": F.lead(F.lit(True)).over(by_day).isNotNull(),
                "__next": following,
            }
        )
        # Of several rows without a day the last one goes on to the first day there is.
        .where(own.isNotNull() | F.col("__next").isNotNull() | ~F.col("__more"))
        .withColumns(
            {
                "__from": F.when(own.isNull() | F.col("__first"), F.col("lo")).otherwise(own),
                "__to": F.coalesce(before, F.col("hi")),
            }
        )
        .where(F.col("__from") <= F.col("__to"))
        .withColumn("__day", _each(day, "__from", "__to"))
        .select(
            *names,
            F.col("__day").alias(spec.day),
            _since(day, "__day", "lo").alias("t"),
            *means,
        )
    )


def _bounds_schema(df: DataFrame, spec: PanelSpec):
    day = df.schema[spec.day].dataType
    return key_schema(df, spec.panel).add("lo", day).add("hi", day)


def zero_fill(completed: DataFrame, spec: PanelSpec) -> DataFrame:
    """Missing means (NULL or NaN) become 0.

    A filled 0 looks like a true one, so `was_filled_<label>` tells them apart.
    """
    flags = {
        f"was_filled_{m.label}": F.col(m.mean).isNull() | F.isnan(m.mean) for m in spec.measures
    }
    return completed.withColumns(flags).na.fill(0.0, spec.means)


def series_offset(filled: DataFrame, spec: PanelSpec) -> DataFrame:
    """One ordered series per account and score: (series key, t, day, measure, value)."""
    values = F.array(
        *[F.struct(F.lit(m.label).alias("measure"), F.col(m.mean).alias("value")) for m in spec.measures]
    )
    keys = [*spec.series, *(["alias"] if "alias" in filled.columns else []), "t", spec.day]
    return filled.select(*keys, F.inline(values))


def with_series_name(series: DataFrame, code: str) -> DataFrame:
    """Name each series <panel code>_<alias>_<measure>."""
    return series.withColumn(
        "series", series_name(F.col(code), F.col("alias"), F.col("measure"))
    )


def wide_table(
    daily: DataFrame,
    spec: PanelSpec,
    label: str,
    picks: Sequence[tuple],
    bounds: DataFrame | Sequence[tuple],
    prefix: str = "",
) -> DataFrame:
    """One row per panel day, one zero-filled column per alias, in the order of `picks`.

    Only existing daily rows are shuffled, once; the calendar, one row per panel and day,
    then supplies the days on which no picked account has a row.
    """
    mean = spec.measure(label).mean
    day_keys = [*spec.panel, spec.day]
    aliases = list(dict.fromkeys(p[-1] for p in picks))
    names = [f"{prefix}{a}_{label}" for a in aliases]
    by_day = (
        pick_accounts(daily, spec, picks)
        .groupBy(*day_keys)
        .agg(
            *[
                F.max(F.when(F.col("alias") == a, F.col(mean))).alias(n)
                for a, n in zip(aliases, names, strict=True)
            ]
        )
    )
    lo_hi = as_table(daily, bounds, _bounds_schema(daily, spec))
    panels = list(dict.fromkeys(tuple(p[: len(spec.panel)]) for p in picks))
    wanted = as_table(daily, panels, key_schema(daily, spec.panel))
    days = lo_hi.join(wanted, list(spec.panel), "left_semi").select(
        *spec.panel, "lo", _each(daily.schema[spec.day].dataType, "lo", "hi").alias(spec.day)
    )
    return (
        days.join(by_day, day_keys, "left")
        .select(*day_keys, _since(daily.schema[spec.day].dataType, spec.day, "lo").alias("t"), *names)
        .na.fill(0.0, names)
    )
