"""Daily means per account, and what is counted on them."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window, functions as F

from dayweave.functions import strict_mean
from dayweave.spec import PanelSpec


def _means(spec: PanelSpec, skip_missing: bool):
    return [
        (F.avg(m.column) if skip_missing else strict_mean(m.column)).alias(m.mean)
        for m in spec.measures
    ]


def daily_mean(df: DataFrame, spec: PanelSpec, skip_missing: bool = False) -> DataFrame:
    """One row per account and day with the mean of each score.

    A mean is missing if any score of that account-day is, unless `skip_missing`. This is
    the collapse of `mean_on_rows` to distinct rows, written as the aggregate it amounts
    to: partial sums are formed before the only shuffle.
    """
    return df.groupBy(*spec.account_day).agg(*_means(spec, skip_missing))


def mean_on_rows(df: DataFrame, spec: PanelSpec, skip_missing: bool = False) -> DataFrame:
    """Every row with the means of its account-day attached.

    A window over the account-day would put all its rows in one task. Here the means come from
    the aggregate and are joined to the rows, and missing keys are equal in that join. Adaptive
    execution splits the rows of a large account-day over several tasks, each of which gets a
    copy of the one row it joins with.
    """
    keys, means = spec.account_day, spec.means
    daily = df.groupBy(*keys).agg(*_means(spec, skip_missing))
    daily = daily.withColumnsRenamed({k: f"__{k}" for k in keys})
    same = reduce(and_, [df[k].eqNullSafe(daily[f"__{k}"]) for k in keys])
    return df.join(daily, same, "left").select(*[df[c] for c in df.columns], *means)


def active_days(daily: DataFrame, spec: PanelSpec) -> DataFrame:
    """Number of days on which each account has a daily row."""
    return daily.groupBy(*spec.series).agg(F.count(F.lit(1)).alias("n"))


def min_active_days(daily: DataFrame, spec: PanelSpec, least: int) -> DataFrame:
    """Accounts with at least `least` active days."""
    return active_days(daily, spec).where(F.col("n") >= least)


def drop_sparse(daily: DataFrame, spec: PanelSpec, least: int) -> DataFrame:
    """Daily rows of the accounts with at least `least` active days."""
    days = F.count(F.lit(1)).over(Window.partitionBy(*spec.series))
    return daily.withColumn("__days", days).where(F.col("__days") >= least).drop("__days")
