"""Dropping and picking accounts by name."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import DataFrame, functions as F, types as T

from dayweave.operators.tables import as_table, key_schema
from dayweave.spec import PanelSpec

ANY_DIFFERS = "any differs"
ALL_DIFFER = "all differ"


def drop_accounts(
    df: DataFrame,
    spec: PanelSpec,
    drops: DataFrame | Sequence[tuple],
    mode: str = ALL_DIFFER,
    column: str | None = None,
) -> DataFrame:
    """Drop the accounts listed as (panel keys, account) from their panels.

    ALL_DIFFER keeps rows whose account differs from every listed name. ANY_DIFFERS keeps
    rows whose account differs from at least one listed name; with two or more names that
    is every account. In both, a panel that has a list also loses the rows without an
    account name; panels without a list are untouched. A missing name in a list differs from
    nothing for certain: with ALL_DIFFER its panel loses all rows. `column` compares another
    column than the account.
    """
    column = column or spec.account
    name = T.StructField("__name", df.schema[column].dataType)
    schema = T.StructType([*key_schema(df, spec.panel).fields, name])
    if isinstance(drops, DataFrame):
        drops = drops.select(*spec.panel, F.col(drops.columns[-1]).alias("__name"))
    table = as_table(df, drops, schema)
    # One row per panel: how many names, and the only one if there is no other.
    panels = table.groupBy(*spec.panel).agg(
        F.count_distinct("__name").alias("__names"),
        F.min("__name").alias("__only"),
        F.max(F.col("__name").isNull()).alias("__unnamed"),
    )
    listed = df.join(panels, list(spec.panel), "left")
    differs = F.col("__names") > 1 if mode == ANY_DIFFERS else ~F.col("__unnamed")
    if mode == ANY_DIFFERS:
        differs = differs | ((F.col("__names") == 1) & (F.col(column) != F.col("__only")))
    kept = listed.where(F.col("__names").isNull() | (F.col(column).isNotNull() & differs)).select(*df.columns)
    if mode == ANY_DIFFERS:
        return kept
    names = table.withColumnsRenamed({k: f"__{k}" for k in spec.panel})
    same = [kept[k] == names[f"__{k}"] for k in spec.panel]
    return kept.join(names, reduce(and_, [*same, kept[column] == names["__name"]]), "left_anti")


def drop_everywhere(df: DataFrame, column: str, *names, mode: str = ALL_DIFFER) -> DataFrame:
    """The same filter without panels: compare `column` with the names in all rows."""
    differs = [F.col(column) != F.lit(n) for n in names]
    return df.where(reduce(or_ if mode == ANY_DIFFERS else and_, differs))


def pick_accounts(df: DataFrame, spec: PanelSpec, picks: DataFrame | Sequence[tuple]) -> DataFrame:
    """Rows of the accounts listed as (panel keys, account, alias), with their alias."""
    schema = key_schema(df, spec.series).add("alias", "string")
    return df.join(as_table(df, picks, schema), spec.series)
