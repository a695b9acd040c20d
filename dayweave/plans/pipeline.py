"""From scored posts to daily tables, wide CSV files and curves, for all panels at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from dayweave.operators.accounts import ANY_DIFFERS, drop_accounts
from dayweave.operators.calendar import complete_days, panel_bounds, series_offset, zero_fill
from dayweave.operators.daily import active_days, daily_mean
from dayweave.operators.panels import with_day, with_panel_code
from dayweave.operators.smooth import daily_sums, fit_curves, with_month_label
from dayweave.operators.tables import as_table, key_schema
from dayweave.operators.windows import account_span, clip_to_window, common_window
from dayweave.functions import series_name
from dayweave.plans.elections import Elections
from dayweave.sources import materialize, read_scored_csv, scratch_space, write_sorted, write_wide_csv
from dayweave.spec import SCORED_POSTS as SPEC

HANDLE = "user_username"
COMPUTED = "computed"


def scored_rows(
    spark: SparkSession,
    path: str | Sequence[str],
    config: Elections,
    handles: bool = False,
    quoted_newlines: bool = True,
) -> DataFrame:
    """The typed rows of all panels with their day; `handles` keeps the account handle too."""
    extra = [HANDLE] if handles else []
    read = read_scored_csv(spark, path, SPEC, extra=extra, quoted_newlines=quoted_newlines)
    rows = with_day(read, SPEC)
    return drop_accounts(rows, SPEC, config.dropped_first)


def kept_accounts(daily: DataFrame, config: Elections, mode: str = ANY_DIFFERS) -> DataFrame:
    """The daily table without the dropped accounts.

    `mode` decides about the lists of several accounts. The default keeps what differs from
    any listed name, hence all of them; ALL_DIFFER drops the listed accounts.
    """
    daily = drop_accounts(daily, SPEC, config.dropped)
    return drop_accounts(daily, SPEC, config.dropped_if_all, mode)


def wide_series(kept: DataFrame, config: Elections) -> DataFrame:
    """Zero-filled series of the accounts of the wide tables: file name, column, t, day, value."""
    completed = complete_days(kept, SPEC, panel_bounds(kept, SPEC), config.wide)
    series = with_panel_code(series_offset(zero_fill(completed, SPEC), SPEC), SPEC, config.codes)
    order = [(*pick[:-1], position) for position, pick in enumerate(config.wide)]
    positions = as_table(series, order, key_schema(series, SPEC.series).add("position", "integer"))
    election = F.split_part("panel", F.lit("_"), F.lit(1))
    return series.join(positions, SPEC.series).select(
        F.concat_ws("_", F.lit("VARdf"), "panel", "measure").alias("name"),
        "position",
        series_name(election, F.col("alias"), F.col("measure")).alias("column"),
        "t",
        SPEC.day,
        "value",
    )


def curves(rows: DataFrame, windows: DataFrame | Sequence[tuple], config: Elections) -> DataFrame:
    """Smoothed curve of each account and score inside the windows.

    Rows are summed per account-day first and the sums are clipped. Where handles are present,
    one account is left out of the Analytic curves.
    """

    def fitted(rows: DataFrame, labels: tuple[str, ...] | None = None) -> DataFrame:
        return fit_curves(clip_to_window(daily_sums(rows, SPEC, labels), SPEC, windows), SPEC, labels)

    if HANDLE in rows.columns:
        analytic = drop_accounts(rows, SPEC, config.dropped_handles, column=HANDLE)
        curve = fitted(rows, ("Spon",)).unionByName(fitted(analytic, ("An",)))
    else:
        curve = fitted(rows)
    return with_month_label(with_panel_code(curve, SPEC, config.codes))


def run(
    spark: SparkSession,
    path: str | Sequence[str],
    out: str,
    config: Elections,
    mode: str = ANY_DIFFERS,
    handles: bool = False,
    quoted_newlines: bool = True,
    windows: DataFrame | Sequence[tuple] | str | None = None,
    exclude: DataFrame | Sequence[tuple] = (),
    folder: str | None = None,
) -> None:
    """Read the CSV once and write every result below `out`.

    `windows` are the stated ones unless given; COMPUTED takes the days on which all accounts of
    a panel are active, leaving out `exclude`. Intermediate tables lie in `folder`, or where the
    session keeps them, and are deleted at the end. With `quoted_newlines=False`, for input
    without line breaks in fields, large files are read by many tasks.
    """
    with scratch_space(spark, "run", folder) as space:
        rows = materialize(scored_rows(spark, path, config, handles, quoted_newlines), "rows", space)
        account_span(rows, SPEC).write.parquet(f"{out}/account_span")

        daily = materialize(daily_mean(rows, SPEC), "daily", space)
        if windows is None:
            windows = config.windows
        elif isinstance(windows, str):
            windows = common_window(daily, SPEC, exclude)
        coded = with_panel_code(clip_to_window(daily, SPEC, windows), SPEC, config.codes)
        write_sorted(coded, f"{out}/daily", "panel", [SPEC.account, SPEC.day])
        clipped = spark.read.parquet(f"{out}/daily").drop("panel")
        active_days(clipped, SPEC).write.parquet(f"{out}/active_days")

        series = wide_series(kept_accounts(clipped, config, mode), config)
        write_sorted(series, f"{out}/series", "name", ["position", "t"])
        write_wide_csv(spark.read.parquet(f"{out}/series"), f"{out}/wide")
        write_sorted(curves(rows, windows, config), f"{out}/curves", "panel", [SPEC.account, "measure", "grid_idx"])
