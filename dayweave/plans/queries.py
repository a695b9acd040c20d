"""The operators as queries over the TPC-H-like test tables.

`lineitem` plays the scored posts: panel = (return flag, line status), account = supplier
or the supplier's nation, Spon = extended price, An = quantity with some values missing.
`events` gives dense 30-day calendars: panel = event type, account = user.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from dayweave.operators.accounts import (
    ANY_DIFFERS,
    drop_accounts,
    drop_everywhere,
    pick_accounts,
)
from dayweave.operators.calendar import (
    calendar,
    complete_days,
    panel_bounds,
    series_offset,
    wide_table,
    with_series_name,
    zero_fill,
)
from dayweave.operators.correlation import autocorrelation
from dayweave.operators.daily import (
    active_days,
    daily_mean,
    drop_sparse,
    mean_on_rows,
    min_active_days,
)
from dayweave.operators.panels import (
    distinct_values,
    first_seen,
    frequency_table,
    one_panel,
    panel_numbers,
    panel_sizes,
    with_bin,
    with_day,
    with_panel_code,
)
from dayweave.operators.smooth import INTERPOLATE, daily_sums, fit_curves, loess_curve, with_month_label
from dayweave.operators.stationarity import dickey_fuller
from dayweave.operators.vector_models import coefficients, granger_tests, impulse_responses, lagged_products
from dayweave.operators.windows import account_span, clip_to_window, common_window
from dayweave.functions import bin_of, bin_start, day_of, month_label
from dayweave.sources import (
    materialize,
    read_in_order,
    read_scored_csv,
    read_with_position,
    scratch_path,
    write_scored_csv,
    write_sorted,
    write_wide_csv,
)
from dayweave.spec import Measure, PanelSpec

LINES = PanelSpec(
    panel=("l_returnflag", "l_linestatus"),
    account="l_suppkey",
    time="l_shipdate",
    measures=(Measure("spon", "mean_spon", "Spon"), Measure("an", "mean_an", "An")),
)
NATIONS = PanelSpec(LINES.panel, "n_name", LINES.time, LINES.measures)
EVENTS = PanelSpec(("event_type",), "user_id", "ts", LINES.measures)
HOURLY = PanelSpec(("event_type",), "users", "at", LINES.measures[:1], day="hour")
DOCUMENTS = PanelSpec(("lang",), "doc_id", "source", (Measure("n_chars", "mean_chars", "Chars"),))

PANELS = [("A", "F"), ("A", "O"), ("N", "F"), ("N", "O"), ("R", "F"), ("R", "O")]
CODES = [(flag, status, flag + status) for flag, status in PANELS]
NATION_NAMES = [f"NATION_{i}" for i in range(25)]
NATION_PICKS = [(*p, n, n) for p in PANELS for n in NATION_NAMES]
ONE_PANEL_PICKS = [
    ("A", "F", "NATION_7", "Seventh"),
    ("A", "F", "NATION_2", "Second"),
    ("A", "F", "NATION_19", "Nineteenth"),
]
WINDOWS = [
    ("A", "F", date(1996, 1, 1), date(2000, 12, 31)),
    ("A", "O", date(1995, 6, 15), date(1999, 2, 28)),
    ("N", "F", date(1997, 3, 1), date(1997, 3, 31)),
    ("N", "O", date(1998, 1, 1), date(2001, 6, 30)),
    ("R", "F", date(1995, 2, 1), date(1996, 2, 29)),
]
LATE = [("A", "F", 3), ("N", "O", 5), ("R", "F", 8)]
DROPS = [("A", "F", 3), ("A", "F", 5), ("N", "O", 1), ("N", "O", 7), ("N", "O", 8)]
PICKS = [("A", "F", 4, "four"), ("A", "F", 2, "two"), ("N", "O", 4, "four"), ("R", "O", 9, "nine")]
# Types of events get windows inside, around, before and across their days; one gets none.
BOUNDS = [
    ("click", date(2024, 1, 14), date(2024, 1, 15)),
    ("error", date(2023, 12, 30), date(2024, 2, 2)),
    ("purchase", date(2023, 11, 1), date(2023, 11, 3)),
    ("signup", date(2024, 1, 20), date(2024, 2, 5)),
]
HOUR, QUARTER, GROUPS, LAGS = 3600, 900, 8, 24
VAR_LAGS, HORIZON, DF_LAGS = 2, 12, 6
UNNAMED = 4
STORED = ["file", "row"]
CHAIN_PICKS = [(*p, a, f"account {a}") for p in PANELS for a in (2, 4, 6)]
DROPPED_NAME = 5
TWO_NAMES = (3, 7)
LEAST_DAYS = 90


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        *LINES.series,
        F.col("l_extendedprice").alias("spon"),
        F.nullif("l_quantity", F.lit(13.0)).alias("an"),
        "l_shipdate",
    )
    return with_day(rows, LINES).drop("l_shipdate")


def nation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = _table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    supplier = _table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    named = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey)
    rows = lines(spark, sf_dir)
    return rows.join(named, rows.l_suppkey == named.s_suppkey).select(
        *NATIONS.account_day, "spon", "an"
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events").select(
        *EVENTS.series,
        "ts",
        F.col("value").alias("spon"),
        F.nullif(F.regexp_extract("props", r"(\d+)", 1).cast("double"), F.lit(13.0)).alias("an"),
    )
    return with_day(rows, EVENTS).drop("ts")


def named_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of which some have no account and some no number."""
    rows = lines(spark, sf_dir)
    return rows.withColumns({c: F.nullif(c, F.lit(UNNAMED)) for c in ("l_suppkey", "l_linenumber")})


def clipped(daily: DataFrame, spec: PanelSpec) -> DataFrame:
    """Clip a daily table to its common window, which is that of the rows. It is written first, so
    that the rows are scanned once: left to itself, the plan would shuffle them once with the
    scores and once without."""
    daily = materialize(daily, "daily")
    return clip_to_window(daily, spec, common_window(daily, spec))


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Round for comparison. Written out, because the rounding functions of two engines treat
    ties differently; ties, and what lies below them by a summing error only, go up."""
    scale = 10.0**digits
    return df.withColumns({c: F.floor(F.col(c) * scale + 0.501) / scale for c in columns})


def _rounded_means(df: DataFrame, spec: PanelSpec) -> DataFrame:
    return rounded(df, *spec.means)


# Fields, panels


def project_fields(spark, sf_dir):
    return lines(spark, sf_dir).select(*LINES.account_day, "spon", "an")


def day_from_text(spark, sf_dir):
    written = F.when(F.col("event_type") == "error", F.col("props")).otherwise(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    )
    rows = _table(spark, sf_dir, "events").select("event_id", written.alias("written"))
    return rows.select("event_id", "written", day_of("written", from_text=True).alias("day"))


def panel_values(spark, sf_dir):
    return distinct_values(lines(spark, sf_dir), "l_returnflag")


def _stored_lines(spark, sf_dir):
    return read_in_order(spark, f"{sf_dir}/lineitem.parquet").select(*LINES.series, *STORED)


def first_seen_values(spark, sf_dir):
    return first_seen(_stored_lines(spark, sf_dir), ["l_returnflag"], STORED)


def first_seen_accounts(spark, sf_dir):
    """Some accounts have no name; that is a value too."""
    rows = _stored_lines(spark, sf_dir).withColumn("l_suppkey", F.nullif("l_suppkey", F.lit(UNNAMED)))
    return first_seen(rows, LINES.series, STORED)


def panel_numbers_query(spark, sf_dir):
    return panel_numbers(_stored_lines(spark, sf_dir), LINES, STORED)


def panel_sizes_query(spark, sf_dir):
    return panel_sizes(lines(spark, sf_dir), LINES)


def one_panel_query(spark, sf_dir):
    return one_panel(lines(spark, sf_dir), LINES, "A", "F")


def panel_codes(spark, sf_dir):
    coded = with_panel_code(lines(spark, sf_dir), LINES, CODES)
    return coded.select("l_orderkey", "l_linenumber", "panel")


def frequency_table_query(spark, sf_dir):
    return frequency_table(lines(spark, sf_dir), LINES, "l_linenumber")


# Spans, windows, clipping


def account_span_query(spark, sf_dir):
    """Strict: an account that has a row without a day has no span."""
    undated = (F.col("l_linenumber") == 7) & (F.col("l_suppkey") % 3 == 0)
    rows = lines(spark, sf_dir).withColumn("day", F.when(~undated, F.col("day")))
    return account_span(rows, LINES)


def common_window_query(spark, sf_dir):
    return common_window(lines(spark, sf_dir), LINES)


def common_window_excluding(spark, sf_dir):
    return common_window(lines(spark, sf_dir), LINES, exclude=LATE)


def clip_to_window_query(spark, sf_dir):
    rows = lines(spark, sf_dir)
    # Six panels: the rows need not be shuffled to meet their windows.
    return clip_to_window(rows, LINES, common_window(rows, LINES), broadcast=True)


def clip_given_windows(spark, sf_dir):
    return clip_to_window(lines(spark, sf_dir), LINES, WINDOWS)


# Daily means


def daily_mean_strict(spark, sf_dir):
    return _rounded_means(clipped(daily_mean(lines(spark, sf_dir), LINES), LINES), LINES)


def daily_mean_skip_missing(spark, sf_dir):
    daily = daily_mean(nation_lines(spark, sf_dir), NATIONS, skip_missing=True)
    return _rounded_means(daily, NATIONS)


def daily_mean_rows(spark, sf_dir):
    return _rounded_means(mean_on_rows(lines(spark, sf_dir), LINES), LINES)


def distinct_rows(spark, sf_dir):
    rows = mean_on_rows(events(spark, sf_dir), EVENTS)
    return _rounded_means(rows.select(*EVENTS.account_day, *EVENTS.means), EVENTS).distinct()


def active_days_query(spark, sf_dir):
    return active_days(daily_mean(lines(spark, sf_dir), LINES), LINES)


def min_active_days_query(spark, sf_dir):
    return min_active_days(daily_mean(lines(spark, sf_dir), LINES), LINES, LEAST_DAYS)


def drop_sparse_accounts(spark, sf_dir):
    daily = daily_mean(lines(spark, sf_dir), LINES)
    return _rounded_means(drop_sparse(daily, LINES, LEAST_DAYS), LINES)


# Accounts by name


def drop_account(spark, sf_dir):
    return drop_everywhere(named_lines(spark, sf_dir), "l_suppkey", DROPPED_NAME)


def drop_any_ne_literal(spark, sf_dir):
    return drop_accounts(named_lines(spark, sf_dir), LINES, DROPS, mode=ANY_DIFFERS)


def drop_any_ne_one_table(spark, sf_dir):
    return drop_everywhere(named_lines(spark, sf_dir), "l_suppkey", *TWO_NAMES, mode=ANY_DIFFERS)


def drop_accounts_intended(spark, sf_dir):
    return drop_accounts(named_lines(spark, sf_dir), LINES, DROPS)


def drop_by_other_column(spark, sf_dir):
    drops = [("A", "F", 1), ("R", "O", 2)]
    return drop_accounts(named_lines(spark, sf_dir), LINES, drops, column="l_linenumber")


def pick_accounts_query(spark, sf_dir):
    return pick_accounts(lines(spark, sf_dir), LINES, PICKS)


# Calendars and series


def panel_bounds_query(spark, sf_dir):
    return panel_bounds(lines(spark, sf_dir), LINES)


def calendar_query(spark, sf_dir):
    rows = lines(spark, sf_dir)
    return calendar(panel_bounds(rows, LINES), LINES)


def month_label_query(spark, sf_dir):
    return calendar_query(spark, sf_dir).withColumn("month", month_label("day"))


def _completed(rows):
    """Written once, the daily table gives the bounds too, and the rows are scanned once."""
    daily = materialize(daily_mean(rows, EVENTS), "daily")
    return complete_days(daily, EVENTS, panel_bounds(daily, EVENTS))


def _completed_events(spark, sf_dir):
    return _completed(events(spark, sf_dir))


def complete_days_query(spark, sf_dir):
    return _rounded_means(_completed_events(spark, sf_dir), EVENTS)


def complete_days_given_bounds(spark, sf_dir):
    daily = daily_mean(events(spark, sf_dir), EVENTS)
    return _rounded_means(complete_days(daily, EVENTS, BOUNDS), EVENTS)


def zero_filled(spark, sf_dir):
    """Some scores are not a number, and so are the means of their days."""
    rows = events(spark, sf_dir)
    broken = F.pmod(F.floor("spon"), F.lit(5)) == 0
    rows = rows.withColumn("spon", F.when(broken, F.lit(float("nan"))).otherwise(F.col("spon")))
    return _rounded_means(zero_fill(_completed(rows), EVENTS), EVENTS)


def series_offset_query(spark, sf_dir):
    filled = zero_fill(_completed_events(spark, sf_dir), EVENTS)
    return rounded(series_offset(filled, EVENTS), "value")


def series_names(spark, sf_dir):
    filled = zero_fill(_completed_events(spark, sf_dir), EVENTS)
    aliased = filled.withColumn("alias", F.col("user_id").cast("string"))
    named = with_series_name(series_offset(aliased, EVENTS), "event_type")
    return rounded(named.select("series", "t", "day", "value"), "value")


def _wide(rows, label, picks, prefix=""):
    # Collapsing to days first and clipping then is the same, and reads the input once.
    spec = NATIONS.only(label)
    daily = clipped(daily_mean(rows, spec), spec)
    wide = wide_table(daily, spec, label, picks, panel_bounds(daily, spec), prefix)
    return rounded(wide, *wide.columns[4:])


def wide_spon(spark, sf_dir):
    return _wide(nation_lines(spark, sf_dir), "Spon", NATION_PICKS)


def wide_an(spark, sf_dir):
    return _wide(nation_lines(spark, sf_dir), "An", NATION_PICKS)


def wide_one_panel(spark, sf_dir):
    rows = one_panel(nation_lines(spark, sf_dir), NATIONS, "A", "F")
    return _wide(rows, "Spon", ONE_PANEL_PICKS, prefix="AF_")


# Bins of other widths than a day


def _hourly(spark, sf_dir):
    """Scores by type of event, group of users and hour; times are text, some of it no time."""
    rows = _table(spark, sf_dir, "events").select(
        "event_id",
        "event_type",
        F.pmod("user_id", F.lit(GROUPS)).alias("users"),
        F.when(F.col("event_id") % 50 == 7, F.col("props")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("at"),
        F.col("value").alias("spon"),
    )
    return with_bin(rows, HOURLY, HOUR)


def bins_from_text(spark, sf_dir):
    """Bins of a quarter of an hour."""
    rows = _hourly(spark, sf_dir).select("event_id", bin_of("at", True, QUARTER).alias("number"))
    return rows.select("event_id", "number", F.date_format(bin_start("number", QUARTER), "yyyy-MM-dd HH:mm:ss").alias("starts"))


def hourly_window(spark, sf_dir):
    window = common_window(_hourly(spark, sf_dir), HOURLY)
    return window.select("event_type", *[F.date_format(bin_start(c, HOUR), "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("lo", "hi")])


def hourly_completed(spark, sf_dir):
    """The hours in which all groups are active, each group with every hour."""
    hourly = materialize(daily_mean(_hourly(spark, sf_dir), HOURLY), "hourly")
    inside = clip_to_window(hourly, HOURLY, common_window(hourly, HOURLY))
    filled = zero_fill(complete_days(inside, HOURLY, panel_bounds(inside, HOURLY)), HOURLY)
    starts = F.date_format(bin_start("hour", HOUR), "yyyy-MM-dd HH:mm:ss").alias("starts")
    return rounded(filled.select("event_type", "users", starts, "t", "mean_spon", "was_filled_Spon"), "mean_spon")


# Structure in time


def _hourly_series(spark, sf_dir):
    hourly = materialize(daily_mean(_hourly(spark, sf_dir), HOURLY), "hourly")
    dated = hourly.where(F.col("hour").isNotNull())
    return zero_fill(complete_days(dated, HOURLY, panel_bounds(dated, HOURLY)), HOURLY)


def autocorrelations(spark, sf_dir):
    """Of hourly means, lags of up to a day. Some series have a missing value, one type of event no variation."""
    kind = F.col("event_type")
    gap = (kind == "click") & (F.col("users") == 3) & (F.col("t") == 5)
    value = F.when(kind == "signup", 1.0).when(~gap, F.col("mean_spon"))
    series = _hourly_series(spark, sf_dir).withColumn("mean_spon", value)
    return rounded(autocorrelation(series, HOURLY.series, "t", "mean_spon", LAGS), "acf", "pacf")


def unit_roots(spark, sf_dir):
    """Of hourly means, whether each series is likely to wander."""
    found = dickey_fuller(_hourly_series(spark, sf_dir), HOURLY.series, "t", "mean_spon", DF_LAGS, trend=True)
    return rounded(found, *found.columns[4:])


def _hourly_products(spark, sf_dir):
    return lagged_products(_hourly_series(spark, sf_dir), HOURLY.panel, "users", "t", "mean_spon", VAR_LAGS)


def var_coefficients(spark, sf_dir):
    """Each group's hourly mean from those of all groups in the hours before."""
    found = coefficients(_hourly_products(spark, sf_dir), HOURLY.panel).drop("std_error")
    return rounded(found, "coefficient")


def var_granger(spark, sf_dir):
    return rounded(granger_tests(_hourly_products(spark, sf_dir), HOURLY.panel), "f", "p")


def var_responses(spark, sf_dir):
    return rounded(impulse_responses(_hourly_products(spark, sf_dir), HOURLY.panel, HORIZON), "response")


# Curves


def loess_curve_query(spark, sf_dir):
    curve = fit_curves(clipped(daily_sums(lines(spark, sf_dir), LINES), LINES), LINES)
    return rounded(curve, "x_day", "fit", digits=4)


def loess_interpolated(spark, sf_dir):
    days = clipped(daily_sums(lines(spark, sf_dir), LINES), LINES)
    return rounded(fit_curves(days, LINES, surface=INTERPOLATE), "x_day", "fit", digits=4)


def loess_events(spark, sf_dir):
    curve = with_month_label(loess_curve(events(spark, sf_dir), EVENTS, labels=("Spon",)))
    return rounded(curve, "x_day", "fit", digits=4)


# CSV in and out


def _csv_round_trip(spark, sf_dir, quoted_newlines):
    path = scratch_path(spark, "scored")
    rows = _table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        *LINES.series,
        F.col("l_extendedprice").alias("spon"),
        F.nullif("l_quantity", F.lit(13.0)).alias("an"),
        F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("l_shipdate"),
    )
    write_scored_csv(rows, path)
    read = read_scored_csv(
        spark, path, LINES, extra=("l_orderkey", "l_linenumber"), quoted_newlines=quoted_newlines
    )
    return with_day(read, LINES)


def csv_round_trip(spark, sf_dir):
    return _csv_round_trip(spark, sf_dir, quoted_newlines=True)


def csv_round_trip_split(spark, sf_dir):
    """Read by as many tasks as the files have splits, as no field has a line break."""
    return _csv_round_trip(spark, sf_dir, quoted_newlines=False)


def csv_text_round_trip(spark, sf_dir):
    path = scratch_path(spark, "documents")
    write_scored_csv(_table(spark, sf_dir, "documents"), path)
    return read_scored_csv(spark, path, DOCUMENTS, extra=("text",))


def csv_text_by_ranges(spark, sf_dir):
    """As many tasks as the files have ranges, though texts have line breaks."""
    path = scratch_path(spark, "documents")
    write_scored_csv(_table(spark, sf_dir, "documents"), path)
    return read_scored_csv(spark, path, DOCUMENTS, extra=("text",), by_ranges=True)


def csv_first_seen(spark, sf_dir):
    """Files hold ascending ids, so the order of files and rows is that of ids."""
    path = scratch_path(spark, "documents")
    write_scored_csv(_table(spark, sf_dir, "documents").orderBy("doc_id"), path)
    return first_seen(read_with_position(spark, path), ["lang", "source"], STORED)


def _wide_csv(spark, sf_dir, rows_kept=None):
    path = scratch_path(spark, "wide")
    daily = daily_mean(nation_lines(spark, sf_dir), NATIONS)
    completed = complete_days(daily, NATIONS, panel_bounds(daily, NATIONS), NATION_PICKS)
    series = series_offset(zero_fill(completed, NATIONS), NATIONS)
    named = with_series_name(with_panel_code(series, NATIONS, CODES), "panel")
    position = F.array_position(F.array(*[F.lit(n) for n in NATION_NAMES]), F.col("alias"))
    cells = named.select(
        F.concat_ws("_", F.lit("VARdf"), "panel", "measure").alias("name"),
        position.alias("position"),
        F.col("series").alias("column"),
        "t",
        "value",
    )
    write_wide_csv(cells if rows_kept is None else cells.where(rows_kept), path)
    columns = ", ".join(f"{n} double" for n in NATION_NAMES)
    read = spark.read.csv(path, header=True, nullValue="NA", schema=f"row int, {columns}, name string")
    return rounded(read, *NATION_NAMES)


def wide_csv_sink(spark, sf_dir):
    return _wide_csv(spark, sf_dir)


def wide_csv_uneven(spark, sf_dir):
    """Every second account starts late, every third ends early, every fifth has a hole."""
    late = (F.col("position") % 2 == 0) & (F.col("t") < 40)
    early = (F.col("position") % 3 == 0) & (F.col("t") > 500)
    hole = (F.col("position") % 5 == 0) & F.col("t").between(100, 120)
    return _wide_csv(spark, sf_dir, ~(late | early | hole))


# Whole chains


def panel_pipeline(spark, sf_dir):
    """Window, clip, means, drops, calendar of the kept accounts, completion, series.

    The accounts whose first or last day bounds the window are dropped after the clip, so the
    calendar of the kept ones is shorter than the window.
    """
    daily = daily_mean(lines(spark, sf_dir), LINES)
    window = common_window(daily, LINES, exclude=LATE)
    inside = clip_to_window(daily, LINES, window)
    ends = account_span(daily, LINES, skip_missing=True).join(window, list(LINES.panel))
    bounding = ends.where((F.col("min_val") == F.col("lo")) | (F.col("max_val") == F.col("hi")))
    kept = drop_accounts(inside, LINES, bounding.select(*LINES.series))
    completed = complete_days(kept, LINES, panel_bounds(kept, LINES), CHAIN_PICKS)
    return rounded(series_offset(zero_fill(completed, LINES), LINES), "value")


def daily_sorted(spark, sf_dir):
    """The place of every row of the sorted sink, read from its files."""
    path = scratch_path(spark, "sorted")
    coded = with_panel_code(daily_mean(lines(spark, sf_dir), LINES), LINES, CODES)
    write_sorted(coded.drop(*LINES.panel), path, "panel", ["l_suppkey", "day"])
    read = spark.read.parquet(path)
    stored = Window.partitionBy("panel").orderBy("_metadata.file_name", "_metadata.row_index")
    return read.select("panel", "l_suppkey", "day", F.row_number().over(stored).alias("place"))


QUERIES = {
    "project_fields": project_fields,
    "day_from_text": day_from_text,
    "panel_values": panel_values,
    "first_seen_values": first_seen_values,
    "first_seen_accounts": first_seen_accounts,
    "panel_numbers": panel_numbers_query,
    "panel_sizes": panel_sizes_query,
    "one_panel": one_panel_query,
    "panel_codes": panel_codes,
    "frequency_table": frequency_table_query,
    "account_span": account_span_query,
    "common_window": common_window_query,
    "common_window_excluding": common_window_excluding,
    "clip_to_window": clip_to_window_query,
    "clip_given_windows": clip_given_windows,
    "daily_mean_strict": daily_mean_strict,
    "daily_mean_skip_missing": daily_mean_skip_missing,
    "daily_mean_rows": daily_mean_rows,
    "distinct_rows": distinct_rows,
    "active_days": active_days_query,
    "min_active_days": min_active_days_query,
    "drop_sparse_accounts": drop_sparse_accounts,
    "drop_account": drop_account,
    "drop_any_ne_literal": drop_any_ne_literal,
    "drop_any_ne_one_table": drop_any_ne_one_table,
    "drop_accounts_intended": drop_accounts_intended,
    "drop_by_other_column": drop_by_other_column,
    "pick_accounts": pick_accounts_query,
    "panel_bounds": panel_bounds_query,
    "calendar": calendar_query,
    "month_label": month_label_query,
    "complete_days": complete_days_query,
    "complete_days_given_bounds": complete_days_given_bounds,
    "zero_filled": zero_filled,
    "series_offset": series_offset_query,
    "series_names": series_names,
    "bins_from_text": bins_from_text,
    "hourly_window": hourly_window,
    "hourly_completed": hourly_completed,
    "autocorrelations": autocorrelations,
    "unit_roots": unit_roots,
    "var_coefficients": var_coefficients,
    "var_granger": var_granger,
    "var_responses": var_responses,
    "wide_spon": wide_spon,
    "wide_an": wide_an,
    "wide_one_panel": wide_one_panel,
    "loess_curve": loess_curve_query,
    "loess_interpolated": loess_interpolated,
    "loess_events": loess_events,
    "csv_round_trip": csv_round_trip,
    "csv_round_trip_split": csv_round_trip_split,
    "csv_text_round_trip": csv_text_round_trip,
    "csv_text_by_ranges": csv_text_by_ranges,
    "csv_first_seen": csv_first_seen,
    "wide_csv_sink": wide_csv_sink,
    "wide_csv_uneven": wide_csv_uneven,
    "panel_pipeline": panel_pipeline,
    "daily_sorted": daily_sorted,
}
