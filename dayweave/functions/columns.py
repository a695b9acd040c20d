"""Column expressions; all built-in, so they stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def day_of(time: Column | str, from_text: bool) -> Column:
    """Calendar day of a timestamp, or of text that starts with one.

    Text is taken as written: the date part decides, no time zone is applied, and text
    that does not start with a valid date gives NULL.
    """
    time = F.col(time) if isinstance(time, str) else time
    if not from_text:
        return time.cast("date")
    written = F.regexp_extract(time, r"^\s*(\d{4}-\d{1,2}-\d{1,2})", 1)
    return written.try_cast("date")


ORIGIN = "1970-01-01 00:00:00"


def bin_of(time: Column | str, from_text: bool, seconds: int, origin: str = ORIGIN) -> Column:
    """Number of the bin of `seconds` that a time falls in, counted from `origin`; earlier ones are negative.

    Text is taken as written, like a day: no time zone is applied, a missing time of day is
    midnight, and text that does not start with a valid date and time gives NULL.
    """
    time = F.col(time) if isinstance(time, str) else time
    if from_text:
        time = F.regexp_extract(time, r"^\s*(\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{1,2}(:\d{1,2}(\.\d+)?)?)?)", 1)
        time = time.try_cast("timestamp_ntz")
    else:
        time = time.cast("timestamp_ntz")
    micros = F.timestamp_diff("MICROSECOND", F.lit(origin).cast("timestamp_ntz"), time)
    width = F.lit(seconds * 1_000_000)
    # A multiple of the width, so that the division is exact.
    return ((micros - F.pmod(micros, width)) / width).cast("long")


def bin_start(number: Column | str, seconds: int, origin: str = ORIGIN) -> Column:
    """Time at which a bin starts, without a zone."""
    number = F.col(number) if isinstance(number, str) else number
    return F.timestamp_add("SECOND", number * seconds, F.lit(origin).cast("timestamp_ntz"))


def strict(aggregate, column: Column | str) -> Column:
    """`aggregate` over a group, NULL as soon as one member of the group is NULL.

    Spark's own aggregates skip NULLs; use this where a missing member must show.
    """
    return F.when(F.count(F.lit(1)) == F.count(column), aggregate(column))


def strict_mean(column: Column | str) -> Column:
    """`strict` average; from one sum and one count, where avg would keep a second count."""
    return F.when(F.count(F.lit(1)) == F.count(column), F.sum(column) / F.count(column))


def finite(score: Column | str) -> Column:
    """The score, or NULL where it is NaN or infinite."""
    score = F.col(score) if isinstance(score, str) else score
    return F.when(~F.isnan(score) & (F.abs(score) < F.lit(float("inf"))), score)


def month_label(day: Column | str) -> Column:
    """Short month and two-digit year, such as Sep-13."""
    return F.date_format(day, "MMM-yy")


def series_name(code: Column, alias: Column, measure: Column) -> Column:
    return F.concat_ws("_", code, alias, measure)


def csv_number(x: Column) -> Column:
    """A double as CSV text: up to 15 significant digits, the shorter of plain and
    exponent notation, NA for missing."""
    general = F.format_string("%.15g", x)
    general = F.when(general.contains("."), F.regexp_replace(general, r"0+$", "")).otherwise(general)
    plain = F.when(F.abs(x) >= 1e15, F.format_string("%.0f", x)).otherwise(
        F.regexp_replace(general, r"\.$", "")
    )
    power = F.regexp_replace(F.format_string("%.14e", x), r"\.?0+e", "e")
    shorter = F.when(
        (F.abs(x) < 1e-4) & (x != 0) | (F.length(power) < F.length(plain)), power
    ).otherwise(plain)
    infinite = F.when(x > 0, "Inf").otherwise("-Inf")
    return (
        F.when(x.isNull() | F.isnan(x), "NA")
        .when((x == F.floor(x)) & (F.abs(x) < 1e5), x.cast("long").cast("string"))
        .when(F.abs(x) == F.lit(float("inf")), infinite)
        .otherwise(shorter)
    )
