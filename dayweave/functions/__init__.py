from dayweave.functions.columns import (
    bin_of,
    bin_start,
    csv_number,
    day_of,
    finite,
    month_label,
    series_name,
    strict,
    strict_mean,
)

__all__ = [
    "bin_of",
    "bin_start",
    "csv_number",
    "day_of",
    "finite",
    "month_label",
    "series_name",
    "strict",
    "strict_mean",
]
