"""Daily panel time series from event-level scored records, on Spark DataFrames."""

from dayweave.spec import Measure, PanelSpec

__all__ = ["Measure", "PanelSpec"]
