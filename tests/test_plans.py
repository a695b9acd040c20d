"""The physical plans: what is read, what is shuffled, what runs in Python."""

import re

import pytest

from dayweave.operators.daily import daily_mean, mean_on_rows
from dayweave.plans.queries import EVENTS, LINES, QUERIES, WINDOWS, events, lines
from dayweave.operators.smooth import loess_curve
from dayweave.operators.windows import clip_to_window

SF_DIR = "/root/testdata/sf0.001"
FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "MapInPandas", "FlatMapGroups"]


def plan(df, run=False):
    if run:
        df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_pairwise_join_and_no_row_udf(spark, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    assert not [f for f in FORBIDDEN if f in text]
    assert text.count("ArrowEvalPython") == (1 if name.startswith("loess") else 0)


def test_window_range_and_columns_reach_the_scan(spark):
    clipped = clip_to_window(lines(spark, SF_DIR), LINES, WINDOWS).select("spon", "day")
    scan = next(line for line in plan(clipped).splitlines() if "FileScan" in line)
    columns = re.search(r"FileScan parquet \[(.*?)\]", scan).group(1)
    assert {c.split("#")[0] for c in columns.split(",")} == {
        "l_extendedprice", "l_returnflag", "l_linestatus", "l_shipdate",
    }
    formatted = clipped._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    pushed = re.search(r"PushedFilters: \[(.*)\]", formatted).group(1)
    assert "GreaterThanOrEqual(l_shipdate" in pushed and "LessThan(l_shipdate" in pushed


def test_daily_mean_shuffles_partial_sums_once(spark):
    text = plan(daily_mean(lines(spark, SF_DIR), LINES))
    assert text.count("Exchange") == 1
    assert "partial_sum" in text.split("Exchange")[1]


def test_means_on_rows_are_joined_without_a_window(spark):
    text = plan(mean_on_rows(events(spark, SF_DIR), EVENTS), run=True)
    assert "Window" not in text
    assert text.count("FileScan") == 2


@pytest.mark.parametrize("name", ["daily_mean_strict", "loess_curve", "wide_spon"])
def test_the_rows_are_scanned_once(spark, name):
    """Windows and what is clipped to them come from the written daily table."""
    text = plan(QUERIES[name](spark, SF_DIR), run=True)
    scans = [x for x in text.splitlines() if "FileScan" in x]
    assert scans and not any("lineitem" in x or "l_shipdate" in x for x in scans)


def test_loess_sends_days_not_rows(spark):
    text = plan(loess_curve(lines(spark, SF_DIR), LINES))
    first_shuffle = text.splitlines()[max(i for i, l in enumerate(text.splitlines()) if "Exchange" in l) + 1]
    assert "partial_sum" in first_shuffle
