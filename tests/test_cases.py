"""Hand-made rows with exact answers."""

import math
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from dayweave import Measure, PanelSpec
from dayweave.functions import csv_number, day_of
from dayweave.operators.accounts import (
    ALL_DIFFER,
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
    zero_fill,
)
from dayweave.operators.daily import active_days, daily_mean, drop_sparse, mean_on_rows, min_active_days
from dayweave.operators.panels import frequency_table, one_panel, with_day, with_panel_code
from dayweave.operators.smooth import loess_curve
from dayweave.operators.windows import account_span, clip_to_window, common_window

SPEC = PanelSpec(("panel",), "who", "at", (Measure("x", "mean_x", "X"), Measure("y", "mean_y", "Y")))
D = date(2013, 9, 23)


def day(i):
    return D + timedelta(days=i)


@pytest.fixture
def table(spark):
    def make(rows):
        full = [(*r, None)[:5] if len(r) == 4 else r for r in rows]
        return spark.createDataFrame(full, "panel string, who string, day date, x double, y double")

    return make


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_strict_mean_is_missing_when_a_score_is(table):
    df = table([("p", "a", D, 10.0, 1.0), ("p", "a", D, None, 3.0)])
    assert rows_of(daily_mean(df, SPEC), "mean_x", "mean_y") == [(None, 2.0)]
    assert rows_of(daily_mean(df, SPEC, skip_missing=True), "mean_x") == [(10.0,)]
    filled = zero_fill(daily_mean(df, SPEC), SPEC)
    assert rows_of(filled, "mean_x", "was_filled_X", "was_filled_Y") == [(0.0, True, False)]


def test_nan_stays_until_filled(table):
    df = daily_mean(table([("p", "a", D, 2.0, 1.0), ("p", "a", D, math.nan, 1.0)]), SPEC)
    assert math.isnan(df.first()["mean_x"])
    assert rows_of(zero_fill(df, SPEC), "mean_x", "was_filled_X") == [(0.0, True)]


@pytest.mark.parametrize("zone", ["UTC", "America/Costa_Rica", "Asia/Tokyo"])
def test_day_is_taken_as_written(spark, zone):
    texts = {
        "2013-09-23 23:59:59": D,
        "2013-09-23": D,
        "2013-9-3 01:00:00": date(2013, 9, 3),
        " 2013-09-23 00:00": D,
        "2013-02-30 00:00:00": None,
        "bad": None,
        "": None,
    }
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([(t,) for t in texts], "at string")
        got = {r.at: r.day for r in df.select("at", day_of("at", True).alias("day")).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == texts


def test_malformed_time_is_gone_after_the_clip(spark):
    df = spark.createDataFrame(
        [("p", "a", "bad", 1.0, 1.0), ("p", "a", "2013-09-23 00:00:00", 2.0, 2.0)],
        "panel string, who string, at string, x double, y double",
    )
    df = with_day(df, SPEC)
    assert rows_of(df, "day") == [(None,), (D,)]
    assert rows_of(clip_to_window(df, SPEC, [("p", D, D)]), "x") == [(2.0,)]
    assert rows_of(account_span(df, SPEC), "min_val", "max_val") == [(None, None)]
    assert rows_of(account_span(df, SPEC, skip_missing=True), "min_val") == [(D,)]


def test_window_keeps_both_ends(table):
    df = table([("p", "a", day(i), float(i), 0.0) for i in (-1, 0, 5, 6)] + [("q", "a", D, 9.0, 0.0)])
    assert rows_of(clip_to_window(df, SPEC, [("p", D, day(5))]), "x") == [(0.0,), (5.0,)]


def spans(*ends):
    return [
        ("p", who, day(i), 0.0, 0.0) for who, (a, b) in zip("abcdef", ends) for i in (a, b)
    ]


def test_common_window(table):
    df = table(spans((1, 10), (3, 8), (2, 12)))
    assert rows_of(common_window(df, SPEC), "lo", "hi") == [(day(3), day(8))]
    late = common_window(df, SPEC, exclude=[("p", "b")])
    assert rows_of(late, "lo", "hi") == [(day(2), day(10))]


def test_no_common_window(table):
    df = table(spans((1, 3), (5, 9)))
    assert common_window(df, SPEC).count() == 0
    assert clip_to_window(df, SPEC, common_window(df, SPEC)).count() == 0


@pytest.mark.parametrize("more", [0, 10_001])
@pytest.mark.parametrize("as_list", [True, False])
def test_the_number_of_windows_changes_nothing(spark, more, as_list):
    rows = [("p", "a", day(i), float(i), {"k": i}) for i in range(4)] + [("q", "a", D, 9.0, None)]
    df = spark.createDataFrame(rows, "panel string, who string, day date, x double, extra map<string,int>")
    windows = [("p", day(1), day(2))] + [(f"z{i}", D, D) for i in range(more)]
    if not as_list:
        windows = spark.createDataFrame(windows, "panel string, lo date, hi date")
    got = clip_to_window(df, SPEC, windows)
    assert got.columns == df.columns
    assert sorted((r.x, r.extra["k"]) for r in got.collect()) == [(1.0, 1), (2.0, 2)]


def test_a_window_without_a_bound_holds_no_row(spark, table):
    df = table([("p", "a", D, 1.0, 1.0), ("q", "a", D, 2.0, 2.0), ("r", "a", D, 3.0, 3.0)])
    windows = [("p", D, D), ("q", None, D), ("r", D, None)]
    assert rows_of(clip_to_window(df, SPEC, windows), "x") == [(1.0,)]
    windows = spark.createDataFrame(windows, "panel string, lo date, hi date")
    assert rows_of(clip_to_window(df, SPEC, windows), "x") == [(1.0,)]
    assert clip_to_window(df, SPEC, []).count() == 0


def test_building_a_query_starts_no_job(spark, table):
    df = table(spans((1, 10), (3, 8)))
    picks = spark.createDataFrame([("p", "a", "A")], "panel string, who string, alias string")
    spark.sparkContext.setJobGroup("building", "")
    daily = clip_to_window(daily_mean(df, SPEC), SPEC, common_window(df, SPEC, exclude=picks))
    kept = drop_accounts(daily, SPEC, picks.select("panel", "who"))
    complete_days(kept, SPEC, panel_bounds(kept, SPEC), picks)
    wide_table(kept, SPEC, "X", [("p", "a", "A")], panel_bounds(kept, SPEC))
    with_panel_code(pick_accounts(mean_on_rows(df, SPEC), SPEC, picks), SPEC, [("p", "P1")])
    loess_curve(df, SPEC)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("building")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert not list(jobs)


def names(df):
    return sorted((r.who or "-") for r in df.select("who").collect())


def test_any_differs_keeps_every_name(table):
    df = table([("p", w, D, 0.0, 0.0) for w in ("a", "b", "c", None)])
    assert names(drop_everywhere(df, "who", "a", "b", mode=ANY_DIFFERS)) == ["a", "b", "c"]
    assert names(drop_everywhere(df, "who", "a", "b")) == ["c"]
    drops = [("p", "a"), ("p", "b")]
    assert names(drop_accounts(df, SPEC, drops, ANY_DIFFERS)) == ["a", "b", "c"]
    assert names(drop_accounts(df, SPEC, drops, ALL_DIFFER)) == ["c"]
    assert names(drop_accounts(df, SPEC, [("p", "a")], ANY_DIFFERS)) == ["b", "c"]


def test_drop_acts_on_its_panel_only(table):
    df = table([(p, w, D, 0.0, 0.0) for p in "pq" for w in ("a", "b", None)])
    got = rows_of(drop_accounts(df, SPEC, [("p", "a")]), "panel", "who")
    assert got == [("p", "b"), ("q", "a"), ("q", "b"), ("q", None)]


def test_same_name_in_two_panels_is_two_series(table):
    df = table([("p", "a", D, 1.0, 0.0), ("q", "a", D, 5.0, 0.0), ("q", "a", D, 7.0, 0.0)])
    assert rows_of(daily_mean(df, SPEC), "panel", "mean_x") == [("p", 1.0), ("q", 6.0)]
    assert rows_of(one_panel(df, SPEC, "p"), "x") == [(1.0,)]
    assert rows_of(pick_accounts(df, SPEC, [("q", "a", "A")]), "x", "alias") == [(5.0, "A"), (7.0, "A")]


def test_rows_keep_their_mean(table):
    df = table([("p", "a", D, float(i), 0.0) for i in (1, 2, 6)])
    assert rows_of(mean_on_rows(df, SPEC), "x", "mean_x") == [(1.0, 3.0), (2.0, 3.0), (6.0, 3.0)]
    daily = daily_mean(df, SPEC)
    assert daily.count() == 1
    assert rows_of(active_days(daily, SPEC), "who", "n") == [("a", 1)]


@pytest.fixture(params=["10MB", "-1"], ids=["broadcast", "shuffle"])
def join_threshold(spark, request):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", request.param)
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_hot_account_days_get_the_same_means(table, join_threshold):
    hot = [("p", "a", D, float(i), None if i == 7 else 1.0) for i in range(50)]
    rest = [("p", "b", day(i % 5), float(i), 2.0) for i in range(12)]
    odd = [("p", None, None, 4.0, 4.0), (None, "b", D, 5.0, 5.0)]
    df = table(hot + rest + odd)
    got = rows_of(mean_on_rows(df, SPEC), "panel", "who", "x", "mean_x", "mean_y")
    want = {}
    for p, w, d, x, y in hot + rest + odd:
        want.setdefault((p, w, d), []).append((x, y))
    expected = []
    for p, w, d, x, _ in hot + rest + odd:
        xs, ys = zip(*want[p, w, d])
        expected.append((p, w, x, sum(xs) / len(xs), None if None in ys else sum(ys) / len(ys)))
    assert got == sorted(expected, key=repr)


def test_a_hot_account_day_is_spread(spark):
    """Half the rows are of one account-day and equal in all columns but three values."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    who = F.when(F.col("id") % 2 == 0, "hot").otherwise((F.col("id") % 5000).cast("string"))
    df = spark.range(0, 400_000, 1, 16).select(
        F.lit("p").alias("panel"), who.alias("who"), F.lit(D).alias("day"), (F.col("id") % 3).cast("double").alias("x"),
        F.lit(1.0).alias("y"),
    )
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        sizes = {}
        for parts in ("4", "16"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            joined = mean_on_rows(df, SPEC).withColumn("part", F.spark_partition_id())
            rows = joined.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("mean_x"), F.max("mean_x")).collect()
            assert sum(r.n for r in rows) == 400_000
            sizes[parts] = max(r.n for r in rows)
    finally:
        for k in settings:
            spark.conf.unset(k)
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    # Unsplit, the task of the hot account-day has 200,000 rows whatever the partitions.
    assert sizes["16"] < sizes["4"] < 120_000


def test_sparse_accounts(table):
    daily = table([("p", "a", day(i), 1.0, 1.0) for i in range(4)] + [("p", "b", D, 1.0, 1.0), ("q", "a", D, 1.0, 1.0)])
    assert rows_of(min_active_days(daily, SPEC, 2), "panel", "who", "n") == [("p", "a", 4)]
    assert rows_of(drop_sparse(daily, SPEC, 2), "panel", "who") == [("p", "a")] * 4


def complete(df, accounts=None):
    daily = daily_mean(df, SPEC)
    return complete_days(daily, SPEC, panel_bounds(daily, SPEC), accounts)


def test_calendar_covers_accounts_not_picked(table):
    df = table([("p", "a", day(1), 1.0, 1.0), ("p", "b", day(0), 2.0, 2.0), ("p", "b", day(4), 3.0, 3.0)])
    got = rows_of(complete(df, [("p", "a", "A")]), "alias", "t", "day", "mean_x")
    assert got == [("A", i, day(i), 1.0 if i == 1 else None) for i in range(5)]


def test_completion_with_and_without_gaps(table):
    full = [("p", "full", day(i), float(i), 0.0) for i in range(6)]
    gaps = [("p", "gaps", day(i), float(i), 0.0) for i in (1, 2, 4)]
    df = table(full + gaps + [("q", "gaps", day(9), 1.0, 1.0)])
    got = rows_of(complete(df), "panel", "who", "t", "mean_x")
    want = [("p", "full", i, float(i)) for i in range(6)]
    want += [("p", "gaps", i, float(i) if i in (1, 2, 4) else None) for i in range(6)]
    assert got == sorted(want + [("q", "gaps", 0, 1.0)], key=repr)


def test_picked_account_without_rows_is_all_zero(table):
    df = table([("p", "a", day(i), 1.0, 1.0) for i in range(3)])
    filled = zero_fill(complete(df, [("p", "a", "A"), ("p", "silent", "S")]), SPEC)
    got = rows_of(filled.where("alias = 'S'"), "who", "t", "mean_x", "was_filled_X")
    assert got == [("silent", i, 0.0, True) for i in range(3)]
    bounds = panel_bounds(df, SPEC)
    wide = wide_table(daily_mean(df, SPEC), SPEC, "X", [("p", "silent", "S"), ("p", "a", "A")], bounds)
    assert rows_of(wide, "t", "S_X", "A_X") == [(i, 0.0, 1.0) for i in range(3)]


def test_one_account_under_two_aliases(table):
    df = table([("p", "a", day(0), 1.0, 1.0), ("p", "a", day(2), 3.0, 1.0)])
    got = rows_of(complete(df, [("p", "a", "A"), ("p", "a", "B")]), "alias", "t", "mean_x")
    assert got == [(n, t, x) for n in "AB" for t, x in ((0, 1.0), (1, None), (2, 3.0))]


def test_completion_within_given_bounds(table):
    rows = [("p", "a", day(i), float(i), 1.0) for i in (1, 3, 7, 12)]
    rows += [("p", "before", day(i), 1.0, 1.0) for i in (0, 1, 2)] + [("p", "after", day(20), 1.0, 1.0)]
    rows += [("p", "around", day(i), 1.0, 1.0) for i in (0, 2, 30)] + [("q", "a", D, 1.0, 1.0)]
    daily = daily_mean(table(rows), SPEC)
    got = rows_of(complete_days(daily, SPEC, [("p", day(5), day(9))]), "who", "t", "day", "mean_x")
    names = ("a", "after", "around", "before")
    want = [(w, i, day(5 + i), 7.0 if (w, i) == ("a", 2) else None) for w in names for i in range(5)]
    assert got == sorted(want, key=repr)
    picked = complete_days(daily, SPEC, [("p", day(5), day(9))], [("p", "before", "B"), ("p", "silent", "S"), ("p", "a", "A")])
    assert rows_of(picked, "alias", "t", "mean_x") == sorted(
        ((n, i, 7.0 if (n, i) == ("A", 2) else None) for n in "ABS" for i in range(5)), key=repr
    )


def test_drop_lists_as_tables_and_with_missing_names(spark, table):
    df = table([(p, w, D, 0.0, 0.0) for p in "pqr" for w in ("a", "b", "c", None)])
    drops = [("p", "a"), ("p", "b"), ("p", "a"), ("q", None), ("q", "a")]
    for given in (drops, spark.createDataFrame(drops, "panel string, name string")):
        everyone = [("r", w) for w in ("a", "b", "c", None)]
        got = rows_of(drop_accounts(df, SPEC, given, ALL_DIFFER), "panel", "who")
        assert got == sorted([("p", "c"), *everyone], key=repr)
        got = rows_of(drop_accounts(df, SPEC, given, ANY_DIFFERS), "panel", "who")
        assert got == sorted([("p", "a"), ("p", "b"), ("p", "c"), ("q", "b"), ("q", "c"), *everyone], key=repr)


def test_wide_columns_are_in_the_given_order(table):
    df = table([("p", w, day(i), float(i), 1.0) for w in ("JOH", "LZ", "SN") for i in range(2)])
    picks = [("p", "LZ", "LuisZelaya"), ("p", "SN", "SalvadorNasralla"), ("p", "JOH", "JOH")]
    wide = wide_table(daily_mean(df, SPEC), SPEC, "X", picks, panel_bounds(df, SPEC), prefix="HO17_")
    assert wide.columns[3:] == ["HO17_LuisZelaya_X", "HO17_SalvadorNasralla_X", "HO17_JOH_X"]


def test_wide_sums_to_long(table):
    df = table([("p", w, day(i * k), float(i + k), 1.0) for k, w in enumerate("abc", 1) for i in range(5)])
    daily, picks = daily_mean(df, SPEC), [("p", w, w.upper()) for w in "abc"]
    wide = wide_table(daily, SPEC, "X", picks, panel_bounds(daily, SPEC))
    long = series_offset(zero_fill(complete(df, picks), SPEC), SPEC).where("measure = 'X'")
    total = wide.select(F.sum(F.col("A_X") + F.col("B_X") + F.col("C_X"))).first()[0]
    assert total == long.agg(F.sum("value")).first()[0]
    assert long.count() == 3 * wide.count() == 3 * calendar(panel_bounds(df, SPEC), SPEC).count()


@pytest.mark.parametrize("seed", range(3))
def test_random_panels_against_brute_force(table, seed):
    rng = random.Random(seed)
    rows = [
        (p, f"u{rng.randrange(6)}", day(int(rng.triangular(0, 40))), float(rng.randrange(64)), rng.choice([None, 1.0, 2.0]))
        for p in ("p", "q", "r") for _ in range(rng.randrange(1, 90))
    ]
    df = table(rows)
    scores = {}
    for p, w, d, x, y in rows:
        scores.setdefault((p, w, d), []).append((x, y))
    first = {p: min(d for q, _, d, *_ in rows if q == p) for p in "pqr"}
    last = {p: max(d for q, _, d, *_ in rows if q == p) for p in "pqr"}

    def mean(key, i):
        values = [s[i] for s in scores.get(key, [])]
        return sum(values) / len(values) if values and None not in values else 0.0

    picks = [(p, f"u{i}", f"A{i}") for p in "pqr" for i in (4, 0, 2)]
    want = []
    for p, w, alias in picks:
        for t in range((last[p] - first[p]).days + 1):
            key = (p, w, first[p] + timedelta(days=t))
            want.append((p, alias, t, mean(key, 0), mean(key, 1)))
    filled = zero_fill(complete(df, picks), SPEC)
    assert rows_of(filled, "panel", "alias", "t", "mean_x", "mean_y") == sorted(want, key=repr)

    wide = wide_table(daily_mean(df, SPEC), SPEC, "X", picks, panel_bounds(df, SPEC))
    assert wide.columns[3:] == ["A4_X", "A0_X", "A2_X"]
    by_day = {}
    for p, alias, t, x, _ in want:
        by_day.setdefault((p, t), {})[alias] = x
    assert rows_of(wide, "panel", "t", "A4_X", "A0_X", "A2_X") == sorted(
        ((p, t, v["A4"], v["A0"], v["A2"]) for (p, t), v in by_day.items()), key=repr
    )


def test_panel_codes_and_frequencies(table):
    df = table([("p", "a", D, 1.0, 1.0), ("p", "a", D, 1.0, 1.0), ("p", None, D, 1.0, 1.0), ("z", "a", D, 1.0, 1.0)])
    assert rows_of(with_panel_code(df, SPEC, [("p", "P1")], "code"), "code") == [("P1",)] * 3
    assert rows_of(frequency_table(df, SPEC, "who"), "panel", "who", "n") == [("p", "a", 2), ("z", "a", 1)]


@pytest.mark.parametrize(
    "number, text",
    [
        (71.25, "71.25"), (66.0, "66"), (0.0, "0"), (-2.5, "-2.5"), (1 / 3, "0.333333333333333"),
        (200 / 3, "66.6666666666667"), (1e5, "1e+05"), (123456.0, "123456"), (1e-4, "1e-04"),
        (0.00012, "0.00012"), (1.5e-7, "1.5e-07"), (1e15, "1e+15"), (99999.0, "99999"),
        (0.1 + 0.2, "0.3"), (None, "NA"), (math.nan, "NA"), (math.inf, "Inf"), (-math.inf, "-Inf"),
    ],
)
def test_csv_number(spark, number, text):
    df = spark.createDataFrame([(number,)], "x double")
    assert df.select(csv_number(F.col("x"))).first()[0] == text
