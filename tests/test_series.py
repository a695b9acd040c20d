"""Bins, autocorrelation and vector models against plain versions."""

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from dayweave import Measure, PanelSpec
from dayweave.functions import bin_of, bin_start
from dayweave.operators.calendar import calendar, complete_days, panel_bounds, wide_table, zero_fill
from dayweave.operators.correlation import autocorrelation
from dayweave.operators.daily import daily_mean
from dayweave.operators.panels import with_bin
from dayweave.operators.stationarity import dickey_fuller
from dayweave.operators.vector_models import coefficients, f_tail, granger_tests, impulse_responses, lagged_products
from dayweave.operators.windows import clip_to_window, common_window

SPEC = PanelSpec(("panel",), "who", "at", (Measure("x", "mean_x", "X"),), day="bin")


# Bins


@pytest.mark.parametrize("seconds", [1, 60, 900, 3600, 7 * 3600, 86_400])
@pytest.mark.parametrize("zone", ["UTC", "America/Costa_Rica"])
def test_bins_of_text_follow_the_text(spark, seconds, zone):
    rng = random.Random(seconds)
    times = [datetime(1965, 1, 1) + timedelta(seconds=rng.randrange(2 * 10**9), microseconds=rng.randrange(10**6)) for _ in range(200)]
    times += [datetime(1970, 1, 1), datetime(1969, 12, 31, 23, 59, 59, 999_999)]
    rows = [(t.strftime("%Y-%m-%d %H:%M:%S.%f"), t) for t in times]
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame(rows, "at string, ntz timestamp_ntz")
        number = bin_of("at", True, seconds)
        got = df.select("ntz", number.alias("n"), bin_of("ntz", False, seconds).alias("m"), bin_start(number, seconds).alias("start")).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    for r in got:
        want = (r.ntz - datetime(1970, 1, 1)) // timedelta(seconds=seconds)
        assert r.n == r.m == want
        assert r.start == datetime(1970, 1, 1) + timedelta(seconds=want * seconds)


def test_text_that_is_no_time_has_no_bin(spark):
    texts = [" 2013-09-23 03:15", "2013-09-23", "2013-09-23T03:15:00 extra", "2013-13-01 00:00:00", "2013-09-23 25:00:00", "bad", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "at string")
    got = [r.n for r in df.select(bin_of("at", True, 3600).alias("n")).collect()]
    day = (datetime(2013, 9, 23) - datetime(1970, 1, 1)) // timedelta(hours=1)
    assert got == [day + 3, day, day + 3, None, None, None, None, None]
    other = df.limit(1).select(bin_of("at", True, 3600, origin="2013-09-23 00:15:00").alias("n")).first()
    assert other.n == 3


def test_an_hourly_panel_is_completed(spark):
    """The window of all accounts by the hour, means, every hour, and the wide form."""
    rows = [("p", "a", "2020-01-01 22:10:00", 1.0), ("p", "a", "2020-01-01 22:50:00", 3.0), ("p", "a", "2020-01-02 03:00:00", 5.0)]
    rows += [("p", "b", "2020-01-01 20:00:00", 9.0), ("p", "b", "2020-01-02 00:30:00", 7.0), ("p", "b", "2020-01-02 09:00:00", 9.0), ("p", "b", "none", 9.0)]
    df = with_bin(spark.createDataFrame(rows, "panel string, who string, at string, x double"), SPEC, 3600)
    window = common_window(df, SPEC)
    daily = daily_mean(clip_to_window(df, SPEC, window), SPEC)
    bounds = panel_bounds(daily, SPEC)
    filled = zero_fill(complete_days(daily, SPEC, bounds), SPEC).select("who", "t", bin_start("bin", 3600).alias("at"), "mean_x")
    start = datetime(2020, 1, 1, 22)
    want = {("a", 0): 2.0, ("a", 5): 5.0, ("b", 2): 7.0}
    assert sorted(map(tuple, filled.collect())) == [
        (who, t, start + timedelta(hours=t), want.get((who, t), 0.0)) for who in "ab" for t in range(6)
    ]
    assert calendar(bounds, SPEC).count() == 6
    lo, hi = window.select("lo", "hi").first()
    assert clip_to_window(df, SPEC, [("p", lo, hi)]).count() == 4
    wide = wide_table(daily, SPEC, "X", [("p", "b", "B"), ("p", "a", "A")], bounds).orderBy("t")
    assert [(r.t, r.B_X, r.A_X) for r in wide.collect()] == [(t, want.get(("b", t), 0.0), want.get(("a", t), 0.0)) for t in range(6)]


# Autocorrelation


def plain_correlations(x, lags):
    x = np.array(x)
    d = x - x.mean()
    r = [float((d[k:] * d[: len(d) - k]).sum() / (d * d).sum()) if k < len(x) else None for k in range(lags + 1)]
    p = [None]
    for k in range(1, lags + 1):
        if r[k] is None:
            p.append(None)
            continue
        # The last coefficient of the best prediction from k values, by its own equations.
        toeplitz = np.array([[r[abs(i - j)] for j in range(k)] for i in range(k)])
        p.append(float(np.linalg.solve(toeplitz, r[1 : k + 1])[-1]))
    return r, p


def test_correlations_match_a_plain_version(spark):
    rng = np.random.default_rng(1)
    walks = {"noise": rng.normal(size=300), "walk": np.cumsum(rng.normal(size=200)), "short": rng.normal(size=5)}
    walks["season"] = np.sin(np.arange(150) * 0.7) * 1e6 + 1e9 + rng.normal(size=150)
    rows = [(w, t, float(x)) for w, xs in walks.items() for t, x in enumerate(xs)]
    rows += [("flat", t, 2.0) for t in range(30)] + [("gap", t, None if t == 3 else float(t % 5)) for t in range(30)] + [("one", 0, 1.0)]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, "who string, t int, x double").repartition(5)
    got = {(r.who, r.lag): r for r in autocorrelation(df, ["who"], "t", "x", 12).collect()}
    assert len(got) == 13 * 7
    for who, xs in walks.items():
        r, p = plain_correlations(xs, 12)
        for k in range(13):
            row = got[who, k]
            assert row.n == len(xs)
            for value, want in ((row.acf, r[k]), (row.pacf, p[k])):
                assert value == (None if want is None else pytest.approx(want, rel=1e-6, abs=1e-9)), (who, k)
    for who in ("flat", "gap", "one"):
        assert all(got[who, k].acf is None and got[who, k].pacf is None for k in range(13))
    assert [r.lag for r in autocorrelation(df.where("who = 'walk'"), ["who"], "t", "x", 0).collect()] == [0]
    assert autocorrelation(df.limit(0), ["who"], "t", "x", 3).count() == 0


# Vector models


def simulated(n, seed):
    """b follows a; c is by itself."""
    rng = np.random.default_rng(seed)
    x = np.zeros((n, 3))
    for t in range(2, n):
        a, b, c = x[t - 1]
        x[t] = [0.5 * a - 0.2 * x[t - 2, 0], 0.3 * b + 0.6 * a, 0.4 * c] + rng.normal(size=3)
    return x + [5, -3, 100]


def plain_model(x, lags):
    n = len(x)
    z = np.hstack([np.ones((n - lags, 1)), *(x[lags - i : n - i] for i in range(1, lags + 1))])
    y = x[lags:]
    b = np.linalg.lstsq(z, y, rcond=None)[0]
    rest = y - z @ b
    free = len(z) - z.shape[1]
    sigma = rest.T @ rest / free
    return z, y, b, sigma, free


@pytest.fixture(scope="module")
def modelled(spark):
    panels = {"p": simulated(400, 1), "q": simulated(60, 2), "few": simulated(8, 3)}
    rows = [(p, t, who, float(x[t, i])) for p, x in panels.items() for t in range(len(x)) for i, who in enumerate("abc")]
    # Two accounts that move alike, and one that never moves.
    rows += [("alike", t, who, float(t * t % 7) * (1 + (who == "b"))) for t in range(50) for who in "ab"]
    rows += [("still", t, who, 1.0 if who == "b" else float(t % 7)) for t in range(50) for who in "ab"]
    random.Random(4).shuffle(rows)
    df = spark.createDataFrame(rows, "panel string, t int, who string, x double").repartition(6)
    return panels, lagged_products(df, ["panel"], "who", "t", "x", 2)


def test_coefficients_match_least_squares(modelled):
    panels, products = modelled
    got = {}
    for r in coefficients(products, ["panel"]).collect():
        got[r.panel, r.equation, r.account, r.lag] = (r.coefficient, r.std_error)
    assert {k[0] for k in got} == {"p", "q"}
    for panel in "pq":
        z, _, b, sigma, _ = plain_model(panels[panel], 2)
        spread = np.sqrt(np.outer(np.diag(np.linalg.inv(z.T @ z)), np.diag(sigma)))
        for e, equation in enumerate("abc"):
            assert got[panel, equation, equation, 0] == (pytest.approx(b[0, e], rel=1e-6), None)
            for lag in (1, 2):
                for c, account in enumerate("abc"):
                    at = 1 + 3 * (lag - 1) + c
                    assert got[panel, equation, account, lag] == (pytest.approx(b[at, e], rel=1e-6), pytest.approx(spread[at, e], rel=1e-6))


def test_granger_tests_match_nested_fits(modelled):
    panels, products = modelled
    got = {(r.panel, r.cause, r.effect): r for r in granger_tests(products, ["panel"]).collect()}
    assert len(got) == 12
    for panel in "pq":
        z, y, b, _, free = plain_model(panels[panel], 2)
        for c, cause in enumerate("abc"):
            for e, effect in enumerate("abc"):
                if c == e:
                    continue
                less = np.delete(z, [1 + c, 4 + c], axis=1)
                full = ((y[:, e] - z @ b[:, e]) ** 2).sum()
                short = ((y[:, e] - less @ np.linalg.lstsq(less, y[:, e], rcond=None)[0]) ** 2).sum()
                r = got[panel, cause, effect]
                assert (r.f, r.df1, r.df2) == (pytest.approx((short - full) / 2 / (full / free), rel=1e-6), 2, free)
                assert r.p == pytest.approx(f_tail(r.f, 2, free))
    assert got["p", "a", "b"].p < 1e-10 and got["p", "b", "a"].p > 0.01 and got["p", "a", "c"].p > 0.01


def test_responses_match_a_simulation(modelled):
    panels, products = modelled
    got = {(r.panel, r.impulse, r.account, r.horizon): r.response for r in impulse_responses(products, ["panel"], 6).collect()}
    for panel in "pq":
        _, _, b, sigma, _ = plain_model(panels[panel], 2)
        shocks = np.linalg.cholesky(sigma)
        for s, impulse in enumerate("abc"):
            # The path after the shock, less the path without it.
            path = [np.zeros(3), shocks[:, s]]
            for _ in range(6):
                path.append(b[1:4].T @ path[-1] + b[4:7].T @ path[-2])
            for h in range(7):
                for a, account in enumerate("abc"):
                    assert got[panel, impulse, account, h] == pytest.approx(path[h + 1][a], rel=1e-6, abs=1e-9)


def test_times_with_missing_accounts_are_not_used(spark):
    x = simulated(80, 5)
    rows = [("p", t, who, float(x[t, i])) for t in range(80) for i, who in enumerate("abc") if (t, who) != (30, "b")]
    rows = [(p, t, who, None if (t, who) == (50, "a") else v) for p, t, who, v in rows]
    products = lagged_products(spark.createDataFrame(rows, "panel string, t int, who string, x double"), ["panel"], "who", "t", "x", 1)
    got = {(r.equation, r.account, r.lag): r.coefficient for r in coefficients(products, ["panel"]).collect()}
    use = [t for t in range(1, 80) if not {t, t - 1} & {30, 50}]
    z, y = np.hstack([np.ones((len(use), 1)), x[[t - 1 for t in use]]]), x[use]
    b = np.linalg.lstsq(z, y, rcond=None)[0]
    assert products.first().n == len(use)
    for e, equation in enumerate("abc"):
        for c, account in enumerate("abc"):
            assert got[equation, account, 1] == pytest.approx(b[1 + c, e], rel=1e-6)


def test_tail_of_the_f_distribution():
    # With 2 and b degrees of freedom the tail has a closed form; with 1 and 1 an arc tangent.
    for f in (0.01, 0.5, 1.0, 3.0, 40.0):
        for b in (1, 5, 30, 1000):
            assert f_tail(f, 2, b) == pytest.approx((1 + 2 * f / b) ** (-b / 2), rel=1e-9)
        assert f_tail(f, 1, 1) == pytest.approx(1 - 2 / math.pi * math.atan(math.sqrt(f)), rel=1e-9)
        assert f_tail(f, 7, 11) == pytest.approx(1 - f_tail(1 / f, 11, 7), rel=1e-9)
    assert f_tail(0.0, 3, 3) == 1.0


# Dickey-Fuller test


def plain_test(x, lags, trend):
    """Every lag fitted on the rows themselves."""
    d = np.diff(x)
    times = range(lags + 1, len(x))
    y = np.array([d[t - 1] for t in times])
    best = (math.inf, None, None)
    for lag in range(lags + 1):
        z = np.array([[1.0, *([t] if trend else []), x[t - 1], *(d[t - 1 - i] for i in range(1, lag + 1))] for t in times])
        b = np.linalg.lstsq(z, y, rcond=None)[0]
        rest = ((y - z @ b) ** 2).sum()
        at = 2 if trend else 1
        error = math.sqrt(np.linalg.inv(z.T @ z)[at, at] * rest / (len(y) - z.shape[1]))
        best = min(best, (len(y) * math.log(rest / len(y)) + 2 * z.shape[1], lag, b[at] / error))
    return len(y), *best[1:]


@pytest.mark.parametrize("trend", [False, True])
def test_dickey_fuller_matches_fits_on_rows(spark, trend):
    rng = np.random.default_rng(9)
    xs = {"noise": rng.normal(size=200), "walk": np.cumsum(rng.normal(size=300)), "high": 1e3 + rng.normal(size=80)}
    ar = [0.0, 0.0]
    for e in rng.normal(size=250):
        ar.append(0.6 * ar[-1] - 0.3 * ar[-2] + e)
    xs["ar"] = np.array(ar)
    rows = [(who, t + 17, float(v)) for who, x in xs.items() for t, v in enumerate(x)]
    rows += [("flat", t, 3.0) for t in range(40)] + [("short", t, float(t % 3)) for t in range(8)] + [("one", 1, 1.0)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "who string, t int, x double").repartition(4)
    got = {r.who: r for r in dickey_fuller(df, ["who"], "t", "x", 5, trend).collect()}
    assert set(got) == {*xs, "flat", "short"}
    for who, x in xs.items():
        n, lag, statistic = plain_test(x, 5, trend)
        r = got[who]
        assert (r.n, r.lag, r.statistic) == (n, lag, pytest.approx(statistic, rel=1e-5)), who
        assert r.critical_1 < r.critical_5 < r.critical_10 < (-3 if trend else -2.5)
    assert (got["flat"].lag, got["flat"].statistic, got["short"].statistic) == (None, None, None)
    assert got["noise"].statistic < got["noise"].critical_1 and got["ar"].statistic < got["ar"].critical_1
    assert got["walk"].statistic > got["walk"].critical_5
    # With a gap, only times with all values before them are used.
    gap = df.where("who = 'noise' AND t <> 100")
    assert dickey_fuller(gap, ["who"], "t", "x", 5, trend).first().n == 194 - 7
