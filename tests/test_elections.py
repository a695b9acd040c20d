"""The 24 election panels: stated sizes, and the whole pipeline on a written CSV."""

import csv
import glob
from collections import Counter, defaultdict
from datetime import date, timedelta

import pytest

from dayweave.operators.accounts import ALL_DIFFER
from dayweave.plans.elections import Elections
from dayweave.plans.pipeline import COMPUTED, kept_accounts, run, scored_rows

CONFIG = Elections(candidate="candidato", party="partido")
PANEL_OF = {(e, t): code for e, t, code in CONFIG.codes}
CALENDAR_DAYS = {
    "ES14_c": 168, "ES14_p": 168, "ES19_c": 124, "ES19_p": 125, "HO13_c": 186,
    "HO13_p": 185, "HO17_c": 185, "HO17_p": 174, "HO21_c": 179, "HO21_p": 81,
}
ACCOUNTS = {
    "ES14_c": 3, "ES14_p": 5, "ES19_c": 4, "ES19_p": 7, "HO13_c": 3,
    "HO13_p": 2, "HO17_c": 3, "HO17_p": 3, "HO21_c": 7, "HO21_p": 3,
}


def test_panels():
    assert len(CONFIG.codes) == len(set(CONFIG.codes)) == 24
    assert [c[2] for c in CONFIG.codes[:3]] == ["CR10_c", "CR10_p", "CR14_c"]


def test_window_lengths_equal_the_stated_calendars():
    lengths = {PANEL_OF[e, t]: (hi - lo).days + 1 for e, t, lo, hi in CONFIG.windows}
    assert {p: lengths[p] for p in CALENDAR_DAYS} == CALENDAR_DAYS


def test_account_counts():
    assert Counter(PANEL_OF[e, t] for e, t, _, _ in CONFIG.wide) == ACCOUNTS


def post(rows, key, account, day, spon, an, handle="h"):
    rows.append([*key, account, an, spon, f"{day} 0{len(rows) % 10}:30:00", handle, 'a "text",\nwith all'])


@pytest.fixture(scope="module")
def posts():
    """Every wide account posts on most days of its window; drops and outsiders post too."""
    rows = []
    for e, t, lo, hi in CONFIG.windows:
        key, days = (e, t), (hi - lo).days + 1
        accounts = [a for *k, a, _ in CONFIG.wide if tuple(k) == key] or ["Someone", "Other"]
        for i, account in enumerate(accounts):
            for d in range(-2, days + 2):
                if (d + i) % 5:
                    for r in range(1 + d % 2):
                        post(rows, key, account, lo + timedelta(days=d), 10 + d % 7 + r, 50 - d % 9)
        post(rows, key, "Outsider", lo, 1, 2)
        post(rows, key, "Outsider", hi, 3, "NA")
    for *key, account in CONFIG.dropped_first + CONFIG.dropped + CONFIG.dropped_if_all:
        window = next(w for w in CONFIG.windows if list(w[:2]) == key)
        post(rows, key, account, window[2], 99, 99)
    for d in range(9):
        post(rows, CONFIG.dropped_handles[0][:2], "By handle", date(2013, 12, 1 + d), d, 5, "jmechandi")
    return rows


@pytest.fixture(scope="module")
def out(spark, posts, tmp_path_factory):
    base = tmp_path_factory.mktemp("elections")
    with open(base / "posts.csv", "w", encoding="utf-8", newline="") as f:
        writer = csv.writer(f)
        writer.writerow(
            "CountryElection type_of_account user_name Analytic Authenticity created_at_seconds user_username text".split()
        )
        writer.writerows(posts)
    run(spark, str(base / "posts.csv"), str(base / "out"), CONFIG, handles=True)
    return base


@pytest.fixture(scope="module")
def daily(posts):
    """The expected daily means, computed without Spark."""
    windows = {w[:2]: w[2:] for w in CONFIG.windows}
    scores = defaultdict(list)
    for e, t, account, an, spon, at, *_ in posts:
        day = date.fromisoformat(at[:10])
        lo, hi = windows[e, t]
        if lo <= day <= hi and (e, t, account) not in CONFIG.dropped_first:
            scores[PANEL_OF[e, t], account, day].append((spon, an))
    means = {}
    for key, values in scores.items():
        columns = zip(*values)
        means[key] = tuple(None if "NA" in c else sum(c) / len(c) for c in columns)
    return means


def test_daily(spark, out, daily):
    got = {
        (r.panel, r.user_name, r.created_at_seconds2): (r.mean_Auth, r.mean_An)
        for r in spark.read.parquet(f"{out}/out/daily").collect()
    }
    assert got.keys() == daily.keys()
    for key, means in daily.items():
        assert got[key] == pytest.approx(means) if None not in means else got[key] == means


def test_active_days(spark, out, daily):
    want = Counter((panel, account) for panel, account, _ in daily)
    got = spark.read.parquet(f"{out}/out/active_days").collect()
    assert {(PANEL_OF[r.CountryElection, r.type_of_account], r.user_name): r.n for r in got} == want


def test_wide_files(out, daily):
    folders = glob.glob(f"{out}/out/wide/name=*")
    assert len(folders) == 20
    for panel, days in CALENDAR_DAYS.items():
        lo = next(w[2] for w in CONFIG.windows if PANEL_OF[w[:2]] == panel)
        picks = [(a, alias) for e, t, a, alias in CONFIG.wide if PANEL_OF[e, t] == panel]
        for measure, label in enumerate(("Spon", "An")):
            (part,) = glob.glob(f"{out}/out/wide/name=VARdf_{panel}_{label}/part-*")
            with open(part, encoding="utf-8", newline="") as f:
                header, *lines = csv.reader(f)
            assert header == ["", *[f"{panel[:4]}_{alias}_{label}" for _, alias in picks]]
            assert len(lines) == days
            for t, (row, *values) in enumerate(lines):
                assert row == str(t + 1)
                day = lo + timedelta(days=t)
                want = [(daily.get((panel, a, day)) or (0, 0))[measure] or 0 for a, _ in picks]
                assert [float(v) for v in values] == pytest.approx(want)


def test_curves(spark, out):
    curves = spark.read.parquet(f"{out}/out/curves")
    assert curves.select("panel", "measure").distinct().count() == 48
    per_curve = curves.groupBy("panel", "measure", "user_name").count()
    assert {r["count"] for r in per_curve.collect()} == {80}
    assert curves.where("panel = 'CR10_c' and user_name = 'Luis Fishman'").count() == 0
    first = curves.where("panel = 'ES14_c' and grid_idx = 0").select("month").distinct().collect()
    assert [r.month for r in first] == ["Sep-13"]


def test_handle_is_left_out_of_one_curve_only(spark, out):
    curves = spark.read.parquet(f"{out}/out/curves").where("user_name = 'By handle'")
    assert {(r.panel, r.measure) for r in curves.collect()} == {("CR14_c", "Spon")}


def test_drop_modes(spark, out):
    daily = spark.read.parquet(f"{out}/out/daily").drop("panel")
    listed = {a for *_, a in CONFIG.dropped_if_all}
    single = {(e, t, a) for e, t, a in CONFIG.dropped}

    def accounts(df):
        return {tuple(r) for r in df.select("CountryElection", "type_of_account", "user_name").distinct().collect()}

    literal = accounts(kept_accounts(daily, CONFIG))
    intended = accounts(kept_accounts(daily, CONFIG, ALL_DIFFER))
    assert single <= accounts(daily) and not single & literal
    assert listed <= {a for *_, a in literal}
    assert literal - intended == {(e, t, a) for e, t, a in CONFIG.dropped_if_all}


def test_handles_are_optional(spark, out):
    rows = scored_rows(spark, f"{out}/posts.csv", CONFIG)
    assert "user_username" not in rows.columns


def test_series_table_keeps_the_days(spark, out):
    series = spark.read.parquet(f"{out}/out/series")
    starts = {r.name: r.lo for r in series.groupBy("name").agg({"created_at_seconds2": "min"}).toDF("name", "lo").collect()}
    for panel in CALENDAR_DAYS:
        lo = next(w[2] for w in CONFIG.windows if PANEL_OF[w[:2]] == panel)
        assert starts[f"VARdf_{panel}_Spon"] == lo
    wrong = series.where("datediff(created_at_seconds2, to_date('1970-01-01')) - t != 0").groupBy("name").count()
    assert wrong.count() == 20  # t counts from each panel's first day


def test_computed_windows(spark, out, posts, tmp_path):
    """All accounts of a panel but the excluded ones share the days of its window."""
    exclude = [(*w[:2], "Outsider") for w in CONFIG.windows]
    exclude += [tuple(x) for x in CONFIG.dropped + CONFIG.dropped_if_all]
    run(spark, f"{out}/posts.csv", str(tmp_path / "out"), CONFIG, windows=COMPUTED, exclude=exclude, folder=str(tmp_path / "scratch"))
    days = defaultdict(set)
    left_out = set(exclude) | {tuple(x) for x in CONFIG.dropped_first}
    for e, t, account, _, _, at, *_ in posts:
        if (e, t, account) not in left_out:
            days[e, t, account].add(date.fromisoformat(at[:10]))
    want = {}
    for e, t, _, _ in CONFIG.windows:
        own = [d for (x, y, _), d in days.items() if (x, y) == (e, t)]
        want[PANEL_OF[e, t]] = (max(map(min, own)), min(map(max, own)))
    daily = spark.read.parquet(str(tmp_path / "out" / "daily"))
    got = daily.groupBy("panel").agg({"created_at_seconds2": "min"}).toDF("panel", "lo").collect()
    assert all(r.lo >= want[r.panel][0] for r in got)
    last = daily.groupBy("panel").agg({"created_at_seconds2": "max"}).toDF("panel", "hi").collect()
    assert all(r.hi <= want[r.panel][1] for r in last) and len(last) == 24
    assert not list((tmp_path / "scratch").glob("run-*"))
