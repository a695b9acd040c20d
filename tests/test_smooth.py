"""LOESS against a direct weighted least squares fit, and its exact properties."""

import math
from datetime import date, timedelta

import numpy as np
import pytest

from dayweave import Measure, PanelSpec
from dayweave.operators.smooth import loess_curve, with_month_label

SPEC = PanelSpec(("panel",), "who", "at", (Measure("x", "mean_x", "X"), Measure("y", "mean_y", "Y")))
D = date(2013, 9, 1)


def frame(spark, points):
    """points: who -> [(day offset, x, y)]"""
    rows = [("p", w, D + timedelta(days=d), x, y) for w, ps in points.items() for d, x, y in ps]
    return spark.createDataFrame(rows, "panel string, who string, day date, x double, y double")


def fits(curve, label="X"):
    out = {}
    for r in curve.where(f"measure = '{label}'").collect():
        out.setdefault(r.who, {})[r.grid_idx] = (r.x_day, r.fit)
    return out


def direct(days, scores, span=0.7):
    """Fit every grid point on the rows themselves with numpy's least squares."""
    x = np.array([(D + timedelta(days=d) - date(1970, 1, 1)).days for d in days], float)
    y = np.array(scores, float)
    q = min(len(x), math.floor(span * len(x) + 1e-5))
    result = []
    for i in range(80):
        g = x.min() + i * (x.max() - x.min()) / 79
        far = np.abs(x - g)
        h = np.sort(far)[q - 1]
        near = far < h
        root = np.sqrt((1 - (far[near] / h) ** 3) ** 3)
        u = (x[near] - g) / h
        design = np.stack([np.ones_like(u), u, u * u], axis=1) * root[:, None]
        result.append(np.linalg.lstsq(design, y[near] * root, rcond=None)[0][0])
    return np.array(result)


def test_quadratic_is_reproduced(spark):
    points = [(d, 2 + 3 * d - 0.1 * d * d, 1.0) for d in range(30)]
    curve = fits(loess_curve(frame(spark, {"a": points}), SPEC))["a"]
    start = (D - date(1970, 1, 1)).days
    assert len(curve) == 80
    for x_day, fit in curve.values():
        d = x_day - start
        assert fit == pytest.approx(2 + 3 * d - 0.1 * d * d, abs=1e-8)


def test_many_rows_per_day_match_a_fit_on_the_rows(spark):
    rng = np.random.default_rng(7)
    points = {}
    for who in "abcd":
        days = rng.integers(0, 60, 300).tolist() + [0, 59]
        points[who] = [(d, float(rng.normal(50, 20)), float(rng.normal())) for d in days]
    curve = loess_curve(frame(spark, points), SPEC)
    for label, column in (("X", 1), ("Y", 2)):
        got = fits(curve, label)
        for who, ps in points.items():
            want = direct([p[0] for p in ps], [p[column] for p in ps])
            mine = [got[who][i][1] for i in range(80)]
            assert np.allclose(mine, want, rtol=0, atol=1e-8)


def test_thin_series(spark):
    points = {"one": [(3, 1.0, 1.0), (3, 2.0, 1.0)], "two": [(0, 1.0, 1.0), (9, 2.0, 1.0)]}
    got = fits(loess_curve(frame(spark, points), SPEC))
    assert set(got) == {"two"}
    assert [f for _, f in got["two"].values()] == [None] * 80


def test_missing_and_infinite_scores_are_left_out(spark):
    good = [(d, float(d * d % 17), 1.0) for d in range(25)]
    bad = [(5, math.nan, 1.0), (6, math.inf, 1.0), (7, None, 1.0), (40, None, 1.0)]
    got = fits(loess_curve(frame(spark, {"a": good, "b": good + bad}), SPEC))
    assert got["a"] == got["b"]


def test_month_label(spark):
    curve = with_month_label(loess_curve(frame(spark, {"a": [(d, 1.0, 1.0) for d in range(40)]}), SPEC, ("X",)))
    labels = {r.grid_idx: r.month for r in curve.collect()}
    assert (labels[0], labels[79]) == ("Sep-13", "Oct-13")


def plain_fit(x, y, at, span, pseudo):
    """Value and slope at one point, on rows, by the pseudo-inverse of the scaled design."""
    q = min(len(x), math.floor(span * len(x) + 1e-5))
    far = np.abs(x - at)
    h = np.sort(far)[q - 1]
    near = far < h
    if not near.any() or (not pseudo and len(set(x[near])) < 3):
        return math.nan, math.nan
    root = np.sqrt((1 - (far[near] / h) ** 3) ** 3)
    u = (x[near] - at) / h
    design = np.stack([np.ones_like(u), u, u * u], axis=1) * root[:, None]
    length = np.linalg.norm(design, axis=0)
    length[length == 0] = 1
    best = np.linalg.pinv(design / length, rcond=1e-9) @ (y[near] * root) / length
    return best[0], best[1] / h


def plain_curve(days, scores, surface, pseudo, span=0.7, share=0.2):
    x = np.array([(D + timedelta(days=d) - date(1970, 1, 1)).days for d in days], float)
    order = np.argsort(x, kind="stable")
    x, y = x[order], np.array(scores, float)[order]
    at = [x[0] + i * (x[-1] - x[0]) / 79 for i in range(80)]
    if surface == "direct":
        return [plain_fit(x, y, g, span, pseudo)[0] for g in at]
    spread = max(x[-1] - x[0], 1e-3 * max(abs(x[0]), abs(x[-1])))
    ends = [x[0] - 0.005 * spread, x[-1] + 0.005 * spread]

    def split(rows):
        if len(rows) <= math.floor(len(x) * span * share):
            return
        # Rows are counted from 1 over all; a cut comes after a row.
        middle = (rows[0] + rows[-1]) // 2
        cuts = [r for r in rows[:-1] if x[r - 1] != x[r]]
        if cuts:
            cut = min(cuts, key=lambda r: (abs(r - middle), -r))
            ends.append((x[cut - 1] + x[cut]) / 2)
            split([r for r in rows if r <= cut])
            split([r for r in rows if r > cut])

    split(list(range(1, len(x) + 1)))
    ends.sort()
    fitted = [plain_fit(x, y, v, span, pseudo) for v in ends]
    out = []
    for g in at:
        i = max(k for k in range(len(ends) - 1) if ends[k] <= g)
        (a, b), width = (fitted[i], fitted[i + 1]), ends[i + 1] - ends[i]
        # The cubic through both values and slopes, from its own equations.
        system = [[1, 0, 0, 0], [0, 1, 0, 0], [1, width, width**2, width**3], [0, 1, 2 * width, 3 * width**2]]
        c = np.linalg.solve(system, [*a, *b]) if not np.isnan([*a, *b]).any() else [math.nan] * 4
        out.append(sum(c[k] * (g - ends[i]) ** k for k in range(4)))
    return out


def awkward_points():
    rng = np.random.default_rng(3)
    points = {}
    for who in "abcdef":
        days = np.sort(rng.choice(120, rng.integers(15, 60), replace=False))
        points[who] = [(int(d), rng.normal(d % 9, 3), 1.0) for d in days for _ in range(rng.integers(1, 6))]
    # Half of all rows on one day; gaps; few days.
    points["hot"] = [(50, float(i % 7), 1.0) for i in range(60)] + [(d, float(d % 5), 1.0) for d in range(0, 100, 2)]
    points["gap"] = [(d, float(d * d % 11), 1.0) for d in [*range(10), *range(200, 215)]]
    points["three"] = [(0, 1.0, 1.0), (0, 3.0, 1.0), (4, 2.0, 1.0), (9, 8.0, 1.0)]
    points["two"] = [(0, 1.0, 1.0), (0, 2.0, 1.0), (10, 7.0, 1.0), (10, 9.0, 1.0), (10, 2.0, 1.0)]
    points["pair"] = [(3, 1.0, 1.0), (8, 5.0, 1.0)]
    return points


@pytest.mark.parametrize("surface", ["direct", "interpolate"])
@pytest.mark.parametrize("singular", ["null", "least"])
def test_curves_match_a_plain_version(spark, surface, singular):
    points = awkward_points()
    if singular == "null":
        # Its fits are nearly singular, and which of them are NULL depends on the limit.
        del points["three"]
    got = fits(loess_curve(frame(spark, points), SPEC, labels=("X",), surface=surface, singular=singular))
    known = 0
    for who, ps in points.items():
        want = plain_curve([d for d, *_ in ps], [x for _, x, _ in ps], surface, singular == "least")
        for i, value in enumerate(want):
            fit = got[who][i][1]
            assert (fit is None) == math.isnan(value), (who, i)
            if fit is not None:
                known += 1
                assert fit == pytest.approx(value, rel=1e-6, abs=1e-6), (who, i)
    assert known > 500


def test_least_fits_where_two_days_have_weight(spark):
    """Two days cannot fix a quadratic: NULL by default, on request the smallest that goes through both means."""
    points = {"two": awkward_points()["two"]}
    plain = fits(loess_curve(frame(spark, points), SPEC, labels=("X",)))["two"]
    assert all(fit is None for _, fit in plain.values())
    least = fits(loess_curve(frame(spark, points), SPEC, labels=("X",), singular="least"))["two"]
    assert sum(fit is not None for _, fit in least.values()) > 10


def test_interpolation_keeps_quadratics_and_stays_near_the_direct_curve(spark):
    exact = [(d, 2 + 3 * d - 0.1 * d * d, 1.0) for d in range(60)]
    rng = np.random.default_rng(6)
    noisy = [(d, math.sin(d / 9) + rng.normal(0, 0.1), 1.0) for d in range(120)]
    df = frame(spark, {"exact": exact, "noisy": noisy})
    direct, blended = (fits(loess_curve(df, SPEC, labels=("X",), surface=s)) for s in ("direct", "interpolate"))
    for (x, a), (_, b) in zip(direct["exact"].values(), blended["exact"].values()):
        assert a == pytest.approx(b, abs=1e-8)
    far = [abs(a - b) for (_, a), (_, b) in zip(direct["noisy"].values(), blended["noisy"].values())]
    assert 1e-9 < max(far) < 0.2


def test_unknown_ways_are_refused(spark):
    for how in ({"surface": "flat"}, {"singular": "guess"}):
        with pytest.raises(ValueError):
            loess_curve(frame(spark, {"a": [(0, 1.0, 1.0)]}), SPEC, **how)
