"""LOESS curves per account."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from dayweave.functions import finite, month_label
from dayweave.spec import PanelSpec

# Executors get the fitting functions themselves and need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

GRID = 80
# Ways to get from local fits to a curve, and what to do where a fit is not determined.
DIRECT, INTERPOLATE = "direct", "interpolate"
NULL, LEAST = "null", "least"
# A cell of the interpolated surface is split while it has more than this share of the rows of a fit.
CELL = 0.2
# Relative weight below which the quadratic term counts as undetermined.
SINGULAR = 1e-9


def loess_curve(
    rows: DataFrame,
    spec: PanelSpec,
    labels: tuple[str, ...] | None = None,
    span: float = 0.7,
    grid: int = GRID,
    surface: str = DIRECT,
    singular: str = NULL,
    cell: float = CELL,
) -> DataFrame:
    """Local quadratic fit of each score against the day, per account.

    The weights of a fit depend on the day only, so rows are first summed per account-day:
    that is exact, and an account then has at most one entry per calendar day however many
    rows it had. Each account's days travel as arrays and are fitted by a vectorised
    function on Arrow batches, which was ten times faster than array expressions.

    Each curve has `grid` evenly spaced points between the account's own first and last
    day. Rows without a day or with a missing or infinite score are left out; accounts with
    a single day give no curve.

    `surface="direct"` fits at every point. `"interpolate"` fits at the ends of cells and blends
    values and slopes between them by cubics: the days' range, a little widened, is cut at the
    middle of a cell's rows, between two different days, while the cell has more than
    `cell * span` of all rows.

    Where fewer than three days have weight the quadratic is not determined: `fit` is NULL, or
    with `singular="least"` the smallest of all coefficients that fit best, columns scaled to
    length 1. Where all rows of a fit lie at one distance there is no weight, and `fit` is NULL.
    """
    return fit_curves(daily_sums(rows, spec, labels), spec, labels, span, grid, surface, singular, cell)


def daily_sums(rows: DataFrame, spec: PanelSpec, labels: tuple[str, ...] | None = None) -> DataFrame:
    """Number and sum of the finite scores of each account-day: all that a curve depends on.

    Clipping by day and summing per day commute, so a computed window can be taken from this
    table and applied to it.
    """
    measures = _measures(spec, labels)
    scored = rows.where(F.col(spec.day).isNotNull()).select(
        *spec.account_day, *[finite(m.column).alias(m.label) for m in measures]
    )
    return scored.groupBy(*spec.account_day).agg(
        *[F.count(m.label).alias(f"n_{m.label}") for m in measures],
        *[F.sum(m.label).alias(f"sum_{m.label}") for m in measures],
    )


def _measures(spec: PanelSpec, labels: tuple[str, ...] | None):
    return spec.only(*labels).measures if labels else spec.measures


def fit_curves(
    per_day: DataFrame,
    spec: PanelSpec,
    labels: tuple[str, ...] | None = None,
    span: float = 0.7,
    grid: int = GRID,
    surface: str = DIRECT,
    singular: str = NULL,
    cell: float = CELL,
) -> DataFrame:
    """The curves of `loess_curve` from `daily_sums`."""
    if surface not in (DIRECT, INTERPOLATE) or singular not in (NULL, LEAST):
        raise ValueError(f"no such surface or way of singular fits: {surface}, {singular}")
    measures = _measures(spec, labels)
    per_measure = per_day.select(
        *spec.series,
        F.unix_date(spec.day).alias("x"),
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(m.label).alias("measure"),
                        F.col(f"n_{m.label}").alias("n"),
                        F.col(f"sum_{m.label}").alias("total"),
                    )
                    for m in measures
                ]
            )
        ),
    ).where(F.col("n") > 0)
    # An explicit number of partitions: adaptive execution merges partitions by their bytes,
    # which are few here, while the work per byte is large.
    # spark.sql.shuffle.partitions is the knob for it.
    tasks = int(per_day.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    series = (
        per_measure.repartition(tasks, *spec.series)
        .groupBy(*spec.series, "measure")
        .agg(
            F.collect_list(F.struct("x", "n", "total")).alias("days"),
            F.min("x").alias("lo"),
            F.max("x").alias("hi"),
        )
        .where(F.col("lo") < F.col("hi"))
    )
    fits = _fitter(span, grid, surface, singular, cell)(F.col("days.x"), F.col("days.n"), F.col("days.total"))
    # The outer form keeps Spark from calling the function a second time to test for emptiness.
    return (
        series.select(*spec.series, "measure", "lo", "hi", fits.alias("fits"))
        .select(*spec.series, "measure", "lo", "hi", F.posexplode_outer("fits").alias("grid_idx", "fit"))
        .select(
            *spec.series,
            "measure",
            "grid_idx",
            (F.col("lo") + F.col("grid_idx") * (F.col("hi") - F.col("lo")) / (grid - 1.0)).alias("x_day"),
            "fit",
        )
    )


def with_month_label(curve: DataFrame) -> DataFrame:
    """Label of the month each point of a curve falls in."""
    day = F.date_from_unix_date(F.floor("x_day").cast("int"))
    return curve.withColumn("month", month_label(day))


def _fitter(span: float, grid: int, surface: str, singular: str, cell: float):
    @F.arrow_udf("array<double>")
    def fit(x: pa.Array, n: pa.Array, total: pa.Array) -> pa.Array:
        ends = np.cumsum(np.asarray(x.value_lengths()))[:-1]
        columns = [np.split(np.asarray(c.flatten(), dtype=float), ends) for c in (x, n, total)]
        return pa.array(
            [_curve(*series, span, grid, surface, singular, cell) for series in zip(*columns)],
            pa.list_(pa.float64()),
            from_pandas=True,
        )

    return fit


def _curve(x, n, total, span: float, grid: int, surface: str, singular: str, cell: float) -> np.ndarray:
    """The curve at `grid` points through days `x` with `n` rows summing to `total` on each."""
    order = np.argsort(x)
    x, n, total = x[order], n[order], total[order]
    lo, hi = x[0], x[-1]
    at = lo + np.arange(grid) * (hi - lo) / (grid - 1.0)
    if surface == DIRECT:
        return _local_quadratic(x, n, total, at, span, singular)[0]
    vertices = cell_ends(x, n, np.floor(n.sum() * span * cell))
    return _blended(vertices, *_local_quadratic(x, n, total, vertices, span, singular), at)


def cell_ends(x, n, most: float) -> np.ndarray:
    """Ends of the cells that sorted days `x` with `n` rows each are cut into, in order."""
    reached = np.cumsum(n).astype(np.int64)
    spread = max(x[-1] - x[0], max(abs(x[0]), abs(x[-1])) * 1e-3 + 1e-30)
    ends = [x[0] - 0.005 * spread, x[-1] + 0.005 * spread]
    # Runs of days: the rows of a cell are those of the days from `first` up to `last`.
    cells = [(0, len(x) - 1)]
    while cells:
        first, last = cells.pop()
        start = reached[first] - int(n[first]) + 1
        if first == last or reached[last] - start + 1 <= most:
            continue
        middle = (start + reached[last]) // 2
        # The change of days next to the middle row, of two the later one.
        away = reached[first:last] - middle
        cut = first + int(np.argmin(2 * np.abs(away) + (away < 0)))
        ends.append((x[cut] + x[cut + 1]) / 2)
        cells += [(first, cut), (cut + 1, last)]
    return np.sort(np.array(ends))


def _blended(ends, value, slope, at) -> np.ndarray:
    """Cubics between the ends of cells with the values and slopes there."""
    i = np.clip(np.searchsorted(ends, at, side="right") - 1, 0, len(ends) - 2)
    width = ends[i + 1] - ends[i]
    t = (at - ends[i]) / width
    rest = 1 - t
    values = rest * rest * (1 + 2 * t) * value[i] + t * t * (1 + 2 * rest) * value[i + 1]
    return values + (t * rest * rest * slope[i] - t * t * rest * slope[i + 1]) * width


def _local_quadratic(x, n, total, at, span: float, singular: str) -> tuple[np.ndarray, np.ndarray]:
    """Values and slopes at some points of the fits to sorted days with `n` rows summing to `total` each."""
    away = x - at[:, None]
    distance = np.abs(away)

    # Bandwidth: distance to the q-th nearest row, where a day counts n times. The q nearest
    # rows fill a run of days, so it is the radius that reaches both ends of the best run
    # with at least q rows; the runs are the same for every point.
    reached = np.cumsum(n)
    q = min(reached[-1], np.floor(span * reached[-1] + 1e-5))
    ends = np.searchsorted(reached, reached - n + q)
    starts = np.flatnonzero(ends < len(x))
    h = np.maximum(distance[:, starts], distance[:, ends[starts]]).min(axis=1)[:, None]

    with np.errstate(divide="ignore", invalid="ignore"):
        u = np.where(distance < h, away / h, 1.0)
        tricube = 1 - np.abs(u * u * u)
        w = tricube * tricube * tricube
        wn = w * n

        # Polynomials 1, d, p2 orthogonal under the weights: no badly conditioned system.
        s0 = _sum(wn)
        mean_u, level = _sum(wn * u) / s0, _sum(w * total) / s0
        d = u - mean_u
        m2, m3 = _sum(wn * d * d), _sum(wn * d * d * d)
        skew, var = m3 / m2, m2 / s0
        p2 = d * d - skew * d - var
        q2 = _sum(wn * p2 * p2)
        at_zero = mean_u * mean_u + skew * mean_u - var
        rest = w * (total - n * level)
        linear, quadratic = _sum(rest * d) / m2, _sum(rest * p2) / q2
        fits = level - linear * mean_u + quadratic * at_zero
        slopes = (linear - quadratic * (2 * mean_u + skew)) / h
        solvable = (_sum(w > 0) >= 3) & (q2 > SINGULAR * s0)
    fits, slopes = (np.where(solvable, v, np.nan)[:, 0] for v in (fits, slopes))
    if singular == LEAST:
        for i in np.flatnonzero(~solvable[:, 0] & (s0[:, 0] > 0)):
            near = w[i] > 0
            fits[i], slopes[i] = _least(u[i, near], wn[i, near], (total / n)[near])
            slopes[i] /= h[i, 0]
    return fits, slopes


def _least(u, weight, mean) -> tuple[float, float]:
    """Value and slope at 0 of the best quadratic with the smallest coefficients, columns scaled to length 1.

    Singular values that are zero but for rounding are left out.
    """
    root = np.sqrt(weight)
    design = np.stack([np.ones_like(u), u, u * u], axis=1) * root[:, None]
    length = np.linalg.norm(design, axis=0)
    scale = np.where(length > 0, length, 1.0)
    best = np.linalg.lstsq(design / scale, root * mean, rcond=1e-10)[0] / scale
    return best[0], best[1]


def _sum(terms) -> np.ndarray:
    return terms.sum(axis=1, keepdims=True)
