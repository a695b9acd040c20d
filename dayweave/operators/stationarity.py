"""The augmented Dickey-Fuller test of series."""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F

from dayweave.operators.vector_models import DEPENDENT, summed_products, symmetric

# Executors get the functions themselves and need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# MacKinnon's response surfaces (2010) of the critical values at 1, 5 and 10 %, as
# coefficients of powers of 1 / n, with a constant and with a constant and a trend.
CRITICAL = {
    False: ((-3.43035, -6.5393, -16.786, -79.433), (-2.86154, -2.8903, -4.234, -40.040), (-2.56677, -1.5384, -2.809, 0.0)),
    True: ((-3.95877, -9.0531, -28.428, -134.155), (-3.41049, -4.3904, -9.036, -45.374), (-3.12705, -2.5856, -3.925, -22.380)),
}
_NAMES = ["n", "lag", "statistic", "critical_1", "critical_5", "critical_10"]


def dickey_fuller(
    series: DataFrame, keys: Sequence[str], order: str, value: str, lags: int, trend: bool = False
) -> DataFrame:
    """`n`, `lag`, `statistic` and critical values at 1, 5 and 10 percent for each series.

    The change of a series is regressed on a constant, with `trend` on the time too, on the
    value one time before and on the changes 1 to `lag` times before; the statistic is the t value of
    the value before, and the more it is below a critical value, the less likely is a unit root. Of
    the lags 0 to `lags` the one with the smallest information criterion of Akaike is taken;
    all are fitted to the same `n` times, those with `lags` changes before them.

    The sums of products of each series come from one aggregate over all times, see `summed_products`.
    Times without all the values needed are left out. A series that does not determine the
    test, by too few times or no variation, has NULL for lag and statistic; one without any
    usable time has no row.
    """
    in_order = Window.partitionBy(*keys).orderBy(order)
    whole = Window.partitionBy(*keys)
    before = F.lag("__y").over(in_order)
    # Both tests are the same for a series moved up or down, and in time.
    rows = series.select(*keys, order, (F.col(value) - F.avg(value).over(whole)).alias("__y"), (F.col(order) - F.min(order).over(whole)).alias("__t"))
    rows = rows.withColumns(
        {
            "__before": before,
            "__change": F.when(F.col(order) - F.lag(order).over(in_order) == 1, F.col("__y") - before),
        }
    )
    fixed = [F.lit(1.0), *([F.col("__t").cast("double")] if trend else []), F.col("__before")]
    changes = [F.lag("__change", i).over(in_order) for i in range(1, lags + 1)]
    z = [*fixed, *changes, F.col("__change")]
    # Any missing part leaves the row out.
    known = F.when(F.col(order) - F.lag(order, lags + 1).over(in_order) == lags + 1, F.array(*z))
    rows = rows.withColumn("__z", known).where(F.col("__z").isNotNull() & ~F.exists("__z", lambda x: x.isNull()))
    products = summed_products(rows, keys)
    types = ", ".join(f"`{k}` {products.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{types}, n long, lag long, " + ", ".join(f"{c} double" for c in _NAMES[2:])
    return products.mapInArrow(_tester(list(keys), lags, trend), schema)


def tested(products, n: int, lags: int, trend: bool) -> tuple[int | None, float | None]:
    """The lag with the least criterion and its statistic, from the sums of products."""
    full = symmetric(products)
    least, fixed = (math.inf, None, None), 3 if trend else 2
    yy = full[-1, -1]
    for lag in range(lags + 1):
        q = fixed + lag
        zz, zy = full[:q, :q], full[:q, -1]
        scale = np.sqrt(np.where(np.diag(zz) > 0, np.diag(zz), 1))
        scaled = zz / np.outer(scale, scale)
        if n <= q or np.linalg.eigvalsh(scaled)[0] <= DEPENDENT:
            continue
        inverse = np.linalg.inv(scaled) / np.outer(scale, scale)
        b = inverse @ zy
        rest = yy - b @ zy
        if rest <= 1e-12 * yy:
            continue
        at = fixed - 1
        statistic = b[at] / math.sqrt(inverse[at, at] * rest / (n - q))
        least = min(least, (n * math.log(rest / n) + 2 * q, lag, float(statistic)))
    return least[1:]


def _tester(keys: list[str], lags: int, trend: bool):
    def run(batches):
        for batch in batches:
            n = batch.column("n").to_pylist()
            found = [tested(p, m, lags, trend) for p, m in zip(batch.column("products").to_pylist(), n)]
            lag, statistic = ([f[i] for f in found] for i in (0, 1))
            critical = [[sum(c / m**i for i, c in enumerate(level)) for m in n] for level in CRITICAL[trend]]
            columns = [batch.column("n"), pa.array(lag, pa.int64()), *(pa.array(c, pa.float64()) for c in (statistic, *critical))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *columns], names=[*keys, *_NAMES])

    return run
