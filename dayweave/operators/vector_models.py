"""Vector autoregressions: coefficients, Granger tests and impulse responses of the series of each panel."""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F

# Executors get the functions themselves and need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Relative size of a pivot below which the lagged values count as dependent.
DEPENDENT = 1e-10


def lagged_products(
    series: DataFrame, panel: Sequence[str], account: str, order: str, value: str, lags: int
) -> DataFrame:
    """All that a vector autoregression of `lags` lags needs to know of each panel, one row per panel.

    The vector at one time has the values of all accounts of the panel, by account, less their
    means. With z = (1, vector 1 time before, ..., vector `lags` times before, vector), `products`
    holds the sums of z z', its upper half row by row; they are formed by one aggregate over
    all times, of which tasks sum up their share first. `accounts` and `means` are in the
    order of the vector, `n` is the number of times used. Times at which an account is missing,
    or has a missing value, and those within `lags` after them, are not used.
    """
    whole = Window.partitionBy(*panel, account)
    centred = series.select(*panel, account, order, F.col(value).alias("__v"), F.avg(value).over(whole).alias("__mean"))
    entry = F.struct(F.col(account).alias("account"), (F.col("__v") - F.col("__mean")).alias("d"), F.col("__mean").alias("mean"))
    at = centred.where(F.col("__v").isNotNull()).groupBy(*panel, order).agg(F.sort_array(F.collect_list(entry)).alias("__row"))
    at = at.withColumn("__k", F.max(F.size("__row")).over(Window.partitionBy(*panel)))
    at = at.where(F.size("__row") == F.col("__k")).withColumn("__y", F.col("__row.d"))
    # A panel has as many vectors as its calendar has times.
    before = Window.partitionBy(*panel).orderBy(order)
    lagged = [F.lag("__y", i).over(before) for i in range(1, lags + 1)]
    consecutive = F.col(order) - F.lag(order, lags).over(before) == lags
    used = at.withColumn("__z", F.when(consecutive, F.concat(F.array(F.lit(1.0)), *lagged, F.col("__y")))).where(F.col("__z").isNotNull())
    products = summed_products(used, panel)
    named = used.groupBy(*panel).agg(F.any_value(F.col("__row.account")).alias("accounts"), F.any_value(F.col("__row.mean")).alias("means"))
    return products.join(named, list(panel)).select(*panel, "accounts", "means", "n", "products", F.lit(lags).alias("lags"))


def summed_products(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per group the sums of z z' over its rows, `products`, upper half row by row, and their number `n`;
    z is the array `__z`, of one length in a group."""
    m = F.size("__z")
    upper = F.flatten(
        F.transform(
            F.sequence(F.lit(1), m), lambda i: F.transform(F.slice("__z", i, m - i + 1), lambda x: x * F.element_at("__z", i))
        )
    )
    sums = rows.select(*keys, F.posexplode(upper).alias("__pos", "__x")).groupBy(*keys, "__pos")
    sums = sums.agg(F.sum("__x").alias("__s"), F.count("__x").alias("__n"))
    listed = F.array_sort(F.collect_list(F.struct("__pos", "__s")))
    return sums.groupBy(*keys).agg(F.transform(listed, lambda x: x["__s"]).alias("products"), F.max("__n").alias("n"))


class Model:
    """The autoregression of one panel by least squares, from its sums of products."""

    def __init__(self, k: int, lags: int, n: int, products, means):
        full = symmetric(products)
        self.k, self.lags, self.n, q = k, lags, n, k * lags + 1
        zz, zy, yy = full[:q, :q], full[:q, q:], full[q:, q:]
        self.free = n - q
        scale = np.sqrt(np.where(np.diag(zz) > 0, np.diag(zz), 1))
        scaled = zz / np.outer(scale, scale)
        # Not determined with too few times, or where lagged values depend on each other.
        self.known = self.free > 0 and np.linalg.eigvalsh(scaled)[0] > DEPENDENT
        if not self.known:
            return
        self.inverse = np.linalg.inv(scaled) / np.outer(scale, scale)
        self.b = self.inverse @ zy
        self.sigma = (yy - self.b.T @ zy) / self.free
        # Coefficients of lags, (lag, equation, account), and the constant for values with their means.
        self.a = self.b[1:].reshape(lags, k, k).transpose(0, 2, 1)
        means = np.asarray(means)
        self.constant = self.b[0] + means - self.a.sum(axis=0) @ means

    def errors(self) -> np.ndarray:
        """Standard errors of the coefficients of lags, shaped like them."""
        e = np.sqrt(np.maximum(np.outer(np.diag(self.inverse)[1:], np.diag(self.sigma)), 0))
        return e.reshape(self.lags, self.k, self.k).transpose(0, 2, 1)

    def granger(self, cause: int, effect: int) -> tuple[float, float]:
        """F statistic, and its tail probability, of the hypothesis that no lag of `cause` is in
        the equation of `effect`."""
        at = 1 + cause + self.k * np.arange(self.lags)
        b = self.b[at, effect]
        variance = self.inverse[np.ix_(at, at)] * self.sigma[effect, effect]
        f = float(b @ np.linalg.solve(variance, b)) / self.lags
        return f, f_tail(f, self.lags, self.free)

    def responses(self, horizon: int) -> np.ndarray:
        """Responses (time, account, shock) to shocks of one standard deviation, made orthogonal in
        the order of accounts."""
        out = [np.linalg.cholesky(self.sigma)]
        for h in range(1, horizon + 1):
            out.append(sum(self.a[i] @ out[h - 1 - i] for i in range(min(self.lags, h))))
        return np.array(out)


def symmetric(products) -> np.ndarray:
    """The whole matrix from its upper half, row by row."""
    m = math.isqrt(2 * len(products))
    full = np.zeros((m, m))
    full[np.triu_indices(m)] = products
    return full + np.triu(full, 1).T


def f_tail(f: float, a: int, b: int) -> float:
    """Probability that an F variable with a and b degrees of freedom is larger than f."""
    return _beta_share(b / (b + a * f), b / 2, a / 2) if f > 0 else 1.0


def _beta_share(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_share(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    # Evaluated from behind; terms this far back no longer matter.
    value = 1.0
    for i in range(400, 0, -1):
        j = i // 2
        term = j * (b - j) * x / ((a + 2 * j - 1) * (a + 2 * j)) if i % 2 == 0 else -(a + j) * (a + b + j) * x / ((a + 2 * j) * (a + 2 * j + 1))
        value = 1 + term / value
    return front / value


def _rows_of(panel: Sequence[str], names: list[str], rows):
    """A function for tasks: the rows that `rows(model, accounts)` gives for each panel."""

    def run(batches):
        for batch in batches:
            found, owner = [], []
            columns = [batch.column(c).to_pylist() for c in ("accounts", "means", "n", "products", "lags")]
            for i, (accounts, means, n, products, lags) in enumerate(zip(*columns)):
                own = list(rows(Model(len(accounts), lags, n, products, means), accounts))
                found += own
                owner += [i] * len(own)
            at = pa.array(owner, pa.int64())
            values = [pa.array(list(c)) for c in zip(*found)]
            if found:
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in panel), *values], names=[*panel, *names])

    return run


def _solved(products: DataFrame, panel: Sequence[str], schema: str, rows) -> DataFrame:
    keys = ", ".join(f"`{k}` {products.schema[k].dataType.simpleString()}" for k in panel)
    name = products.schema["accounts"].dataType.elementType.simpleString()
    schema = schema.replace("ACCOUNT", name)
    names = [c.split()[0] for c in schema.split(", ")]
    return products.mapInArrow(_rows_of(panel, names, rows), f"{keys}, {schema}")


def coefficients(products: DataFrame, panel: Sequence[str]) -> DataFrame:
    """`equation`, `account`, `lag`, `coefficient` and `std_error` of each panel's model.

    The row with lag 0 and the equation's own account is the constant, without a standard
    error. Models that are not determined have no rows: fewer times than coefficients, or values
    of an account that do not vary or follow from others.
    """

    def rows(model: Model, accounts):
        if not model.known:
            return
        errors = model.errors()
        for e, equation in enumerate(accounts):
            yield equation, equation, 0, float(model.constant[e]), float("nan")
            for lag in range(model.lags):
                for c, account in enumerate(accounts):
                    yield equation, account, lag + 1, float(model.a[lag, e, c]), float(errors[lag, e, c])

    out = _solved(products, panel, "equation ACCOUNT, account ACCOUNT, lag long, coefficient double, std_error double", rows)
    return out.withColumn("std_error", F.nullif("std_error", F.lit(float("nan"))))


def granger_tests(products: DataFrame, panel: Sequence[str]) -> DataFrame:
    """For every two accounts of a panel the F test that the past of `cause` adds nothing to `effect`:
    `f`, `df1`, `df2` and `p`, the probability of a larger one."""

    def rows(model: Model, accounts):
        for c, cause in enumerate(accounts) if model.known else ():
            for e, effect in enumerate(accounts):
                if c != e:
                    f, p = model.granger(c, e)
                    yield cause, effect, f, model.lags, model.free, p

    return _solved(products, panel, "cause ACCOUNT, effect ACCOUNT, f double, df1 long, df2 long, p double", rows)


def impulse_responses(products: DataFrame, panel: Sequence[str], horizon: int) -> DataFrame:
    """`response` of every account, 0 to `horizon` times after a shock to `impulse` of one standard
    deviation. Shocks are made orthogonal in the order of accounts, so an account's shock moves
    later ones at once, and earlier ones only with the next time."""

    def rows(model: Model, accounts):
        if not model.known:
            return
        for h, moved in enumerate(model.responses(horizon)):
            for r, account in enumerate(accounts):
                for s, shock in enumerate(accounts):
                    yield shock, account, h, float(moved[r, s])

    return _solved(products, panel, "impulse ACCOUNT, account ACCOUNT, horizon long, response double", rows)
