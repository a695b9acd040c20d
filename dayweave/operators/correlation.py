"""Autocorrelation and partial autocorrelation of series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

_NONE = "cast(array() AS array<double>)"


def autocorrelation(series: DataFrame, keys: Sequence[str], order: str, value: str, lags: int) -> DataFrame:
    """`n`, `lag` from 0 to `lags`, `acf` and `pacf` of each series.

    A series is what has equal `keys`, in the order of `order`, without gaps: its offset or day
    after completion. With d the distance from the series' mean, acf is the sum of
    d(t) * d(t + lag) divided by the sum of d(t)^2; pacf comes from the acf by Durbin and
    Levinson's recursion and is NULL at lag 0.

    Lagged products and their sums are formed in one shuffle, by series. A lag of n or more has
    NULL, and so have all lags of a series with a missing value or without variation; beyond a
    lag that the earlier ones determine wholly, pacf is NULL.
    """
    whole = Window.partitionBy(*keys)
    in_order = whole.orderBy(order)
    complete = F.count(F.lit(1)).over(whole) == F.count(value).over(whole)
    centred = series.withColumn("__d", F.when(complete, F.col(value) - F.avg(value).over(whole)))
    later = {f"__d{k}": F.lead("__d", k).over(in_order) for k in range(1, lags + 1)}
    sums = centred.withColumns(later).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("__d") * F.col("__d")).alias("__c0"),
        *[F.sum(F.col("__d") * F.col(d)).alias(f"__c{k}") for k, d in enumerate(later, 1)],
    )
    ratios = [F.when(F.col("__c0") > 0, F.col(f"__c{k}") / F.col("__c0")) for k in range(lags + 1)]
    return (
        sums.select(*keys, "n", F.array(*ratios).alias("__r"))
        .withColumn("__p", F.concat(F.array(F.lit(None).cast("double")), partial(F.col("__r"), lags)))
        .select(*keys, "n", F.posexplode(F.arrays_zip("__r", "__p")).alias("lag", "__both"))
        .select(*keys, "n", "lag", F.col("__both.__r").alias("acf"), F.col("__both.__p").alias("pacf"))
    )


def partial(r: Column, lags: int) -> Column:
    """Partial autocorrelations at lags 1 to `lags` from the array of autocorrelations from lag 0 on.

    With phi the coefficients of the best prediction from k - 1 values before, the k-th one is
    (r(k) - sum phi(j) r(k - j)) / (1 - sum phi(j) r(j)), and it moves the others by its own
    multiple of them in reverse.
    """

    def dot(a, b):
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    def step(state, k):
        phi = state["phi"]
        earlier = F.slice(r, 2, k - 1)
        left = 1 - dot(phi, earlier)
        new = F.when(left > 0, (F.element_at(r, k + 1) - dot(phi, F.reverse(earlier))) / left)

        def moved(at):
            return F.concat(F.zip_with(phi, F.reverse(phi), lambda a, b: a - at * b), F.array(at))

        # The array of one makes the new coefficient a variable, computed once.
        return F.transform(
            F.array(new), lambda at: F.struct(moved(at).alias("phi"), F.concat(state["out"], F.array(at)).alias("out"))
        )[0]

    none = F.expr(_NONE)
    start = F.struct(none.alias("phi"), none.alias("out"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(lags)), start, step)["out"] if lags else none
