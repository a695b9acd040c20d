"""Running sums over many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from dayweave.sources.scratch import materialize


def running_totals(
    df: DataFrame, order: list[Column], totals: dict[str, Column], name: str, folder: str | None = None
) -> DataFrame:
    """`df` with inclusive running sums in a total order, without sorting in one task.

    Rows are range-partitioned in that order and written, so that the partition of a row is
    fixed; the sums of the partitions, one row each, give what lies before each partition, and
    the rest is a window inside it. `order` must tell rows apart: equal ones stay together.
    """
    values = {f"__v_{out}": value for out, value in totals.items()}
    ranged = (
        df.withColumns(values)
        .repartitionByRange(*order)
        .withColumn("__part", F.spark_partition_id())
    )
    ranged = materialize(ranged, name, folder)
    up_to = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        ranged.groupBy("__part")
        .agg(*[F.sum(v).alias(v) for v in values])
        .select("__part", *[F.coalesce(F.sum(v).over(up_to), F.lit(0)).alias(f"__before{v}") for v in values])
    )
    within = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # As many rows as partitions, so the side is small whatever the data.
    return (
        ranged.join(F.broadcast(before), "__part")
        .withColumns({out: F.col(f"__before__v_{out}") + F.sum(f"__v_{out}").over(within) for out in totals})
        .drop("__part", *values, *[f"__before{v}" for v in values])
    )
