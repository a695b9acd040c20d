"""Tables given as arguments: windows, bounds, drops, picks, codes."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, types as T
from pyspark.sql.pandas.types import to_arrow_schema


def key_schema(df: DataFrame, keys: Sequence[str]) -> T.StructType:
    """The fields of `df` named in `keys`, for building a small table with equal types."""
    return T.StructType([T.StructField(k, df.schema[k].dataType) for k in keys])


def as_table(df: DataFrame, given: DataFrame | Sequence[tuple], schema: T.StructType) -> DataFrame:
    """`given` as a DataFrame with the columns of `schema`; no job is started.

    A DataFrame is used as it is, whatever its size. A list is in the driver's memory already
    and becomes a local relation of known size. Either way the join is left to Spark, which
    broadcasts a side by its size and splits skewed partitions where it does not.
    """
    if isinstance(given, DataFrame):
        return given.select(*schema.names)
    arrow = to_arrow_schema(schema)
    columns = zip(*given) if given else [[]] * len(schema)
    arrays = [pa.array(c, f.type) for c, f in zip(columns, arrow)]
    return df.sparkSession.createDataFrame(pa.Table.from_arrays(arrays, names=schema.names), schema)
