"""What several operators share: tables, the definition of a word, and running totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from dayweave.operators.totals import running_totals

__all__ = ["SPACES", "WORD", "let", "running_totals", "table", "word_count"]

# A word is a run of characters other than space, tab, line feed, vertical tab,
# form feed and carriage return.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: str) -> Column:
    """Number of words; 0 without text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def let(value: Column, body) -> Column:
    """`body(value)` with `value` computed once, however often `body` uses it."""
    return F.transform(F.array(value), body)[0]
