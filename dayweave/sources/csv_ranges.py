"""Quoted CSV read by many tasks: records found by the parity of quotes in byte ranges."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from dayweave.sources.scratch import materialize

# Executors get the functions themselves and need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

QUOTE = '"'
_ENDS = (
    "file string, block long, crlf boolean, parity long, starts_0 long, starts_1 long, "
    "head string, tail_0 string, tail_1 string"
)
_RECORDS = "file string, row long, record string"


def csv_records(spark: SparkSession, path: str | Sequence[str], folder: str | None = None) -> DataFrame:
    """`file`, `row` (from 0, the header's) and text of every record, read in byte ranges.

    Spark splits the files into ranges and reads their lines. A line break lies inside a field
    where the number of quotes before it is odd, so a range needs to know only whether that
    number is odd where it begins:

    1. Each range counts its quotes, and gives what lies before its first record end and after
       its last one, for both cases.
    2. The parities of a file's ranges, one row each, are summed up in order; so are the numbers
       of records that begin in each.
    3. The ranges are read again and give the records that begin and end in them. Those that
       reach over several ranges are put together from the pieces of step 1.

    What steps 1 and 2 find is a small table, written to `folder` (see `scratch_folder`). Texts are
    not shuffled, but for the pieces, unless there are too many ranges for Spark to
    broadcast a row for each. Quotes inside quoted fields must be doubled and a field with a quote
    must be quoted, as `write_scored_csv` writes it. Lines end in LF or CR LF; in a file whose
    first line ends in CR LF, those inside fields become LF, as with Spark's own reader. Empty
    records are left out and count for no row. A compressed file is one range.
    """
    lines = (
        spark.read.option("lineSep", "\n")
        .text(path if isinstance(path, str) else list(path))
        .select(
            "value",
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line"),
        )
    )
    in_file = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = lines.select("value", "file", "block").mapInArrow(_find_ends, _ENDS)
    ends = ends.withColumn("inside", F.pmod(F.coalesce(F.sum("parity").over(in_file), F.lit(0)), F.lit(2)).cast("int"))
    starts = F.when(F.col("inside") == 0, F.col("starts_0")).otherwise(F.col("starts_1"))
    ends = ends.withColumns({"starts": starts, "tail": F.when(F.col("inside") == 0, F.col("tail_0")).otherwise(F.col("tail_1"))})
    first = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    ends = ends.withColumns({"before": F.coalesce(F.sum("starts").over(in_file), F.lit(0)), "crlf": F.first("crlf").over(first)})

    # With its range's start known, a task finds its whole records; they are numbered as they begin.
    ends = materialize(ends, "csv-ranges", folder)
    known = ends.select("file", "block", "inside", "before", "crlf")
    laid = lines.join(known, ["file", "block"]).sortWithinPartitions("file", "block", "line")
    whole = laid.select("file", "block", "inside", "before", "crlf", "value").mapInArrow(_whole_records, _RECORDS)

    # A record that is not over at the end of a range goes on at the head of the next ones.
    piece = lambda text, place, row: F.struct(text.alias("text"), F.lit(place).alias("place"), row.alias("row"))
    head = F.when(F.col("inside") == 1, piece(F.col("head"), 0, F.lit(None).cast("long")))
    tail = F.when(F.col("tail").isNotNull(), piece(F.col("tail"), 1, F.col("before") + F.col("starts") - 1))
    pieces = ends.select("file", "block", "crlf", F.explode(F.array_compact(F.array(head, tail))).alias("piece"))
    pieces = pieces.select("file", "block", "crlf", "piece.*")
    so_far = Window.partitionBy("file").orderBy("block", "place").rowsBetween(Window.unboundedPreceding, 0)
    pieces = pieces.withColumn("row", F.max("row").over(so_far))
    texts = F.sort_array(F.collect_list(F.struct("block", "place", "text")))
    record = F.concat_ws("\n", F.transform(texts, lambda p: p["text"]))
    plain = F.regexp_replace(F.replace(record, F.lit("\r\n"), F.lit("\n")), r"\r\z", "")
    joined = pieces.groupBy("file", "row", "crlf").agg(record.alias("record"), plain.alias("plain"))
    return whole.unionByName(joined.select("file", "row", F.when(F.col("crlf"), F.col("plain")).otherwise(F.col("record")).alias("record")))


class Lines:
    """The lines of one range."""

    def __init__(self, values: pa.Array):
        self.values = values
        quotes = np.asarray(pc.count_substring(values, QUOTE)).astype(np.int64)
        # Parity after each line, if the range began outside a field.
        self.after = np.cumsum(quotes) % 2
        self.blank = np.asarray(pc.is_in(values, pa.array(["", "\r"], values.type)))

    def ends(self, inside: int) -> np.ndarray:
        """Lines after which a record is over."""
        return np.flatnonzero(self.after == inside)

    def starts(self, inside: int) -> np.ndarray:
        """Lines with which a record begins; an empty line between records is none."""
        before = np.concatenate([[0], self.after[:-1]]) ^ inside
        return np.flatnonzero((before == 0) & ~self.blank)

    def text(self, start: int, end: int) -> str:
        return "\n".join(self.values.slice(start, end - start).to_pylist())


def _ranges(batches, *keys: str) -> Iterator[tuple[tuple, Lines]]:
    """The lines of each range with its keys; a range's lines follow each other."""
    held, own = [], None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        changes = [0]
        for name in ("file", "block"):
            column = batch.column(name)
            if batch.num_rows > 1:
                changes += (np.flatnonzero(np.asarray(pc.not_equal(column.slice(1), column.slice(0, batch.num_rows - 1)))) + 1).tolist()
        edges = [*sorted(set(changes)), batch.num_rows]
        for start, end in zip(edges, edges[1:]):
            if start == end:
                continue
            key = tuple(batch.column(k)[start].as_py() for k in keys)
            if own is not None and key != own:
                yield own, Lines(pa.concat_arrays(held))
                held = []
            own = key
            held.append(table.column("value").slice(start, end - start).combine_chunks().cast(pa.large_string()))
    if held:
        yield own, Lines(pa.concat_arrays(held))


def _find_ends(batches):
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in _ENDS.split(", "))])
    for (file, block), lines in _ranges(batches, "file", "block"):
        n = len(lines.values)
        first, tails = lines.ends(1), []
        for inside in (0, 1):
            ends = lines.ends(inside)
            after = ends[-1] + 1 if len(ends) else 0
            # Inside a field from end to end, a range is all head.
            tails.append(lines.text(after, n) if after < n and (inside == 0 or len(ends)) else None)
        row = [
            file, block, lines.text(0, 1).endswith("\r"), int(lines.after[-1]), len(lines.starts(0)), len(lines.starts(1)),
            lines.text(0, first[0] + 1 if len(first) else n), *tails,
        ]
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, row))], schema=schema)


def _whole_records(batches):
    for (file, _, inside, before, crlf), lines in _ranges(batches, "file", "block", "inside", "before", "crlf"):
        starts, ends = lines.starts(inside), lines.ends(inside)
        # The first end belongs to a record of an earlier range if this one begins inside a field.
        to = np.searchsorted(ends, starts)
        use = to < len(ends)
        place, starts, ends = np.flatnonzero(use), starts[use], ends[to[use]] + 1
        records = lines.values.take(pa.array(starts))
        several = np.flatnonzero(ends - starts > 1)
        if len(several):
            length = ends[several] - starts[several]
            ahead = np.cumsum(length) - length
            at = np.repeat(starts[several] - ahead, length) + np.arange(length.sum())
            edges = pa.array(np.append(ahead, length.sum()), pa.int32())
            lists = pa.ListArray.from_arrays(edges, lines.values.take(pa.array(at)))
            mask = np.zeros(len(starts), dtype=bool)
            mask[several] = True
            records = pc.replace_with_mask(records, pa.array(mask), pc.binary_join(lists, pa.scalar("\n", pa.large_string())))
        if crlf:
            records = pc.replace_substring_regex(pc.replace_substring(records, "\r\n", "\n"), r"\r\z", "")
        n = len(starts)
        # Parts of bounded size, whatever the range.
        for first in range(0, n, 10_000):
            part = slice(first, min(first + 10_000, n))
            size = part.stop - part.start
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([file] * size, pa.string()),
                    pa.array(before + place[part], pa.int64()),
                    records.slice(part.start, size).cast(pa.string()),
                ],
                names=["file", "row", "record"],
            )
