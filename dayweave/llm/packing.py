"""Packing documents into training sequences: exact complements first, then best fit."""

from __future__ import annotations

import sys
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F

from dayweave.llm.tokens import WordEncoder, tokenizer_path, utf8
from dayweave.sources import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CAPACITY = 2048
END = b"\0\0\0\0"
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _cutter(path: str, capacity: int):
    def cut(batches):
        encoder = WordEncoder(path)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), utf8(batch.column("text"))):
                ids = encoder.ids(text) + END
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            columns = zip(*rows) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    return cut


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """The documents as token ids with an end mark, those above `capacity` cut into pieces."""
    path = path or tokenizer_path()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_cutter(path, capacity), _PIECES)


class Plan:
    """Which lengths go together, made from the number of pieces of each length.

    There are `capacity` lengths at most, so the work and the plan are bounded whatever the
    number of pieces. Always for the longest length left, the gap is filled exactly by one, two
    or three lengths whose sum is the gap, looked up by complement among those still available;
    if none fit exactly, by the longest that fits, and on with the gap that remains. A pattern
    is used as often as its lengths last.
    """

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY):
        self.left = np.zeros(capacity + 1, dtype=np.int64)
        for length, n in counts.items():
            self.left[length] = n
        self.capacity = capacity
        self.patterns: list[tuple[list[int], int]] = []
        while (lengths := np.flatnonzero(self.left)).size:
            pattern = self._pattern(int(lengths[-1]))
            uses = min(int(self.left[x]) // n for x, n in Counter(pattern).items())
            for x in pattern:
                self.left[x] -= uses
            self.patterns.append((pattern, uses))

    def _pattern(self, first: int) -> list[int]:
        pattern, gap = [first], self.capacity - first
        self.left[first] -= 1
        while gap:
            found = self._exactly(gap) or self._best(gap)
            if not found:
                break
            for x in found:
                self.left[x] -= 1
            pattern += found
            gap -= sum(found)
        for x in pattern:
            self.left[x] += 1
        return pattern

    def _best(self, gap: int) -> list[int]:
        fitting = np.flatnonzero(self.left[: gap + 1])
        return [int(fitting[-1])] if fitting.size else []

    def _exactly(self, gap: int) -> list[int]:
        if self.left[gap]:
            return [gap]
        if pair := self._pair(gap):
            return pair
        # The largest of three is at least a third of the gap.
        for third in np.flatnonzero(self.left[: gap - 1])[::-1]:
            if 3 * third < gap:
                break
            self.left[third] -= 1
            pair = self._pair(gap - int(third))
            self.left[third] += 1
            if pair:
                return [int(third), *pair]
        return []

    def _pair(self, total: int) -> list[int]:
        """Two available lengths of this sum, with the largest one there is."""
        half = total // 2
        small = self.left[1 : half + 1]
        large = self.left[total - half : total][::-1]
        both = np.flatnonzero((small > 0) & (large > 0))
        for i in both[:2]:
            x = int(i) + 1
            if 2 * x != total or self.left[x] > 1:
                return [total - x, x]
        return []

    def slots(self) -> dict[str, np.ndarray]:
        """Runs of places: pieces of a length, by rank from `rank`, go to the sequences from
        `sequence` on, at `offset`. Sorted by length and rank."""
        used = Counter()
        rows, sequence = [], 0
        for pattern, uses in self.patterns:
            offset = 0
            for length in pattern:
                rows.append((length, used[length], sequence, offset))
                used[length] += uses
                offset += length
            sequence += uses
        table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)
        return dict(zip(("length", "rank", "sequence", "offset"), table.T))


def _placer(slots: dict[str, np.ndarray], names: list[str]):
    def place(batches):
        for batch in batches:
            length, rank = (np.asarray(batch.column(c)) for c in ("length", "__rank"))
            run = np.empty(len(rank), dtype=np.int64)
            for x in np.unique(length):
                first, last = np.searchsorted(slots["length"], [x, x + 1])
                mine = length == x
                run[mine] = first + np.searchsorted(slots["rank"][first:last], rank[mine], side="right") - 1
            sequence = slots["sequence"][run] + rank - slots["rank"][run]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(sequence), pa.array(slots["offset"][run])],
                names=[*names, "sequence_id", "offset"],
            )

    return place


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece with its place: `sequence_id`, `offset`.

    Pieces are counted by length (at most `capacity` counts reach the driver), the plan is made
    from the counts, and each piece finds its place by its rank among the pieces of its length.
    Ranks come from the written table of pieces, counted per part and length, so no length has
    to fit into one task.

    A missing text is an empty one, which is a piece of one end mark. Repeated rows are packed
    each; ties are broken by the order in which the pieces were written. Columns of `docs`
    other than doc_id and text are not used. No documents give no rows.
    """
    cut = pieces(docs, path, capacity).withColumns(
        {"__part": F.spark_partition_id(), "__row": F.monotonically_increasing_id()}
    )
    cut = materialize(cut, "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = Plan(counts, capacity).slots()

    earlier = Window.partitionBy("length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        cut.groupBy("__part", "length")
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
        .select("__part", "length", "__before")
    )
    within = Window.partitionBy("__part", "length").orderBy("__row")
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    ranked = (
        cut.withColumn("__at", F.row_number().over(within))
        .join(parts, ["__part", "length"])
        .select(*names, (F.col("__before") + F.col("__at") - 1).alias("__rank"))
    )
    return ranked.mapInArrow(_placer(slots, names), f"{_PIECES}, sequence_id long, offset long")
