"""Hard-negative mining by Fagin's threshold algorithm over blocks of integer vectors."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from dayweave.sources import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

POSITIVES, NEGATIVES = 5, 5
SCALE, LOW, HIGH = 256, 80, 100
# Rows of a block of candidates, and of a chunk of anchors. They decide memory and speed only.
BLOCK, CHUNK = 4096, 256
# How far the first round of sorted access goes; each further one goes twice as far.
FIRST = 16
# Integers beyond this are taken as this.
_MOST = float(1 << 62)


def integers(vectors: pa.Array) -> np.ndarray:
    """floor(SCALE * x) of every component, one row per vector; shorter ones end in zeros."""
    size = np.asarray(vectors.value_lengths()).astype(np.int64)
    flat = np.floor(SCALE * np.asarray(vectors.flatten(), dtype=np.float64))
    out = np.zeros((len(size), int(size.max(initial=0))), dtype=np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = np.clip(flat, -_MOST, _MOST)
    return out


def _narrow(matrix: np.ndarray) -> np.ndarray:
    most = max(int(matrix.max(initial=0)), -int(matrix.min(initial=0)))
    return matrix.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64)


def _exact(dims: int, most_a: int, most_b: int):
    """The fastest type in which every inner product of such vectors is exact."""
    bound = dims * most_a * most_b
    return np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64 if bound < 1 << 63 else object


class Block:
    """Candidates with one list per dimension, sorted by that component."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, matrix: np.ndarray, lists: np.ndarray):
        self.ids, self.labels, self.matrix = ids, labels, matrix
        values = np.take_along_axis(matrix.T, lists, axis=1)
        # Each list from its end, for positive components of an anchor, then from its start.
        self.lists = np.concatenate([lists[:, ::-1], lists])
        self.values = np.concatenate([values[:, ::-1], values])
        self.most = max(int(matrix.max(initial=0)), -int(matrix.min(initial=0)))
        self.typed = {}

    def of_type(self, kind) -> tuple[np.ndarray, np.ndarray]:
        if kind not in self.typed:
            self.typed[kind] = self.matrix.astype(kind), self.values.astype(kind)
        return self.typed[kind]

    def search(self, anchor: np.ndarray, fits: np.ndarray, low: np.ndarray, high: np.ndarray, k: int):
        """Per window [low, high] of scores, the rows of the first k that fit, and their scores.

        Sorted access goes down all lists in step, each from the end that the anchor's sign
        prefers; every row met is scored at once. No row not met yet can score above the
        threshold, the anchor's product with the last values seen. The search ends when that is
        strictly below the k-th score of every window (or its lower end, if it has fewer).
        """
        dims = min(len(anchor), self.matrix.shape[1])
        anchor = anchor[:dims]
        most = max(int(anchor.max(initial=0)), -int(anchor.min(initial=0)))
        kind = _exact(dims, most, self.most)
        matrix, values = self.of_type(kind)
        anchor = anchor.astype(kind)
        used = np.flatnonzero(anchor)
        weight = anchor[used]
        rows = used + np.where(weight < 0, self.matrix.shape[1], 0)
        n = len(self.ids)
        kth, best = low.copy(), low.min()
        met, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        seen = np.zeros(n, dtype=bool)
        start, end = 0, FIRST
        if not len(used):
            # Every row scores 0.
            met, scores, start = np.flatnonzero(fits), np.zeros(int(fits.sum()), np.int64), n
        elif _whole(values[rows, 0] @ weight) < best:
            start = n
        while start < n:
            end = min(end, n)
            before = seen.copy()
            seen[self.lists[rows, start:end].ravel()] = True
            new = np.flatnonzero(seen & ~before & fits)
            own = _whole(matrix[new, :dims] @ anchor)
            inside = (own >= best) & (own <= high.max())
            met, scores = np.concatenate([met, new[inside]]), np.concatenate([scores, own[inside]])
            for w in range(len(low)):
                held = scores[(scores >= low[w]) & (scores <= high[w])]
                if len(held) >= k:
                    kth[w] = np.partition(held, len(held) - k)[len(held) - k]
            best = kth.min()
            if _whole(values[rows, end - 1] @ weight) < best:
                break
            start, end = end, 2 * end
        out = []
        for w in range(len(low)):
            held = np.flatnonzero((scores >= low[w]) & (scores <= high[w]))
            first = held[np.lexsort((self.ids[met[held]], -scores[held]))[:k]]
            out.append((met[first], scores[first]))
        return out


def _whole(scores) -> np.ndarray:
    """Scores as 64-bit integers; those that do not fit are taken as the nearest that does."""
    scores = np.asarray(scores)
    if scores.dtype.kind in "Ou":
        most = (1 << 63) - 1
        return np.array(np.clip(scores.astype(object), -most, most), dtype=np.int64)
    return scores.astype(np.int64)


_BLOCK = "block long, n int, lo long, hi long, labels_held array<long>, ids binary, labels binary, kind string, matrix binary, lists binary"


def _block_writer(size: int, lists: bool, extra: list[str]):
    """Rows in order, `size` to a block; a row that repeats the one before it is left out."""

    def write(batches):
        number = TaskContext.get().partitionId() << 32
        held, last = [], None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("id", "label")), strict=True))
            same = [i for i, key in enumerate(keys) if key == (keys[i - 1] if i else (last and last[0]))]
            if same:
                # Only rows that share id and label with the one before them are looked at whole.
                vectors = batch.column("vector")
                again = [i for i in same if vectors[i].as_py() == (vectors[i - 1].as_py() if i else last[1])]
                table = table.take(np.setdiff1d(np.arange(len(keys)), again))
            last = keys[-1], batch.column("vector")[-1].as_py()
            held.append(table)
            while sum(map(len, held)) >= size:
                whole = pa.concat_tables(held).combine_chunks()
                yield _block(whole.slice(0, size), number, lists, extra)
                held, number = [whole.slice(size)], number + 1
        if sum(map(len, held)):
            yield _block(pa.concat_tables(held).combine_chunks(), number, lists, extra)

    return lambda batches: write(b for b in batches if b.num_rows)


def _block(rows: pa.Table, number: int, lists: bool, extra: list[str]) -> pa.RecordBatch:
    rows = rows.combine_chunks()
    ids, labels = (np.asarray(rows.column(c)) for c in ("id", "label"))
    matrix = _narrow(integers(rows.column("vector").combine_chunks()))
    order = np.argsort(matrix, axis=0, kind="stable").T if lists else np.zeros(0)
    order = np.ascontiguousarray(order, dtype=np.int16 if len(ids) < 1 << 15 else np.int32)
    kinds = f"{matrix.dtype.str} {order.dtype.str}"
    out = {
        "block": [number],
        "n": pa.array([len(ids)], pa.int32()),
        "lo": [int(labels.min())],
        "hi": [int(labels.max())],
        "labels_held": [np.unique(labels)],
        "ids": [ids.tobytes()],
        "labels": [labels.tobytes()],
        "kind": [kinds],
        "matrix": [matrix.tobytes()],
        "lists": [order.tobytes()],
    }
    for name in extra:
        # As many values for each anchor as it has positives.
        column = rows.column(name).combine_chunks()
        out[name] = [np.asarray(column.flatten(), dtype=np.int64).tobytes()]
        counts = np.asarray(column.value_lengths(), dtype=np.int64)
    if extra:
        out["counts"] = [counts.tobytes()]
    return pa.RecordBatch.from_pydict(out)


def _read(row: dict, side: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, labels = (np.frombuffer(row[f"{c}_{side}"], np.int64) for c in ("ids", "labels"))
    kind = row[f"kind_{side}"].split()[0]
    return ids, labels, np.frombuffer(row[f"matrix_{side}"], kind).reshape(len(ids), -1)


def _pairs_of_blocks(batches):
    """(block, anchor ids, anchor labels, anchors, row) for every pair of a block and a chunk."""
    last = None
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
            if last is None or last[0] != row["block_b"]:
                ids, labels, matrix = _read(row, "b")
                lists = np.frombuffer(row["lists_b"], row["kind_b"].split()[1]).reshape(-1, len(ids))
                last = row["block_b"], Block(ids, labels, matrix, lists)
            yield last[1], *_read(row, "a"), row


def _positive_searcher(k: int):
    def search(batches):
        low, high = np.array([-(1 << 63) + 1]), np.array([(1 << 63) - 1])
        for block, ids, labels, matrix, _ in _pairs_of_blocks(batches):
            found = [
                block.search(anchor, (block.labels == label) & (block.ids != own), low, high, k)[0]
                for own, label, anchor in zip(ids, labels, matrix)
            ]
            count = [len(rows) for rows, _ in found]
            at, scores = (np.concatenate(x).astype(np.int64) for x in zip(*found))
            columns = [np.repeat(ids, count), block.ids[at], scores]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["anchor_id", "positive_id", "positive_score"])

    return search


def _negative_searcher(k: int, low: int, high: int):
    def search(batches):
        for block, ids, labels, matrix, row in _pairs_of_blocks(batches):
            counts = np.frombuffer(row["counts_a"], np.int64)
            edges = np.concatenate([[0], np.cumsum(counts)])
            ranks, positives, scores = (np.frombuffer(row[f"{c}_a"], np.int64) for c in ("ranks", "positives", "scores"))
            out = []
            for i, (own, label, anchor) in enumerate(zip(ids, labels, matrix)):
                own_scores = scores[edges[i] : edges[i + 1]]
                least, most = window(own_scores, low, high)
                use = np.flatnonzero(least <= most)
                if not len(use):
                    continue
                for w, (at, found) in zip(use, block.search(anchor, block.labels != label, least[use], most[use], k)):
                    p, n = edges[i] + w, len(at)
                    given = [np.full(n, x) for x in (own, ranks[p], positives[p], scores[p])]
                    out.append([*given, block.ids[at], found])
            columns = [np.concatenate(x).astype(np.int64) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 6
            names = ["anchor_id", "place", "positive_id", "positive_score", "negative_id", "negative_score"]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=names)

    return search


def window(scores: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest integer x with low * score <= 100 * x <= high * score."""
    ends = [(-(-low * int(s) // 100), high * int(s) // 100) for s in scores]
    least, most = np.array(ends, dtype=object).reshape(-1, 2).T
    return _whole(least), _whole(most)


def _valid(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False))


def _blocks(rows: DataFrame, size: int, lists: bool, name: str, extra: list[str] = ()) -> DataFrame:
    extra = list(extra)
    schema = _BLOCK + "".join(f", {c} binary" for c in [*extra, *(["counts"] if extra else [])])
    laid = rows.repartitionByRange("label", "id").sortWithinPartitions("label", "id", "vector")
    return materialize(laid.mapInArrow(_block_writer(size, lists, extra), schema), name)


def _side(blocks: DataFrame, side: str) -> DataFrame:
    return blocks.select(*[F.col(c).alias(f"{c}_{side}") for c in blocks.columns])


def mine(
    vectors: DataFrame,
    anchors: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    `vectors` has vec_id, label and embedding; rows for which the condition `anchors` on vec_id
    holds are the anchors, as well as candidates. Components become integers, floor(256 * x), and a score is an integer
    inner product. An anchor's positives are the first other rows of its label, by score and
    then by smaller vec_id; for each, its negatives are the first rows of other labels whose
    score is between `low` and `high` percent of the positive's.

    Candidates are laid out by label in blocks of bounded size, each with a sorted list per
    dimension; anchors come in chunks. A chunk meets every block it needs, and each anchor runs
    the threshold algorithm there (`Block.search`), which gives at most k rows per window. The
    first k of those over all blocks are exact, since every block gives its own first k. No
    label, however frequent, is more than its blocks.

    Rows with a missing id or label, a missing vector, or a missing or non-finite component take
    no part. Rows that repeat another in id, label and vector count once; different rows of one
    id are rows of their own, but only the smallest of them (by label, vector) is an anchor, and none of
    them is a positive of that anchor. Vectors of other lengths are compared as if the shorter one ended in zeros. Ties
    go to the smaller id. Integers beyond 2^62, and scores that no long holds, are taken as the nearest one that fits. Anchors without
    positives, and positives without negatives, have no rows; an empty table gives none. Other
    columns are not used.
    """
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("id"),
        F.col("label").cast("long").alias("label"),
        F.col("embedding").cast("array<double>").alias("vector"),
        F.coalesce(anchors, F.lit(False)).alias("anchor"),
    ).where(F.col("id").isNotNull() & F.col("label").isNotNull() & _valid(F.col("vector")))
    blocks = _blocks(rows.drop("anchor"), BLOCK, True, "candidate-blocks")
    own = rows.where("anchor").groupBy("id").agg(F.min(F.struct("label", "vector")).alias("row"))
    own = materialize(own.select("id", "row.label", "row.vector"), "anchors")
    parts = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    # A block stays one row, whatever the number of chunks that come to it.
    candidates = _side(blocks, "b").repartition(parts, "block_b")

    chunks = _blocks(own, CHUNK, False, "anchor-chunks")
    labels = lambda df, name: df.select(F.col("block").alias(name), F.explode("labels_held").alias("label"))
    meet = labels(chunks, "block_a").join(labels(blocks, "block_b"), "label").select("block_a", "block_b").distinct()
    near = _side(chunks, "a").join(meet, "block_a").join(candidates, "block_b")
    found = near.mapInArrow(_positive_searcher(positives), "anchor_id long, positive_id long, positive_score long")
    by_score = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    first = found.withColumn("place", F.row_number().over(by_score)).where(F.col("place") <= positives)
    given = first.groupBy("anchor_id").agg(
        F.sort_array(F.collect_list(F.struct(F.col("place").cast("long").alias("place"), "positive_id", "positive_score"))).alias("given")
    )
    asking = own.join(given, own["id"] == given["anchor_id"]).select(
        "id",
        "label",
        "vector",
        F.col("given.place").alias("ranks"),
        F.col("given.positive_id").alias("positives"),
        F.col("given.positive_score").alias("scores"),
    )

    chunks = _side(_blocks(asking, CHUNK, False, "asking-chunks", ["ranks", "positives", "scores"]), "a")
    # Each chunk goes to every block. Those that one task wrote have consecutive numbers: as many rows as tasks.
    runs = blocks.groupBy(F.shiftright("block", 32)).agg(F.min("block").alias("first"), F.max("block").alias("last"))
    dealt = chunks.crossJoin(F.broadcast(runs.select("first", "last")))
    dealt = dealt.select(*chunks.columns, F.explode(F.sequence("first", "last")).alias("block_b"))
    far = dealt.join(candidates, "block_b").where(
        ~((F.col("lo_a") == F.col("hi_a")) & (F.col("lo_b") == F.col("hi_b")) & (F.col("lo_a") == F.col("lo_b")))
    )
    schema = "anchor_id long, place long, positive_id long, positive_score long, negative_id long, negative_score long"
    found = far.mapInArrow(_negative_searcher(negatives, low, high), schema)
    by_score = Window.partitionBy("anchor_id", "place").orderBy(F.desc("negative_score"), "negative_id")
    return (
        found.withColumn("rank", F.row_number().over(by_score).cast("int"))
        .where(F.col("rank") <= negatives)
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )
