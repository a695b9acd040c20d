"""Near-duplicate embeddings by tiles in the order of the leading principal component."""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from dayweave.llm.components import components
from dayweave.llm.text import running_totals
from dayweave.sources import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

THRESHOLD = 0.93
TILE = 1024
# Dimensions accumulated before each test whether a pair can still reach the threshold.
STEP = 16
# Vectors that the principal components are fitted to. They decide the speed, not the result.
SAMPLE = 4096
_MARGIN = 1e-9


def _valid() -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return (
        F.col("vec_id").isNotNull()
        & F.col("label").isNotNull()
        & F.coalesce(F.forall("embedding", finite) & F.exists("embedding", lambda x: x != 0), F.lit(False))
    )


def _bases(reps: DataFrame) -> dict[int, np.ndarray]:
    """For each dimension in a bounded sample an orthogonal basis, leading component first."""
    sample = reps.select("embedding").orderBy(F.xxhash64("embedding"), "embedding").limit(SAMPLE).collect()
    by_size: dict[int, list] = {}
    for row in sample:
        by_size.setdefault(len(row["embedding"]), []).append(row["embedding"])
    bases = {}
    for size, rows in by_size.items():
        unit = _unit(np.array(rows, dtype=np.float64))
        bases[size] = np.linalg.eigh(unit.T @ unit)[1][:, ::-1].copy()
    return bases


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, size)


def _leading(bases):
    """The coordinate along the leading component, by which the tiles are ordered."""

    @F.arrow_udf("double")
    def leading(embedding: pa.Array) -> pa.Array:
        sizes = np.asarray(embedding.value_lengths())
        values = np.asarray(embedding.flatten(), dtype=np.float64)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        out = np.zeros(len(sizes))
        for size in np.unique(sizes):
            rows = np.flatnonzero(sizes == size)
            unit = _unit(values[ends[rows][:, None] + np.arange(size)])
            out[rows] = unit @ bases[size][:, 0] if size in bases else unit[:, 0]
        return pa.array(out)

    return leading


def close_pairs(x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places in two sets of unit vectors, leading dimensions first, with cosine >= threshold.

    After each step of dimensions the rest of a product is bounded by the norms of what remains;
    vectors of which no pair can reach the threshold any more leave the comparison.
    """
    size = x.shape[1]
    rows, columns = np.arange(len(x)), np.arange(len(y))
    products = np.zeros((len(x), len(y)))
    for at in range(0, size, STEP):
        products += x[rows, at : at + STEP] @ y[columns, at : at + STEP].T
        if at + STEP >= size:
            break
        rest = np.sqrt((x[rows, at + STEP :] ** 2).sum(axis=1))[:, None] * np.sqrt((y[columns, at + STEP :] ** 2).sum(axis=1))
        alive = products + rest >= threshold - _MARGIN
        left, right = alive.any(axis=1), alive.any(axis=0)
        if not left.any():
            return rows[:0], columns[:0]
        rows, columns, products = rows[left], columns[right], products[np.ix_(left, right)]
    i, j = np.nonzero(products >= threshold - _MARGIN)
    return rows[i], columns[j]


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n places the smallest place linked to it, over any number of links."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _comparer(bases, threshold):
    def compare(batches):
        for batch in batches:
            for row in batch.to_pylist():
                if found := _compared(row, bases, threshold):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], names=["rep", "n", "root"])

    return compare


def _block(row, side):
    ids = np.array(row[f"ids_{side}"], dtype=np.int64)
    copies = np.array(row[f"copies_{side}"], dtype=np.int64)
    return ids, copies, np.array(row[f"vectors_{side}"], dtype=np.float64)


def _compared(row, bases, threshold):
    """Per vector of one or two blocks with a link: how many it links with, and the smallest
    vector it is connected to here. Pairs never leave the task."""
    ids, copies, vectors = _block(row, "a")
    n = len(ids)
    if row["tile_b"] != row["tile_a"]:
        other, more, rest = _block(row, "b")
        ids, copies, vectors = np.append(ids, other), np.append(copies, more), np.concatenate([vectors, rest])
    unit = _unit(vectors)
    basis = bases.get(unit.shape[1])
    turned = unit if basis is None else unit @ basis
    if n < len(ids):
        i, j = close_pairs(turned[:n], turned[n:], threshold)
        j = j + n
    else:
        i, j = close_pairs(turned, turned, threshold)
        i, j = i[i < j], j[i < j]
    exact = np.einsum("ij,ij->i", unit[i], unit[j]) >= threshold
    i, j = i[exact], j[exact]
    if not len(i):
        return None
    links = np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))
    order = np.argsort(ids)
    place = np.empty_like(order)
    place[order] = np.arange(len(ids))
    root = ids[order][_roots(len(ids), place[i], place[j])[place]]
    linked = links > 0
    return ids[linked], links[linked].astype(np.int64), root[linked]


def link(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector.

    Only vectors of equal labels and lengths are compared. Equal vectors are one representative
    with a number of copies, so a group of copies costs no more than one vector. The
    representatives of a label are ordered along the leading principal component and cut into
    tiles. Vectors that reach the threshold differ by at most sqrt(2 - 2 * threshold) along it,
    so tiles further apart are not compared. Each comparison of two tiles gives at most one row
    per vector, and components are made from those.

    A vector that is null, zero, or holds null or non-finite components, or has no label or id,
    links with nothing and is its own component. Repeated rows are vectors of their own that
    link with each other. Ties at the threshold are links. An empty table gives no rows. Other
    columns are not used.
    """
    rows = vectors.select("vec_id", "label", "embedding")
    reps = (
        rows.where(_valid())
        .groupBy("label", "embedding")
        .agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    )
    reps = materialize(reps, "vectors")
    bases = _bases(reps)
    placed = reps.withColumns({"size": F.size("embedding"), "lead": _leading(bases)("embedding")})
    keys = ["label", "size"]
    order = [F.col(c) for c in (*keys, "lead", "rep")]
    ranked = running_totals(placed, order, {"rank": F.lit(1)}, "ranked")
    blocks = (
        ranked.withColumn("tile", F.floor((F.col("rank") - 1) / tile))
        .groupBy(*keys, "tile")
        .agg(
            F.collect_list(F.struct("rep", "copies", "embedding")).alias("rows"),
            F.min("lead").alias("lo"),
            F.max("lead").alias("hi"),
        )
    )
    blocks = materialize(blocks, "blocks")
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + _MARGIN
    side = lambda s: blocks.select(*keys, *[F.col(c).alias(f"{c}_{s}") for c in ("tile", "lo", "hi")])
    pairs = side("a").join(side("b"), keys).where(
        (F.col("tile_a") <= F.col("tile_b"))
        & (F.col("lo_b") - F.col("hi_a") <= reach)
        & (F.col("lo_a") - F.col("hi_b") <= reach)
    )
    for s in ("a", "b"):
        own = blocks.select(
            *keys,
            F.col("tile").alias(f"tile_{s}"),
            F.col("rows.rep").alias(f"ids_{s}"),
            F.col("rows.copies").alias(f"copies_{s}"),
            F.col("rows.embedding").alias(f"vectors_{s}"),
        )
        pairs = pairs.join(own, [*keys, f"tile_{s}"])
    wanted = ["tile_a", "tile_b", *[f"{c}_{s}" for s in ("a", "b") for c in ("ids", "copies", "vectors")]]
    found = pairs.select(*wanted).mapInArrow(_comparer(bases, threshold), "rep long, n long, root long")
    found = materialize(found, "links")
    linked = found.groupBy("rep").agg(F.sum("n").alias("n"))
    connected = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    classes = (
        reps.join(linked, "rep", "left")
        .join(connected, F.col("rep") == F.col("node"), "left")
        .select(
            F.col("label").alias("__label"),
            F.col("embedding").alias("__embedding"),
            (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("__links"),
            F.coalesce("component", "rep").alias("__component"),
        )
    )
    same = _valid() & (F.col("label") == F.col("__label")) & (F.col("embedding") == F.col("__embedding"))
    joined = rows.join(classes, same, "left")
    component = F.coalesce("__component", "vec_id")
    return joined.select(
        "vec_id",
        F.coalesce("__links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
