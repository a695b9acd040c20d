"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from dayweave.sources import delete, materialize, scratch_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Edges, of 16 bytes each, that one task connects; while there are more, rounds of stars go on.
FEW_EDGES = 1 << 20


def components(edges: DataFrame, folder: str | None = None) -> DataFrame:
    """(node, component) of every node on an edge (a, b); a component is its smallest node.

    Alternating stars: every node links its larger neighbours, then its smaller ones, to the
    smallest node it knows, until nothing changes. That takes about log n rounds, each a grouped
    minimum and a join, so a node with very many edges is spread like any other join key. As soon
    as `FEW_EDGES` or fewer are left, one task connects them: a round is ten exchanges, and what
    the driver keeps for each does not depend on its rows. Loops and repeated edges do not matter;
    edges with a missing end are left out. The tables of the rounds go as soon as they are read.
    """
    spark = edges.sparkSession
    clean = edges.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")
    )
    space = scratch_path(spark, "components", folder)
    stars = materialize(clean.distinct(), "stars", f"{space}/0")
    seen, rounds = None, 0
    while (now := _state(stars)) != seen:
        seen, rounds = now, rounds + 1
        if now[0] <= FEW_EDGES:
            kind = stars.schema["high"].dataType.simpleString()
            found = stars.coalesce(1).mapInArrow(_connected, f"node {kind}, component {kind}")
            found = materialize(found, "connected", f"{space}/{rounds}")
            delete(spark, f"{space}/{rounds - 1}")
            return found
        stars = materialize(_small_star(_large_star(stars)), "stars", f"{space}/{rounds}")
        delete(spark, f"{space}/{rounds - 1}")
    members = stars.select(F.col("high").alias("node"), F.col("low").alias("component"))
    roots = stars.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct()
    return members.unionByName(roots)


def _connected(batches):
    """(node, component) of every node on the edges of a task."""
    edges = [[np.asarray(batch.column(c)) for c in ("high", "low")] for batch in batches if batch.num_rows]
    if not edges:
        return
    high, low = (np.concatenate(x) for x in zip(*edges))
    node, at = np.unique(np.concatenate([high, low]), return_inverse=True)
    a, b, root = at[: len(high)], at[len(high) :], np.arange(len(node))
    while len(a):
        # Of two roots on an edge, the larger goes below the smallest it meets; then every node points at its root.
        ends = root[a], root[b]
        np.minimum.at(root, np.maximum(*ends), np.minimum(*ends))
        while (root != root[root]).any():
            root = root[root]
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(node[root])], names=["node", "component"])


def _state(stars: DataFrame) -> tuple:
    """One row that tells two sets of edges apart."""
    h = F.xxhash64("high", "low").cast("decimal(38,0)")
    return tuple(stars.agg(F.count(F.lit(1)), F.sum(h), F.sum("low")).first())


def _large_star(stars: DataFrame) -> DataFrame:
    both = stars.unionByName(stars.select(F.col("low").alias("high"), F.col("high").alias("low")))
    both = both.select(F.col("high").alias("u"), F.col("low").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    larger = both.where(F.col("v") > F.col("u")).join(least, "u")
    return larger.select(F.col("v").alias("high"), F.col("m").alias("low"))


def _small_star(stars: DataFrame) -> DataFrame:
    least = stars.groupBy("high").agg(F.min("low").alias("m"))
    moved = stars.join(least, "high").where(F.col("low") != F.col("m")).select(F.col("low").alias("high"), F.col("m").alias("low"))
    kept = least.select("high", F.col("m").alias("low"))
    return kept.unionByName(moved).distinct()
