"""Hard negatives against a plain search."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dayweave.llm import hard_negatives
from dayweave.llm.hard_negatives import Block, integers

SCHEMA = "vec_id long, label int, embedding array<double>, block string, rank string, n string"


def plain(rows, k=5, low=80, high=100):
    """Every anchor against every row; rows that repeat count once."""
    use = {}
    for i, label, v, *_ in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            use[(i, label, tuple(v))] = [math.floor(256 * x) for x in v]
    use = [(i, label, q) for (i, label, _), q in sorted(use.items())]
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for own, label, q in use:
        if own % 100 or any(i == own and (lab, v) < (label, q) for i, lab, v in use):
            continue
        scored = sorted((-score(q, v), i, lab) for i, lab, v in use)
        positives = [(i, -s) for s, i, lab in scored if lab == label and i != own][:k]
        for i, p in positives:
            fits = [(n, -s) for s, n, lab in scored if lab != label and low * p <= -100 * s <= high * p][:k]
            out += [(own, i, rank, n, p, s) for rank, (n, s) in enumerate(fits, 1)]
    return sorted(out)


def mined(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(3)
    got = hard_negatives.mine(df, F.col("vec_id") % 100 == 0)
    return sorted(map(tuple, got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))


def vectors(n, dims, labels, seed, ids=lambda i: 10 * i):
    rng = random.Random(seed)
    return [(ids(i), rng.choice(labels), [rng.gauss(0, 0.3) for _ in range(dims)]) for i in range(n)]


@pytest.fixture
def small_blocks(monkeypatch):
    for name, value in (("BLOCK", 16), ("CHUNK", 3), ("FIRST", 2)):
        monkeypatch.setattr(hard_negatives, name, value)


def test_matches_a_plain_search(spark, small_blocks):
    rows = vectors(220, 6, [0, 0, 0, 0, 1, 2, 3], 1)
    want = plain(rows)
    assert len(want) > 200 and mined(spark, rows) == want


def test_ties_repeats_and_rows_that_take_no_part(spark, small_blocks):
    rng = random.Random(5)
    # Few different vectors, so that most scores tie.
    rows = [(10 * i, rng.randrange(3), [rng.choice([-0.25, 0.0, 0.5]) for _ in range(3)]) for i in range(120)]
    rows += rows[:30] + rows[:1]
    # One id with several contents, vectors of zeros and of other lengths.
    rows += [(100, 2, [0.5, 0.5, 0.5]), (100, 0, [0.25, 0.5, 0.0]), (300, 1, [0.0, 0.0, 0.0]), (5, 1, [])]
    rows += [(1, 1, [0.5]), (2, 0, [0.5, 0.5, 0.5, 0.5])]
    bad = [(400, None, [1.0]), (500, 1, None), (None, 1, [0.5, 0.5, 0.5]), (600, 1, [0.5, None, 0.5])]
    bad += [(700, 1, [float("nan"), 0.5, 0.5]), (800, 0, [float("inf"), 0.5, 0.5])]
    got = mined(spark, rows + bad)
    assert got == mined(spark, rows) == plain(rows) and len(got) > 100


def test_large_components_stay_exact(spark, small_blocks):
    for scale in (1e3, 1e6):
        rows = [(i, label, [x * scale for x in v]) for i, label, v in vectors(60, 4, [0, 1], 9)]
        assert mined(spark, rows) == plain(rows)
    # Products beyond a long become the nearest long.
    rows = [(0, 1, [1e17]), (1, 1, [1e17]), (2, 0, [1e17]), (3, 0, [1e-3])]
    top = (1 << 63) - 1
    assert mined(spark, rows) == [(0, 1, 1, 2, top, top)]


def test_empty_tables_and_lonely_anchors(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(100, 1, [0.5]), (101, 0, [0.5])]) == []
    assert mined(spark, [(100, 1, [0.5]), (101, 1, [0.5])]) == []
    assert mined(spark, [(100, 1, [0.5]), (101, 1, [-0.5]), (102, 0, [-0.5])]) == []


def test_one_label_holds_most_rows(spark, small_blocks):
    rows = vectors(200, 4, [7] * 9 + [8], 3)
    assert mined(spark, rows) == plain(rows)


def test_blocks_need_no_numbers(spark, small_blocks, monkeypatch):
    """Every chunk meets every block of several tasks, without tables and exchanges that number the blocks."""
    written, write = [], hard_negatives.materialize
    monkeypatch.setattr(hard_negatives, "materialize", lambda df, name, *a: written.append(name) or write(df, name, *a))
    monkeypatch.setitem(vars(hard_negatives), "running_totals", None)
    rows = vectors(300, 5, [0, 1, 2], 8)
    assert mined(spark, rows) == plain(rows)
    assert written == ["candidate-blocks", "anchors", "anchor-chunks", "asking-chunks"]


def test_the_search_stops_early():
    """On candidates along one direction a few of them are scored, not all."""
    n = 4000
    matrix = np.stack([np.arange(n), np.zeros(n, int)], axis=1).astype(np.int64)
    block = Block(np.arange(n), np.zeros(n, int), matrix, np.argsort(matrix, axis=0, kind="stable").T)
    looked = []
    block.lists = _Watched(block.lists, looked)
    [(rows, scores)] = block.search(np.array([3, 0]), np.ones(n, bool), np.array([0]), np.array([3 * n]), 5)
    assert rows.tolist() == [3999, 3998, 3997, 3996, 3995] and scores.tolist() == [3 * r for r in rows]
    assert sum(looked) <= 64


class _Watched:
    def __init__(self, lists, looked):
        self.lists, self.looked = lists, looked

    def __getitem__(self, at):
        found = self.lists[at]
        self.looked.append(found.size)
        return found


def test_integers_are_floors():
    import pyarrow as pa

    got = integers(pa.array([[0.1, -0.1], [], [1.0, 2.0, -0.004]], pa.list_(pa.float64())))
    assert got.tolist() == [[25, -26, 0], [0, 0, 0], [256, 512, -2]]
