"""Links, components and removed passages against versions that compare everything."""

import random
import re
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from dayweave.llm import embedding_dedup, ngram_join
from dayweave.llm.components import components
from dayweave.llm.embedding_dedup import close_pairs, link
from dayweave.llm.ngram_join import join, keep_one


def _reach(nodes, pairs):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    return {n: find(n) for n in nodes}


def test_components(spark):
    random.seed(5)
    edges = [(random.randint(0, 400), random.randint(0, 400)) for _ in range(260)]
    edges += [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2100)] + [(5, 5)]
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    got = components(spark.createDataFrame([*edges, (None, 3)], "a long, b long"))
    assert dict(map(tuple, got.collect())) == _reach(nodes, [e for e in edges if e[0] != e[1]])
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def _jobs(spark, run):
    """What `run` gives, and how many Spark jobs it started."""
    group = f"counted-{random.random()}"
    spark.sparkContext.setJobGroup(group, "counted")
    try:
        return run(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_few_edges_are_connected_without_rounds(spark, monkeypatch):
    """The driver keeps something for each exchange of a round, so few edges take no rounds."""
    random.seed(6)
    edges = [(random.randint(-300, 300), random.randint(-300, 300)) for _ in range(250)]
    edges += [(i, i + 1) for i in range(1000, 1200)] + [(1 << 62, -(1 << 62)), (None, 3), (9, 9)]
    run = lambda: sorted(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    once, jobs = _jobs(spark, run)
    monkeypatch.setattr(sys.modules["dayweave.llm.components"], "FEW_EDGES", 0)
    assert _jobs(spark, run)[0] == once and jobs <= 8


def test_many_ids_are_not_broadcast(spark, monkeypatch):
    """Texts of many ids are found through a table of fixed size; only rows that may have one are shuffled."""
    rows = spark.range(-2000, 2000).select(
        F.when(F.col("id") % 10 != 0, F.col("id") * 7919).alias("doc_id"), F.concat(F.lit("text"), F.col("id").cast("string")).alias("text")
    )
    ids = spark.createDataFrame([(i * 7919,) for i in range(-2000, 3000, 3)] + [((1 << 63) - 1,), (-(1 << 63),)], "doc long")
    want = [(i * 7919, f"text{i}") for i in range(-2000, 2000, 3) if i % 10]
    monkeypatch.setattr(ngram_join, "IDS", 100)
    # Also where different ids have the same bit.
    for bits in (ngram_join.ID_BITS, 64):
        monkeypatch.setattr(ngram_join, "ID_BITS", bits)
        texts = ngram_join._texts(rows, ids)
        assert sorted(map(tuple, texts.collect())) == want
        hints = re.findall(r"strategy=broadcast", texts._jdf.queryExecution().logical().toString())
        assert len(hints) == 1 and "bitmap_construct_agg" in texts._jdf.queryExecution().logical().toString()


def _shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if 0 < len(words) < n:
        return {tuple(words)}
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def _brute_join(rows, n, percent):
    sets = [(i, _shingles(t, n)) for i, t in rows]
    pairs = [
        (a, b)
        for x, (a, s) in enumerate(sets)
        for b, t in sets[:x]
        if s and t and None not in (a, b) and 100 * len(s & t) >= percent * len(s | t)
    ]
    root = _reach({i for i, _ in sets if i is not None}, pairs)
    return sorted(((i, len(s), root.get(i)) for i, s in sets), key=repr)


def _brute_pairs(rows, n, percent):
    sets = [_shingles(t, n) for _, t in rows]
    return [
        (x, y)
        for x, s in enumerate(sets)
        for y, t in enumerate(sets[:x])
        if s and t and 100 * len(s & t) >= percent * len(s | t)
    ]


def _copies():
    random.seed(11)
    vocabulary = [f"w{i}" for i in range(300)] + ["the", "of", "and"] * 100
    rows, base = [], []
    for i in range(160):
        if base and random.random() < 0.6:
            words = list(random.choice(base))
            for _ in range(random.randint(0, 1 + len(words) // 25)):
                words[random.randrange(len(words))] = random.choice(vocabulary)
        else:
            words = [random.choice(vocabulary) for _ in range(random.choice([1, 3, 4, 6, 20, 60, 150]))]
        base.append(words)
        rows.append((1000 - i, random.choice([" ", "\n", "  "]).join(words).replace("w1", "W1")))
    return rows


@pytest.mark.parametrize(
    "n, percent, group, tile, agree", [(4, 85, 4096, 512, 6), (4, 85, 3, 4, 6), (5, 80, 4096, 5, 2), (4, 85, 4096, 512, 17)]
)
def test_join(spark, monkeypatch, n, percent, group, tile, agree):
    """With large and small goes; with large families, and with none, where prefixes find all."""
    for name, value in (("GROUP", group), ("TILE", tile), ("AGREE", agree)):
        monkeypatch.setattr(ngram_join, name, value)
    rows = _copies()
    got = join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), n, percent).collect()
    assert sorted(map(tuple, got), key=repr) == _brute_join(rows, n, percent)


@pytest.mark.parametrize("sent", [0, 3, 7])
def test_links_stay_when_different_ngrams_look_alike(spark, monkeypatch, sent):
    """Few bits of a prefix n-gram reach its bucket; there are few buckets and no families."""
    for name, value in (("SENT", sent), ("LEAST_BUCKETS", 3), ("AGREE", 17)):
        monkeypatch.setattr(ngram_join, name, value)
    rows = _copies()
    got = join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 4, 85).collect()
    assert sorted(map(tuple, got), key=repr) == _brute_join(rows, 4, 85)


def test_texts_of_one_id_keep_their_links(spark, monkeypatch):
    """Rows with one doc_id, equal and different ones, link where any of their texts does."""
    monkeypatch.setattr(ngram_join, "AGREE", 17)
    rows = _copies()
    rows = [(i // 2, t) for i, t in rows] + rows[:9] * 3 + rows[:9]
    root = _reach({i for i, _ in rows}, [(rows[x][0], rows[y][0]) for x, y in _brute_pairs(rows, 4, 85)])
    got = join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 4, 85).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == root and len(got) == len(rows)


def test_prefixes_are_shuffled_in_packed_form(spark, monkeypatch):
    """N-grams go to buckets, many in a row; no table of single n-grams is shuffled to find those that are shared."""
    plans, write = {}, ngram_join.materialize

    def seen(df, name, *folder):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, name, *folder)

    monkeypatch.setattr(ngram_join, "materialize", seen)
    join(spark.createDataFrame(_copies(), "doc_id long, text string"), 4, 85).collect()
    assert not re.search(r"hashpartitioning\(token", plans["across"])
    assert re.search(r"hashpartitioning\(bucket", plans["across"]) and "explode" not in plans["across"]


def test_shared_ngrams_of_buckets():
    rng = np.random.default_rng(8)
    docs = [(d, None if d % 3 else d % 2, rng.choice(200, rng.integers(0, 40), replace=False)) for d in range(60)]
    hashes = ngram_join.mixed(np.arange(200, dtype=np.uint64))
    packed = [(d, f, hashes[t].view(np.uint8).reshape(-1, 8)[:, :6].tobytes()) for d, f, t in docs]
    schema = pa.schema([("doc", pa.int64()), ("family", pa.int64()), ("prefix", pa.binary())])
    batches = [pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), schema)], schema=schema) for part in (packed[:25], packed[25:])]
    batches.append(batches[0].slice(0, 0))
    dealt = pa.Table.from_batches(ngram_join._dealer(7)(iter(batches)))
    got = []
    for b in set(dealt.column("bucket").to_pylist()):
        got += ngram_join._shared(dealt.filter(pc.equal(dealt.column("bucket"), b))).to_pylist()
    homes = {}
    for d, f, t in docs:
        for x in t:
            homes.setdefault(int(x), []).append((d, d if f is None else f))
    want = sorted((len(h), d, f) for h in homes.values() if len({f for _, f in h}) > 1 for d, f in h)
    assert sorted((r["df"], r["doc"], r["family"]) for r in got) == want
    assert len({r["token"] for r in got}) == sum(len({f for _, f in h}) > 1 for h in homes.values())


@pytest.mark.parametrize("percent", [60, 80, 95])
def test_sets_compared_at_once(percent):
    rng = np.random.default_rng(percent)
    sets = [np.unique(rng.integers(0, 90, rng.integers(1, 80)).astype(np.uint64)) for _ in range(60)]
    sets += [np.unique(np.append(s, np.uint64(1000 + i))) for i, s in enumerate(sets[:20])]
    side = np.arange(len(sets)) % 2
    for both in (False, True):
        pairs = [
            (i, j)
            for i in range(len(sets))
            for j in range(i)
            if (not both or side[i] != side[j])
            and 100 * len(np.intersect1d(sets[i], sets[j])) >= percent * len(np.union1d(sets[i], sets[j]))
        ]
        found = ngram_join.linked(sets, side, both, percent)
        assert _reach(range(len(sets)), found) == _reach(range(len(sets)), pairs)
        assert len(found) < len(sets)
        assert {tuple(sorted(p)) for p in found} <= {tuple(sorted(p)) for p in pairs}


def test_odd_rows_are_joined(odd, odd_rows, none):
    got = join(odd).collect()
    assert sorted(map(tuple, got), key=repr) == _brute_join([r[:2] for r in odd_rows], 5, 80)
    assert join(none).count() == 0


def test_one_of_each_group_stays(odd, odd_rows, none):
    root = {i: c for i, _, c in _brute_join([r[:2] for r in odd_rows], 5, 80)}
    kept = keep_one(odd)
    assert kept.columns == odd.columns
    got = sorted((r["doc_id"] for r in kept.collect()), key=repr)
    assert got == sorted([None, None, *[i for i, c in root.items() if i is not None and i == c]], key=repr)
    assert keep_one(none).count() == 0


def test_different_texts_of_one_id_stay(spark):
    """Rows with one doc_id are one only where their texts are linked."""
    one, two, three, four = (" ".join(f"{c}{i}" for i in range(60)) for c in "abcd")
    rows = [(1, one, 0), (5, one, 0), (5, two, 0), (5, two + " more", 0), (5, two, 3), (9, two, 0), (4, three, 0), (4, four, 0), (7, four, 1), (7, three, 1)]
    rows += [((1 << 63) - 1, "the end of the numbers is near", 0), (None, one, 0)]
    kept = keep_one(spark.createDataFrame(rows, "doc_id long, text string, other long").repartition(3))
    got = sorted((tuple(r) for r in kept.collect()), key=repr)
    # Of the texts like `two` one stays, with the smallest id that has it.
    assert [r for r in got if r[0] == 5 and r[1].startswith("b0")] and sum(bool(r[1].startswith("b0")) for r in got) == 1
    assert sorted((r for r in got if not r[1].startswith("b0")), key=repr) == sorted(
        [rows[0], rows[6], rows[7], rows[10], rows[11]], key=repr
    )


def _brute_link(rows):
    def unit(e):
        if not e or any(x is None or not np.isfinite(x) for x in e) or not any(e):
            return None
        v = np.array(e, np.float64)
        return v / np.sqrt(v @ v)

    vectors = [(i, label, unit(e)) for i, label, e in rows]
    pairs = []
    for x, (a, la, u) in enumerate(vectors):
        for y, (b, lb, v) in enumerate(vectors[:x]):
            if None in (la, lb, a, b) or la != lb or u is None or v is None or len(u) != len(v):
                continue
            if u @ v >= 0.93:
                pairs.append((x, y))
    root = _reach({i for i, _, _ in rows if i is not None}, [(rows[x][0], rows[y][0]) for x, y in pairs])
    n = np.bincount([p for pair in pairs for p in pair], minlength=len(rows))
    return sorted(((r[0], int(k), root.get(r[0]), r[0] is None or root[r[0]] == r[0]) for r, k in zip(rows, n)), key=repr)


@pytest.mark.parametrize("tile", [1024, 5])
def test_links(spark, tile):
    random.seed(2)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(9, 24)) * np.linspace(3, 0.3, 24)
    rows = []
    for i in range(150):
        e = (centres[i % 9] + rng.normal(size=24) * random.choice([0.05, 0.3, 0.6])).astype(np.float32).tolist()
        rows.append((i, random.choice([0, 0, 0, 1, None]), e))
    rows += [(200 + i, 0, rows[0][2]) for i in range(7)] + [(300, 0, [2 * x for x in rows[0][2]]), (301, 0, [0.0] * 24)]
    rows += [(302, 0, None), (303, 0, []), (304, 0, [None] * 24), (305, 0, [float("nan")] * 24), (306, 0, [float("inf")] * 24)]
    rows += [(None, 0, rows[0][2]), (307, 0, [1.0, 0.0]), (308, 0, [1.0, 0.1])]
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(3)
    got = sorted(map(tuple, link(table, tile=tile).collect()), key=repr)
    assert got == _brute_link(rows)
    assert link(table.limit(0)).count() == 0


def test_close_pairs_stop_early_and_miss_nothing():
    rng = np.random.default_rng(4)
    x = embedding_dedup._unit(rng.normal(size=(80, 64)))
    y = embedding_dedup._unit(np.concatenate([x[:20] + rng.normal(size=(20, 64)) * 0.04, rng.normal(size=(60, 64))]))
    i, j = close_pairs(x, y, 0.93)
    want = np.argwhere(x @ y.T >= 0.93)
    assert sorted(zip(i.tolist(), j.tolist())) == sorted(map(tuple, want.tolist()))
