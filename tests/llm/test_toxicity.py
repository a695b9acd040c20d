"""The classifier on labelled rows it has not seen."""

import hashlib
import math
import random
import zlib

import numpy as np
import xxhash

from dayweave.llm import toxicity
from dayweave.llm.toxicity import Features, ftrl, score


def _auc(rows):
    order = sorted(rows)
    ranks = {i: r for r, i in enumerate(range(len(order)))}
    good = [ranks[i] for i, (_, y) in enumerate(order) if y]
    n = len(good)
    return (sum(good) - n * (n - 1) / 2) / (n * (len(order) - n))


def test_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    scored = score(docs, labels).collect()
    assert len(scored) == docs.count()
    for r in scored:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
    unseen = [(r["score"], truth[r["doc_id"]]) for r in scored if r["held_out"] and r["doc_id"] in truth]
    assert _auc(unseen) > 0.9
    assert np.mean([(s >= 0.5) == y for s, y in unseen]) > 0.93


def test_labels_of_held_out_rows_are_not_used(spark):
    random.seed(1)
    rows = [(i, ("vile " if i % 2 else "") + " ".join(random.choice("abcdefgh") for _ in range(20))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    honest = [(i, i % 2) for i, _ in rows]
    swapped = [(i, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, t in honest]
    result = lambda x: sorted(map(tuple, score(docs, spark.createDataFrame(x, "doc_id long, toxic int")).collect()))
    first = result(honest)
    assert first == result(swapped)
    assert all(p == i % 2 for i, _, _, p in first)


def test_odd_rows(spark, odd, odd_rows, none):
    labels = [(1, 1), (5, 0), (6, 0), (6, 1), (9, None), (None, 1), (7, 2), (99, 1)]
    labels = spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, toxic int, text string")
    got = score(odd, labels).collect()
    assert sorted((r["doc_id"] for r in got), key=repr) == sorted((i for i, _, _ in odd_rows), key=repr)
    empty = {r["score"] for r in got if r["doc_id"] in (2, 3, 4)}
    assert len(empty) == 1 and 0 < empty.pop() < 1
    assert all(r["held_out"] for r in got if r["doc_id"] is None)
    assert score(none, labels).count() == 0
    assert {r["score"] for r in score(odd, labels.limit(0)).collect()} == {0.5}


def test_features_ignore_case_and_marks_and_skip_one_word():
    f = Features()
    same = lambda a, b: sorted(f.places(a)) == sorted(f.places(b))
    assert same(b"One, TWO three!", b"one two three")
    assert not same(b"one two three", b"three two one")
    assert len(f.places(b"a b c")) == 3 + 2 + 1 and len(f.places(b"")) == 0


def test_weights_without_evidence_stay_zero():
    rng = np.random.default_rng(0)
    examples = []
    for i in range(300):
        noise = rng.integers(100, 60_000, 30)
        examples.append((np.unique(np.append(noise, 7) if i % 3 == 0 else noise), i % 3 == 0))
    weights, _ = ftrl(examples, bits=16, epochs=2)
    assert weights[7] == weights.max() > 1
    assert (weights != 0).mean() < 0.05


def plain_ftrl(examples):
    """FTRL-proximal one coordinate at a time, in plain Python: weights from z and n as they are needed."""
    z, n, bias, bias_n = {}, {}, 0.0, 0.0

    def weight(i):
        if abs(z.get(i, 0.0)) <= toxicity.L1:
            return 0.0
        sign = 1 if z[i] > 0 else -1
        return -(z[i] - sign * toxicity.L1) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.EPOCHS):
        for places, label in examples:
            own = {i: weight(i) for i in places}
            p = 1 / (1 + math.exp(-(bias + sum(own.values()))))
            g = p - label
            for i, w in own.items():
                rate = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / toxicity.ALPHA
                z[i] = z.get(i, 0.0) + g - rate * w
                n[i] = n.get(i, 0.0) + g * g
            bias_n += g * g
            bias -= toxicity.ALPHA / (toxicity.BETA + math.sqrt(bias_n)) * g
    return {i: w for i in z if (w := weight(i))}, bias


def plain_places(text):
    """Hashed words, pairs and skip-pairs of a text, by their definition."""
    words = "".join(chr(c + 32) if 65 <= c <= 90 else chr(c) if c >= 128 or chr(c).isalnum() else " " for c in (text or "").encode()).encode("latin-1").split()
    h = [xxhash.xxh3_64_intdigest(w) for w in words]
    one, two, three = map(int, toxicity._STEP)
    found = h + [a * two + b for a, b in zip(h, h[1:])] + [a * three + b for a, b in zip(h, h[2:])]
    return {(x * one % 2**64) >> (64 - toxicity.BITS) for x in found}


def test_weights_and_scores_match_a_plain_version(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "L1", 2.0)
    random.seed(5)
    words = [f"w{i}" for i in range(60)] + ["Vile", "foul!"]
    rows = [(i, " ".join(random.choice(words[:60] if i % 3 else words) for _ in range(random.randint(0, 40)))) for i in range(250)]
    rows = [(i, t + " vile foul" if i % 4 == 0 else t) for i, t in rows] + [(900, None), (901, ""), (902, "é İ vile")]
    labels = [(i, int(i % 4 == 0)) for i, _ in rows[:250]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["score"] for r in score(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    texts = dict(rows)
    learned = sorted((hashlib.md5(str(i).encode()).hexdigest(), label, i) for i, label in labels if zlib.crc32(str(i).encode()) % 5)
    weights, bias = plain_ftrl([(plain_places(texts[i]), label) for _, label, i in learned])
    assert len(weights) > 5
    for i, text in rows:
        total = bias + sum(weights.get(p, 0.0) for p in plain_places(text))
        assert abs(got[i] - 1 / (1 + math.exp(-total))) < 1e-9, i
