"""Removed passages against a table of all strings."""

import hashlib
import random

import numpy as np
import pytest

from dayweave.llm import suffix_dedup
from dayweave.llm.hashing import Hashed
from dayweave.llm.suffix_dedup import remove_repeats, sorted_suffixes


def _brute(rows):
    least = {}
    for doc, text in rows:
        data = (text or "").encode()
        for i in range(len(data) - 49 if doc is not None else 0):
            s = data[i : i + 50]
            least[s] = min(least.get(s, doc), doc)
    out = []
    for doc, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data), dtype=bool)
        for i in range(len(data) - 49 if doc is not None else 0):
            if least[data[i : i + 50]] < doc:
                gone[i : i + 50] = True
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        out.append((doc, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def _rows():
    random.seed(3)
    words = ["a", "be", "sea", "tree", "éclair", "the", "of", "and"]
    some = lambda n: " ".join(random.choice(words) for _ in range(n))
    shared = [some(random.randint(9, 60)) for _ in range(12)]
    rows = [
        (i, some(random.randint(0, 40)) + random.choice(shared) + some(random.randint(0, 30)) + random.choice(shared)[random.randint(0, 20) :])
        for i in range(120)
    ]
    rows += [(200, None), (201, ""), (None, shared[0]), (None, None), (202, "a" * 400), (203, "a" * 300), (5, shared[1] * 3)]
    rows += [(204, rows[7][1]), (205, rows[7][1][3:]), (206, rows[9][1][:50]), (207, rows[9][1][:49]), (8, rows[8][1])]
    return rows


def _digests(df):
    return sorted((tuple(r)[:5] for r in df.collect()), key=repr)


@pytest.mark.parametrize("unit, block", [(4 << 20, 1 << 20), (2000, 300)])
def test_removal(spark, monkeypatch, unit, block):
    monkeypatch.setattr(suffix_dedup, "UNIT_BYTES", unit)
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", block)
    rows = _rows()
    assert _digests(remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))) == _brute(rows)


def test_colliding_hashes_are_noticed(spark, monkeypatch):
    """With one value for all letters, texts of equal length have equal hashes."""
    rows = _rows()[:40]
    right = _brute(rows)
    suffixes = np.frombuffer(b"bananabandanabandit", np.uint8)
    table = np.array([np.pad(suffixes[i : i + 6], (0, 6 - len(suffixes[i : i + 6]))) for i in range(19)])
    sizes = np.array([min(6, 19 - i) for i in range(19)])
    monkeypatch.setattr(Hashed, "letters", np.full(256, 3, dtype=np.uint64))
    order, shared = sorted_suffixes(np.zeros(19, dtype=np.int64), table, sizes)
    texts = [bytes(suffixes[i : i + 6]) for i in order]
    assert texts == sorted(texts)
    for a, b, n in zip(texts, texts[1:], shared[1:]):
        assert a[:n] == b[:n] and (n == min(len(a), len(b)) or a[n] != b[n])
    monkeypatch.undo()
    assert _digests(remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))) == right


def test_odd_rows(odd, odd_rows, none):
    assert _digests(remove_repeats(odd)) == _brute([r[:2] for r in odd_rows])
    assert remove_repeats(none).count() == 0


def test_hot_grams_are_removed_alike(spark, monkeypatch):
    """The same bytes go when all windows, or those of some grams, meet one by one."""
    rows = _rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    monkeypatch.setattr(suffix_dedup, "UNIT_BYTES", 2000)
    for few, hot in ((1, 0), (2, 4)):
        monkeypatch.setattr(suffix_dedup, "FEW", few)
        monkeypatch.setattr(suffix_dedup, "HOT", hot)
        assert _digests(remove_repeats(docs)) == _brute(rows)


def test_no_gram_is_one_task(spark, monkeypatch, tmp_path):
    """A passage in a third of 3,000 documents, each time between other words."""
    random.seed(4)
    some = lambda n: " ".join(f"{random.getrandbits(30):x}" for _ in range(n))
    passage = some(20)
    rows = [(i, f"{some(12)} {passage} {some(12)}" if i % 3 == 0 else some(30)) for i in range(3000)]
    sort, folder = suffix_dedup.sorted_suffixes, str(tmp_path)

    def counted(group, rows, size):
        import uuid

        with open(f"{folder}/{uuid.uuid4()}", "w") as f:
            f.write(str(np.bincount(group).max()))
        return sort(group, rows, size)

    monkeypatch.setattr(suffix_dedup, "sorted_suffixes", counted)
    monkeypatch.setattr(suffix_dedup, "HOT", 100, raising=False)
    monkeypatch.setattr(suffix_dedup, "UNIT_BYTES", 100_000)
    assert _digests(remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))) == _brute(rows)
    largest = max([int(p.read_text()) for p in tmp_path.iterdir()], default=0)
    print("largest group of one gram:", largest)
    # 1,000 contexts stand at either edge of the passage.
    assert largest <= 150
