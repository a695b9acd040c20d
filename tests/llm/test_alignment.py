"""Token alignment against the libraries on whole texts and a plain cut at common ends."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

from dayweave.llm import alignment
from dayweave.llm.tokens import tokenizer_path

ODD = ["a", "the", " ", "  ", "\n", "\t", " ", "　", "é", "日本", "▁", "<s>", "<|endoftext|>", "<0x0A>", "'s", " 't", "1234"]
ODD += ["!!", "\x1c", " ", "\U0001f600", "é", "\r\n", "x" * 50, "ß", "\x00", "﻿"]


@pytest.fixture(scope="module")
def aligner():
    return alignment.Aligner(tokenizer_path(alignment.TOKENIZER_A), tokenizer_path(alignment.TOKENIZER_B))


def whole(aligner, text):
    """Groups of a text as two lists of ids each, from tokens of the whole text."""
    if not text:
        return []
    a = aligner.first.encode(" " + text, add_special_tokens=False).ids
    b = aligner.second.encode(text)
    spelled = [[table[i] for i in ids] for table, ids in ((aligner.bytes_a, a), (aligner.bytes_b, b))]
    if any(b"".join(s) != (" " + text).encode() for s in spelled):
        return []
    ends = [np.cumsum([len(x) for x in s]).tolist() for s in spelled]
    groups, i, j = [], 0, 0
    for end in sorted(set(ends[0]) & set(ends[1])):
        x, y = i, j
        i, j = ends[0].index(end, i) + 1, ends[1].index(end, j) + 1
        groups.append((a[x:i], b[y:j]))
    return groups


def plain(aligner, texts):
    """The measures of every text, with counts over all."""
    groups = [whole(aligner, t) for t in texts]
    links = [Counter((x, y) for a, b in g for x in a for y in b) for g in groups]
    held = Counter(pair for own in links for pair in own)
    most = defaultdict(int)
    for (a, _), n in held.items():
        most[a] = max(most[a], n)
    out = []
    for g, own in zip(groups, links):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        best = sum(n for p, n in own.items() if held[p] == most[p[0]])
        summed = sum(n * held[p] for p, n in own.items())
        counts = (sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(own.values()), best, summed)
        out.append((*counts, hashlib.sha256(text.encode()).hexdigest() if g else ""))
    return out


def aligned(df):
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted(tuple(r) for r in alignment.align(df, ["doc_id"]).select(*names).collect())


def test_pointer_jumping_finds_common_ends():
    rng = np.random.default_rng(2)
    for _ in range(200):
        n = int(rng.integers(1, 60))
        cuts = [np.sort(rng.choice(np.arange(1, n), rng.integers(0, n), replace=False)) for _ in "ab"]
        ends = [np.append(c, n) for c in cuts]
        common = np.intersect1d(*ends)
        for got, own in zip(alignment.overlap_groups(*ends), ends):
            assert got.tolist() == np.searchsorted(common, own).tolist()
    # One chain through all tokens.
    n = 1000
    a, b = alignment.overlap_groups(np.append(np.arange(1, 2 * n, 2), 2 * n), np.arange(2, 2 * n + 1, 2))
    assert not a.any() and not b.any()


def test_odd_texts_match_the_libraries(aligner):
    rng = random.Random(4)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    totals, digests, *_ = alignment.measured(aligner, texts)
    for i, want in enumerate(plain(aligner, texts)):
        assert (*totals[:, i].tolist(), digests[i]) == (*want[:4], want[6]), texts[i]


def test_runs_and_sections_change_nothing(aligner, monkeypatch):
    rng = random.Random(8)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 60))) for _ in range(200)]
    want = alignment.measured(aligner, texts)
    for name, value in (("SECTION", 40), ("RUN_WORDS", 5), ("MANY", 2)):
        monkeypatch.setattr(alignment, name, value)
    got = alignment.measured(aligner, texts)
    assert all(np.array_equal(x, y) for x, y in zip(got, want))


def test_whole_table(spark, sf_dir, aligner):
    path = f"{sf_dir}/documents.parquet"
    rows = sorted((r["doc_id"], r["text"]) for r in pq.read_table(path, columns=["doc_id", "text"]).to_pylist())
    want = [(i, *m) for (i, _), m in zip(rows, plain(aligner, [t for _, t in rows]))]
    assert aligned(spark.read.parquet(path)) == sorted(want)


def test_odd_rows_and_small_units(spark, odd, odd_rows, none, aligner, monkeypatch):
    monkeypatch.setattr(alignment, "UNIT_BYTES", 3000)
    want = plain(aligner, [t for _, t, _ in odd_rows])
    got = [tuple(r) for r in alignment.align(odd, ["doc_id", "n"]).drop("n").collect()]
    assert sorted(map(repr, got)) == sorted(repr((i, *m)) for (i, *_), m in zip(odd_rows, want))
    assert alignment.align(none, ["doc_id"]).count() == 0


def test_text_that_is_not_utf8_has_no_tokens(spark):
    df = spark.sql("SELECT 1L AS doc_id, CAST(X'61ff62' AS STRING) AS text UNION ALL SELECT 2L, 'a b'")
    (broken, good) = aligned(df)
    assert broken == (1, 0, 0, 0, 0, 0, 0, "") and good[1:4] == (2, 2, 2)


def test_groups_have_spans(spark, aligner):
    text = "The naïve — 12345 don't  \n日本 <|endoftext|> end "
    df = spark.createDataFrame([(3, text), (4, None), (5, "▁")], "doc_id long, text string")
    rows = sorted(alignment.token_groups(df).collect())
    assert [(r.a_ids, r.b_ids) for r in rows] == whole(aligner, text)
    raw = (" " + text).encode()
    for r in rows:
        assert r.doc_id == 3 and b"".join(aligner.bytes_a[i] for i in r.a_ids) == raw[r.from_byte : r.to_byte]
    assert [r.place for r in rows] == list(range(len(rows))) and rows[-1].to_byte == len(raw)
