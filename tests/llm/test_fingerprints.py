"""Fingerprints: consistency of the parse, likeness, and the order of documents."""

import hashlib
import random

import numpy as np
import pyarrow.parquet as pq

from dayweave.llm import fingerprints as fp

LETTERS = "abcdefghijklmnopqrstuvwxyz     é\n"


def words(n, seed):
    rng = random.Random(seed)
    return "".join(rng.choice(LETTERS) for _ in range(n))


def names(text: bytes) -> list[dict[int, int]]:
    """For each level where phrases begin and their names."""
    data = np.frombuffer(text, np.uint8)
    return [dict(zip(b.tolist(), n.tolist())) for n, b, _ in fp.levels(data, np.zeros(1, np.int64), 3)]


def test_equal_passages_have_equal_interior_names():
    passage = words(3000, 1).encode() + b"aaaaaaaaaabbbbbbbbbb" * 20 + words(3000, 2).encode()
    before = [b"", b"x", words(777, 3).encode(), b"a" * 50]
    found = [(names(b + passage + b"end of it"), len(b)) for b in before]
    for level in range(4):
        # Away from the edges of the passage, the same phrases begin at the same places.
        edge = 40 * 4**level
        inside = lambda x: {p - x[1]: n for p, n in x[0][level].items() if edge <= p - x[1] < len(passage) - edge}
        want = inside(found[0])
        assert len(want) > 10
        assert all(inside(x) == want for x in found[1:])


def test_phrases_are_short_and_cover_the_text():
    for text in (words(5000, 4).encode(), b"ab" * 3000, bytes(range(256)) * 10, b"abcde" * 999):
        at = np.flatnonzero(np.diff(np.frombuffer(text, np.uint8).astype(int), prepend=-1))
        data = np.frombuffer(text, np.uint8)[at]
        starts = fp.phrase_starts(data, np.zeros(1, np.int64))
        assert starts[0] == 0 and np.diff(np.append(starts, len(data)))[:-1].max() <= 12


def test_a_fingerprint_does_not_depend_on_what_is_parsed_with_it():
    texts = [words(n, n).encode() for n in (0, 1, 2, 3, 5, 9, 40, 400, 4000)] + [b"a" * 5000, b"\0", b"\0\0\0"]
    together = list(zip(*fp.fingerprints(texts)))
    for text, got in zip(texts, together):
        [alone] = zip(*fp.fingerprints([text]))
        assert fp.spelled(*alone) == fp.spelled(*got)
    assert len({fp.spelled(*f) for f in together}) == len(texts)


def test_likeness_follows_the_shared_part():
    base = words(20_000, 5)
    print_of = lambda t: next(zip(*fp.fingerprints([t.encode()])))
    own = print_of(base)
    assert fp.likeness(own, print_of(base)) == 1.0
    shares = [fp.likeness(own, print_of(base[: 200 * k] + words(20_000 - 200 * k, 6))) for k in (0, 25, 50, 75, 95)]
    assert shares == sorted(shares) and shares[0] < 0.05
    for k, share in zip((25, 50, 75), shares[1:]):
        assert abs(share - k / (200 - k)) < 0.12
    # Moved by any offset, nearly all is shared.
    assert fp.likeness(own, print_of("shift " + base)) > 0.9
    assert fp.compare(fp.spelled(*own), fp.spelled(*print_of(base[:-1]))) > 0.9


def plain(rows):
    """doc_id, n_chars and digest of the edited text, and both texts, in the stated order."""
    out = []
    for (i, t), (_, n) in zip(rows, rows[1:] + rows[:1]):
        half = len(t) // 2
        text = t[: len(t) - half] + n[:half]
        out.append((i, len(t), hashlib.sha256(text.encode()).hexdigest(), t, text, n))
    return out


def test_whole_table(spark, sf_dir):
    path = f"{sf_dir}/documents.parquet"
    rows = [(r["doc_id"], r["text"] or "") for r in pq.read_table(path, columns=["doc_id", "text"]).to_pylist()]
    want = plain(sorted(rows, reverse=True))
    got = {r.doc_id: r for r in fp.compare_edits(spark.read.parquet(path)).collect()}
    assert len(got) == len(rows)
    for i, n, digest, *texts in want:
        r = got[i]
        own, changed, following = (next(zip(*fp.fingerprints([t.encode()]))) for t in texts)
        assert (r.n_chars, r.edited_sha256) == (n, digest)
        assert (r.fingerprint, r.edited_fingerprint) == (fp.spelled(*own), fp.spelled(*changed))
        assert (r.near_edited, r.near_next) == (fp.likeness(own, changed), fp.likeness(own, following))
    near = [(r.near_edited, r.near_next) for r in got.values() if r.n_chars > 300]
    assert sum(a > b for a, b in near) > 0.97 * len(near) and np.mean([a for a, _ in near]) > 0.25


def test_odd_rows(spark, odd, odd_rows, none, monkeypatch):
    monkeypatch.setattr(fp, "BLOCK_BYTES", 5000)
    got = fp.compare_edits(odd).collect()
    assert sorted((repr(r.doc_id), r.n_chars) for r in got) == sorted((repr(i), len(t or "")) for i, t, _ in odd_rows)
    by_id = {r.doc_id: r for r in got}
    texts = {i: t or "" for i, t, _ in odd_rows if i is not None}
    for i, following in ((12, 11), (11, 10), (8, 7), (7, 6), (6, 6), (5, 4), (3, 2)):
        if i != 6:
            assert by_id[i].edited_sha256 == hashlib.sha256(fp.edited(texts[i], texts[following]).encode()).hexdigest()
    # Of two equal rows the first is followed by the second.
    [six, other] = sorted((r for r in got if r.doc_id == 6), key=lambda r: -r.near_next)
    assert six.near_next == 1.0 and six.fingerprint == other.fingerprint == by_id[5].fingerprint
    assert by_id[3].near_next == 1.0 and by_id[4].near_next == 0.0
    assert fp.compare_edits(none).count() == 0
    alone = fp.compare_edits(odd.where("doc_id = 12")).collect()[0]
    assert alone.near_next == 1.0
    plain_prints = {(r.doc_id, r.n): r.fingerprint for r in fp.fingerprint(odd, ["doc_id", "n"]).collect()}
    assert plain_prints[(12, "other3")] == by_id[12].fingerprint


def test_many_ranges_give_the_same(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs = docs.union(docs.where("doc_id % 3 = 0"))
    want = sorted(map(tuple, fp.compare_edits(docs).collect()))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "61")
        got = sorted(map(tuple, fp.compare_edits(docs).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == want
