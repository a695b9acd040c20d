"""WARC archives, and what they say after a round trip."""

import base64
import gzip
import hashlib
import subprocess
from collections import defaultdict

from dayweave.llm import warc


def _want(rows, least=0):
    payloads = [(i, (h or "").encode()) for i, _, h in rows]
    holder = defaultdict(list)
    for i, p in payloads:
        holder[p].append(i)
    out = []
    for i, p in payloads:
        ids = [x for x in holder[p] if x is not None]
        top = max(ids) if ids and len(holder[p]) > 1 and len(p) >= least else None
        revisit = top is not None and i != top
        digest = base64.b32encode(hashlib.sha1(p).digest()).decode()
        out.append((i, len(p), digest, "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=repr)


ROWS = [
    (1, "http://a.example.com/", "<p>one</p>"),
    (2, "http://a.example.com/2", "<p>one</p>"),
    (9, None, "<p>one</p>"),
    (9, None, "<p>one</p>"),
    (3, "http://x.example.com/a b\r\nWARC-Type: evil", "é\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"),
    (4, "u", None),
    (5, "u", ""),
    (None, "u", "<p>one</p>"),
    (None, "u", "alone"),
    (6, "u", "z" * 2_000_000),
    (7, "u", "\x00\x01 \U0001f600"),
]


def test_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(*r, "x") for r in ROWS], "page_id long, url string, html string, digest string")
    got = warc.round_trip(pages.repartition(3), str(tmp_path / "a")).collect()
    assert sorted(map(tuple, got), key=repr) == _want(ROWS)
    got = warc.round_trip(pages, str(tmp_path / "b"), min_bytes=5).collect()
    assert sorted(map(tuple, got), key=repr) == _want(ROWS, 5)
    assert warc.round_trip(pages.limit(0), str(tmp_path / "c")).count() == 0


def test_tables(spark, sf_dir, tmp_path):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = warc.round_trip(pages, str(tmp_path / "a")).collect()
    assert sorted(map(tuple, got), key=repr) == _want([tuple(r) for r in pages.select("page_id", "url", "html").collect()])


def test_streams_are_one_member_and_archives_one_a_record(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").coalesce(1)
    warc.round_trip(pages, str(tmp_path / "a")).collect()
    (stream,) = (tmp_path / "a" / "streams").glob("*.gz")
    (archive,) = (tmp_path / "a" / "archives" / "kind=warc").glob("*/part-*")
    whole, packed = gzip.decompress(stream.read_bytes()), archive.read_bytes()
    assert gzip.decompress(packed) == whole
    assert whole.count(b"WARC/1.1\r\nWARC-Type: ") == len(ROWS) + 1  # one is inside a payload
    index = warc.read_index(spark, str(tmp_path / "a" / "archives")).orderBy("offset").collect()
    assert len(index) == len(ROWS) and index[0]["offset"] == 0
    for row, after in zip(index, [*index[1:], None]):
        end = row["offset"] + row["size"]
        assert end == (after["offset"] if after else len(packed))
        record = gzip.decompress(packed[row["offset"] : end])
        assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
        assert f"<urn:page:{'null' if row['page_id'] is None else row['page_id']}>".encode() in record
    assert subprocess.run(["gzip", "-tc"], input=packed, stdout=subprocess.DEVNULL).returncode == 0


def test_members_end_with_a_zero_byte():
    for record in (b"", b"a" * 100, b"ab" * (9 << 20)):
        packed = warc.member(record)
        assert packed.endswith(b"\0") and gzip.decompress(packed) == record


def test_records_are_found_whatever_the_pieces():
    record = lambda n: b"WARC/1.1\r\nContent-Length: %d\r\n\r\n" % n + b"x" * n + b"\r\n\r\n"
    data = record(0) + record(5) + record(70_000)
    for step in (1, 7, 1 << 16, 1 << 20):
        pieces = (data[i : i + step] for i in range(0, len(data), step))
        assert b"".join(r for _, r, _ in warc.split_records(pieces)) == data
