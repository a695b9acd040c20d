import os

import duckdb
import pytest

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = "documents embeddings pages benchmark labels conversations".split()
COPIED = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
# Names that operators use inside; here they hold something else.
CLASHING = ["size", "key", "digest", "n", "doc", "unit", "label", "kept", "n_words", "rank", "finish", "n_replaced", "content"]


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def db():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return con


@pytest.fixture(scope="session")
def odd_rows():
    """Missing and empty values, ties, repeated rows, one very long text and one without spaces."""
    long_text = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
    clean = " ".join(f"clean{i}" for i in range(80))
    rows = [
        (1, clean, "a"),
        (2, None, "a"),
        (3, "", None),
        (4, " \n\t\r\x0b\x0c ", "b"),
        (5, COPIED * 4, "b"),
        (6, COPIED * 4, "a"),
        (6, COPIED * 4, "a"),
        (None, clean, "c"),
        (None, None, None),
        (7, long_text, "c"),
        (8, "x" * 60_000, "c"),
        (9, f"call +1 (017) 555-7713 or und.34@mail7.example.com now {clean}", "a"),
        (10, "short", "d"),
        (11, "ÉÀ 日本 \U0001f600 İß " * 30, "d"),
        (12, clean + " more", "d"),
    ]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    rows = [(*r, *[f"other{i}" for i in range(len(CLASHING))]) for r in odd_rows]
    names = ", ".join(f"{c} string" for c in CLASHING)
    return spark.createDataFrame(rows, f"doc_id long, text string, source string, {names}").repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
