"""The queries against the same queries in SQL."""

import pytest

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from dayweave.llm.oracle import ORACLE
from dayweave.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, db, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    want = db.execute(ORACLE[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    plain = lambda names, rows: sorted(repr([r[names.index(c)] for c in sorted(names)]) for r in rows)
    assert plain(got.columns, got.collect()) == plain(columns, want.fetchall())


def test_all_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(queries())
    assert set(ORACLE) <= set(oracle_sql())
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))
    assert [s[0] for s in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "pseudonyms", "mixture", "packing"]
