"""The stages of the pipeline, each judged on its own input."""

from collections import Counter

import pytest
from test_links import _brute_join
from test_rows import _rules
from test_tokens_packing import _check_packed
from tokenizers import Tokenizer

import corpus_pipeline
from dayweave.llm.mixing import mixed_documents
from dayweave.llm.tokens import tokenizer_path


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """What each stage reads and gives, with the columns of documents."""
    folder = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        result = stage(spark, docs, sf_dir)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert result.dtypes == docs.dtypes, name
        result.write.parquet(str(folder / str(i)))
        result = spark.read.parquet(str(folder / str(i)))
        out.append((docs.collect(), result.collect()))
        docs = result
    return out


def test_quality(stages):
    before, after = stages[0]
    assert sorted(after) == sorted(r for r in before if not _rules(r["text"])[-1])


def test_near_duplicates(stages):
    before, after = stages[1]
    root = {i: c for i, _, c in _brute_join([(r["doc_id"], r["text"]) for r in before], 5, 80)}
    assert sorted(after) == sorted(r for r in before if root[r["doc_id"]] == r["doc_id"])
    assert len(after) < len(before)


def test_pseudonyms(stages):
    before, after = ({r["doc_id"]: r for r in rows} for rows in stages[2])
    assert before.keys() == after.keys()
    changed = [i for i in before if before[i] != after[i]]
    assert changed and all(before[i][2:] == after[i][2:] and len(before[i]["text"]) >= len(after[i]["text"]) - 40 for i in changed)
    for i in set(before) - set(changed):
        assert "@mail" not in before[i]["text"] and "555-" not in before[i]["text"]


def test_mixture(spark, stages):
    before, after = stages[3]
    assert set(after) <= set(before)
    assert max(Counter(after).values()) <= 3
    again = mixed_documents(spark.createDataFrame(before).repartition(3)).collect()
    assert Counter(again) == Counter(after)


def test_packing(stages):
    before, after = stages[4]
    texts = {}
    for r in before:
        texts.setdefault(r["doc_id"], []).append(r["text"])
    _check_packed(after, texts, Tokenizer.from_file(tokenizer_path()))


def test_run_gives_the_rows_of_the_last_stage(spark, sf_dir, stages):
    got = corpus_pipeline.run(spark, sf_dir).select("doc_id", "piece", "length").collect()
    assert Counter(got) == Counter((r["doc_id"], r["piece"], r["length"]) for r in stages[4][1])
