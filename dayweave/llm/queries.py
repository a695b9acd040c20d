"""One query per operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from dayweave.llm import (
    alignment,
    embedding_dedup,
    fingerprints,
    hard_negatives,
    mixing,
    ngram_join,
    packing,
    pii,
    quality,
    suffix_dedup,
    tokens,
    toxicity,
    warc,
)
from dayweave.llm.text import table
from dayweave.sources import scratch_path


def op1_mix(spark, sf_dir):
    return mixing.report(table(spark, sf_dir, "documents"))


def op2_toxicity(spark, sf_dir):
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_warc(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))


def op4_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_pseudonyms(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs)


def op6_token_counts(spark, sf_dir):
    return tokens.count_tokens(table(spark, sf_dir, "documents"), ["doc_id"], scratch_path(spark, "token-cache"))


def op7_embedding_links(spark, sf_dir):
    return embedding_dedup.link(table(spark, sf_dir, "embeddings"))


def op8_ngram_join(spark, sf_dir):
    return ngram_join.join(table(spark, sf_dir, "documents"), words=4, percent=85)


def op9_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return quality.judge(docs, ["doc_id"]).drop("source")


def op10_suffix_dedup(spark, sf_dir):
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op11_hard_negatives(spark, sf_dir):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", moved)
    return hard_negatives.mine(vectors, anchors=F.col("vec_id") % 100 == 0)


def op12_token_alignment(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return alignment.align(docs, ["doc_id"])


def op13_fingerprints(spark, sf_dir):
    return fingerprints.compare_edits(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_mix": op1_mix,
    "op2_toxicity": op2_toxicity,
    "op3_warc": op3_warc,
    "op4_packing": op4_packing,
    "op5_pseudonyms": op5_pseudonyms,
    "op6_token_counts": op6_token_counts,
    "op7_embedding_links": op7_embedding_links,
    "op8_ngram_join": op8_ngram_join,
    "op9_quality": op9_quality,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_token_alignment": op12_token_alignment,
    "op13_fingerprints": op13_fingerprints,
}
