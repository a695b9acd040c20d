"""Toxicity by logistic regression over hashed word n-grams, trained by FTRL-proximal."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from dayweave.llm.tokens import utf8

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BITS = 20
# The labelled rows that are learned from: at most so many, those first in the order of a hash.
TRAIN_ROWS = 16_000
EPOCHS = 8
# Rates and penalties, chosen on held-out rows: a strong L1 leaves a few hundred weights.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 20.0, 0.0
FOLDS = 5
WORDS_KEPT = 500_000
# Lower case, and every ASCII mark a space.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_STEP = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


class Features:
    """Hashed words, pairs of neighbours, and pairs with one word between."""

    def __init__(self, bits: int = BITS):
        import xxhash

        class Known(dict):
            def __missing__(self, word):
                if len(self) >= WORDS_KEPT:
                    self.clear()
                value = self[word] = xxhash.xxh3_64_intdigest(word)
                return value

        self.shift = np.uint64(64 - bits)
        self.known = Known()

    def places(self, text: bytes) -> np.ndarray:
        words = text.translate(_PLAIN).split()
        h = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        pairs = h[:-1] * _STEP[1] + h[1:]
        skips = h[:-2] * _STEP[2] + h[2:]
        return ((np.concatenate([h, pairs, skips]) * _STEP[0]) >> self.shift).astype(np.int64)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that labels are never learned from; so is a row without an id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def _extractor(bits: int):
    def extract(batches):
        features = Features(bits)
        for batch in batches:
            places = [np.unique(features.places(text)).astype(np.int32) for text in utf8(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("label"), pa.array(places, pa.list_(pa.int32()))],
                names=["key", "label", "places"],
            )

    return extract


def ftrl(examples, bits: int = BITS, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias. Each coordinate has a rate of its own, from the gradients it has seen,
    and stays exactly zero until they add up to more than L1."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    bias, bias_n = 0.0, 0.0

    def weights(z, n):
        return np.where(np.abs(z) > L1, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)

    for _ in range(epochs):
        for places, label in examples:
            zi, ni = z[places], n[places]
            w = weights(zi, ni)
            g = 1 / (1 + np.exp(-np.clip(bias + w.sum(), -35, 35))) - label
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA
            z[places] = zi + g - sigma * w
            n[places] = ni + g * g
            bias_n += g * g
            bias -= ALPHA / (BETA + np.sqrt(bias_n)) * g
    return weights(z, n), float(bias)


def _trainer(bits: int):
    def train(batches):
        rows = [
            (key, np.asarray(places.values), label)
            for batch in batches
            for key, label, places in zip(
                batch.column("key").to_pylist(), batch.column("label").to_pylist(), batch.column("places")
            )
        ]
        rows.sort(key=lambda r: r[0])
        w, bias = ftrl([(places, label) for _, places, label in rows], bits)
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(at, -1)), pa.array(np.append(w[at], bias))], names=["place", "weight"]
        )

    return train


def fit(docs: DataFrame, labels: DataFrame, bits: int = BITS, rows: int = TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray, float]:
    """Places and values of the weights that are not zero, and the bias.

    Learned from at most `rows` labelled documents outside the held-out part, so the sample, the
    one task that goes through it in order, and the weights (at most 2 ** bits) are bounded
    whatever the input. Labels other than 0 and 1 are no labels; a document with several labels
    counts for each. Without any labelled document the weights are empty and the bias is 0.
    """
    key = F.md5(F.col("doc_id").cast("string"))
    chosen = (
        labels.where(F.col("toxic").isin(0, 1) & ~held_out())
        .select(key.alias("key"), F.col("doc_id").alias("__doc_id"), F.col("toxic").cast("int").alias("label"))
        .orderBy("key", "label")
        .limit(rows)
    )
    # At most `rows` rows of three short columns.
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("__doc_id"))
    examples = texts.select("key", "label", "text").mapInArrow(
        _extractor(bits), "key string, label int, places array<int>"
    )
    found = examples.repartition(1).mapInArrow(_trainer(bits), "place long, weight double").collect()
    weights = sorted((r["place"], r["weight"]) for r in found if r["place"] >= 0)
    bias = next((r["weight"] for r in found if r["place"] < 0), 0.0)
    return (
        np.array([p for p, _ in weights], dtype=np.int64),
        np.array([w for _, w in weights], dtype=np.float64),
        bias,
    )


def _scorer(places, values, bias, bits):
    def score(batches):
        features = Features(bits)
        weights = np.zeros(1 << bits)
        weights[places] = values
        for batch in batches:
            scores = []
            for text in utf8(batch.column("text")):
                at = features.places(text)
                at = np.unique(at[weights[at] != 0])
                scores.append(1 / (1 + np.exp(-np.clip(bias + weights[at].sum(), -35, 35))))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"]
            )

    return score


def score(docs: DataFrame, labels: DataFrame, bits: int = BITS) -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    Only the text decides the score. A missing or empty text has no features and gets the score
    of the bias. Repeated rows get equal scores each. No documents give no rows. Other columns
    of `docs` and `labels` are not used.
    """
    places, values, bias = fit(docs, labels, bits)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = rows.mapInArrow(_scorer(places, values, bias, bits), "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
