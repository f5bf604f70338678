"""Word vectors trained on the corpus, as an encoder of sentences for ``embed``.

Words that stand near one another are counted; the table of their positive
pointwise mutual information is reduced to a few dimensions by a randomised
singular value decomposition, whose products with the table are Spark jobs over
its entries. The driver holds matrices of vocabulary times dimensions only.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.let import let
from ..functions.tokens import word_tokens

VOCABULARY = 20_000
DIMENSIONS = 64
NEAR = 4
LEAST = 3
#: Columns beyond the dimensions, and passes over the table, that make the decomposition exact enough.
BEYOND, PASSES = 16, 2
#: Weight of a word of relative frequency p: SMOOTH / (SMOOTH + p).
SMOOTH = 1e-3


@dataclass(frozen=True)
class WordVectors:
    """An encoder: unit vectors of texts, from the weighted mean of their words less what is common to all words."""

    words: dict[str, int]
    vectors: np.ndarray
    weights: np.ndarray

    def __call__(self, texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.vectors.shape[1]), np.float32)
        for row, text in zip(out, texts, strict=True):
            found = [self.words[w] for w in (text or "").lower().split() if w in self.words]
            if found:
                row += self.weights[found] @ self.vectors[found]
                row /= np.linalg.norm(row) or 1
        return out


def _near(words: Column, near: int) -> Column:
    """(word, other) of each two words at most ``near`` places apart, either way round."""
    after = lambda w: F.transform(w, lambda x, i: F.transform(F.slice(w, i + 2, near), lambda y: F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))))
    return let(words, lambda w: F.flatten(after(w)))


def cooccurrences(texts: DataFrame, text: str = "text", *, near: int = NEAR, least: int = LEAST, vocabulary: int = VOCABULARY) -> tuple[list[tuple[str, int]], DataFrame]:
    """The most frequent words with their counts, and (a, b, n): how often two of them stand near each other, by place in that list."""
    rows = texts.select(word_tokens(F.lower(F.col(text))).alias("words"))
    counts = rows.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    words = [(r.word, r.n) for r in counts.orderBy(F.desc("n"), "word").limit(vocabulary).collect()]  # ``vocabulary`` rows at most
    places = texts.sparkSession.createDataFrame([(w, i) for i, (w, _) in enumerate(words)], "word string, place int")
    pairs = rows.select(F.explode(_near(F.col("words"), near)).alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("n"))
    first, second = places.toDF("a", "i"), places.toDF("b", "j")
    met = pairs.join(F.broadcast(first), "a").join(F.broadcast(second), "b")  # the vocabulary bounds both
    return words, met.select(F.col("i").alias("a"), F.col("j").alias("b"), "n")


def ppmi(pairs: DataFrame) -> DataFrame:
    """(i, j, value): positive pointwise mutual information of both orders of each pair."""
    both = pairs.select("a", "b", "n").unionByName(pairs.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "n"))
    sums = both.groupBy("a").agg(F.sum("n").alias("s"))  # as many rows as words
    total = sums.agg(F.sum("s")).first()[0] or 1
    met = both.join(F.broadcast(sums.toDF("a", "sa")), "a").join(F.broadcast(sums.toDF("b", "sb")), "b")
    value = F.log(F.col("n") * F.lit(float(total)) / (F.col("sa") * F.col("sb")))
    return met.select(F.col("a").alias("i"), F.col("b").alias("j"), value.alias("value")).where("value > 0")


def product(entries: DataFrame, right: np.ndarray, rows: int) -> np.ndarray:
    """The matrix of the entries times ``right``; each task gives sums for the rows that it has entries of."""
    width = right.shape[1]
    told = entries.sparkSession.sparkContext.broadcast(right)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i, j, v = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            at, place = np.unique(i, return_inverse=True)
            sums = np.zeros((len(at), width))
            np.add.at(sums, place, told.value[j] * v[:, None])
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.FixedSizeListArray.from_arrays(pa.array(sums.ravel()), width).cast(pa.list_(pa.float64()))], ["i", "sums"])

    parts = entries.sortWithinPartitions("i", "j").mapInArrow(run, "i int, sums array<double>")
    added = parts.groupBy("i").agg(*(F.sum(F.round(F.col("sums")[k], 9)).alias(f"s{k}") for k in range(width)))
    found = added.toArrow()  # as many rows as words
    out = np.zeros((rows, width))
    out[found.column("i").to_numpy()] = np.stack([found.column(f"s{k}").to_numpy() for k in range(width)], 1)
    told.unpersist()
    return out


def fit_vectors(texts: DataFrame, text: str = "text", *, dimensions: int = DIMENSIONS, near: int = NEAR, least: int = LEAST, vocabulary: int = VOCABULARY, seed: int = 42) -> WordVectors:
    """Vectors of the words of a column of texts, the same for the same texts up to the last digits. Without words it encodes all as zeros."""
    words, pairs = cooccurrences(texts, text, near=near, least=least, vocabulary=vocabulary)
    n = len(words)
    if not n:
        return WordVectors({}, np.zeros((0, dimensions)), np.zeros(0))
    entries = ppmi(pairs).repartition("i").cache()
    try:
        width = min(n, dimensions + BEYOND)
        basis = np.linalg.qr(product(entries, np.random.default_rng(seed).standard_normal((n, width)), n))[0]
        for _ in range(PASSES):  # the table is symmetric
            basis = np.linalg.qr(product(entries, basis, n))[0]
        small = basis.T @ product(entries, basis, n)
    finally:
        entries.unpersist()
    values, turned = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-np.abs(values))[:dimensions]
    vectors = basis @ turned[:, order] * np.sqrt(np.abs(values[order]))
    share = np.array([c for _, c in words], float)
    weights = SMOOTH / (SMOOTH + share / share.sum())
    vectors = vectors - (weights @ vectors) / weights.sum()
    return WordVectors({w: i for i, (w, _) in enumerate(words)}, vectors, weights)
