"""Naive Bayes classifiers as plain weights: a table that any engine can read, and a Column without ML transforms."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import NaiveBayesModel
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, StopWordsRemover
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.tokens import any_in
from .train import STOP

WORD = re.compile(r"\w\w+")


@dataclass(frozen=True)
class Light:
    """Words with their inverse document frequency and, for each tag, by how much they speak for it; ``bias`` is what no word says.

    A text has the tag if its words, weighted by frequency and scaled to length 1, and the bias sum to more than 0.
    """

    words: list[str]
    idf: np.ndarray
    weights: dict[str, np.ndarray]
    bias: dict[str, float]
    stop: frozenset[str]

    @classmethod
    def of(cls, models: Mapping[str, PipelineModel]) -> Light:
        """From models of one training, which share their words."""
        stages = next(iter(models.values())).stages
        one = lambda kind: next(s for s in stages if isinstance(s, kind))
        weights, bias = {}, {}
        for tag, model in models.items():
            bayes = next((s for s in model.stages if isinstance(s, NaiveBayesModel)), None)
            if bayes is None or bayes.numClasses > 2:
                raise ValueError(f"{tag}: only Naive Bayes of two classes has these weights")
            theta, pi = bayes.theta.toArray(), bayes.pi.toArray()
            if bayes.numClasses < 2:  # one class was seen, and it is all that is ever told
                weights[tag], bias[tag] = np.zeros(theta.shape[1]), -1.0
            else:
                weights[tag], bias[tag] = theta[1] - theta[0], float(pi[1] - pi[0])
        idf = one(ElementwiseProduct).getScalingVec().toArray()
        return cls(list(one(CountVectorizerModel).vocabulary), idf, weights, bias, frozenset(one(StopWordsRemover).getStopWords()))

    def table(self, spark: SparkSession) -> DataFrame:
        """(word, idf, weight of each tag); the row of the empty word has the biases. As many rows as the vocabulary has words."""
        columns = {"word": [*self.words, ""], "idf": [*self.idf.tolist(), 1.0]}
        columns |= {tag: [*w.tolist(), self.bias[tag]] for tag, w in self.weights.items()}
        return spark.createDataFrame(pa.table(columns))

    @classmethod
    def from_table(cls, rows: DataFrame, stop: frozenset[str] = frozenset(STOP)) -> Light:
        held = rows.toArrow().to_pydict()
        tags = [c for c in held if c not in ("word", "idf")]
        at = held["word"].index("")
        rest = [i for i in range(len(held["word"])) if i != at]
        pick = lambda c: np.array([held[c][i] for i in rest], float)
        return cls([held["word"][i] for i in rest], pick("idf"), {t: pick(t) for t in tags}, {t: held[t][at] for t in tags}, stop)

    def predictor(self):
        """What tells 0 or 1 for each text of an array, by tag."""
        place = {w: i for i, w in enumerate(self.words)}
        matrix, bias = list(self.weights.values()), list(self.bias[t] for t in self.weights)

        def told(texts: pa.Array) -> list[np.ndarray]:
            rows, columns = [], []
            for i, t in enumerate(texts.to_pylist()):
                found = [place[w] for w in WORD.findall((t or "").lower()) if w not in self.stop and w in place]
                rows += [i] * len(found)
                columns += found
            wide = max(len(self.words), 1)
            flat, counts = np.unique(np.array(rows, np.int64) * wide + np.array(columns, np.int64), return_counts=True)
            cells = np.divmod(flat, wide)
            x = counts * self.idf[cells[1]]
            norm = np.sqrt(np.bincount(cells[0], x * x, len(texts)))
            sums = (np.bincount(cells[0], x * w[cells[1]], len(texts)) / np.where(norm > 0, norm, 1) for w in matrix)
            return [(s + b > 0).astype(np.int32) for s, b in zip(sums, bias, strict=True)]

        return told

    def predict(self, text: Column) -> Column:
        """A struct of 0 or 1 for each tag; null and texts without known words have what the biases say."""
        tags = list(self.weights)

        def told(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            predict = self.predictor()
            for texts in batches:
                yield pa.StructArray.from_arrays([pa.array(x) for x in predict(texts)], tags)

        return F.arrow_udf(told, ", ".join(f"`{t}` int" for t in tags))(text)


def classify_light(extracts: DataFrame, light: Light, keywords: Mapping[str, Sequence[str]], *, chunks: str = "chunks") -> DataFrame:
    """``extracts`` with each tag: 1 if a chunk with one of its keywords is told 1, else 0. Rows stay where they are."""
    tags = list(light.weights)

    def told(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        predict = light.predictor()
        for lists in batches:
            found = predict(lists.flatten())
            yield pa.ListArray.from_arrays(lists.offsets, pa.StructArray.from_arrays([pa.array(x) for x in found], tags))

    one = ", ".join(f"`{t}`: int" for t in tags)
    found = F.arrow_udf(told, f"array<struct<{one}>>")(F.array_distinct(chunks))
    pairs = F.arrays_zip(F.array_distinct(chunks).alias("c"), found.alias("p"))
    yes = lambda t: F.exists(pairs, lambda x: any_in(x["c"], keywords[t]) & (x["p"][t] == 1))
    return extracts.select(*(c for c in extracts.columns if c not in tags), *(F.coalesce(yes(t), F.lit(False)).cast("int").alias(t) for t in tags))
