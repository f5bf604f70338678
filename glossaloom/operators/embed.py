"""Tagging by similarity of chunk embeddings to the mean embedding of a tag's positive rules."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..config import RuleSet, TagSet
from ..functions.names import unused

DIMENSIONS = 256
#: Numbers of all class vectors that may be sent to every task.
MOST = 1 << 24
#: Texts whose vectors a task holds at a time.
TEXTS = 1 << 10
Encoder = Callable[[Sequence[str]], np.ndarray]


def hashing_encoder(texts: Sequence[str]) -> np.ndarray:
    """Unit vectors of hashed words and word pairs; stands in for a sentence encoder, with no files."""
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    for row, text in zip(out, texts, strict=True):
        words = (text or "").lower().split()
        for token in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))]:
            h = zlib.crc32(token.encode())
            row[h % DIMENSIONS] += 1 if h >> 31 else -1
        norm = np.linalg.norm(row)
        row /= norm or 1
    return out


def class_vectors(rulesets: Sequence[RuleSet], encoder: Encoder = hashing_encoder) -> dict[str, list[float]]:
    """For each tag the mean vector of the rules that set it; a tag without such rules has none."""
    positive: dict[str, list[str]] = {}
    for r in rulesets:
        for tag in r.tags:
            positive.setdefault(tag, []).extend(x.text for x in r.rules if x.encoding[tag] == 1)
    return {tag: encoder(texts).mean(0).astype(float).tolist() for tag, texts in positive.items() if texts}


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; null if one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _cosines(vector: Sequence[float], found: np.ndarray) -> np.ndarray:
    """As ``cosine`` of one vector and each row, added up in the same order; NaN if one has no length."""
    dot = lambda x, y: np.add.accumulate(x * y, axis=-1)[..., -1]
    a, b = np.asarray(vector, np.float64), np.asarray(found, np.float64)
    with np.errstate(divide="ignore", invalid="ignore"):
        return dot(a, b) / (np.sqrt(dot(a, a)) * np.sqrt(dot(b, b)))


def cosines(rows: DataFrame, classes: DataFrame, to: str = "cosines", *, vector: str = "embedding", name: str = "class", of: str = "vector", most: int = MOST) -> DataFrame:
    """``rows`` with an array (cosine, class) for all classes, by name; the cosine is null where a vector has no length.

    The classes come as one array to every row, so nothing is shuffled; their numbers must be at most ``most`` in all.
    """
    size = classes.agg(F.sum(F.size(of))).first()[0] or 0
    if size > most:
        raise ValueError(f"the class vectors have {size} numbers; most is {most}")
    (listed,) = unused([*rows.columns, to], "listed")
    one = classes.agg(F.array_sort(F.collect_list(F.struct(F.col(name).alias("class"), F.col(of).alias("vector")))).alias(listed))
    told = F.transform(F.col(listed), lambda c: F.struct(cosine(F.col(vector), c["vector"]).alias("cosine"), c["class"].alias("class")))
    return rows.crossJoin(F.broadcast(one)).withColumn(to, told).drop(listed)  # one row


def best_class(rows: DataFrame, classes: DataFrame, *, vector: str = "embedding", name: str = "class", of: str = "vector", most: int = MOST) -> DataFrame:
    """``rows`` with the class of the nearest vector and its cosine, ties to the first by name; null where a vector has no length."""
    all_, best = unused([*rows.columns, name, "cosine"], "all", "best")
    rows_ = cosines(rows, classes, all_, vector=vector, name=name, of=of, most=most)
    nearer = lambda a, b: F.when(a["cosine"].isNull() | (b["cosine"] > a["cosine"]), b).otherwise(a)
    found = rows_.withColumn(best, F.aggregate(F.col(all_), F.get(F.col(all_), F.lit(0)), nearer))
    return found.select(*rows.columns, F.col(best)["class"].alias(name), F.col(best)["cosine"].alias("cosine"))


def apply_embeddings(extracts: DataFrame, rulesets: Sequence[RuleSet], tags: TagSet, threshold: float = 0.6, *, encoder: Encoder = hashing_encoder, chunks: str = "chunks") -> DataFrame:
    """``extracts`` with each tag and its ``_evidence``: chunks with a keyword of the tag whose cosine is above the threshold."""
    if not 0 <= threshold <= 1:
        raise ValueError("the threshold is from 0 to 1")
    vectors = class_vectors(rulesets, encoder)
    told = {tag: tags.keywords[tag] for tag in tags.keywords if tag in vectors}
    wanted = sorted({k for keys in told.values() for k in keys})

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column(chunks).to_pylist()
            # chunks without a keyword of any tag need no vector; equal ones share what is told of them, and vectors go at once
            asked = list(dict.fromkeys(c for x in held for c in x or () if c is not None and any(k in c for k in wanted)))
            near: dict[str, set[str]] = {tag: set() for tag in told}
            for i in range(0, len(asked), TEXTS):
                some = asked[i : i + TEXTS]
                found = encoder(some)
                for tag, keys in told.items():
                    close = _cosines(vectors[tag], found) > threshold
                    near[tag].update(c for c, yes in zip(some, close, strict=True) if yes and any(k in c for k in keys))
            evidence = [pa.array([None if x is None else [c for c in x if c in near[tag]] for x in held], pa.list_(pa.string())) for tag in told]
            yield pa.RecordBatch.from_arrays([*batch.columns, *evidence], names=[*batch.schema.names, *(f"_near_{i}" for i in range(len(told)))])

    schema = T.StructType(list(extracts.schema))
    for i in range(len(told)):
        schema = schema.add(f"_near_{i}", T.ArrayType(T.StringType()))
    rows, place = extracts.mapInArrow(embed, schema), {tag: i for i, tag in enumerate(told)}
    for tag in tags.keywords:
        evidence = F.col(f"_near_{place[tag]}") if tag in place else F.array().cast("array<string>")
        rows = rows.withColumn(f"{tag}_evidence", evidence).withColumn(tag, (F.size(evidence) > 0).cast("int"))
    return rows.drop(*(f"_near_{i}" for i in range(len(told))))
