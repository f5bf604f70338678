"""Stratified validation samples and their scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.names import unused
from .sample import smallest_by


def rule_counts(train: DataFrame) -> DataFrame:
    """(rule, count)"""
    return train.groupBy("rule").agg(F.count("*").alias("count"))


def quotas(counts: DataFrame, x: int = 100, m: int = 5) -> DataFrame:
    """``counts`` with ``quota``: shares of about x rows, at least m for each rule that has more than m in its share."""
    if not (1 <= x <= 1000 and 1 <= m <= 100):
        raise ValueError("x is from 1 to 1000, m from 1 to 100")
    # one row for each rule: they are few, and a window over all of them reads them once
    v, wanted = unused(counts.columns, "v", "wanted")
    rules = W.partitionBy(F.lit(0))
    rows = counts.withColumn(wanted, F.lit(x) + m * F.count("*").over(rules))
    rows = rows.withColumn(v, F.floor(F.col("count") / F.sum("count").over(rules) * F.col(wanted) + 5))
    share = F.floor((F.col(v) - m) / F.sum(F.when(F.col(v) > m, F.col(v))).over(rules) * F.col(wanted))
    return rows.withColumn("quota", F.when(F.col(v) > m, F.greatest(share, F.lit(m))).otherwise(F.col(v)).cast("long")).drop(v, wanted)


def validation_sample(train: DataFrame, x: int = 100, m: int = 5, *, key: Sequence[str], seed: str = "42") -> DataFrame:
    """``train`` rows within their rule's quota, with an empty ``truth``."""
    kept = smallest_by(train, "rule", lambda counts: quotas(counts, x, m).withColumnRenamed("quota", "size"), key=key, seed=seed)
    return kept.withColumn("truth", F.lit(None).cast("int"))


def _cell(truth: str, predicted: str, t: int, p: int) -> Column:
    return F.count_if((F.col(truth) == t) & (F.col(predicted) == p))


def score(rows: DataFrame, *, truth: str = "truth", predicted: str = "predicted", by: Sequence[str] = (), digits: int = 3) -> DataFrame:
    """accuracy, precision, recall and f1 of 0/1 columns; 0 where there is nothing to divide by."""
    cells = rows.groupBy(*by).agg(_cell(truth, predicted, 1, 1).alias("tp"), _cell(truth, predicted, 0, 1).alias("fp"), _cell(truth, predicted, 1, 0).alias("fn"), _cell(truth, predicted, 0, 0).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    ratio = lambda a, b: F.round(F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0)), digits)
    return cells.select(*by, ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def confusion_matrix(rows: DataFrame, *, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """(label, n, pct) of TN, FP, FN and TP."""
    cells = rows.agg(*(_cell(truth, predicted, t, p).alias(name) for name, t, p in (("TN", 0, 0), ("FP", 0, 1), ("FN", 1, 0), ("TP", 1, 1))))
    total = F.col("TN") + F.col("FP") + F.col("FN") + F.col("TP")
    listed = F.array(*(F.struct(F.lit(k).alias("label"), F.col(k).alias("n"), F.round(F.coalesce(F.try_divide(F.col(k) * 100.0, total), F.lit(0.0)), 2).alias("pct")) for k in ("TN", "FP", "FN", "TP")))
    return cells.select(F.explode(listed).alias("c")).select("c.*")


def score_all(truth: DataFrame, predictions: DataFrame, tags: Sequence[str], *, id: str = "id") -> DataFrame:
    """Scores of every tag (class, accuracy, ...) of predictions joined to the truth by id."""
    met = truth.select(id, *(F.col(t).alias(f"_t_{t}") for t in tags)).join(predictions.select(id, *tags), id)
    long = met.select(F.explode(F.array(*(F.struct(F.lit(t).alias("class"), F.col(f"_t_{t}").alias("truth"), F.col(t).alias("predicted")) for t in tags))).alias("r")).select("r.*")
    return score(long, by=["class"])
