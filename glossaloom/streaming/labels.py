"""Labelling of texts as they arrive: an addition. Extraction and rules are row by row, so they run on streams as they are."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..config import RuleSet
from ..operators.extract import extract
from ..operators.rules import apply_rules


def label_stream(stream: DataFrame, keywords: Sequence[str], rulesets: Sequence[RuleSet], n: int = 6, *, text: str = "text") -> DataFrame:
    """Extracts with tags of a streaming table."""
    return apply_rules(extract(stream, keywords, n, text=text), rulesets)


def to_parquet(labelled: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write what is there now, once, and remember how far it came."""
    return labelled.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
