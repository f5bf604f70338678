"""Training rows from rules: every match of a chunk and a rule, with negative sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..config import Rule, RuleSet
from ..functions.let import constant, once
from ..functions.names import unused
from ..functions.tokens import any_in
from .rule_index import all_matches, negatives as take_negatives
from .rules import CASE_RULES, rule_hits
from .sample import sample_rows


def _matches(chunks: Column, rules: Sequence[Rule]) -> Column:
    """``hits``: (pos, place) of each chunk and each rule that matches it; ``free``: chunks without the text of any rule."""
    if len(rules) > CASE_RULES:
        return all_matches(chunks, rules)
    of = lambda c, i: F.filter(F.array(*(F.when(rule_hits(r, c), F.struct(i.alias("pos"), F.lit(place).alias("place"))) for place, r in enumerate(rules))), lambda h: h.isNotNull())
    bare = lambda c, i: F.when(~any_in(c, [r.text for r in rules]), i)
    return F.struct(F.flatten(F.transform(chunks, of)).alias("hits"), F.filter(F.transform(chunks, bare), lambda i: i.isNotNull()).alias("free"))


def training_set(extracts: DataFrame, rules: RuleSet, *, negatives: bool = False, chunks: str = "chunks", keep: Sequence[str] = (), percent: float = 100, key: Sequence[str] = ()) -> DataFrame:
    """(keep, pos, chunk, rule, ord, match, tags): ``match`` is the rule's priority; negatives have all tags 0.

    Chunks are taken in order. A match adds one to the rule's credit; a chunk that holds no rule's text takes the number
    of tags from a positive credit, as a negative of that rule. Below 100, ``percent`` of the rows are matched, chosen by
    ``key`` (or ``keep``). Rows may have any number of chunks, and there may be thousands of rules.
    """
    if not 0 < percent <= 100:
        raise ValueError("percent is above 0 and at most 100")
    if percent < 100:
        extracts = sample_rows(extracts, percent, key=list(key) or list(keep))
    at, found, more, one = unused([*extracts.columns, *keep], "at", "found", "more", "one")
    rows = extracts.select(*keep, F.col(chunks).alias(at)).withColumn(found, once(_matches(F.col(at), rules.rules)))
    tell = lambda x, hit: F.struct(x["pos"].alias("pos"), x["place"].alias("place"), F.lit(hit).alias("hit"), F.get(F.col(at), x["pos"]).alias("chunk"))
    listed = F.transform(F.col(found)["hits"], lambda x: tell(x, True))
    if negatives:
        rows = rows.withColumn(more, take_negatives(F.col(found), len(rules.tags)))
        listed = F.concat(listed, F.transform(more, lambda x: tell(x, False)))
    rows = rows.select(*keep, F.explode(listed).alias(one))
    kind = f"struct<rule:string,ord:int,match:int,{','.join(f't{i}:int' for i in range(len(rules.tags)))}>"
    told = F.get(constant([{"rule": r.text, "ord": r.order, "match": r.priority, **{f"t{i}": r.encoding[t] for i, t in enumerate(rules.tags)}} for r in rules.rules], kind), F.col(one)["place"])
    return rows.select(*keep, F.col(one)["pos"].alias("pos"), F.col(one)["chunk"].alias("chunk"), *(told[c].alias(c) for c in ("rule", "ord", "match")), *(F.when(F.col(one)["hit"], told[f"t{i}"]).otherwise(0).cast("int").alias(t) for i, t in enumerate(rules.tags)))


def dedupe(train: DataFrame, order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Of rows with the same chunk (in the same source, ``by``) the one of highest priority; ties by ``order``."""
    best = W.partitionBy(*by, "chunk").orderBy(F.desc("match"), "ord", *order)
    return train.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def label_vector(tags: Sequence[str]) -> Column:
    """The tags as one array."""
    return F.array(*map(F.col, tags))
