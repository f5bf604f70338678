"""Applying rules to chunks: the matching rule of highest priority sets all tags of its file."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..config import Rule, RuleSet
from ..functions.let import constant
from .rule_index import first_match, pruned

#: More rules than this are found by one automaton instead of one CASE.
CASE_RULES = 100


def rule_hits(rule: Rule, chunk: Column) -> Column:
    return chunk.rlike(rule.pattern) if rule.pattern is not None else chunk.contains(rule.text)


def _holding(text: str):
    return lambda chunk: chunk.contains(text)


def winner(chunks: Column, rules: RuleSet, strict_compat: bool = False) -> Column:
    """Place, by priority and then order, of the rule that wins; null if none matches.

    ``strict_compat``: a regular expression only counts if a substring rule
    before it in the file matches too.
    """

    def holds(rule: Rule) -> Column:
        hit = F.exists(chunks, lambda c: rule_hits(rule, c))
        if strict_compat and rule.pattern is not None:
            earlier = [r for r in rules.rules if r.order < rule.order and r.pattern is None]
            hit = hit & reduce(lambda a, b: a | b, (F.exists(chunks, _holding(r.text)) for r in earlier), F.lit(False))
        return hit

    if len(rules.rules) <= CASE_RULES or strict_compat:
        return F.coalesce(*(F.when(holds(r), F.lit(i)) for i, r in enumerate(rules.by_priority)), F.lit(None).cast("int"))
    return first_match(chunks, rules.by_priority)


def apply_rules(extracts: DataFrame, rulesets: RuleSet | Sequence[RuleSet], *, chunks: str = "chunks", strict_compat: bool = False) -> DataFrame:
    """``extracts`` with an INT column for each tag; a tag of several files is the OR of them. No join, no shuffle.

    Rules that can't win are left out first. Up to ``CASE_RULES`` are one CASE; the time of more does not grow with their number.
    """
    rulesets = [rulesets] if isinstance(rulesets, RuleSet) else list(rulesets)
    rulesets = rulesets if strict_compat else [pruned(r) for r in rulesets]
    rows = extracts.withColumns({f"_won{k}": winner(F.col(chunks), r, strict_compat) for k, r in enumerate(rulesets)})
    found: dict[str, list[Column]] = {}
    for k, r in enumerate(rulesets):
        for tag in r.tags:
            values = constant([x.encoding[tag] for x in r.by_priority], "int")
            found.setdefault(tag, []).append(F.coalesce(F.get(values, F.col(f"_won{k}")), F.lit(0)).cast("int") if r.rules else F.lit(0))
    rows = rows.withColumns({tag: each[0] if len(each) == 1 else F.greatest(*each) for tag, each in found.items()})
    return rows.drop(*(f"_won{k}" for k in range(len(rulesets))))


def rule_words(rule: Column) -> Column:
    """How many words a rule has."""
    return F.size(F.filter(F.split(rule, r"\s+"), lambda w: w != ""))
