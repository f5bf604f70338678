"""Thousands of rules at once: an automaton of all their texts reads each chunk once.

A substring rule is found where its text ends. A regular expression becomes a
candidate where a text ends that all its matches hold, and is then tried by
Spark on that chunk alone, so its meaning is the same as in a CASE.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

from ..config import REGEX_SEPARATOR, Rule, RuleSet
from ..functions.let import constant, let

#: Stands between chunks; a rule that holds it matches nothing.
GAP = "\x00"


def required_text(pattern: str) -> str | None:
    """The longest text that every match of a regular expression holds, as far as its top level tells."""
    if re.search(r"\(\?[a-zA-Z-]*[ix]|\\[Q0-9xuckNgRXG]", pattern):  # letters of any case, and escapes of more than one character
        return None
    runs, run, i, depth = [], "", 0, 0
    while i < len(pattern):
        c = pattern[i]
        plain, step = None, 1
        if c == "\\":
            plain, step = (pattern[i + 1] if pattern[i + 1 : i + 2] and not pattern[i + 1].isalnum() else None), 2
        elif c == "[":
            end = i + 2 + (pattern[i + 1 : i + 2] == "^")
            while end < len(pattern) and pattern[end] != "]":
                if pattern[end] == "[":  # nested classes: too much to tell
                    return None
                end += 2 if pattern[end] == "\\" else 1
            step = end + 1 - i
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "|" and depth == 0:
            return None
        elif c in "?*{" and depth == 0:
            run = run[:-1]
            step = pattern.index("}", i) + 1 - i if c == "{" and "}" in pattern[i:] else 1
        elif c not in ".^$+?*{|":
            plain = c
        if plain is not None and depth == 0:
            run += plain
        else:
            runs.append(run)
            run = ""
        i += step
    return max([*runs, run], key=len) or None


def pruned(rules: RuleSet) -> RuleSet:
    """The rules that can win or change a tag.

    A substring rule goes if it holds the text of a better one, which then
    matches wherever it does; so do the last rules by priority that set no tag.
    """
    automaton = ahocorasick.Automaton()
    for place, r in enumerate(rules.by_priority):
        if r.pattern is None and r.text and r.text not in automaton:
            automaton.add_word(r.text, place)
    if len(automaton):
        automaton.make_automaton()
    kept = []
    for place, r in enumerate(rules.by_priority):
        if r.pattern is None and r.text and min(found for _, found in automaton.iter(r.text)) < place:
            continue
        kept.append(r)
        if r.text == "":  # it matches every chunk
            break
    while kept and not any(kept[-1].encoding.values()):
        kept.pop()
    stay = {r.order for r in kept}
    return RuleSet([r for r in rules.rules if r.order in stay], rules.tags, rules.name)


@dataclass(frozen=True)
class Index:
    """Texts and what ends with each: rules by their place, and regular expressions to try; ``always`` are those of which no text is known."""

    words: dict[str, tuple[list[int], bool]]
    always: list[int]
    patterns: list[str | None]

    @classmethod
    def of(cls, rules: Sequence[Rule]) -> Index:
        words: dict[str, tuple[list[int], bool]] = {}
        always = []

        def add(text: str, place: int | None) -> None:
            places, told = words.setdefault(text, ([], False))
            if place is not None:
                places.append(place)

        for place, r in enumerate(rules):
            text = r.text if r.pattern is None else required_text(r.text.split(REGEX_SEPARATOR)[1])
            if text:
                add(text, place)
            elif r.pattern is not None or r.text == "":
                always.append(place)
            if r.text:  # a chunk with a rule's own text, be it a pattern, is no negative
                add(r.text, None)
                words[r.text] = (words[r.text][0], True)
        return cls({k: v for k, v in words.items() if GAP not in k}, always, [r.pattern for r in rules])

    def automaton(self) -> ahocorasick.Automaton:
        built = ahocorasick.Automaton()
        for text, value in self.words.items():
            built.add_word(text, value)
        if len(built):
            built.make_automaton()
        return built


def first_match(chunks: Column, rules: Sequence[Rule]) -> Column:
    """Place of the first of ``rules`` that matches a chunk; null if none does."""
    index = Index.of(rules)
    sure = [p is None for p in index.patterns]

    def look(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = index.automaton()
        none = len(sure)
        for lists in batches:
            best, maybe = [], []
            for held in lists.to_pylist():
                held = [c for c in held or () if c is not None]
                places = set(index.always) if held else set()
                if len(automaton) and held:
                    for _, (found, _) in automaton.iter(GAP.join(held)):
                        places.update(found)
                first = min((p for p in places if sure[p]), default=none)
                best.append(first if first < none else None)
                maybe.append(sorted(p for p in places if p < first and not sure[p]))
            yield pa.StructArray.from_arrays([pa.array(best, pa.int32()), pa.array(maybe, pa.list_(pa.int32()))], ["best", "maybe"])

    found = F.arrow_udf(look, "best int, maybe array<int>").asNondeterministic()(chunks)  # not to be computed twice
    if all(sure):
        return found["best"]
    patterns = constant(index.patterns, "string")
    held = lambda i: F.exists(chunks, lambda c: F.call_function("rlike", c, F.get(patterns, i)))
    return let(found, lambda x: F.coalesce(F.get(F.filter(x["maybe"], held), F.lit(0)), x["best"]))


def all_matches(chunks: Column, rules: Sequence[Rule]) -> Column:
    """``hits``: (pos, place) of each chunk and each rule that matches it; ``free``: chunks without the text of any rule."""
    index = Index.of(rules)

    empty = any(r.text == "" for r in rules)

    def look(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = index.automaton()

        def holds(chunk: str) -> tuple[list[int], bool]:
            places, told = set(index.always), empty
            for _, (found, text) in automaton.iter(chunk) if len(automaton) else ():
                places.update(found)
                told |= text
            return sorted(places), told

        for lists in batches:
            known: dict[str, tuple[list[int], bool]] = {}  # equal chunks are read once
            at, place, bare, hits, free = array("i"), array("i"), array("i"), array("i", [0]), array("i", [0])
            for held in lists.to_pylist():
                for pos, chunk in enumerate(held or ()):
                    if chunk is None:
                        continue
                    if (found := known.get(chunk)) is None:
                        found = known[chunk] = holds(chunk)
                    at.extend([pos] * len(found[0]))
                    place.extend(found[0])
                    if not found[1]:
                        bare.append(pos)
                hits.append(len(place))
                free.append(len(bare))
            whole = lambda x: pa.array(np.frombuffer(x, np.int32) if x else [], pa.int32())
            pairs = pa.StructArray.from_arrays([whole(at), whole(place)], ["pos", "place"])
            yield pa.StructArray.from_arrays([pa.ListArray.from_arrays(whole(hits), pairs), pa.ListArray.from_arrays(whole(free), whole(bare))], ["hits", "free"])

    found = F.arrow_udf(look, "hits array<struct<pos:int,place:int>>, free array<int>").asNondeterministic()(chunks)
    if not any(index.patterns):
        return found
    patterns = constant(index.patterns, "string")
    sure = lambda h: F.get(patterns, h["place"]).isNull() | F.call_function("rlike", F.get(chunks, h["pos"]), F.get(patterns, h["place"]))
    return let(found, lambda x: F.struct(F.filter(x["hits"], sure).alias("hits"), x["free"].alias("free")))


def paid_negatives(hits: Sequence[tuple[int, int]], free: Sequence[int], cost: int) -> list[tuple[int, int]]:
    """(pos, place) of the free chunks that each rule's earlier hits pay for: a hit adds 1 to its credit, a chunk takes ``cost`` from one above 0."""
    by_rule = defaultdict(list)
    for pos, place in hits:
        by_rule[place].append(pos)
    out = []
    for place, at in by_rule.items():
        at.sort()
        own = set(at)
        seen = credit = 0
        i = bisect_left(free, at[0])
        while i < len(free):
            while seen < len(at) and at[seen] < free[i]:
                seen += 1
                credit += 1
            if credit <= 0:  # on to the free chunk after the hit that makes the credit positive again
                if seen - credit >= len(at):
                    break
                i = bisect_left(free, at[seen - credit], i + 1)
                continue
            if free[i] not in own:
                out.append((free[i], place))
                credit -= cost
            i += 1
    return out


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("place", T.IntegerType())])))
def _negatives(hits: pa.Array, free: pa.Array, cost: pa.Array) -> pa.Array:
    each = zip(hits.to_pylist(), free.to_pylist(), cost.to_pylist(), strict=True)
    found = [[{"pos": p, "place": k} for p, k in paid_negatives([(x["pos"], x["place"]) for x in h or ()], f or (), c)] for h, f, c in each]
    return pa.array(found, pa.list_(pa.struct([("pos", pa.int32()), ("place", pa.int32())])))


def negatives(matches: Column, cost: int) -> Column:
    """(pos, place) of the chunks that are taken as negatives of the rules that match others of the row."""
    return _negatives(matches["hits"], matches["free"], F.lit(cost))
