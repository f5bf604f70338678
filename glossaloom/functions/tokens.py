"""Tokens, keyword hits, and the keyword-centred trimming of chunks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

from .let import let

#: Place of the keyword in a chunk of 13 words.
CENTRE = 6
TRIM = 2


def filled(words: Column) -> Column:
    return F.filter(words, lambda x: x != "")


def word_tokens(text: Column) -> Column:
    """Runs of a-z and 0-9 of lower-cased text."""
    return filled(F.split(F.regexp_replace(text, "[^a-z0-9]+", " "), " "))


def sentence_tokens(text: Column) -> Column:
    """Sentences of lower-cased text, split at ``.?!`` and trimmed; empty ones count as neighbours."""
    t = F.regexp_replace(text, "[^a-z0-9.!?]+", " ")
    return F.transform(F.split(F.regexp_replace(t, "[.?!]", ". "), r"\."), lambda x: F.btrim(x))


def any_in(text: Column, keys: Sequence[str], trim: bool = False) -> Column:
    """Some key is a substring of the text."""
    keys = [k.strip() if trim else k for k in keys]
    return reduce(lambda a, b: a | b, (text.contains(k) for k in keys), F.lit(False))


def contexts(tokens: Column, keys: Sequence[str], n: int) -> Column:
    """For each token that holds a key, the token and its n neighbours on either side, joined."""
    if not 0 <= n <= 20:
        raise ValueError("n is from 0 to 20")

    def around(w: Column) -> Column:
        hits = F.filter(F.transform(w, lambda x, i: F.when(any_in(x, keys, trim=True), i)), lambda i: i.isNotNull())
        return F.transform(hits, lambda i: F.array_join(F.slice(w, F.greatest(i - n, F.lit(0)) + 1, i + n + 1 - F.greatest(i - n, F.lit(0))), " "))

    return let(tokens, around)


def without_stop_words(words: Column, stop: Sequence[str]) -> Column:
    """Words that are not stop words; repeated words stay."""
    return F.filter(words, lambda x: ~F.array_contains(F.array(*map(F.lit, stop)), x)) if stop else words


def key_index(words: Column, keys: Sequence[str]) -> Column:
    """Index of the word with a key that is closest to the centre, else the middle; ties by order of keys."""

    def of(w: Column) -> Column:
        def held(k: int, key: str) -> Column:
            return F.filter(F.transform(w, lambda x, i: F.when(x.contains(key), F.struct(F.abs(i - CENTRE).alias("d"), F.lit(k).alias("k"), i.alias("i")))), lambda s: s.isNotNull())

        found = F.array_min(F.concat(*(held(k, key) for k, key in enumerate(keys)))) if keys else F.lit(None)
        return F.coalesce(found["i"], F.floor(F.size(w) / 2).cast("int")) if keys else F.floor(F.size(w) / 2).cast("int")

    return let(words, of)


def _equal(word: str):
    return lambda x: x == word


def add_qualifiers(words: Column, qualifiers: Sequence[str]) -> Column:
    """Words with the sorted qualifiers that were found as prefix; qualifiers stay as they are."""
    if not qualifiers:
        return words
    of = F.array(*map(F.lit, qualifiers))
    prefix = lambda w: F.array_join(F.array_sort(F.concat(*(F.filter(w, _equal(q)) for q in qualifiers))), "_")
    return let(words, lambda w: let(prefix(w), lambda p: F.transform(w, lambda x: F.when(F.array_contains(of, x) | (p == ""), x).otherwise(F.concat(p, F.lit("_"), x)))))


def trim_to_keyword(chunk: Column, keys: Sequence[str], qualifiers: Sequence[str] = (), keep: Sequence[str] = (), stop: Sequence[str] = ()) -> Column:
    """A chunk without stop words, cut to two words around its keyword; kept outside words come first."""
    words = without_stop_words(filled(F.split(chunk, r"\s+")), stop)
    keep_array, qualifier_array = F.array(*map(F.lit, keep)), F.array(*map(F.lit, qualifiers))

    def cut(w: Column) -> Column:
        def at(m: Column) -> Column:
            lower = F.greatest(m - TRIM, F.lit(0))
            # the upper end is bounded by the length of the chunk in characters
            upper = F.least(F.length(chunk), m + TRIM)

            def of(t: Column) -> Column:
                inside = F.slice(t, lower + 1, upper + 1 - lower)
                inside = F.filter(inside, lambda x: ~F.array_contains(qualifier_array, x)) if qualifiers else inside
                if not keep:
                    return inside
                outside = F.filter(t, lambda x, i: ((i < lower) | (i > upper)) & F.array_contains(keep_array, x))
                return F.concat(outside, inside)

            return let(add_qualifiers(w, qualifiers), of)

        return let(key_index(w, keys), at)

    return F.array_join(let(words, cut), " ")


def trim_words(chunk: Column, n: int) -> Column:
    """The middle of a chunk of words: n words on either side of word L/2."""
    words = filled(F.split(chunk, r"\s+"))

    def middle(w: Column) -> Column:
        m = F.floor(F.size(w) / 2).cast("int")
        low = F.greatest(m - n, F.lit(0))
        return F.slice(w, low + 1, m + n + 1 - low)

    return F.array_join(let(words, middle), " ")
