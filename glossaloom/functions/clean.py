"""Cleaning of raw text as Column expressions; the order of steps is the meaning."""

from __future__ import annotations

from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from .html import strip_markup
from .numbers import digits_to_words

# What is replaced by what, in this order. The order is the meaning.
MARKS = ((",", ""), (":", "."), ("*", "."), (" .", "."))
MARKS_OF_FILES = ((",", " "), (":", " "), ("*", " "))
ENDS_OF_FILES = ((" .", "."),)
PARTS_OF_WORDS = (("-site", "site"), (" site", "site"), ("-life", "life"), (" life", "life"), (" s ", " "))


@F.pandas_udf(T.StringType())
def _strip_markup(texts: pd.Series) -> pd.Series:
    return texts.map(strip_markup, na_action="ignore")


@F.pandas_udf(T.StringType())
def _digits_to_words(texts: pd.Series) -> pd.Series:
    return texts.map(digits_to_words, na_action="ignore")


# Not that it were, but what is said to be not deterministic is not copied into filters and computed twice.
_strip_markup = _strip_markup.asNondeterministic()


def without_markup(text: Column) -> Column:
    """Text without html. Rows that need nothing reach Python as nulls."""
    needs = text.contains("&") | text.contains("<")
    return F.when(needs, _strip_markup(F.when(needs, text))).otherwise(text)


def spell_digits(text: Column) -> Column:
    """Digits as words; rows without digits reach Python as nulls."""
    needs = text.rlike(r"(?U)\d")
    return F.when(needs, _digits_to_words(F.when(needs, text))).otherwise(text)


def _head(text: Column, html: bool) -> Column:
    """Steps that all cleaners begin with: html, web addresses, single letters but a and i."""
    t = without_markup(text) if html else text
    t = F.regexp_replace(t, r"(?U)www\S+", " ")
    return F.regexp_replace(t, r"(?U)\b[b-hj-zA-Z]\b", " ")


def _no_digits(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\d+", " ")


def _ascii(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\x00-\x7F]", "")


def _collapse(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, r"(?U)\s+", " "))


def _replace(text: Column, *pairs: tuple[str, str]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def clean(text: Column, keep_num: bool = False, html: bool = True) -> Column:
    """Cleaning before extraction; white space is not collapsed."""
    t = _head(text, html)
    t = spell_digits(t) if keep_num else _no_digits(t)
    return _replace(_ascii(_replace(t, *MARKS)), *PARTS_OF_WORDS)


def clean_sample(text: Column, html: bool = True) -> Column:
    """Cleaning of sampled rows: no digits, white space collapsed, ASCII."""
    t = _collapse(_no_digits(_head(text, html)))
    return _ascii(_replace(t, *MARKS))


def clean_file(text: Column, abbreviations: Mapping[str, str] | None = None, html: bool = True) -> Column:
    """Cleaning of text files: letters, digits and sentence marks, abbreviations spelt out, lower case."""
    t = _replace(_no_digits(_head(text, html)), *MARKS_OF_FILES)
    t = _collapse(F.regexp_replace(_ascii(t), r"[^0-9a-zA-Z.?! ]+", " "))
    t = F.regexp_replace(_replace(t, *ENDS_OF_FILES), r"\.{2,}", ".")
    if abbreviations:
        known = F.create_map(*(F.lit(x) for pair in abbreviations.items() for x in pair))
        t = F.array_join(F.transform(F.split(t, " "), lambda x: F.coalesce(F.try_element_at(known, F.lower(x)), x)), " ")
    return F.lower(F.regexp_replace(t, r"(?<!\w)([A-Za-z])\.", "$1"))
