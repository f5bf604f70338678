"""Goldens of the text functions."""

import pytest
from pyspark.sql import functions as F

from glossaloom.functions.clean import clean, clean_file, clean_sample
from glossaloom.functions.html import strip_markup
from glossaloom.functions.numbers import cardinal, digits_to_words
from glossaloom.functions.tokens import add_qualifiers, contexts, key_index, sentence_tokens, trim_to_keyword, trim_words, word_tokens


def value(spark, text, expression):
    return spark.createDataFrame([(text,)], "t string").select(expression(F.col("t")).alias("v")).first().v


@pytest.mark.parametrize(
    "text, cleaned",
    [
        ("A b www.x.com 12 cats, dogs: on site", " " * 8 + "cats dogs. onsite"),
        ("b i I a A", "  i   a  "),
        ("café résumé", "caf rsum"),
        ("fish &amp; chips <b>now</b>", "fish & chips now"),
        ("one٣two", "one two"),
        ("it s me", "it   me"),
        (None, None),
        ("", ""),
    ],
)
def test_clean(spark, text, cleaned):
    assert value(spark, text, clean) == cleaned


def test_clean_variants(spark):
    assert value(spark, "  A  2 cats , and: dogs * x ", clean_sample) == "cats  and. dogs."
    assert value(spark, "The U.S. team (2 of 3): Dr. X won!! ...", lambda t: clean_file(t, {"dr.": "doctor"})) == "the. team of doctor won!!."
    assert value(spark, "in 1999", lambda t: clean(t, keep_num=True)) == "in nineteen ninety-nine"


@pytest.mark.parametrize(
    "piece, words",
    [("5", "five"), ("12", "twelve"), ("101", "one hundred and one"), ("12345", "twelve thousand, three hundred and forty-five"), ("1999", "nineteen ninety-nine"), ("2005", "two thousand and five"), ("1900", "nineteen hundred"), ("1905", "nineteen oh-five"), ("3.25", "three point two five"), ("1.2.3", "one.two.three"), ("$5.50", "five dollars, fifty cents"), ("$1,200", "one thousand, two hundred dollars, zero cents")],
)
def test_numerals(piece, words):
    assert digits_to_words(piece) == words


@pytest.mark.parametrize(
    "text, words",
    [
        ("1,200 people", "one thousand, two hundred people"),
        ("1,234,567", "one million, two hundred and thirty-four thousand, five hundred and sixty-seven"),
        ("1,200.5 km", "one thousand, two hundred point five km"),
        ("3,5 or 1,2345", "three,five or one,twenty-three forty-five"),
        ("1-11", "one-eleven"),
        ("about 5.", "about five."),
        (".5% off", "zero point five percent off"),
        ("$1,200.50 (2 of 3)", "one thousand, two hundred dollars, fifty cents (two of three)"),
        ("$.01", "zero dollars, one cent"),
        ("10.0.0.1", "ten.zero.zero.one"),
        ("x1y22z", "xoneytwenty-twoz"),
        ("٣ and 0007", "three and seven"),
    ],
)
def test_numbers_in_texts(text, words):
    assert digits_to_words(text) == words


def test_digits():
    assert digits_to_words("no digits  here") == "no digits  here"
    assert digits_to_words("10% of  2 cats") == "ten percent of two cats"
    assert digits_to_words(None) is None
    assert cardinal(1_000_005) == "one million and five" and cardinal(-3) == "minus three"


def test_markup():
    assert strip_markup(" a &lt;b&gt;c ") == "a c"
    assert strip_markup("x<script>var t</script><p>y") == "xy"


@pytest.mark.parametrize(
    "text, keys, n, chunks",
    [
        ("the slow cooker ran for one hour today", ["hour"], 2, ["for one hour today"]),
        ("slow slow roast", ["slow"], 1, ["slow slow", "slow slow roast"]),
        ("an hourly rate", ["hour"], 0, ["hourly"]),
        ("a slow cooker", ["slow cooker"], 3, []),
        ("", ["x"], 1, []),
    ],
)
def test_word_contexts(spark, text, keys, n, chunks):
    assert value(spark, text, lambda t: contexts(word_tokens(t), keys, n)) == chunks


def test_sentence_contexts(spark):
    text = "first one. hour two! third?"
    assert value(spark, text, lambda t: contexts(sentence_tokens(t), ["hour"], 1)) == ["first one hour two third"]
    assert value(spark, text, lambda t: contexts(sentence_tokens(t), ["hour"], 2)) == ["first one hour two third "]
    with pytest.raises(ValueError):
        contexts(F.array(), ["x"], 21)


def test_trimming(spark):
    assert value(spark, "a b c d e f g", lambda t: trim_words(t, 2)) == "b c d e f"
    assert value(spark, "a b", lambda t: trim_words(t, 0)) == "b"
    words = lambda t: F.split(t, " ")
    assert value(spark, "k a a a a k a a a k", lambda t: key_index(words(t), ["k"])) == 5
    assert value(spark, "a a a a", lambda t: key_index(words(t), ["k"])) == 2
    assert value(spark, "not a very good day", lambda t: F.array_join(add_qualifiers(words(t), ["very", "not"]), " ")) == "not not_very_a very not_very_good not_very_day"
    assert value(spark, "w0 keepme w2 w3 w4 w5 key w7 w8 w9", lambda t: trim_to_keyword(t, ["key"], keep=["keepme"], stop=["w2"])) == "keepme w4 w5 key w7 w8"
