"""Number words: cardinals, years and amounts of money in English."""

from __future__ import annotations

import re
from decimal import Decimal

# English number names.
UNITS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "zero ten twenty thirty forty fifty sixty seventy eighty ninety".split()
SCALES = ["", "thousand", "million", "billion", "trillion", "quadrillion", "quintillion", "sextillion", "septillion", "octillion", "nonillion", "decillion"]


def _below_thousand(n: int) -> str:
    parts = []
    if n >= 100:
        parts.append(f"{UNITS[n // 100]} hundred")
        n %= 100
    if n >= 20:
        parts.append(TENS[n // 10] + (f"-{UNITS[n % 10]}" if n % 10 else ""))
    elif n:
        parts.append(UNITS[n])
    return " and ".join(parts)


def cardinal(n: int) -> str:
    """Words of a whole number."""
    if n < 0:
        return f"minus {cardinal(-n)}"
    if n < 1:
        return UNITS[0]
    if n >= 1000 ** len(SCALES):
        return " ".join(UNITS[int(c)] for c in str(n))
    groups = []
    scale = 0
    while n:
        if n % 1000:
            groups.append((n % 1000, scale))
        n //= 1000
        scale += 1
    words = [_below_thousand(g) + (f" {SCALES[s]}" if s else "") for g, s in reversed(groups)]
    if len(words) > 1 and groups[0][1] == 0 and groups[0][0] < 100:
        return f"{', '.join(words[:-1])} and {words[-1]}"
    return ", ".join(words)


def decimal(amount: Decimal) -> str:
    """Words of a decimal number; digits after the point one by one."""
    whole, _, fraction = format(amount, "f").partition(".")
    return " point ".join([cardinal(int(whole)), *([" ".join(UNITS[int(c)] for c in fraction)] if fraction else [])])


def year(n: int) -> str:
    """Words of a number of four digits, read as a year."""
    century, rest = divmod(n, 100)
    if century == 0 or century % 10 == 0 and rest < 10:
        return cardinal(n)
    if rest == 0:
        return f"{cardinal(century)} hundred"
    return f"{cardinal(century)} {'oh-' * (rest < 10)}{cardinal(rest)}"


def money(amount: Decimal) -> str:
    """Words of an amount in dollars and cents."""
    dollars, cents = divmod(int(amount * 100), 100)
    return f"{cardinal(dollars)} dollars, {cardinal(cents)} cent{'s' * (cents != 1)}"


#: What is read as one number: with commas before every three digits, with several points, or plain, and a dollar sign
#: before it. A comma elsewhere stands between two numbers, and a last point is none of a number's.
NUMERAL = re.compile(
    r"""(?P<sign>\$)?(?:(?P<grouped>\d{1,3}(?:,\d{3})+(?!\d))(?P<cents>\.\d+)?(?!\.?\d)|(?P<dotted>\d+(?:\.\d+){2,})|(?P<whole>\d*)(?P<point>\.\d+)|(?P<plain>\d+))"""
)
DIGITS = re.compile(r"\S*\d\S*")


def spelled(numeral: re.Match) -> str:
    """Words of a numeral, by the form in which it stands."""
    form = numeral.groupdict(default="")
    if form["dotted"]:
        return ".".join(cardinal(int(part)) for part in form["dotted"].split("."))
    whole, point = form["grouped"].replace(",", "") or form["whole"] or form["plain"], form["cents"] or form["point"]
    if form["sign"]:
        return money(Decimal(f"{whole or 0}{point}"))
    if point:
        return decimal(Decimal(f"{whole or 0}{point}"))
    return year(int(whole)) if len(form["plain"]) == 4 else cardinal(int(whole))


def digits_to_words(text: str | None) -> str | None:
    """Spell out the numbers of a text, and ``%`` beside them; white space collapses in texts that have any.

    ``1,200`` is one thousand, two hundred: commas that group three digits belong to the number.
    """
    if text is None or DIGITS.search(text) is None:
        return text
    return DIGITS.sub(lambda word: NUMERAL.sub(spelled, word[0]).replace("%", " percent"), " ".join(text.split()))
