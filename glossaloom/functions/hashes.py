"""Choosing rows by hash without bringing them together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

PART = 16
FEW = 10_000


def smallest(rows: DataFrame, h: Column, want: int, of: Column | None = None) -> Column:
    """True for the ``want`` rows of the smallest hash ``h`` (a long); rows of equal hash stand or fall together, so it may be fewer.

    It is told of ``of`` where ``rows`` are hashes that were computed before.

    The cut is found from counts of at most ``2**PART`` ranges of hashes, then
    of parts of the range in which it lies, until that holds ``FEW`` hashes. So
    no task or driver sees more than that, whatever the number of rows.
    """
    unsigned = lambda x: x.bitwiseXOR(F.lit(-(1 << 63)))  # noqa: E731  in the order of x
    u, of = unsigned(h), h if of is None else of
    held, shift, before = 0, 64 - PART, 0
    while True:
        part = F.shiftrightunsigned(u, shift).bitwiseAND(F.lit((1 << PART) - 1))
        within = F.lit(True) if shift == 64 - PART else F.shiftrightunsigned(u, shift + PART) == held
        counted = sorted(rows.where(within & h.isNotNull()).groupBy(part.alias("part")).count().collect())
        at = None
        for bucket, n in counted:
            if before + n > want:
                at = bucket, n
                break
            before += n
        if at is None:  # there are no more rows than wanted
            return of.isNotNull()
        held = held << PART | at[0]
        if at[1] <= FEW or shift == 0:
            break
        shift -= PART
    if before == want or shift == 0:
        return _below(unsigned(of), held, shift)
    within = F.shiftrightunsigned(u, shift) == held
    values = sorted(r[0] for r in rows.where(within & h.isNotNull()).select(h).collect())  # FEW at most
    left = want - before
    cut = values[left]  # rows below it, so that equal hashes stay together
    return of.isNotNull() & (of < F.lit(cut))


def _below(u: Column, prefix: int, shift: int) -> Column:
    """Hashes whose first bits are below a prefix."""
    if shift == 0:
        signed = (prefix ^ (1 << 63)) - (1 << 64) if (prefix ^ (1 << 63)) >= 1 << 63 else prefix ^ (1 << 63)
        return u.bitwiseXOR(F.lit(-(1 << 63))) < F.lit(signed)
    return F.shiftrightunsigned(u, shift) < F.lit(prefix)
