"""Names for columns that an operator adds for a while."""

from __future__ import annotations

from collections.abc import Iterable


def unused(names: Iterable[str], *wanted: str) -> list[str]:
    """``wanted`` as column names that do not clash with ``names``, whatever their case."""
    taken, out = {x.lower() for x in names}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
