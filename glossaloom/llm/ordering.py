"""Places of rows in an order of all rows, found without bringing a group together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from .shared import unused, written


def numbered(rows: DataFrame, group: str, order: Sequence[str], place: str = "place", total: str = "total") -> DataFrame:
    """``rows`` with their place (from 0) in their group, and the group's number of rows.

    Rows are dealt out by ranges of (group, order) and sorted in each range, so
    a large group lies in several tasks. Only the numbers of rows of each range
    and group are brought together: as many as there are tasks and groups. The
    sorted rows are written, so places do not depend on a second sorting. Rows
    that are equal in ``group`` and ``order`` get places in any order. The group
    must not be null; nulls of ``order`` come first. ``rows`` are read twice.
    """
    at, part, first, n, before = unused([*rows.columns, place, total], "at", "part", "first", "n", "before")
    cut = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn(at, F.monotonically_increasing_id())
    cut = written(cut, "sorted").withColumn(part, F.shiftright(at, 33))
    heads = cut.groupBy(group, part).agg(F.min(at).alias(first), F.count(F.lit(1)).alias(n))
    of = Window.partitionBy(group)
    earlier = of.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.withColumn(before, F.coalesce(F.sum(n).over(earlier), F.lit(0))).withColumn(total, F.sum(n).over(of))
    found = cut.join(heads, [group, part]).withColumn(place, F.col(at) - F.col(first) + F.col(before))
    return found.select(*rows.columns, place, total)
