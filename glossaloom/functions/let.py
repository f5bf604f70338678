"""Values that are computed once."""

import json
from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def let(value: Column, body) -> Column:
    """``body`` of ``value``. The optimiser may copy an expression wherever its column is used, also into
    the lambda of a higher-order function; a lambda's variable is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(value: Column) -> Column:
    """``value``, computed where it stands only: the optimiser moves no filter on it below, where it would be computed again."""
    return F.when(F.spark_partition_id() >= 0, value)


def constant(values: Sequence, kind: str) -> Column:
    """An array of a SQL type, as one literal however many values there are; structs are given as dictionaries."""
    return F.from_json(F.lit(json.dumps(list(values))), f"array<{kind}>")
