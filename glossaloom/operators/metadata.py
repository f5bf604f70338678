"""Ids for files, common columns, and changes between tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.names import unused


def metadata_ids(files: DataFrame, *, directory: str = "dir", path: str = "filename") -> DataFrame:
    """(id, filename): ``{dir}_{i}``, counted from 0 by path in each directory."""
    place = F.row_number().over(W.partitionBy(directory).orderBy(path)) - 1
    return files.select(F.concat_ws("_", F.col(directory), place.cast("string")).alias("id"), F.col(path).alias("filename"))


def common_columns(tables: Sequence[DataFrame]) -> list[str]:
    """Columns that all tables have, in the order of the first."""
    shared = set.intersection(*(set(t.columns) for t in tables)) if tables else set()
    return [c for c in (tables[0].columns if tables else []) if c in shared]


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows that were taken away or added, with ``change``."""
    gone, new = before.exceptAll(after), after.exceptAll(before)
    return gone.withColumn("change", F.lit("removed")).unionByName(new.withColumn("change", F.lit("added")))


def cell_changes(before: DataFrame, after: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, nth, column, old, new, change) of the cells that differ between two states of a table, values as text.

    ``change`` is changed, added or removed; rows of one side only have a line for each of their columns. Of several
    rows with one key the nth of one side, in the order of their values, is held against the nth of the other. Null
    keys are equal. Columns that one side lacks are null there.
    """
    columns = [c for c in dict.fromkeys([*before.columns, *after.columns]) if c not in key]
    nth, old, new = unused([*key, *columns], "nth", "old", "new")

    def side(rows: DataFrame, as_: str) -> DataFrame:
        rows = rows.select(*key, *((F.col(c) if c in rows.columns else F.lit(None)).cast("string").alias(c) for c in columns))
        place = F.row_number().over(W.partitionBy(*key).orderBy(*columns)) if columns else F.row_number().over(W.partitionBy(*key).orderBy(F.lit(0)))
        rows = rows.withColumn(nth, place)
        return rows.select(F.struct(*key, nth).alias(f"k{as_}"), F.struct(F.lit(True).alias("there"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(columns))).alias(as_))

    met = side(before, old).join(side(after, new), F.col(f"k{old}").eqNullSafe(F.col(f"k{new}")), "full")
    gone, come = F.col(new).isNull(), F.col(old).isNull()
    cell = lambda s, i: F.col(s).getField(f"c{i}")
    change = F.when(gone, "removed").when(come, "added").otherwise("changed")
    each = F.array(*(F.struct(F.lit(c).alias("column"), cell(old, i).alias("old"), cell(new, i).alias("new"), change.alias("change")) for i, c in enumerate(columns)))
    rows = met.select(F.coalesce(f"k{old}", f"k{new}").alias("k"), F.explode(F.filter(each, lambda x: (x["change"] != "changed") | ~x["old"].eqNullSafe(x["new"]))).alias("x"))
    return rows.select(*(F.col("k").getField(c).alias(c) for c in key), F.col("k").getField(nth).alias("nth"), "x.column", "x.old", "x.new", "x.change")


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(name, rows) of several tables."""
    return reduce(DataFrame.unionByName, (t.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows") for name, t in tables.items()))


def new_rule_file(keywords: DataFrame, tags: Sequence[str]) -> DataFrame:
    """(rule, prio, tags) of a table (tag, keyword): the distinct keywords of the tags, all 0."""
    chosen = keywords.where(F.col("tag").isin(list(tags))).select(F.col("keyword").alias("rule")).distinct()
    return chosen.select("rule", F.lit(0).alias("prio"), *(F.lit(0).alias(t) for t in tags))
