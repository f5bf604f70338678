"""The final dataset: classified extracts joined to metadata and stored."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

#: Column types of the final table.
TYPES = {"INTEGER": "bigint", "REAL": "double", "TEXT": "string"}


def read_metadata_names(metadata: DataFrame, id: str, to: str = "id") -> DataFrame:
    """Metadata with lower-case names and the id renamed."""
    return metadata.withColumnsRenamed({c: to if c == id else c.lower() for c in metadata.columns})


def join_metadata(metadata: DataFrame, tagged: DataFrame, tags: Sequence[str], *, id: str = "id") -> DataFrame:
    """All metadata rows with the tags of their id; 0 where there is no extract."""
    return metadata.join(tagged.select(id, *tags), id, "left").fillna(0, list(tags)).withColumns({t: F.col(t).cast("int") for t in tags})


def not_stored(rows: DataFrame, stored: DataFrame, *, id: str = "id") -> DataFrame:
    """Rows whose id is not in the stored table."""
    return rows.join(stored.select(id), id, "left_anti")


def keep_first(rows: DataFrame, order: Sequence[str], *, id: str = "id") -> DataFrame:
    """The first row of each id."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(id).orderBy(*order))).where("_n = 1").drop("_n")


def cast_columns(rows: DataFrame, types: Mapping[str, str], tags: Sequence[str]) -> DataFrame:
    """Columns in their declared types INTEGER, REAL or TEXT; what does not parse is null. Tags are whole numbers."""
    typed = [F.expr(f"try_cast(`{c}` as {TYPES[kind]})").alias(c) for c, kind in types.items()]
    return rows.select(*typed, *(F.coalesce(F.col(t).cast("int"), F.lit(0)).alias(t.lower()) for t in tags))


def create_dataset(metadata: DataFrame | None, tagged: DataFrame, tags: Sequence[str], types: Mapping[str, str], *, id: str = "id", stored: DataFrame | None = None, order: Sequence[str] | None = None) -> DataFrame:
    """Classified rows with their metadata, one for each id, without ids that are stored already."""
    tagged = keep_first(tagged, list(order or [c for c in tagged.columns if c != id]), id=id)
    rows = tagged if metadata is None else join_metadata(metadata, tagged, tags, id=id)
    if metadata is not None:
        rows = keep_first(rows, [c for c in metadata.columns if c != id] or [id], id=id)
    if stored is not None:
        rows = not_stored(rows, stored, id=id)
    return cast_columns(rows, types, tags)
