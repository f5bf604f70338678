"""Connected components of a table of links, by large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .shared import written


def components(links: DataFrame) -> DataFrame:
    """(node, root): for every node of ``links`` (a, b) the smallest node that it reaches.

    Each round hangs the larger neighbours of a node, then the smaller ones, on
    the smallest it knows; minima are grouped sums and links are joined to them,
    so a node of many links is never gathered. Each round is written to the
    shared folder. It ends when the links are stars, which takes about as many
    rounds as the logarithm of the longest chain.
    """
    now = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while not _are_stars(now):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("m")), "least")
        large = written(both.where("b > a").join(least.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        least = written(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least.hint("merge"), "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        now = written(small.where("a <> b").distinct(), "links")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _are_stars(links: DataFrame) -> bool:
    """Every node either hangs on one other or has others hang on it."""
    ends = links.select(F.col("a").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(links.select(F.col("b").alias("v"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    met = ends.groupBy("v").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not met.where("up > 1 or up = 1 and down = 1").head(1)
