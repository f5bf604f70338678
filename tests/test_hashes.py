"""Choosing rows by hash."""

import pytest
from pyspark.sql import functions as F

from glossaloom.functions import hashes


@pytest.mark.parametrize("few", [10_000, 3])
@pytest.mark.parametrize("want", [0, 1, 17, 999, 1000, 5000])
def test_smallest(spark, monkeypatch, few, want):
    monkeypatch.setattr(hashes, "FEW", few)
    rows = spark.range(1000)
    h = F.xxhash64("id")
    found = {r.id for r in rows.where(hashes.smallest(rows, h, want)).collect()}
    by = sorted((r.h, r.id) for r in rows.select("id", h.alias("h")).collect())
    assert found == {i for _, i in by[:want]}


def test_smallest_of_equal_hashes(spark):
    rows = spark.createDataFrame([(5, i) for i in range(20)] + [(-3, 100), (None, 101)], "h long, i long")
    assert {r.i for r in rows.where(hashes.smallest(rows, F.col("h"), 10)).collect()} == {100}
    assert rows.where(hashes.smallest(rows, F.col("h"), 21)).count() == 21
    hashes_few, hashes.FEW = hashes.FEW, 2
    try:
        assert {r.i for r in rows.where(hashes.smallest(rows, F.col("h"), 10)).collect()} == {100}
    finally:
        hashes.FEW = hashes_few
