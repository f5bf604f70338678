"""Features of a table of more distinct words than the old bound of 2**18."""

from pyspark.sql import functions as F

from glossaloom.ml.train import fit_features


def test_vocabulary_is_not_capped(spark):
    n = (1 << 18) + 1000
    rows = spark.range(n // 100 + 1).select(F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i: F.concat(F.lit("zz"), (F.col("id") * 100 + i).cast("string")))).alias("chunk"))
    model = fit_features(rows)
    assert len(model.stages[2].vocabulary) == 100 * (n // 100 + 1)
