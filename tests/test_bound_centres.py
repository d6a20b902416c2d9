"""Crossing rates about a centre that is itself an expression of the window."""

from pyspark.sql import functions as F

from strideframe.functions import arrays as A


def test_rate_about_the_mean(spark):
    rows = spark.createDataFrame([([1.0, 5.0, 1.0, 5.0],), ([2.0],)], "v array<double>")
    assert [r[0] for r in rows.select(A.crossing_rate(F.col("v"), A.mean(F.col("v")))).collect()] == [1.0, 0.0]
