"""Principal axes next to the best features, without the learners' solver."""

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from strideframe.operators import prep


def test_axes_are_those_of_the_covariance_and_a_flat_column_is_no_fault(spark):
    rng = np.random.default_rng(3)
    x = np.c_[rng.normal(size=(60, 4)) * [5, 3, 1, 0.5], np.full(60, 2.0)]
    rows = spark.createDataFrame([(float(i % 3), r.tolist()) for i, r in enumerate(x)], "label double, features array<double>")
    axes = prep.principal_axes(rows, 2)
    _, _, vt = np.linalg.svd(x - x.mean(axis=0))
    assert np.allclose(np.abs(axes.T @ vt[:2].T), np.eye(2), atol=1e-8)
    rows = rows.withColumn("features", F.slice("features", 1, 4))
    train, _ = prep.joined_blocks(rows, rows, "label", 2)
    got = np.array(train.select(vector_to_array("vector").alias("v")).toPandas()["v"].tolist())
    assert got.shape == (60, 4) and np.allclose(np.abs(got[:, :2]), np.abs(x @ axes))
