"""Session settings and the places where a plan is cut."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(name: str = "strideframe", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{k.replace("_", "."): v for k, v in extra.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def settle(df: DataFrame) -> DataFrame:
    """Cut the plan with a reliable checkpoint in the cluster's shared folder.

    The folder is the one named by ``spark.checkpoint.dir``; only a session
    without one (a test on one machine) gets a temporary folder.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="strideframe-"))
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder below the cluster's shared folder (a temporary one in a local session)."""
    from uuid import uuid4

    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="strideframe-"))
    return f"{context.getCheckpointDir()}/{name}-{uuid4().hex}"


def stored(df: DataFrame, name: str = "table", by: Sequence[str] = ()) -> DataFrame:
    """The table written into the shared folder (a part for each value of ``by``) and read back.

    Unlike a checkpoint it is planned by its real size, which matters in loops:
    estimates that grow with every join soon have more digits than fit anywhere.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
