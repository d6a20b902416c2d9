"""What several operators need: tables, names that do not clash, tables kept in the shared folder."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideframe.session import scratch_path


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def whole_text(column: str = "text"):
    """The text as a string; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the cluster's shared folder and read it back.

    Later jobs read it instead of computing it again, and a lost executor
    takes nothing of it away.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(*frames: DataFrame) -> str:
    """A prefix that starts no column of these tables."""
    used = [c.lower() for f in frames for c in f.columns]
    while True:
        prefix = f"z{uuid4().hex[:8]}_"
        if not any(c.startswith(prefix) for c in used):
            return prefix
