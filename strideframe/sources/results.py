"""Result tables: Parquet by default, CSV with a fixed number format on request."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def fixed_format(df: DataFrame) -> DataFrame:
    """Every float as text with six decimals; a missing value stays missing."""
    def text(field: T.StructField):
        column = F.col(field.name)
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            return F.when(column.isNotNull(), F.format_string("%.6f", column)).alias(field.name)
        return column

    return df.select(*[text(field) for field in df.schema.fields])


def write_result(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    if fmt == "csv":
        fixed_format(df).write.mode("errorifexists").option("header", True).option("nullValue", "").csv(path)
    else:
        df.write.mode("errorifexists").parquet(path)


def read_result(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Only an empty cell is missing; the text NULL stays text."""
    reader = spark.read.option("header", True).option("nullValue", "")
    return reader.schema(schema).csv(path) if schema else reader.csv(path)
