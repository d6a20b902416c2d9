"""Readers of sensor logs, feature windows and recordings, and the tables that index them."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strideframe.operators.ordered import sweep

LOG_COLUMNS = 24
# Fixed layout of the tab-separated logs: first column of each placement's three axes, and the label column.
LOG_PLACEMENTS = {"chest": 0, "leftAnkle": 5, "rightLowerArm": 14}
LOG_LABEL = 23
# Fixed column layout of the raw motion csv files.
RAW_SENSORS = ("LF", "LW", "ST", "RW", "RF")
RAW_STREAMS = (
    "Quat_W", "Quat_X", "Quat_Y", "Quat_Z", "dq_W", "dq_X", "dq_Y", "dq_Z", "dv[1]", "dv[2]", "dv[3]", "Mag_X", "Mag_Y", "Mag_Z",
)


def file_block() -> Column:
    """The part of a file that a row was read from; parts sort by file name and place."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with their 0-based number in the order of file names, the only key such files have.

    Lines are counted per file block, then numbered inside the block.
    """
    lines = spark.read.text(path).select(F.col("value").alias("line"), file_block().alias("block"), F.monotonically_increasing_id().alias("order"))
    return sweep(lines, [], ["order"], chunk="block", number="row").select("row", "line")


def checked(value: Column, holds: Column, message: str) -> Column:
    """The value, or an error where the layout rule does not hold."""
    return F.when(holds, value).otherwise(F.raise_error(F.lit(message)))


def read_matrix(spark: SparkSession, path: str, width: int) -> DataFrame:
    """Whitespace-separated numeric matrix, one row per line, every row ``width`` long."""
    cells = F.split(F.trim("line"), r"\s+").cast("array<double>")
    return numbered_lines(spark, path).select("row", checked(cells, F.size(cells) == width, f"expected {width} values in a row").alias("values"))


def read_column(spark: SparkSession, path: str, name: str) -> DataFrame:
    return numbered_lines(spark, path).select("row", F.trim("line").cast("bigint").alias(name))


def read_codes(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``code name`` as a dictionary table."""
    text = F.trim("value")
    return spark.read.text(path).select(
        F.substring_index(text, " ", 1).cast("int").alias("code"), F.trim(F.regexp_replace(text, r"^\S+\s", "")).alias("name")
    )


def align(matrix: DataFrame, *columns: DataFrame) -> DataFrame:
    """Join side files to the matrix by row; a row missing on any side is an error."""
    out = matrix.withColumn("__0", F.lit(True))
    present = F.col("__0")
    for i, side in enumerate(columns, start=1):
        out = out.join(side.withColumn(f"__{i}", F.lit(True)), "row", "full_outer")
        present = present & F.coalesce(F.col(f"__{i}"), F.lit(False))
    good = checked(F.col("row"), F.coalesce(present, F.lit(False)), "row counts differ between the files")
    return out.withColumn("row", good).drop(*[f"__{i}" for i in range(len(columns) + 1)])


def read_split(spark: SparkSession, matrix: str, subjects: str, labels: str, names: DataFrame, split: str, width: int = 561) -> DataFrame:
    """One split of pre-cut feature windows with subject, activity name and split name."""
    rows = align(read_matrix(spark, matrix, width), read_column(spark, subjects, "subject"), read_column(spark, labels, "code"))
    named = rows.join(names.withColumnRenamed("name", "Activity"), "code")
    return named.select("row", F.col("values").alias("features"), "subject", "Activity", F.lit(split).alias("Data"))


def combine_splits(*splits: DataFrame) -> DataFrame:
    out = splits[0]
    for more in splits[1:]:
        out = out.unionByName(more)
    return out


def rename_repeats(names: DataFrame, index: str, name: str) -> DataFrame:
    """Unique names: repeats get ``.1``, ``.2`` and so on, skipping a suffix that is already a name.

    The names are a dimension (one row per feature). A taken suffix is rare, so
    the first clash is moved on and the table checked again until none is left.
    """
    by_name = Window.partitionBy(name).orderBy(index)
    table = names.select(
        index,
        name,
        F.row_number().over(by_name).alias("occurrence"),
        F.count(F.lit(1)).over(Window.partitionBy(name)).alias("name_count"),
    ).withColumn("__suffix", (F.col("occurrence") - 1).cast("long"))

    def unique() -> Column:
        return F.when(F.col("__suffix") == 0, F.col(name)).otherwise(F.concat_ws(".", F.col(name), F.col("__suffix").cast("string")))

    table = table.withColumn("unique_name", unique())
    while True:
        clash = table.withColumn("__r", F.row_number().over(Window.partitionBy("unique_name").orderBy(index))).filter("__r > 1")
        first = clash.agg(F.min(index)).first()[0]
        if first is None:
            break
        table = table.withColumn("__suffix", F.col("__suffix") + (F.col(index) == first).cast("long")).withColumn("unique_name", unique())
    return table.select(index, name, "unique_name", "occurrence", "name_count", (F.col("unique_name") != F.col(name)).alias("renamed"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated sensor logs (one file or a glob): participant, frame, nine signals, label.

    The participant comes from the name of the file or of its folder, the frame
    from the line number in the participant's files. The column count is checked
    on every row.
    """
    lines = spark.read.text(path).select("value", file_block().alias("block"))
    cells = F.split("value", "\t")
    rows = lines.select("block", F.monotonically_increasing_id().alias("order"), checked(cells, F.size(cells) == LOG_COLUMNS, f"expected {LOG_COLUMNS} columns").alias("c"))
    subject = F.regexp_extract("block.file", r"subject=?(\d+)[^/]*(?:/[^/]*)?$", 1).cast("int")
    signals = [F.col("c")[first + i].cast("double").alias(f"{p}_{axis}") for p, first in LOG_PLACEMENTS.items() for i, axis in enumerate("xyz")]
    return rows.select(subject.alias("subject"), "block", "order", *signals, F.col("c")[LOG_LABEL].cast("int").alias("label"))


def number_log(log: DataFrame) -> DataFrame:
    """Frame numbers of ``read_log`` rows: counted per file block, then numbered inside the block."""
    return sweep(log.withColumnRenamed("block", "chunk"), ["subject"], ["order"], number="frame").drop("chunk", "order")


def raw_header(sensors: Sequence[str] = RAW_SENSORS) -> list[str]:
    return [f"{stream}_{sensor}" for sensor in sensors for stream in RAW_STREAMS] + ["SampleTimeFine", "activity"]


def read_raw_csv(spark: SparkSession, path: str, sensors: Sequence[str] = RAW_SENSORS) -> DataFrame:
    """Raw motion csv: header must match, an empty field is missing, only used columns are parsed."""
    fields = [T.StructField(c, T.DoubleType()) for c in raw_header(sensors)[:-2]]
    schema = T.StructType([*fields, T.StructField("SampleTimeFine", T.LongType()), T.StructField("activity", T.StringType())])
    rows = spark.read.csv(path, schema=schema, header=True, enforceSchema=False, nullValue="", mode="FAILFAST")
    kept = [c for c in raw_header(sensors)[:-2] if re.match(r"dq_|dv\[", c)]
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)\.csv$", 1)
    return rows.select(name.alias("recording"), *[F.col(f"`{c}`") for c in kept], "SampleTimeFine", "activity")


def convert_raw(rows: DataFrame, sensors: Sequence[str], period_seconds: Column) -> DataFrame:
    """Increments of every sensor turned into acceleration and angular rate, single precision."""
    from strideframe.functions.scalars import angular_rate

    out = []
    for s in sensors:
        out += [(F.col(f"`dv[{i}]_{s}`") / period_seconds).cast("float").alias(f"{s}_acc{axis}") for i, axis in zip((1, 2, 3), "XYZ")]
        rates = angular_rate(F.col(f"dq_W_{s}"), [F.col(f"dq_{axis}_{s}") for axis in "XYZ"], period_seconds)
        out += [rate.cast("float").alias(f"{s}_gyro{axis}") for rate, axis in zip(rates, "XYZ")]
    return rows.select("recording", F.col("SampleTimeFine").alias("t"), *out, F.col("activity").alias("label"))


def encode_labels(df: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """Codes 0.. in the sorted order of all labels, with the samples of each label."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("samples"))
    names = counts.withColumn("code", (F.row_number().over(Window.orderBy(label)) - 1).cast("long"))
    return df.join(names, label), names


def write_recordings(df: DataFrame, path: str, partition: str = "participant") -> None:
    df.write.mode("errorifexists").partitionBy(partition).parquet(path)


def read_recordings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def index_tables(df: DataFrame, recording: str, label: str, channels: dict[str, str]) -> dict[str, DataFrame]:
    """Recordings with their samples, labels with codes and samples, channels with units."""
    spark = df.sparkSession
    _, names = encode_labels(df, label)
    return {
        "recordingIndex": df.groupBy(recording).agg(F.count(F.lit(1)).alias("samples"), F.count_distinct(label).alias("labels")),
        "labelNames": names,
        "channelNames": spark.createDataFrame(list(channels.items()), "channel string, unit string"),
    }


def read_gestures(spark: SparkSession, path: str, channels: int = 15) -> DataFrame:
    """Gesture frames stored as (subject, frame, ch array, label), with the channel count checked."""
    rows = spark.read.parquet(path)
    return rows.withColumn("ch", checked(F.col("ch"), F.size("ch") == channels, f"expected {channels} channels"))
