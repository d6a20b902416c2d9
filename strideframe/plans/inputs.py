"""The driver tables in the roles of sensor tables, in Spark and (for the answers) in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strideframe.operators.ordered import add_chunk, sweep
from strideframe.operators.windows import sliding_members
from strideframe.plans.registry import table

WINDOW, STEP = 8, 4
KEYS = ["recording"]
ORDER = ["t", "event_id"]
FRAME_ORDER = ["t", "l_orderkey", "l_linenumber", "l_partkey"]


def load(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r6(value: Column, name: str) -> Column:
    return F.round(value, 6).alias(name)


def r9(value: Column, name: str) -> Column:
    return F.round(value, 9).alias(name)


def raw_samples(spark: SparkSession, d: str) -> DataFrame:
    """events as samples: recording = user, clock in microseconds, value in radians, label = type."""
    events = load(spark, d, "events").select(
        F.col("user_id").alias("recording"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("t"),
        "event_id",
        F.radians("value").alias("v"),
        F.col("event_type").alias("label"),
    )
    return add_chunk(events, KEYS, "t")


def samples(spark: SparkSession, d: str) -> DataFrame:
    """Samples with their position and the length of their recording."""
    return sweep(raw_samples(spark, d), KEYS, ORDER, number="pos", totals={"n": ("sum", F.lit(1))})


def gapped_samples(spark: SparkSession, d: str) -> DataFrame:
    """Samples where every eleventh event has lost its value."""
    return raw_samples(spark, d).withColumn("v", F.when(F.col("event_id") % 11 != 0, F.col("v")))


def windows(spark: SparkSession, d: str, size: int = WINDOW, step: int = STEP) -> DataFrame:
    return sliding_members(samples(spark, d), size, step)


def frames(spark: SparkSession, d: str, **totals: Column) -> DataFrame:
    """lineitem as three-channel frames of a recording per supplier; ``totals`` are sums over a recording, on its frames."""
    rows = load(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("recording"),
        F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("t"),
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.radians("l_quantity").alias("x"),
        F.radians(F.col("l_extendedprice") / 1000).alias("y"),
        F.radians(F.col("l_discount") * 100 + F.col("l_tax")).alias("z"),
        F.col("l_returnflag").alias("label"),
        (F.col("l_partkey") % 5 == 0).alias("filled"),
    )
    rows = add_chunk(rows, KEYS, "t")
    return sweep(rows, KEYS, FRAME_ORDER, number="pos", totals={"n": ("sum", F.lit(1)), **{name: ("sum", value) for name, value in totals.items()}})


def frame_windows(spark: SparkSession, d: str, size: int = WINDOW, step: int = STEP) -> DataFrame:
    return sliding_members(frames(spark, d), size, step)


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """embeddings as feature windows with a participant and an official split."""
    return load(spark, d, "embeddings").select(
        "vec_id",
        F.col("embedding").cast("array<double>").alias("features"),
        "label",
        (F.col("vec_id") % 8).alias("participant"),
        F.when(F.col("vec_id") % 4 == 0, "Test").otherwise("Train").alias("split"),
    )


def long_vectors(spark: SparkSession, d: str) -> DataFrame:
    return vectors(spark, d).select("vec_id", "label", "participant", "split", F.posexplode("features").alias("feature", "x"))


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """True label of every sample and, as its prediction, the label of the sample before."""
    return sweep(raw_samples(spark, d), KEYS, ORDER, number="pos", prev={"before": F.col("label")}).select(
        "recording", "t", "event_id", "pos", "chunk", F.col("label").alias("truth"), F.coalesce("before", "label").alias("guess")
    )


table(
    "raw",
    """SELECT user_id AS recording, epoch_us(ts) AS t, event_id, radians(value) AS v, event_type AS label FROM events""",
)
table(
    "ev",
    """SELECT *, row_number() OVER (PARTITION BY recording ORDER BY t, event_id) - 1 AS pos,
       count(*) OVER (PARTITION BY recording) AS n FROM raw""",
    "raw",
)
table("gap", "SELECT * REPLACE (CASE WHEN event_id % 11 <> 0 THEN v END AS v) FROM ev", "ev")


def members_sql(source: str, size: int, step: int, keys: str = "recording") -> str:
    return (
        f"SELECT *, unnest(range(greatest(0, (pos - {size} + {step}) // {step}), "
        f"least(pos // {step}, (n - {size}) // {step}) + 1)) AS win FROM {source} WHERE n >= {size}"
    )


table("win", members_sql("ev", WINDOW, STEP), "ev")
table("pr", "SELECT *, label AS truth, coalesce(lag(label) OVER (PARTITION BY recording ORDER BY t, event_id), label) AS guess FROM ev", "ev")
table(
    "fr",
    """SELECT *, row_number() OVER (PARTITION BY recording ORDER BY t, l_orderkey, l_linenumber, l_partkey) - 1 AS pos,
       count(*) OVER (PARTITION BY recording) AS n
       FROM (SELECT l_suppkey AS recording, epoch_us(l_shipdate) AS t, l_orderkey, l_linenumber, l_partkey,
             radians(l_quantity) AS x, radians(l_extendedprice / 1000) AS y, radians(l_discount * 100 + l_tax) AS z,
             l_returnflag AS label, l_partkey % 5 = 0 AS filled FROM lineitem)""",
)
table("fwin", members_sql("fr", WINDOW, STEP), "fr")
table(
    "fw",
    """SELECT vec_id, embedding::DOUBLE[] AS features, label, vec_id % 8 AS participant,
       CASE WHEN vec_id % 4 = 0 THEN 'Test' ELSE 'Train' END AS split FROM embeddings""",
)
table(
    "lv",
    """SELECT vec_id, label, participant, split, (i - 1)::INTEGER AS feature, features[i] AS x
       FROM (SELECT *, unnest(range(1, 65)) AS i FROM fw)""",
    "fw",
)
