"""Ranks inside groups of any size, and quotas of strata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideframe.operators.ordered import add_chunk, add_value_chunk, chunk_rows, meet, stamped, sweep


def rank_rows(df: DataFrame, keys: Sequence[str], score: Column, tie: str, place: str = "place", average: str | None = None) -> DataFrame:
    """0-based place by descending score, the lower tie key first; optionally the average rank of ties (from 1).

    Distinct scores are counted and summed in chunks of the score range; rows of
    one score are numbered in chunks of the tie key. Neither a hot group nor a
    score shared by most of its rows ends up in one task. ``tie`` must be a
    whole number. Null scores come last, as ties.
    """
    rows = df.withColumn("__neg", (-score).cast("double"))
    counted = rows.groupBy(*keys, "__neg").agg(F.count(F.lit(1)).alias("__ties"))
    ranked = sweep(
        add_value_chunk(counted, keys, "__neg", "__vc"), keys, ["__neg"], chunk="__vc", sums={"__upto": F.col("__ties")}
    ).select(*keys, "__neg", "__ties", (F.col("__upto") - F.col("__ties")).alias("__before"))
    on = [*keys, "__neg"]
    placed = meet(stamped(rows, on), stamped(ranked, on), on).drop("__edge")
    placed = placed.withColumn("__tc", F.coalesce(F.floor(F.col(tie) / chunk_rows(df)).cast("long"), F.lit(-(1 << 62))))
    out = sweep(placed, [*keys, "__neg"], [tie], chunk="__tc", number="__within")
    extra = [] if average is None else [(F.col("__before") + (F.col("__ties") + 1) / 2).alias(average)]
    return out.select(*df.columns, (F.col("__before") + F.col("__within")).cast("long").alias(place), *extra)


def rank_by_hash(df: DataFrame, keys: Sequence[str], mixed: Column, tie: str, place: str = "place") -> DataFrame:
    """0-based place by a spread-out hash: chunks of the hash range are even by construction."""
    rows = add_chunk(df.withColumn("__h", mixed), keys, "__h", "__hc")
    return sweep(rows, keys, ["__h", tie], chunk="__hc", number=place).drop("__h", "__hc")


def largest_remainder(strata: DataFrame, size: str, total: Column, order: str, name: str = "quota") -> DataFrame:
    """Quotas that add up to ``total``: floors first, then the largest remainders (ties by ``order``).

    ``strata`` holds one row per stratum.
    """
    whole = Window.partitionBy()
    exact = total * F.col(size) / F.sum(size).over(whole)
    table = strata.withColumn("__e", exact).withColumn("__f", F.floor("__e"))
    left = total - F.sum("__f").over(whole)
    seat = F.row_number().over(Window.orderBy((F.col("__e") - F.col("__f")).desc(), order))
    return table.withColumn("__left", left).withColumn("__seat", seat).select(
        *strata.columns, (F.col("__f") + (F.col("__seat") <= F.col("__left")).cast("long")).cast("long").alias(name)
    )
