"""Splits, folds and samples without leakage; every draw orders rows by a hash of their key."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideframe.functions.scalars import spread_order
from strideframe.operators.ranking import largest_remainder, rank_by_hash


def fill_lightest(loads: list[float], size: float, count: int) -> list[int]:
    """How many of ``count`` equal items each fold gets when each item goes to the lightest fold."""
    k = len(loads)
    low, high = min(loads), max(loads) + size * (count + 1)
    take = np.zeros(k, dtype=np.int64)
    base = np.array(loads, dtype=np.float64)
    for _ in range(200):
        level = (low + high) / 2
        wanted = np.maximum(0, np.ceil((level - base) / size)).astype(np.int64)
        if wanted.sum() <= count:
            low, take = level, wanted
        else:
            high = level
        if high - low <= size * 1e-9:
            break
    for _ in range(int(count - take.sum())):
        take[int(np.argmin(base + take * size))] += 1
    return take.tolist()


def group_folds(df: DataFrame, group: str, folds: int, strata: str | None = None, name: str = "fold") -> DataFrame:
    """Fold of every group: the largest group goes to the lightest fold.

    Groups of one size are interchangeable, so only the table of distinct sizes
    comes to the driver. Sizes add up to no more than the rows, so there are at
    most sqrt(2 x rows) of them per class: 1.4 million numbers for 10^12 rows.
    It returns how many
    groups of a size each fold takes, and groups are dealt out by their place
    within their size. With ``strata`` the loads are balanced per dominant class.
    """
    if strata is None:
        sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("__s")).withColumn("__k", F.lit("all"))
    else:
        cells = df.groupBy(group, strata).agg(F.count(F.lit(1)).alias("__n"))
        top = F.min(F.struct((-F.col("__n")).alias("a"), F.col(strata).alias("b")))
        sizes = cells.groupBy(group).agg(F.sum("__n").alias("__s"), top.alias("__t"))
        sizes = sizes.select(group, "__s", F.col("__t")["b"].cast("string").alias("__k"))
    spectrum = sizes.groupBy("__k", "__s").agg(F.count(F.lit(1)).alias("m"))
    rows = spectrum.orderBy("__k", F.col("__s").desc()).collect()
    edges, loads, everything, now = [], [0.0] * folds, [0.0] * folds, None
    for row in rows:
        if row["__k"] != now:
            # A new class starts level; the overall loads break its first ties.
            now, whole = row["__k"], sum(everything) + 1.0
            loads = [x / whole * 1e-6 for x in everything]
        taken = fill_lightest(loads, row["__s"], row["m"])
        loads = [a + t * row["__s"] for a, t in zip(loads, taken)]
        everything = [a + t * row["__s"] for a, t in zip(everything, taken)]
        edges.append((row["__k"], row["__s"], np.cumsum(taken).tolist()))
    plan = df.sparkSession.createDataFrame(edges, "__k string, __s bigint, __e array<bigint>")
    placed = rank_by_hash(sizes, ["__k", "__s"], F.pmod(F.xxhash64(group), F.lit(1 << 31)), group, "__p")
    dealt = placed.join(plan, ["__k", "__s"])
    return dealt.select(group, F.size(F.filter("__e", lambda e: e <= F.col("__p"))).cast("int").alias(name))


def stratified_folds(df: DataFrame, label: str, key: str, folds: int, seed: int = 42, name: str = "fold") -> DataFrame:
    """Shuffled folds that spread every class evenly: places in hash order, modulo the fold count."""
    placed = rank_by_hash(df, [label], spread_order(F.col(key), seed), key, "__p")
    return placed.withColumn(name, (F.col("__p") % folds).cast("int")).drop("__p")


def leave_one_out(df: DataFrame, who: str) -> DataFrame:
    """Fold table of leave-one-participant-out: test and training rows of every fold."""
    sizes = df.groupBy(F.col(who).alias("fold")).agg(F.count(F.lit(1)).alias("test_rows"))
    return sizes.withColumn("train_rows", F.sum("test_rows").over(Window.partitionBy()) - F.col("test_rows"))


def inner_participants(participants: DataFrame, who: str, every: int = 3) -> DataFrame:
    """Inner role of every remaining participant in each leave-one-out fold: each ``every``-th validates.

    Works on the participant table: removing the held-out one moves only the
    places after it, so the place is arithmetic on one numbering, not a re-sort
    per fold.
    """
    numbered = participants.select(who).distinct().withColumn("__p", F.row_number().over(Window.orderBy(who)) - 1)
    held = numbered.select(F.col(who).alias("fold"), F.col("__p").alias("__h"))
    pairs = numbered.join(held, F.col(who) != F.col("fold"))
    place = F.col("__p") - (F.col("__p") > F.col("__h")).cast("int")
    return pairs.select("fold", who, F.when(place % every == 0, "valid").otherwise("train").alias("role"))


def stratified_split(df: DataFrame, label: str, key: str, test_rows: Column, seed: int = 42, name: str = "split") -> DataFrame:
    """Random split with an exact number of test rows, spread over classes by largest remainder."""
    strata = df.groupBy(label).agg(F.count(F.lit(1)).alias("__size"))
    quotas = largest_remainder(strata, "__size", test_rows, label, "__q").select(label, "__q")
    placed = rank_by_hash(df, [label], spread_order(F.col(key), seed), key, "__p").join(quotas, label)
    return placed.withColumn(name, F.when(F.col("__p") < F.col("__q"), "Test").otherwise("Train")).drop("__p", "__q")


def subsample(df: DataFrame, keys: Sequence[str], key: str, share: float, seed: int = 42) -> DataFrame:
    """A fixed share of every (participant, class) group, at least one row, half to even."""
    sizes = df.groupBy(*keys).agg(F.greatest(F.lit(1), F.rint(F.lit(share) * F.count(F.lit(1)))).cast("long").alias("__q"))
    placed = rank_by_hash(df, keys, spread_order(F.col(key), seed), key, "__p").join(sizes, list(keys))
    return placed.filter(F.col("__p") < F.col("__q")).drop("__p", "__q")


def cap_rows(df: DataFrame, label: str, key: str, limit: int, seed: int = 42) -> DataFrame:
    """Exactly ``limit`` rows (all when there are fewer), classes in proportion by largest remainder."""
    strata = df.groupBy(label).agg(F.count(F.lit(1)).alias("__size"))
    total = F.least(F.lit(limit).cast("long"), strata.agg(F.sum("__size")).scalar())
    quotas = largest_remainder(strata, "__size", total, label, "__q").select(label, "__q")
    placed = rank_by_hash(df, [label], spread_order(F.col(key), seed), key, "__p").join(quotas, label)
    return placed.filter(F.col("__p") < F.col("__q")).drop("__p", "__q")


def repetition_rounds(blocks: DataFrame, who: str, block: str) -> DataFrame:
    """One round per held-out repetition of a participant: (scheme, test, train, block)."""
    pairs = blocks.select(who, block).distinct()
    return pairs.select(F.lit("personDependent").alias("scheme"), F.col(who).alias("test"), F.col(who).alias("train"), F.col(block).alias("block"))


def cross_rounds(participants: DataFrame, who: str) -> DataFrame:
    """One round per ordered pair of different participants, no block held out."""
    people = participants.select(who).distinct()
    other = people.select(F.col(who).alias("train"))
    pairs = people.select(F.col(who).alias("test")).join(other, F.col("test") != F.col("train"))
    return pairs.select(F.lit("personIndependent").alias("scheme"), "test", "train", F.lit(None).cast("long").alias("block"))


def round_windows(windows: DataFrame, who: str, block: str, win: str, size: int, step: int) -> DataFrame:
    """Test and purged windows of every held-out repetition; every other window of the participant trains.

    The span of a held-out block is turned into the window numbers it touches, so
    windows meet only the rounds they are kept out of: an equi-join whose output
    grows with the windows, not with windows times rounds.
    """
    spans = windows.groupBy(who, F.col(block).alias("held")).agg((F.min(win) * step).alias("__a"), (F.max(win) * step + size).alias("__b"))
    first = F.greatest(F.lit(0), F.floor((F.col("__a") - size) / step) + 1).cast("long")
    last = (F.ceil(F.col("__b") / step) - 1).cast("long")
    touched = spans.select(who, "held", F.explode(F.sequence(first, last)).alias(win))
    role = F.when(F.col(block) == F.col("held"), "test").otherwise("purged")
    return windows.join(touched, [who, win]).withColumn("role", role)


def round_sizes(windows: DataFrame, roles: DataFrame, who: str) -> DataFrame:
    """Test, purged and training windows of every round, from counts alone."""
    sizes = windows.groupBy(who).agg(F.count(F.lit(1)).alias("__n"))
    kept_out = roles.groupBy(who, "held").agg(F.count_if(F.col("role") == "test").alias("test"), F.count_if(F.col("role") == "purged").alias("purged"))
    return kept_out.join(sizes, who).select(who, "held", "test", "purged", (F.col("__n") - F.col("test") - F.col("purged")).alias("train"))
