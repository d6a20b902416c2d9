"""Windows of samples: membership, labels, frame mapping.

Membership is an ``explode`` of the window numbers a row belongs to, so no range
join is needed, and every window is a small group of its own.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seconds_to_samples(seconds: float, rate: float) -> int:
    """Window length in samples: half-even rounding, at least one."""
    return max(1, round(seconds * rate))


def check_sizes(size: int, step: int) -> None:
    if size < 1 or step < 1:
        raise ValueError(f"Invalid window of {size} frames with step {step}")


def sliding_members(df: DataFrame, size: int, step: int, pos: str = "pos", n: str = "n", name: str = "win") -> DataFrame:
    """One row per (window, sample); windows start every ``step`` and only whole ones exist."""
    check_sizes(size, step)
    low = F.greatest(F.lit(0), F.ceil((F.col(pos) - size + 1) / step).cast("long"))
    high = F.least(F.floor(F.col(pos) / step), F.floor((F.col(n) - size) / step)).cast("long")
    whole = df.filter(F.col(n) >= size).withColumn("__lo", low).withColumn("__hi", high)
    return (
        whole.filter(F.col("__lo") <= F.col("__hi"))
        .withColumn(name, F.explode(F.sequence("__lo", "__hi")))
        .drop("__lo", "__hi")
    )


def tumbling_members(df: DataFrame, size: int, pos: str = "pos", n: str = "n", name: str = "win") -> DataFrame:
    """Back-to-back windows of ``size`` samples; the tail that fills no window is dropped."""
    check_sizes(size, size)
    return df.withColumn(name, F.floor(F.col(pos) / size).cast("long")).filter((F.col(name) + 1) * size <= F.col(n))


def majority_labels(
    members: DataFrame, keys: Sequence[str], label: str = "label", centre: Column | None = None
) -> DataFrame:
    """Most frequent label per window.

    A tie goes to the label of the centre sample when that one is tied (if
    ``centre`` marks it), else to the lowest label.
    """
    is_centre = F.lit(0) if centre is None else F.max(centre.cast("int"))
    counts = members.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("__n"), is_centre.alias("__c"))
    rank = F.struct((-F.col("__n")).alias("a"), (-F.col("__c")).alias("b"), F.col(label).alias("v"))
    return counts.groupBy(*keys).agg(F.min(rank).alias("__best")).select(*keys, F.col("__best")["v"].alias(label))


def gather(members: DataFrame, keys: Sequence[str], columns: Sequence[str], pos: str = "pos") -> DataFrame:
    """Samples of every window as arrays in time order."""
    # sort_array orders like array_sort, without a comparison function called per pair
    rows = F.sort_array(F.collect_list(F.struct(F.col(pos), *[F.col(c) for c in columns])))
    packed = members.groupBy(*keys).agg(rows.alias("__rows"))

    def field(name: str) -> Column:
        return F.transform("__rows", lambda r: r[name]).alias(name)

    return packed.select(*keys, *[field(c) for c in columns])


def sliding_arrays(df: DataFrame, keys: Sequence[str], columns: Sequence[str], size: int, step: int, pos: str = "pos", n: str = "n", name: str = "win", extra: DataFrame | None = None) -> DataFrame:
    """``gather`` of ``sliding_members`` for positions without gaps: one row per window with its samples as arrays.

    A sample is shuffled with the stretch of 64 windows that start in it (and
    with the stretches before, where their last windows reach it) instead of
    once per window; windows are slices of the stretch's arrays. A stretch holds
    64 steps and a window, however long the series is. ``extra`` (keys and
    further columns) is dealt out over the stretches and joins those.
    """
    check_sizes(size, step)
    long = 64 * step
    last = F.floor((F.col(n) - size) / step).cast("long")
    home = F.floor(F.col(pos) / long).cast("long")
    first = F.greatest(F.lit(0), F.ceil((F.col(pos) - size + 1) / step).cast("long"))
    spread = F.sequence(F.least(home, F.floor(first / 64).cast("long")), F.least(home, F.floor(last / 64).cast("long")))
    whole = df.filter(F.col(n) >= size)
    # a sample beyond its last window (or between windows) goes with none
    touched = whole.filter(first <= F.least(F.floor(F.col(pos) / step), last))
    rows = touched.select(*keys, n, pos, *columns, F.explode(spread).alias("__stretch"))
    held = F.sort_array(F.collect_list(F.struct(pos, *columns)))
    packed = rows.groupBy(*keys, "__stretch").agg(F.max(n).alias("__n"), held.alias("__rows"))

    def field(name: str) -> Column:
        return F.transform("__rows", lambda r: r[name]).alias(name)

    packed = packed.select(*keys, "__stretch", "__n", *[field(c) for c in columns])
    more = []
    if extra is not None:
        more = [c for c in extra.columns if c not in keys]
        ends = whole.groupBy(*keys).agg(F.max(F.floor(last / 64).cast("long")).alias("__end"))
        dealt = ends.join(extra, list(keys)).withColumn("__stretch", F.explode(F.sequence(F.lit(0).cast("long"), "__end"))).drop("__end")
        packed = packed.join(dealt, [*keys, "__stretch"], "left")
    upto = F.least(F.col("__stretch") * 64 + 63, F.floor((F.col("__n") - size) / step).cast("long"))
    windows = packed.withColumn(name, F.explode(F.sequence(F.col("__stretch") * 64, upto)))
    # a step longer than the window leaves samples out, so a slice starts where its first position stands
    at = F.col(name) * step - F.col("__stretch") * long + 1 if step <= size else (F.col(name) - F.col("__stretch") * 64) * size + 1
    return windows.select(*keys, name, *more, *[F.slice(c, at.cast("int"), F.lit(size)).alias(c) for c in columns])


def majority_of(labels: Column, centre: int) -> Column:
    """The rule of ``majority_labels`` for the codes of a window in one array; ``centre`` is the place of the centre sample."""
    middle = F.get(labels, F.lit(centre))

    def rank(v: Column) -> Column:
        alike = F.filter(labels, lambda x: x.eqNullSafe(v))
        return F.struct((-F.size(alike)).alias("a"), (-middle.eqNullSafe(v).cast("int")).alias("b"), v.alias("v"))

    @F.arrow_udf("long")
    def most(windows: pa.Array) -> pa.Array:
        lengths = pc.fill_null(pc.list_value_length(windows), 0).to_numpy(zero_copy_only=False)
        codes, size = windows.flatten(), int(lengths.max(initial=0))
        if codes.null_count or size <= centre or (lengths != size).any():
            return pa.nulls(len(windows), pa.int64())
        m = codes.to_numpy(zero_copy_only=False).reshape(-1, size)
        score = np.zeros(m.shape, dtype=np.int32)
        for i in range(size):
            score += 2 * (m == m[:, i : i + 1])
        score += m == m[:, centre : centre + 1]
        found = np.where(score == score.max(axis=1, keepdims=True), m, np.iinfo(np.int64).max).min(axis=1)
        return pa.array(found)

    # batches with null codes or uneven windows go through the array expressions
    return F.coalesce(most(labels.cast("array<long>")), F.array_min(F.transform(F.array_distinct(labels), rank))["v"])


def covered_frames(members: DataFrame, kept: DataFrame, keys: Sequence[str], pos: str = "pos", name: str = "win") -> DataFrame:
    """Frames that lie in at least one kept window."""
    return members.join(kept.select(*keys, name), [*keys, name], "left_semi").groupBy(*keys, pos).agg(F.lit(1).alias("covered")).drop("covered")


def window_span(first: Column, last: Column, size: int, step: int) -> tuple[Column, Column]:
    return first * step, last * step + size


def nearest_window(frame: Column, size: int, step: int, first: Column, last: Column) -> Column:
    """Window whose centre is nearest to a frame, ties to the earlier one, clipped to a range."""
    return F.greatest(first, F.least(last, nearest_unclipped(frame, size, step)))


def nearest_unclipped(frame: Column, size: int, step: int) -> Column:
    """Number of the window whose centre is nearest to a frame, whether that window exists or not."""
    return F.ceil((2 * frame + 1 - size - step) / (2 * step)).cast("long")
