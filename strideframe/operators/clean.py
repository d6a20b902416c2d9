"""Cleaning of timed samples: repeats, gaps, missing and filled values, runs, blocks, bouts."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideframe.operators.ordered import attach, chunk_rows, exact_quantiles, number_groups, number_runs, sweep

GAP_FACTOR = 1.5
STEP_MICROSECONDS = 16667


def flag_repeats(df: DataFrame, keys: Sequence[str], order: Sequence[str], clock: str = "t") -> DataFrame:
    """Mark rows whose clock does not move on from the row before."""
    seen = sweep(df, keys, order, prev={"__before": F.col(clock)})
    repeated = F.coalesce(F.col(clock) <= F.col("__before"), F.lit(False))
    return seen.withColumn("repeated", repeated).drop("__before")


def drop_repeats(df: DataFrame, keys: Sequence[str], order: Sequence[str], clock: str = "t") -> DataFrame:
    return flag_repeats(df, keys, order, clock).filter(~F.col("repeated")).drop("repeated")


def split_streams(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    clock: str = "t",
    step: float = STEP_MICROSECONDS,
    gap_factor: float = GAP_FACTOR,
) -> DataFrame:
    """Number gap-free streams: a step above ``gap_factor * step`` starts a new one."""
    longest = gap_factor * step
    return number_runs(
        df, keys, order, {"clock": F.col(clock)}, lambda was, now: now["clock"] - was["clock"] > longest, name="stream"
    )


def hold_last_valid(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """Fill each channel by its last valid value, leading gaps by the first valid one.

    Adds ``filled`` (values filled on the row) and ``usable`` (false in a stream
    with a channel that has no valid value at all).
    """
    looked = sweep(
        df,
        keys,
        order,
        last_valid={f"__b_{c}": F.col(c) for c in columns},
        next_valid={f"__a_{c}": F.col(c) for c in columns},
        totals={f"__n_{c}": ("sum", F.col(c).isNotNull().cast("long")) for c in columns},
    )
    filled = sum((F.col(c).isNull().cast("int") for c in columns), F.lit(0))
    usable = F.lit(True)
    for c in columns:
        usable = usable & (F.col(f"__n_{c}") > 0)
    kept = [F.coalesce(f"__b_{c}", f"__a_{c}").alias(c) if c in columns else F.col(c) for c in df.columns]
    return looked.select(*kept, filled.alias("filled"), usable.alias("usable"))


def sample_periods(df: DataFrame, keys: Sequence[str], order: Sequence[str], clock: str = "t") -> DataFrame:
    """Median positive time step per recording and the count of steps that run backwards."""
    seen = sweep(df, keys, order, prev={"__before": F.col(clock)})
    steps = seen.withColumn("__step", (F.col(clock) - F.col("__before")).cast("double"))
    backwards = steps.groupBy(*keys).agg(F.count_if(F.col("__step") < 0).alias("backwards"))
    medians = exact_quantiles(steps.filter(F.col("__step") > 0), keys, "__step", [0.5], ["period"])
    return backwards.join(medians, list(keys), "left")


def require_shared_period(periods: DataFrame) -> DataFrame:
    """Rows that break the rule of one shared period (empty when it holds)."""
    return periods.agg(F.count_distinct("period").alias("periods"), F.sum("backwards").alias("backwards")).filter(
        (F.col("periods") != 1) | (F.col("backwards") > 0)
    )


def profile_recordings(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    clock: str,
    channels: Sequence[str],
    magnitude: Column,
    label: str = "label",
    gap: float = GAP_FACTOR * STEP_MICROSECONDS,
) -> DataFrame:
    """One row per recording: samples, repeats, gaps, missing samples, labels, changes, median magnitude."""
    seen = sweep(df, keys, order, prev={"__t": F.col(clock), "__l": F.col(label)})
    step = F.col(clock) - F.col("__t")
    missing = F.lit(False)
    for channel in channels:
        missing = missing | F.col(channel).isNull()
    rows = seen.withColumn("__m", magnitude)
    profile = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("samples"),
        F.count_if(step == 0).alias("repeated_times"),
        F.count_if(step > gap).alias("gaps"),
        F.count_if(missing).alias("missing_samples"),
        F.count_distinct(label).alias("labels"),
        F.count_if(F.col("__l") != F.col(label)).alias("label_changes"),
    )
    return profile.join(exact_quantiles(rows, keys, "__m", [0.5], ["median_magnitude"]), list(keys), "left")


def missing_runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], missing: Column) -> DataFrame:
    """Number of runs of rows with a missing channel, and the longest, per recording."""
    runs = number_runs(df.withColumn("__m", missing), keys, order, {"m": F.col("__m")}, lambda a, b: a["m"] != b["m"])
    sizes = runs.groupBy(*keys, "run", "__m").agg(F.count(F.lit(1)).alias("rows"))
    return sizes.groupBy(*keys).agg(
        F.count_if("__m").alias("missing_runs"),
        F.coalesce(F.max(F.when(F.col("__m"), F.col("rows"))), F.lit(0)).alias("longest_run"),
    )


def label_runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], label: str = "label") -> DataFrame:
    """Rows with the number of their label run (``run``) and a mark on its first row (``run_start``)."""
    return number_runs(df, keys, order, {"label": F.col(label)}, lambda a, b: ~a["label"].eqNullSafe(b["label"]))


def segments(runs: DataFrame, keys: Sequence[str], pos: str = "pos", label: str = "label") -> DataFrame:
    """Half-open [start, end) segments of a table numbered by ``label_runs``."""
    return runs.groupBy(*keys, "run", label).agg(
        F.min(pos).alias("start"), (F.max(pos) + 1).alias("end"), F.count(F.lit(1)).alias("frames")
    )


def repetition_blocks(
    runs: DataFrame, keys: Sequence[str], null_label: str | int, label: str = "label", pos: str = "pos"
) -> DataFrame:
    """Number repetition blocks: one starts at the null run before each return of the first gesture."""
    starts = runs.filter("run_start").select(*keys, pos, "chunk", label)
    gesture = F.when(F.col(label) != null_label, F.col(label))
    seen = sweep(
        starts,
        keys,
        [pos],
        prev={"__was": F.col(label)},
        following={"__next": F.col(label)},
        totals={"__first": ("min", F.when(gesture.isNotNull(), F.struct(F.col(pos), gesture.alias("g"))))},
    )
    first = F.col("__first")["g"]
    opens = (F.col(label) == first) & ~F.coalesce(F.col("__was") == null_label, F.lit(False))
    opens = opens | ((F.col(label) == null_label) & F.coalesce(F.col("__next") == first, F.lit(False)))
    marks = seen.filter(opens).select(*keys, F.col(pos), F.lit(1).alias("__mark"))
    marked = runs.join(marks, [*keys, pos], "left")
    counted = sweep(marked, keys, [pos], sums={"__cum": F.coalesce(F.col("__mark"), F.lit(0))})
    return counted.withColumn("block", F.greatest(F.col("__cum") - 1, F.lit(0)).cast("long")).drop("__cum", "__mark")


def check_blocks(blocks: DataFrame, keys: Sequence[str], null_label: str | int, gestures: Sequence, label: str = "label") -> DataFrame:
    """Per block: does it hold each gesture exactly once?"""
    held = blocks.filter(F.col("run_start")).groupBy(*keys, "block", label).agg(F.count(F.lit(1)).alias("times"))
    return held.groupBy(*keys, "block").agg(
        (
            (F.count_if((F.col(label) != null_label) & (F.col("times") == 1)) == len(gestures))
            & (F.count_if((F.col(label) != null_label) & (F.col("times") != 1)) == 0)
        ).alias("complete")
    )


def replace_filled_by_mean(df: DataFrame, keys: Sequence[str], order: Sequence[str], filled: Column, columns: Sequence[str]) -> DataFrame:
    """Filled frames get the mean over the unfilled frames of their recording."""
    marked = df.withColumn("__f", filled)
    sums = {f"__s_{c}": ("sum", F.when(~F.col("__f"), F.col(c))) for c in columns}
    seen = sweep(marked, keys, order, totals={**sums, "__n": ("sum", (~F.col("__f")).cast("long"))})
    out = [
        F.when(F.col("__f"), F.col(f"__s_{c}") / F.col("__n")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c)
        for c in df.columns
    ]
    return seen.select(*out)


def replace_filled_by_line(
    df: DataFrame, keys: Sequence[str], filled: Column, columns: Sequence[str], pos: str = "pos"
) -> DataFrame:
    """Filled frames get the straight line between the nearest unfilled frames, edges held."""
    point = F.when(~filled, F.struct(F.col(pos), *[F.col(c) for c in columns]))
    seen = sweep(df.withColumn("__f", filled), keys, [pos], last_valid={"__b": point}, next_valid={"__a": point})
    span = F.col("__a")[pos] - F.col("__b")[pos]

    def line(c: str) -> Column:
        before, after = F.col("__b")[c], F.col("__a")[c]
        between = before + (after - before) * (F.col(pos) - F.col("__b")[pos]) / span
        return F.when(~F.col("__f"), F.col(c)).otherwise(F.coalesce(between, before, after))

    return seen.select(*[line(c).alias(c) if c in columns else F.col(c) for c in df.columns])


def fill_inventory(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], filled: Column, columns: Sequence[str], label: str = "label", pos: str = "pos", tolerance: float = 1e-6
) -> DataFrame:
    """Runs of filled frames, their label counts, and whether every value equals its class mean."""
    runs = number_runs(df.withColumn("__f", filled), keys, order, {"f": F.col("__f")}, lambda a, b: a["f"] != b["f"])
    means = df.groupBy(*keys, label).agg(*[F.avg(c).alias(f"__m_{c}") for c in columns])
    equal = F.lit(True)
    for c in columns:
        equal = equal & (F.abs(F.col(c) - F.col(f"__m_{c}")) <= tolerance)
    per_label = (
        attach(runs.filter("__f"), means, keys, extra=[label])
        .groupBy(*keys, "run", label)
        .agg(F.count(F.lit(1)).alias("n"), F.min(pos).alias("lo"), F.max(pos).alias("hi"), F.bool_and(equal).alias("same"))
    )
    entry = F.concat_ws(":", F.col(label).cast("string"), F.col("n").cast("string"))
    return per_label.groupBy(*keys, "run").agg(
        F.min("lo").alias("run_start"),
        (F.max("hi") + 1).alias("run_end"),
        F.sum("n").alias("frames"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(label, entry.alias("e")))), lambda x: x["e"]), " ").alias("label_counts"),
        F.bool_and("same").alias("equals_class_mean"),
    ).drop("run")


def continued_windows(df: DataFrame, keys: Sequence[str], row: str, signals: Sequence[str], step: int) -> DataFrame:
    """Mark rows whose second part is repeated by the first part of the next row with equal keys."""
    seen = sweep(df, keys, [row], following={"__r": F.col(row), **{f"__n_{c}": F.slice(c, 1, step) for c in signals}})
    same = F.col("__r") == F.col(row) + 1
    for c in signals:
        tail = F.slice(F.col(c), F.lit(step + 1), F.size(c) - step)
        same = same & (tail == F.slice(F.col(f"__n_{c}"), F.lit(1), F.size(c) - step))
    return seen.select(*df.columns, F.coalesce(same, F.lit(False)).alias("continues"))


def label_bouts(marked: DataFrame, row: str, name: str = "bout") -> DataFrame:
    """Number recording bouts over the whole table by counting breaks before each row.

    Chunks of the row number are summed first; only one count per chunk is
    ordered in one place.
    """
    rows = marked.withColumn("__c", F.floor(F.col(row) / chunk_rows(marked)).cast("long"))
    broken = (~F.col("continues")).cast("long")
    out = sweep(rows, [], [row], chunk="__c", sums={"__s": broken})
    return out.withColumn(name, (F.col("__s") - broken).cast("long")).drop("__s", "__c")


def stitch_bouts(windows: DataFrame, bout: str, order: str, signal: str, step: int) -> DataFrame:
    """Samples of a bout from half-overlapping windows: the first one whole, then only new samples."""
    rows = windows.withColumn("__c", F.floor(F.col(order) / chunk_rows(windows)).cast("long"))
    rows = sweep(rows, [bout], [order], chunk="__c", number="__w")
    samples = rows.select(bout, "__w", F.size(signal).alias("__n"), F.posexplode(signal).alias("__i", "value"))
    old = F.col("__n") - step
    fresh = samples.filter((F.col("__w") == 0) | (F.col("__i") >= old))
    return fresh.select(bout, (F.col("__w") * step + F.col("__i")).cast("long").alias("sample"), "value")


def number_segments(df: DataFrame, recording: str, inner: str, name: str = "segment") -> DataFrame:
    """Renumber per-recording groups (segments, streams) over all recordings, dropping nothing."""
    numbers = number_groups(df, recording, [inner], name).select(recording, inner, name)
    # A segment may hold most rows: its number meets a row of each of its parts first.
    parts = 1 + df.groupBy(recording, inner).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.floor(F.max("n") / chunk_rows(df)), F.lit(0)).alias("p")).scalar()
    spread = df.withColumn("__part", F.pmod(F.xxhash64(*df.columns), parts).cast("long"))
    return attach(spread, numbers, [recording, inner], chunk="__part").drop("__part")


def stream_ranges(windows: DataFrame, stream: str = "stream", window: str = "win") -> DataFrame:
    return windows.groupBy(stream).agg(F.min(window).alias("first_window"), (F.max(window) + 1).alias("end_window"))


def segment_durations(
    segs: DataFrame, keys: Sequence[str], rate: float, label: str = "label", shortest: float = 2.0, longest: float = 8.0
) -> DataFrame:
    """Segment durations per recording and class: count, frames, min, median, max, share in a range."""
    lasting = segs.withColumn("__s", F.col("frames") / F.lit(float(rate)))
    table = lasting.groupBy(*keys, label).agg(
        F.count(F.lit(1)).alias("segments"),
        F.sum("frames").alias("frames"),
        F.min("__s").alias("min_seconds"),
        F.max("__s").alias("max_seconds"),
        F.avg(F.col("__s").between(shortest, longest).cast("double")).alias("share_in_range"),
    )
    return table.join(exact_quantiles(lasting, [*keys, label], "__s", [0.5], ["median_seconds"]), [*keys, label])


# ---- decimation -----------------------------------------------------------------------------------

RIPPLE_DECIBEL = 0.05
PASS_SHARE = 0.8


def lowpass_coefficients(factor: int = 2, order: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Digital Chebyshev type I low pass (numerator, denominator) by the bilinear transform."""
    eps = np.sqrt(10 ** (RIPPLE_DECIBEL / 10) - 1)
    mu = np.arcsinh(1 / eps) / order
    theta = np.pi * (2 * np.arange(1, order + 1) - 1) / (2 * order)
    poles = -np.sinh(mu) * np.sin(theta) + 1j * np.cosh(mu) * np.cos(theta)
    gain = np.real(np.prod(-poles)) / (np.sqrt(1 + eps**2) if order % 2 == 0 else 1.0)
    warped = 4 * np.tan(np.pi * (PASS_SHARE / factor) / 2)
    poles, gain = poles * warped, gain * warped**order
    digital = (4 + poles) / (4 - poles)
    gain = np.real(gain / np.prod(4 - poles))
    return gain * np.real(np.poly(-np.ones(order))), np.real(np.poly(digital))


def impulse_response(factor: int, order: int, length: int) -> np.ndarray:
    b, a = lowpass_coefficients(factor, order)
    out = np.zeros(length)
    for i in range(length):
        out[i] = (b[i] if i < len(b) else 0.0) - np.dot(a[1 : min(i, order) + 1], out[i - 1 :: -1][: min(i, order)] if i else [])
    return out


def zero_phase(values: np.ndarray, response: np.ndarray, pad: int, open_left: bool, open_right: bool) -> np.ndarray:
    """Filter forwards and backwards along the rows; recording ends get an odd extension.

    ``open_left``/``open_right`` mark a true end of the recording; other ends lie
    in the overlap and are cut off by the caller.
    """
    rows = len(values)
    pad = min(pad, rows - 1)
    left = 2 * values[0] - values[pad:0:-1] if open_left else values[:0]
    right = 2 * values[-1] - values[-2 : -pad - 2 : -1] if open_right else values[:0]
    x = np.concatenate([left, values, right])

    def run(signal: np.ndarray) -> np.ndarray:
        # Before its first value the signal is held: that adds what the response has left by then.
        own = response[: len(signal)]
        size = 1 << int(np.ceil(np.log2(len(signal) + len(own))))
        spectrum = np.fft.rfft(signal, size, axis=0) * np.fft.rfft(own, size)[:, None]
        out = np.fft.irfft(spectrum, size, axis=0)[: len(signal)]
        out[: len(own)] += (response.sum() - np.cumsum(own))[:, None] * signal[:1]
        return out

    y = run(run(x)[::-1])[::-1]
    return y[len(left) : len(left) + rows]


def decimate(
    df: DataFrame, keys: Sequence[str], pos: str, channels: Sequence[str], label: str, factor: int = 2, order: int = 8, halo: int = 4096, n: str | None = None
) -> DataFrame:
    """Zero-phase low pass and every ``factor``-th sample with its label.

    Long recordings are cut into chunks that reach ``halo`` samples into their
    neighbours; the filter forgets its past geometrically (below 1e-13 after
    4096 samples), so the cut does not show. A chunk that reaches the
    recording's first or last sample extends it there. ``n`` names the length of
    the recording if the rows hold it; else it is taken from the positions.
    """
    size = chunk_rows(df)
    if n:
        df = df.withColumn("__last", F.col(n) - 1)
    else:
        last = df.groupBy(*keys).agg(F.max(pos).alias("__last"))
        df = attach(df.withColumn("__c", F.floor(F.col(pos) / size).cast("long")), last, keys, chunk="__c")
    reach = lambda p: F.floor(p / size).cast("long")
    homes = F.sequence(reach(F.greatest(F.col(pos) - halo, F.lit(0))), reach(F.least(F.col(pos) + halo, F.col("__last"))))
    spread = df.select(*keys, pos, label, *channels, "__last", F.explode(homes).alias("__chunk"))
    schema = spread.select(*keys, pos, label, *[F.col(c).cast("double") for c in channels]).schema
    pad = 3 * (order + 1)
    response = impulse_response(factor, order, halo)

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(pos)
        number = int(pdf["__chunk"].iloc[0])
        at = pdf[pos].to_numpy()
        out = zero_phase(
            pdf[list(channels)].to_numpy(dtype=np.float64), response, pad, at[0] == 0, at[-1] == pdf["__last"].iloc[0]
        )
        mine = (at // size == number) & (at % factor == 0)
        kept = pdf.loc[mine, [*keys, pos, label]].copy()
        kept[pos] = kept[pos] // factor
        for i, c in enumerate(channels):
            kept[c] = out[mine, i]
        return kept[[f.name for f in schema]]

    return spread.groupBy(*keys, "__chunk").applyInPandas(work, schema)
