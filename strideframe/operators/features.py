"""Per-window features and scores."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideframe.functions import arrays as A
from strideframe.functions.arrays import flat_entropies, spectra
from strideframe.functions.scalars import magnitude
from strideframe.operators.ordered import chunk_by_position, chunk_rows, sweep
from strideframe.operators.windows import gather
from strideframe.session import settle

# Band edges in Hz, names of the feature types.
BAND_EDGES = (0.5, 1.0, 2.0, 4.0, 8.0, 16.0)
FEATURE_TYPES = ("Raw", "VerySimple", "Simple", "FFT", "All")


def mean_variance(members: DataFrame, keys: Sequence[str], channels: Sequence[str]) -> DataFrame:
    """Mean and population variance of every channel and window."""
    out = []
    for c in channels:
        out += [F.avg(c).alias(f"mean_{c}"), F.greatest(F.var_pop(c), F.lit(0.0)).alias(f"variance_{c}")]
    return members.groupBy(*keys).agg(*out)


def window_table(members: DataFrame, keys: Sequence[str], channels: Sequence[str], label: str = "label") -> DataFrame:
    """Mean, population variance and majority label (the lowest on a tie) of every window in one pass.

    Samples are added up per (window, label) before the shuffle; the second step
    joins at most as many rows as a window has labels.
    """
    sums = []
    for c in channels:
        sums += [F.sum(c).alias(f"__s_{c}"), F.sum(F.col(c) * F.col(c)).alias(f"__q_{c}")]
    parts = members.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("__n"), *sums)
    whole = parts.groupBy(*keys).agg(
        F.min(F.struct((-F.col("__n")).alias("n"), F.col(label).alias("v"))).alias("__best"),
        F.sum("__n").alias("__n"),
        *[F.sum(f"__{k}_{c}").alias(f"__{k}_{c}") for c in channels for k in "sq"],
    )
    out = []
    for c in channels:
        mean = F.col(f"__s_{c}") / F.col("__n")
        out += [mean.alias(f"mean_{c}"), F.greatest(F.col(f"__q_{c}") / F.col("__n") - mean * mean, F.lit(0.0)).alias(f"variance_{c}")]
    return whole.select(*keys, *out, F.col("__best")["v"].alias(label))


def shape_statistics(members: DataFrame, keys: Sequence[str], channel: str) -> DataFrame:
    """Skewness, excess kurtosis, median, quartile range, RMS, peak to peak, crest factor, DC part."""
    c = F.col(channel)
    flat = F.var_pop(c) <= A.FLAT
    rms = F.sqrt(F.avg(c * c))
    quartiles = F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return members.groupBy(*keys).agg(
        F.when(flat, 0.0).otherwise(F.skewness(c)).alias("skewness"),
        F.when(flat, 0.0).otherwise(F.kurtosis(c)).alias("kurtosis"),
        quartiles[1].alias("median"),
        (quartiles[2] - quartiles[0]).alias("interquartile_range"),
        rms.alias("rms"),
        (F.max(c) - F.min(c)).alias("peak_to_peak"),
        F.when(rms > 0, F.max(F.abs(c)) / rms).otherwise(0.0).alias("crest_factor"),
        F.abs(F.avg(c)).alias("dc_component"),
    )


def axis_correlations(members: DataFrame, keys: Sequence[str], axes: Sequence[str]) -> DataFrame:
    """Pearson correlation of axis pairs (0 for flat axes), mean and variance of the axis norm."""
    out = []
    for i, a in enumerate(axes):
        for b in axes[i + 1 :]:
            spread = F.stddev_pop(a) * F.stddev_pop(b)
            out.append(F.when(spread > A.FLAT, F.covar_pop(a, b) / spread).otherwise(0.0).alias(f"correlation_{a}{b}"))
    norm = magnitude(*[F.col(a) for a in axes])
    return members.groupBy(*keys).agg(*out, F.avg(norm).alias("norm_mean"), F.var_pop(norm).alias("norm_variance"))


def with_spectrum(packed: DataFrame, channel: str, name: str = "power") -> DataFrame:
    return packed.withColumn(name, A.power_spectrum(F.col(channel).cast("array<double>")))


def channel_block(values: Column, power: Column, kind: str, centre: Column, size: int, bands: int, cepstral: int) -> Column:
    """Features of one channel for a feature type, as an array."""
    if kind not in FEATURE_TYPES:
        raise ValueError(f"Unknown feature type {kind}")
    if kind == "Raw":
        return values
    parts = []
    if kind in ("VerySimple", "Simple", "All"):
        parts += [A.mean(values), F.greatest(A.moment(A.centred(values), 2), F.lit(0.0))]
    if kind in ("Simple", "All"):
        parts += [A.crossing_rate(values, centre), A.crossing_rate(values, A.mean(values))]
    block = F.array(*parts) if parts else F.array().cast("array<double>")
    if parts:  # windows with null or non-finite samples go through the array expressions
        block = F.coalesce(A.level_block(values, None if kind == "VerySimple" else centre), block)
    if kind in ("FFT", "All"):
        bins = A.without_dc(power, size)
        spectral = F.array(*[A.band_power(power, lo, hi) for lo, hi in A.log_bands(size, bands)])
        ends = F.array(A.entropy_bits(bins), A.total(bins) / size)
        block = F.concat(block, spectral, A.cepstrum(bins, cepstral), ends)
    return block


def block_names(kind: str, size: int, bands: int, cepstral: int) -> list[str]:
    names: list[str] = []
    if kind == "Raw":
        names += [f"raw{i}" for i in range(size)]
    if kind in ("VerySimple", "Simple", "All"):
        names += ["mean", "variance"]
    if kind in ("Simple", "All"):
        names += ["zeroCrossingRate", "meanCrossingRate"]
    if kind in ("FFT", "All"):
        names += [f"fftBand{i}" for i in range(1, bands + 1)] + [f"cepstrum{i}" for i in range(1, cepstral + 1)]
        names += ["spectralEntropy", "energy"]
    return names


def typed_features(
    packed: DataFrame, keys: Sequence[str], channels: Sequence[str], kind: str, centres: dict[str, Column], size: int, bands: int = 4, cepstral: int = 10
) -> tuple[DataFrame, list[str]]:
    """Feature vector of a type, channel by channel, with its names. No shuffle beyond the packing."""
    rows = packed
    if kind in ("FFT", "All"):
        for c in channels:
            rows = with_spectrum(rows, c, f"__p_{c}")
    blocks = [
        channel_block(F.col(c), F.col(f"__p_{c}") if kind in ("FFT", "All") else F.lit(None), kind, centres.get(c, F.lit(0.0)), size, bands, cepstral)
        for c in channels
    ]
    names = [f"{name}_{c}" for c in channels for name in block_names(kind, size, bands, cepstral)]
    return rows.select(*keys, F.concat(*blocks).alias("features")), names


def recognizer_features(
    packed: DataFrame, keys: Sequence[str], channels: Sequence[str], size: int, rate: float, edges: Sequence[float] = BAND_EDGES
) -> tuple[DataFrame, list[str]]:
    """Mean, variance, band powers and dominant frequency of every channel, single precision."""
    rows = packed
    blocks, names = [], []
    for c in channels:
        rows = with_spectrum(rows, c, f"__p_{c}")
        power = F.col(f"__p_{c}")
        bands = [A.band_power(power, lo, hi) / size for lo, hi in A.hertz_bands(size, rate, edges)]
        blocks.append(F.array(A.mean(F.col(c)), A.moment(A.centred(F.col(c)), 2), *bands, A.dominant_bin(power) * (rate / size)))
        labels = [f"power{a:g}to{b:g}Hz" for a, b in zip(edges[:-1], edges[1:])] + [f"above{edges[-1]:g}Hz"]
        names += [f"{c}_{n}" for n in ("mean", "variance", *labels, "dominantFrequency")]
    return rows.select(*keys, F.concat(*blocks).cast("array<float>").alias("features")), names


# Names and order of the features of one signal.
SIGNAL_FEATURES = [
    "mean", "variance", "median", "interquartileRange", "skewness", "kurtosis", "rootMeanSquare", "zeroCrossings", "peakToPeak",
    "crestFactor", "range", "fftDcComponent", "spectralEnergy", "spectralEntropy", "waveletSum", "waveletSquaredSum", "waveletEnergy",
]


def signal_block(values: Column, power: Column, details: Column, size: int) -> Column:
    """The 17 features of one signal, in the order of SIGNAL_FEATURES."""
    c = A.centred(values)
    second = A.moment(c, 2)
    flat = second <= A.FLAT
    ordered = F.array_sort(values)
    rms = F.sqrt(A.total(F.transform(values, lambda x: x * x)) / size)
    peak = F.array_max(values) - F.array_min(values)
    bins = A.without_dc(power)
    wavelet = A.total(details)
    return F.array(
        A.mean(values),
        second,
        A.quantile(ordered, 0.5),
        A.quantile(ordered, 0.75) - A.quantile(ordered, 0.25),
        F.when(flat, 0.0).otherwise(A.moment(c, 3) / F.pow(second, 1.5)),
        F.when(flat, 0.0).otherwise(A.moment(c, 4) / (second * second) - 3.0),
        rms,
        A.sign_changes(c).cast("double"),
        peak,
        F.when(rms > 0, F.array_max(F.transform(values, F.abs)) / rms).otherwise(0.0),
        peak,
        F.abs(A.mean(values)),
        A.total(bins) / size,
        A.entropy_bits(bins),
        wavelet,
        wavelet * wavelet,
        A.total(F.transform(details, lambda x: x * x)),
    )


def placement_block(axes: Sequence[Column]) -> Column:
    """Axis-pair correlations, then mean and variance of the axis norm."""
    centred = [A.centred(a) for a in axes]
    spread = [F.sqrt(A.moment(c, 2)) for c in centred]
    out = []
    for i in range(len(axes)):
        for j in range(i + 1, len(axes)):
            product = spread[i] * spread[j]
            covariance = A.mean(F.zip_with(centred[i], centred[j], lambda x, y: x * y))
            out.append(F.when(product > A.FLAT, covariance / product).otherwise(0.0))
    squares = [F.transform(a, lambda x: x * x) for a in axes]
    sums = squares[0]
    for more in squares[1:]:
        sums = F.zip_with(sums, more, lambda x, y: x + y)
    norm = F.transform(sums, F.sqrt)
    return F.array(*out, A.mean(norm), A.moment(A.centred(norm), 2))


def total_of(columns: Sequence[np.ndarray]) -> np.ndarray:
    """Sums run sample by sample, as ``arrays.total`` does."""
    out = np.zeros(len(columns[0]) if columns else 1)
    for c in columns:
        out = out + c
    return out


def haar_of(x: Sequence[np.ndarray], levels: int = 3) -> list[np.ndarray]:
    """Detail coefficients of many windows, as ``arrays.haar_details``."""
    sizes, out = [len(x)], []
    for k in range(1, levels + 1):
        sizes.append((sizes[-1] + 1) // 2)
        for i in range(sizes[k]):
            terms = []
            for halves in product((0, 1), repeat=k):
                place = i
                for level, half in zip(reversed(range(k)), halves):
                    place = min(place * 2 + half, sizes[level] - 1)
                terms.append(x[place] * (-1 if halves[0] else 1))
            out.append(total_of(terms) * 0.5 ** (k / 2))
    return out


def signal_numbers(m: np.ndarray, size: int) -> list[np.ndarray]:
    """``signal_block`` of many windows (rows of finite samples), in the same order of sums."""
    n, x = m.shape[1], list(np.asfortranarray(m).T)
    mean = total_of(x) / n
    c = [v - mean for v in x]
    second = total_of([v * v for v in c]) / n
    flat = second <= A.FLAT
    ordered = np.sort(m, axis=1)

    def quantile(probability: float) -> np.ndarray:
        rank = probability * (n - 1)
        low, high = int(np.floor(rank)), int(np.ceil(rank))
        return ordered[:, low] + (ordered[:, high] - ordered[:, low]) * (rank - low)

    rms = np.sqrt(total_of([v * v for v in x]) / size)
    peak = ordered[:, -1] - ordered[:, 0]
    bins = list(A.power_of(m).T[1:])
    power = total_of(bins) + np.zeros(len(m))
    entropy = np.zeros(len(m))
    for p in bins:
        share = np.where(power > 0, p / power, 0.0)
        entropy = entropy - np.where(share > 0, share * (np.log(np.where(share > 0, share, 1.0)) / np.log(2.0)), 0.0)
    details = haar_of(x)
    wavelet = total_of(details)
    below = np.stack(c) < 0  # Spark's atan2 takes a negative zero for zero
    return [
        mean,
        second,
        quantile(0.5),
        quantile(0.75) - quantile(0.25),
        np.where(flat, 0.0, total_of([v * v * v for v in c]) / n / second**1.5),
        np.where(flat, 0.0, total_of([v * v * v * v for v in c]) / n / (second * second) - 3.0),
        rms,
        (below[1:] != below[:-1]).sum(axis=0).astype(np.float64),
        peak,
        np.where(rms > 0, np.abs(m).max(axis=1) / rms, 0.0),
        peak,
        np.abs(mean),
        power / size,
        entropy,
        wavelet,
        wavelet * wavelet,
        total_of([d * d for d in details]),
    ]


def placement_numbers(axes: Sequence[np.ndarray]) -> list[np.ndarray]:
    """``placement_block`` of many windows."""
    n = axes[0].shape[1]

    def centred(x: list[np.ndarray]) -> list[np.ndarray]:
        mean = total_of(x) / n
        return [v - mean for v in x]

    columns = [list(np.asfortranarray(m).T) for m in axes]
    gaps = [centred(x) for x in columns]
    spread = [np.sqrt(total_of([v * v for v in c]) / n) for c in gaps]
    out = []
    for i in range(len(axes)):
        for j in range(i + 1, len(axes)):
            scale = spread[i] * spread[j]
            out.append(np.where(scale > A.FLAT, total_of([u * v for u, v in zip(gaps[i], gaps[j])]) / n / scale, 0.0))
    norm = []
    for parts in zip(*columns):
        square = parts[0] * parts[0]
        for v in parts[1:]:
            square = square + v * v
        norm.append(np.sqrt(square))
    return [*out, total_of(norm) / n, total_of([v * v for v in centred(norm)]) / n]


def sound_signals(packed_signals: Sequence[str], placements: Sequence[Sequence[str]], size: int) -> Column:
    """Features of ``signal_features`` of a window, worked out over all windows of a batch at once.

    Null for a window that is empty, of signals of different lengths, or with a null or non-finite sample or result.
    """
    places = [[packed_signals.index(a) for a in axes] for axes in placements]
    # functions, not their module, travel to the tasks
    numbers, placed, width = signal_numbers, placement_numbers, sum(len(SIGNAL_FEATURES) for _ in packed_signals) + sum(len(p) * (len(p) - 1) // 2 + 2 for p in places)

    @F.arrow_udf("array<double>")
    def block(*signals: pa.Array) -> pa.Array:
        lengths = [pc.fill_null(pc.list_value_length(s), 0).to_numpy(zero_copy_only=False).astype(np.int64) for s in signals]
        flat = [s.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False) for s in signals]
        starts = [np.cumsum(n) - n for n in lengths]
        count = len(lengths[0])
        even = np.logical_and.reduce([n == lengths[0] for n in lengths])
        out, sound = np.zeros((count, width)), np.zeros(count, dtype=bool)
        for length in np.unique(lengths[0][even]):
            if length:
                at = np.flatnonzero(even & (lengths[0] == length))
                blocks = [f[s[at][:, None] + np.arange(length)] for f, s in zip(flat, starts)]
                finite = np.logical_and.reduce([np.isfinite(m).all(axis=1) for m in blocks])
                at, blocks = at[finite], [m[finite] for m in blocks]
                if len(at):
                    with np.errstate(all="ignore"):
                        found = [v for m in blocks for v in numbers(m, size)] + [v for p in places for v in placed([blocks[i] for i in p])]
                    out[at] = np.stack(found, axis=1)
                    sound[at] = np.isfinite(out[at]).all(axis=1)
        offsets = pa.array(np.append(np.cumsum(sound) - sound, sound.sum()).astype(np.int32) * width, mask=np.append(~sound, False))
        return pa.ListArray.from_arrays(offsets, pa.array(out[sound].ravel()))

    return block(*[F.col(s).cast("array<double>") for s in packed_signals])


def signal_features(packed: DataFrame, keys: Sequence[str], placements: dict[str, Sequence[str]], size: int) -> tuple[DataFrame, list[str]]:
    """17 features per signal and 5 per placement of three axes.

    Windows whose samples are all finite numbers go through ``sound_signals``, others through the array expressions.
    """
    blocks, names = [], []
    signals = [s for axes in placements.values() for s in axes]
    rows = packed.withColumn("__sound", sound_signals(signals, list(placements.values()), size))
    left = F.col("__sound").isNull()
    for s in signals:
        rows = rows.withColumn(f"__p_{s}", A.power_spectrum(F.when(left, F.col(s).cast("array<double>")))).withColumn(f"__d_{s}", F.when(left, A.haar_details(s)))
        blocks.append(signal_block(F.col(s), F.col(f"__p_{s}"), F.col(f"__d_{s}"), size))
        names += [f"{s}_{n}" for n in SIGNAL_FEATURES]
    for placement, axes in placements.items():
        blocks.append(placement_block([F.col(a) for a in axes]))
        pairs = [f"correlation{a}{b}" for a, b in (("x", "y"), ("x", "z"), ("y", "z"))]
        names += [f"{placement}_{n}" for n in (*pairs, "normMean", "normVariance")]
    return rows.select(*keys, F.coalesce("__sound", F.concat(*blocks)).alias("features")), names


def average(values: Sequence[Column]) -> Column:
    return sum(values[1:], values[0]) / len(values)


def starts_of(columns: Sequence[pa.Array]) -> np.ndarray:
    """First rows of the groups of rows sorted by these columns; null equals null."""
    n = len(columns[0])
    new = np.ones(n, dtype=bool)
    new[1:] = False
    for column in columns:
        a, b = column.slice(1), column.slice(0, n - 1)
        apart = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(a.is_null(), b.is_null()))
        new[1:] |= apart.to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def moments_of(values: pa.Array, starts: np.ndarray, sizes: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Mean and population variance of the values of every group that are not null (null if there are none)."""
    missing = values.is_null().to_numpy(zero_copy_only=False)
    x = np.where(missing, 0.0, values.to_numpy(zero_copy_only=False))
    n = sizes - np.add.reduceat(missing.astype(np.int64), starts)
    known = np.maximum(n, 1)
    mean = np.add.reduceat(x, starts) / known
    gap = np.where(missing, 0.0, x - np.repeat(mean, sizes))
    variance = np.add.reduceat(gap * gap, starts) / known
    return pa.array(mean, mask=n == 0), pa.array(variance, mask=n == 0)


def sample_statistics(members: DataFrame, stream: Sequence[str], win: str, pos: str, axes: Sequence[str], mags: Sequence[str]) -> DataFrame:
    """Per window: variance (``__v``) and flat entropy of the spectrum (``__e``) of every magnitude, mean (``__a``) and deviation (``__s``) of every axis.

    Samples are dealt by stream and a range of windows, sorted, and added up
    batch by batch; a window that a batch cuts waits for the next one.
    """
    keys, values = [*stream, win], [*axes, *mags]
    rows = members.select(*keys, pos, *[F.col(c).cast("double").alias(c) for c in values])
    dealt = rows.repartition(*stream, F.floor(F.col(win) / chunk_rows(members))).sortWithinPartitions(*keys, pos)
    names = [*keys, *[f"__v{m}" for m in mags], *[f"__a{a}" for a in axes], *[f"__s{a}" for a in axes], *[f"__e{m}" for m in mags]]
    kinds = [*[members.schema[k].dataType.simpleString() for k in keys], *["double"] * (2 * len(mags) + 2 * len(axes))]

    def added(held: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        sizes = np.diff(np.append(starts, len(held)))
        column = {c: held[c].combine_chunks() for c in held.column_names}
        of = {c: moments_of(column[c], starts, sizes) for c in values}
        offsets = pa.array(np.append(starts, len(held)).astype(np.int32))
        out = [column[k].take(pa.array(starts)) for k in keys]
        out += [of[m][1] for m in mags] + [of[a][0] for a in axes] + [pc.sqrt(of[a][1]) for a in axes]
        out += [flat_entropies(spectra(pa.ListArray.from_arrays(offsets, column[m]))) for m in mags]
        return pa.RecordBatch.from_arrays(out, names=names)

    def work(batches):
        held = None
        for batch in batches:
            more = pa.Table.from_batches([batch])
            held = more if held is None else pa.concat_tables([held, more])
            if len(held):
                starts = starts_of([held[k].combine_chunks() for k in keys])
                last = int(starts[-1])
                if last:
                    yield added(held.slice(0, last), starts[:-1])
                    held = held.slice(last)
        if held is not None and len(held):
            yield added(held, np.zeros(1, dtype=np.int64))

    return dealt.mapInArrow(work, ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds)))


def window_scores(
    members: DataFrame, stream: Sequence[str], sensors: Sequence[Sequence[str]], win: str = "win", pos: str = "pos"
) -> DataFrame:
    """The three window scores, each averaged over sensors of three axes.

    variance  population variance of the acceleration magnitude
    change    distance of axis means plus distance of axis deviations to the window before (null at the start)
    entropy   spectral entropy of the magnitude over that of a flat spectrum
    """
    keys = [*stream, win]
    rows = members
    for i, axes in enumerate(sensors):
        rows = rows.withColumn(f"__m{i}", magnitude(*[F.col(a) for a in axes]))
    mags = [f"__m{i}" for i in range(len(sensors))]
    axes_all = [a for axes in sensors for a in axes]
    stats = sample_statistics(rows, stream, win, pos, axes_all, mags)
    entropy = average([F.col(f"__e{m}") for m in mags])
    variance = average([F.col(f"__v{m}") for m in mags])
    # Settled because the sweep reads its input twice.
    kept = settle(stats.select(*keys, variance.alias("variance"), entropy.alias("entropy"), *[f"__a{a}" for a in axes_all], *[f"__s{a}" for a in axes_all]))
    state = F.struct(*[F.col(f"__a{a}") for a in axes_all], *[F.col(f"__s{a}") for a in axes_all])
    seen = sweep(chunk_by_position(kept, win, "__chunk"), stream, [win], chunk="__chunk", prev={"__was": state})
    distances = []
    for axes in sensors:
        parts = [magnitude(*[F.col(f"{p}{a}") - F.col("__was")[f"{p}{a}"] for a in axes]) for p in ("__a", "__s")]
        distances.append(parts[0] + parts[1])
    return seen.select(*keys, "variance", average(distances).alias("change"), "entropy")


def packed_windows(members: DataFrame, keys: Sequence[str], channels: Sequence[str]) -> DataFrame:
    return gather(members, keys, channels)
