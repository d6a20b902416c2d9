"""Features of one window held as an array of samples.

Moments, crossings and band sums are array expressions in the JVM. The Fourier
and cosine transforms are Arrow functions over batches of windows.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOUBLES = T.ArrayType(T.DoubleType())
FLAT = 1e-12
LOG_FLOOR = 1e-10


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    return total(a) / F.size(a)


def centred(a: Column) -> Column:
    """The array minus its mean (the mean is bound once per array)."""
    return F.element_at(F.transform(F.array(F.struct(a.alias("a"), mean(a).alias("m"))), lambda s: F.transform(s["a"], lambda x: x - s["m"])), 1)


def moment(c: Column, order: int) -> Column:
    """Population moment of an already centred array."""
    power = {2: lambda x: x * x, 3: lambda x: x * x * x, 4: lambda x: x * x * x * x}[order]
    return F.aggregate(c, F.lit(0.0), lambda s, x: s + power(x)) / F.size(c)


def quantile(ordered: Column, probability: float) -> Column:
    """Linear-interpolated quantile of a sorted array."""
    rank = F.lit(probability) * (F.size(ordered) - 1)
    low, high = F.floor(rank).cast("int"), F.ceil(rank).cast("int")
    a, b = F.element_at(ordered, low + 1), F.element_at(ordered, high + 1)
    return a + (b - a) * (rank - low)


def flips(marks: Column) -> Column:
    """Number of changes between neighbours of a boolean array."""
    pairs = F.zip_with(F.slice(marks, F.lit(2), F.size(marks) - 1), F.slice(marks, F.lit(1), F.size(marks) - 1), lambda x, y: x != y)
    return F.size(F.filter(pairs, lambda f: f))


def crossing_rate(a: Column, centre: Column) -> Column:
    """Share of neighbouring samples on different sides of ``centre`` (at the centre counts as above; it is bound once per array)."""
    marks = F.transform(F.array(F.struct(a.alias("a"), centre.alias("m"))), lambda s: F.transform(s["a"], lambda x: x >= s["m"]))
    rate = F.transform(marks, lambda m: flips(m) / F.greatest(F.size(m) - 1, F.lit(1)))
    return F.element_at(rate, 1)


def sign_changes(c: Column) -> Column:
    """Changes of the sign bit of a centred array; a negative zero counts as negative."""
    return flips(F.transform(c, lambda x: F.atan2(x, F.lit(-1.0)) < 0))


def by_length(values: pa.Array, kernel: Callable[[np.ndarray], np.ndarray]) -> pa.Array:
    """Apply a kernel on (windows, samples) blocks of equal length; a null window stays null, a null sample counts as NaN."""
    missing = values.is_null().to_numpy(zero_copy_only=False)
    lengths = pc.fill_null(pc.list_value_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    starts = np.cumsum(lengths) - lengths
    blocks, sizes = [], np.zeros(len(values), dtype=np.int64)
    for length in np.unique(lengths[~missing]):
        at = np.flatnonzero((lengths == length) & ~missing)
        block = kernel(flat.reshape(-1, length) if len(at) * length == len(flat) and length else flat[starts[at][:, None] + np.arange(length)])
        sizes[at] = block.shape[1]
        blocks.append((at, block))
    ends = np.cumsum(sizes)
    out = np.empty(int(sizes.sum()))
    for at, block in blocks:
        if len(at) == len(values):
            out = np.ascontiguousarray(block, dtype=np.float64).reshape(-1)
        else:
            out[(ends - sizes)[at][:, None] + np.arange(block.shape[1])] = block
    offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32), mask=np.append(missing, False) if missing.any() else None)
    return pa.ListArray.from_arrays(offsets, pa.array(out))


def power_of(m: np.ndarray) -> np.ndarray:
    return np.abs(np.fft.rfft(m - m.mean(axis=1, keepdims=True), axis=1)) ** 2


def spectra(values: pa.Array) -> pa.Array:
    """One-sided power of every mean-removed window, from the zero bin up."""
    return by_length(values, power_of)


def level_block(values: Column, centre: Column | None = None) -> Column:
    """Mean and population variance of a window and, given a centre, its crossing rates of the centre and of the mean.

    Sums run sample by sample, as ``total`` does, over all windows of a batch at
    once. Null for a window that is empty or holds a null or non-finite sample.
    """

    crossings = centre is not None

    @F.arrow_udf(DOUBLES)
    def block(samples: pa.Array, middle: pa.Array) -> pa.Array:
        at_centre = pc.fill_null(middle, np.nan).to_numpy(zero_copy_only=False) if crossings else np.zeros(len(samples))
        marked = pa.ListArray.from_arrays(pa.array(np.arange(len(samples) + 1, dtype=np.int32)), pa.array(at_centre))
        wide = pa.array(np.zeros(0)) if not len(samples) else with_first(samples, marked)

        def kernel(m: np.ndarray) -> np.ndarray:
            middle, x = m[:, :1], np.asfortranarray(m[:, 1:])
            n = x.shape[1]
            if not n:
                return np.full((len(m), 4 if crossings else 2), np.nan)
            mean, square = np.zeros(len(m)), np.zeros(len(m))
            with np.errstate(over="ignore", invalid="ignore"):
                for i in range(n):
                    mean += x[:, i]
                mean /= n
                for i in range(n):
                    gap = x[:, i] - mean
                    square += gap * gap
            parts = [mean, np.maximum(square / n, 0.0)]
            if crossings:
                for level in (middle, mean[:, None]):
                    above = x >= level
                    parts.append((above[:, 1:] != above[:, :-1]).sum(axis=1) / max(n - 1, 1))
            return np.where(np.isfinite(m).all(axis=1, keepdims=True), np.stack(parts, axis=1), np.nan)

        return by_length(wide, kernel)

    made = block(values.cast("array<double>"), centre.cast("double") if crossings else F.lit(0.0))
    return F.when(~F.isnan(F.get(made, F.lit(0))), made)


def with_first(values: pa.Array, first: pa.Array) -> pa.Array:
    """Arrays with an entry put before their own; a null array stays null."""
    missing = values.is_null().to_numpy(zero_copy_only=False)
    lengths = pc.fill_null(pc.list_value_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.cumsum(lengths + 1) - (lengths + 1)
    flat = np.empty(int((lengths + 1).sum()))
    own = np.ones(len(flat), dtype=bool)
    own[starts] = False
    flat[starts] = first.flatten().to_numpy(zero_copy_only=False)
    flat[own] = values.flatten().to_numpy(zero_copy_only=False)
    offsets = pa.array(np.append(starts, len(flat)).astype(np.int32), mask=np.append(missing, False) if missing.any() else None)
    return pa.ListArray.from_arrays(offsets, pa.array(flat))


def power_spectrum(values: str | Column) -> Column:
    """One-sided power of the mean-removed window, from the zero bin up.

    The Arrow function is made anew for every call: a used one holds a handle of
    the JVM, and one held by the module would go with every function that names it.
    """

    @F.arrow_udf(DOUBLES)
    def power(windows: pa.Array) -> pa.Array:
        return spectra(windows)

    return power(values)


def cepstrum(power: Column, count: int) -> Column:
    """Coefficients 1..count of the orthonormal DCT-II of the log power without the zero bin."""

    @F.arrow_udf(DOUBLES)
    def transform(values: pa.Array) -> pa.Array:
        def kernel(m: np.ndarray) -> np.ndarray:
            n = m.shape[1]
            if n < count + 1:
                raise ValueError(f"{n} spectrum bins are too few for {count} cepstral coefficients")
            k = np.arange(1, count + 1)
            basis = np.sqrt(2 / n) * np.cos(np.pi * np.outer(2 * np.arange(n) + 1, k) / (2 * n))
            return np.log(m + LOG_FLOOR) @ basis

        return by_length(values, kernel)

    return transform(power)


def without_dc(power: Column, size: int | None = None) -> Column:
    """Bins 1.. of a spectrum, up to half the window (the last bin of an even window)."""
    return F.slice(power, F.lit(2), F.size(power) - 1) if size is None else F.slice(power, 2, size // 2)


def band_power(power: Column, low: int, high: int) -> Column:
    """Power of bins low <= k < high."""
    return total(F.slice(power, low + 1, max(high - low, 0)))


def hertz_bands(size: int, rate: float, edges: Sequence[float]) -> list[tuple[int, int]]:
    """Bin ranges of bands in Hz: edges rounded to bins, the last band ends at Nyquist."""
    width = rate / size
    bins = [round(edge / width) for edge in edges] + [size // 2 + 1]
    return list(zip(bins[:-1], bins[1:]))


def log_bands(size: int, count: int = 4) -> list[tuple[int, int]]:
    """Bin ranges of bands ending at 1/8, 1/4, 1/2 and all of the spectrum (for four bands)."""
    half = size // 2
    edges = [0.0] + [half / 2**p for p in range(count - 1, 0, -1)] + [float(half)]
    inside = [[k for k in range(1, half + 1) if a < k <= b] for a, b in zip(edges[:-1], edges[1:])]
    return [(ks[0], ks[-1] + 1) if ks else (1, 1) for ks in inside]


def dominant_bin(power: Column) -> Column:
    """Number of the strongest bin after the zero bin (the first one on a tie)."""
    tail = without_dc(power)
    return F.array_position(tail, F.array_max(tail))


def entropy(bins: Column, log: Callable[[Column], Column]) -> Column:
    """Entropy of the power shares; 0 when there is no power."""

    def of_shares(b: Column) -> Column:
        gain = lambda s, p: s - F.when(p / b["t"] > 0, p / b["t"] * log(p / b["t"])).otherwise(0.0)
        return F.when(b["t"] > 0, F.aggregate(b["a"], F.lit(0.0), gain)).otherwise(0.0)

    # The total is bound once per array, as in ``centred``.
    return F.element_at(F.transform(F.transform(F.array(bins), lambda a: F.struct(a.alias("a"), total(a).alias("t"))), of_shares), 1)


def entropy_bits(bins: Column) -> Column:
    return entropy(bins, F.log2)


def flat_entropy(bins: Column) -> Column:
    """Entropy in nats over the entropy of a flat spectrum, between 0 and 1."""
    return entropy(bins, F.ln) / F.ln(F.size(bins))


def flat_entropies(power: pa.Array) -> pa.Array:
    """``flat_entropy`` of the bins after the zero bin of many spectra, in the same order of sums; null for fewer than two of them."""

    def kernel(m: np.ndarray) -> np.ndarray:
        bins, out = np.asfortranarray(m[:, 1:]).T, np.zeros(len(m))
        if len(bins) < 2:
            return np.full((len(m), 1), np.nan)
        total = np.zeros(len(m))
        for p in bins:
            total = total + p
        with np.errstate(divide="ignore", invalid="ignore"):
            for p in bins:
                share = p / total
                out = out - np.where(share > 0, share * np.log(np.where(share > 0, share, 1.0)), 0.0)
        # no power has no entropy, a spectrum of a missing sample none that is known
        out = np.where(np.isnan(total), np.nan, np.where(total > 0, out, 0.0))
        return out[:, None] / np.log(len(bins))

    few = pc.list_value_length(power).to_numpy(zero_copy_only=False) < 3
    return pa.array(by_length(power, kernel).flatten().to_numpy(zero_copy_only=False), mask=few)


def haar_details(values: str | Column, levels: int = 3) -> Column:
    """Detail coefficients of the Haar levels, finest first; a level of odd size repeats its last value.

    Every coefficient is a signed sum of samples: at level k, sample positions
    follow from the coefficient's place by doubling k times, held inside each
    level's size, and the first half of them counts positive.
    """
    values = F.col(values) if isinstance(values, str) else values
    sizes = [F.size(values)]
    for _ in range(levels):
        sizes.append(F.floor((sizes[-1] + 1) / 2).cast("int"))

    def sample(place: Column, halves: tuple[int, ...]) -> Column:
        for level, half in zip(reversed(range(len(halves))), halves):
            place = F.least(place * 2 + half, sizes[level] - 1)
        return F.element_at(values, (place + 1).cast("int"))

    def level(k: int) -> Column:
        paths = list(product((0, 1), repeat=k))
        signed = lambda i: sum((sample(i, h) * (-1 if h[0] else 1) for h in paths), F.lit(0.0)) * 0.5 ** (k / 2)
        return F.transform(F.sequence(F.lit(0), sizes[k] - 1), signed)

    return F.concat(*[level(k) for k in range(1, levels + 1)])
