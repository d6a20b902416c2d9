"""Singular spectrum of series that no task holds whole.

A vector of the length of the window (half the series) lies in chunks, like the
series. A product with the trajectory matrix or its transpose is a correlation
with the series: each chunk of the vector meets the stretches of the series that
it reaches (two chunks long, the second one is the halo), and the products that
belong to one chunk of the result are added up. A block Krylov basis grows by
the residuals of the best Ritz vectors and is restarted from these when it is
full. What the driver sees of a series are products of basis vectors, a matrix
of some tens of rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideframe.session import stored

#: Vectors of a basis, in blocks, before it is restarted.
HELD_BLOCKS = 6


def flat(matrix: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(matrix, dtype=np.float64).ravel()


def _kind(df: DataFrame, key: str) -> str:
    return dict(df.dtypes)[key]


def _total(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    return df.groupBy(*keys).agg(vector_to_array(Summarizer.sum(array_to_vector(F.col(column)))).alias(column))


def stretches(chunks: DataFrame, key: str, size: int) -> DataFrame:
    """(key, s, h): the series from chunk s on, two chunks long, zeros beyond its end."""
    full = lambda c: F.concat(c, F.array_repeat(F.lit(0.0), F.lit(size) - F.size(c)))
    rows = chunks.select(key, F.col("chunk").alias("s"), full(F.col("v")).alias("h"))
    after = rows.select(F.col(key).alias("__k"), (F.col("s") - 1).alias("__s"), F.col("h").alias("__h"))
    joined = rows.join(after, (F.col(key) == F.col("__k")) & (F.col("s") == F.col("__s")), "left")
    return joined.select(key, "s", F.concat("h", F.coalesce("__h", F.array_repeat(F.lit(0.0), size))).alias("h"))


def correlate(vectors: DataFrame, parts: DataFrame, key: str, size: int, length: Column) -> DataFrame:
    """Products of every vector with the series moved by 0 .. length - 1: (key, whole, c, w).

    ``vectors``: key, whole, c (chunk), w (rows of values, one after another) and rows (their number).
    """
    last = F.floor((length - 1) / size)
    wide = vectors.select(key, "whole", "rows", F.col("c").alias("b"), "w", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("c"), length.alias("length"))
    met = wide.withColumn("s", F.col("b") + F.col("c")).join(parts, [key, "s"])

    def run(frames):
        for pdf in frames:
            out = []
            for name, whole, rows, c, length, w, h in zip(pdf[key], pdf["whole"], pdf["rows"], pdf["c"], pdf["length"], pdf["w"], pdf["h"]):
                w = np.asarray(w).reshape(rows, -1)
                points = 1 << (2 * size + w.shape[1] - 1).bit_length()
                many = min(size, int(length) - int(c) * size)
                spectrum = np.fft.rfft(np.asarray(h), points) * np.conj(np.fft.rfft(w, points, axis=1))
                out.append((name, whole, rows, c, flat(np.fft.irfft(spectrum, points, axis=1)[:, :many])))
            yield pd.DataFrame(out, columns=[key, "whole", "rows", "c", "w"])

    made = met.select(key, "whole", "rows", "c", "length", "w", "h").mapInPandas(run, f"{key} {_kind(vectors, key)}, whole long, rows int, c long, w array<double>")
    return _total(made, [key, "whole", "rows", "c"], "w")


def convolve(left: DataFrame, right: DataFrame, key: str, size: int) -> DataFrame:
    """Sums u[i] r[p - i] of matching rows of two sets of vectors, for all p: (key, rows, c, w)."""
    other = right.select(F.col(key).alias("__k"), F.col("c").alias("d"), F.col("w").alias("r"))
    met = left.join(other, F.col(key) == F.col("__k"))

    def run(frames):
        for pdf in frames:
            out = []
            for name, rows, b, d, u, r in zip(pdf[key], pdf["rows"], pdf["c"], pdf["d"], pdf["w"], pdf["r"]):
                u, r = np.asarray(u).reshape(rows, -1), np.asarray(r).reshape(rows, -1)
                points = 1 << (u.shape[1] + r.shape[1] - 1).bit_length()
                both = np.fft.irfft(np.fft.rfft(u, points, axis=1) * np.fft.rfft(r, points, axis=1), points, axis=1)
                padded = np.zeros((rows, 2 * size))
                many = min(2 * size, u.shape[1] + r.shape[1] - 1)
                padded[:, :many] = both[:, :many]
                out += [(name, rows, b + d + k, flat(padded[:, k * size : (k + 1) * size])) for k in range(2)]
            yield pd.DataFrame(out, columns=[key, "rows", "c", "w"])

    made = met.select(key, "rows", "c", "d", "w", "r").mapInPandas(run, f"{key} {_kind(left, key)}, rows int, c long, w array<double>")
    return _total(made, [key, "rows", "c"], "w")


def products(state: DataFrame, key: str, columns: list[str], rows: list[int]) -> dict:
    """Products of all vectors of the columns, one below another, for every series."""

    def run(frames):
        for pdf in frames:
            out = []
            for name, *held in zip(pdf[key], *[pdf[c] for c in columns]):
                stack = np.vstack([np.asarray(h).reshape(n, -1) for h, n in zip(held, rows) if n])
                out.append((name, flat(stack @ stack.T)))
            yield pd.DataFrame(out, columns=[key, "g"])

    found = _total(state.select(key, *columns).mapInPandas(run, f"{key} {_kind(state, key)}, g array<double>"), [key], "g").collect()
    n = sum(rows)
    return {r[key]: np.array(r["g"]).reshape(n, n) for r in found}


def combine(state: DataFrame, key: str, columns: list[str], rows: list[int], make: dict[str, dict]) -> DataFrame:
    """New columns as combinations of the vectors of all ``columns``: column -> series -> matrix."""
    fields = list(state.columns)
    schema = ", ".join(f"{c} {_kind(state, c)}" for c in fields)
    for c in make:
        schema += "" if c in fields else f", {c} array<double>"

    def run(frames):
        for pdf in frames:
            done: dict[str, list] = {c: [] for c in make}
            for name, *held in zip(pdf[key], *[pdf[c] for c in columns]):
                stack = np.vstack([np.asarray(h).reshape(n, -1) for h, n in zip(held, rows) if n])
                for c, matrices in make.items():
                    done[c].append(flat(matrices[name] @ stack))
            for c, values in done.items():
                pdf[c] = values
            yield pdf[[*fields, *[c for c in make if c not in fields]]]

    return state.mapInPandas(run, schema)


def orthonormal(state: DataFrame, key: str, held: int, block: int) -> DataFrame:
    """The vectors of ``block`` at right angles to ``basis`` and each other; dependent ones become zero."""
    for _ in range(2):
        grams = products(state, key, ["basis", "block"], [held, block])
        make = {}
        for name, g in grams.items():
            cross = g[held:, :held]
            inner = g[held:, held:] - cross @ cross.T
            power, turn = np.linalg.eigh((inner + inner.T) / 2)
            strong = power > 1e-13 * max(g[held:, held:].max(), 1e-300)
            scale = np.where(strong, 1 / np.sqrt(np.where(strong, power, 1)), 0)
            own = scale[:, None] * turn.T
            make[name] = np.hstack([-own @ cross, own])
        state = stored(combine(state, key, ["basis", "block"], [held, block], {"block": make}))
    return state


def leading(chunks: DataFrame, key: str, size: int, kept: int, tolerance: float = 1e-11, most: int = 200) -> DataFrame:
    """Leading singular-spectrum components of long series: (key, component, share, residual, chunk, values).

    ``chunks``: key, chunk, whole, v (``size`` values, the last one fewer). The
    windows are half a series long. Ends when the residuals of the ``kept`` best
    pairs are below ``tolerance`` of the largest eigenvalue; after ``most`` blocks
    an error says how far it got.
    """
    width = kept + 3
    parts = stored(stretches(chunks, key, size))
    window, lags = F.floor(F.col("whole") / 2), F.col("whole") - F.floor(F.col("whole") / 2) + 1
    kind = _kind(chunks, key)

    def begin(frames):
        for pdf in frames:
            out = []
            for name, whole, c in zip(pdf[key], pdf["whole"], pdf["chunk"]):
                many = min(size, whole // 2 - c * size)
                if many > 0:
                    out.append((name, whole, c, np.zeros(0), np.zeros(0), flat(np.random.default_rng([7, c]).normal(size=(width, many)))))
            yield pd.DataFrame(out, columns=[key, "whole", "c", "basis", "image", "block"])

    state = chunks.select(key, "whole", "chunk").mapInPandas(begin, f"{key} {kind}, whole long, c long, basis array<double>, image array<double>, block array<double>")
    state, held = stored(state), 0

    def times(vectors: DataFrame, rows: int) -> DataFrame:
        """The trajectory matrix times its transpose times the vectors."""
        across = correlate(vectors.withColumn("rows", F.lit(rows)), parts, key, size, lags)
        return correlate(across, parts, key, size, window)

    for step in range(most):
        state = orthonormal(state, key, held, width)
        image = times(state.select(key, "whole", "c", F.col("block").alias("w")), width)
        joined = state.join(image.select(key, "c", "w"), [key, "c"])
        state = stored(joined.select(key, "whole", "c", F.concat("basis", "block").alias("basis"), F.concat("image", "w").alias("image")))
        held += width
        grams = products(state, key, ["basis", "image"], [held, held])
        turns, powers = {}, {}
        for name, g in grams.items():
            power, turn = np.linalg.eigh((g[:held, held:] + g[held:, :held]) / 2)
            powers[name], turns[name] = power[::-1], turn[:, ::-1]
        rest = {n: np.hstack([-(t[:, :width] * powers[n][:width]).T, t[:, :width].T]) for n, t in turns.items()}
        make: dict[str, dict] = {"block": rest}
        if held + width > HELD_BLOCKS * width:  # begin anew from the best ones
            zero = np.zeros((2 * width, held))
            make["basis"] = {n: np.hstack([t[:, : 2 * width].T, zero]) for n, t in turns.items()}
            make["image"] = {n: np.hstack([zero, t[:, : 2 * width].T]) for n, t in turns.items()}
            turns = {n: np.eye(2 * width) for n in turns}
        state = stored(combine(state, key, ["basis", "image"], [held, held], make))
        held = 2 * width if "basis" in make else held
        sizes = products(state, key, ["block"], [width])
        worst = max((float(np.sqrt(np.maximum(np.diag(g)[:kept], 0)).max() / max(powers[n][0], 1e-300)) for n, g in sizes.items()), default=0.0)
        if worst <= tolerance:
            break
    else:
        raise RuntimeError(f"After {most} blocks the residuals are still {worst:.1e} of the largest eigenvalue")
    left = combine(state, key, ["basis"], [held], {"w": {n: t[:, :kept].T for n, t in turns.items()}})
    left = stored(left.select(key, "whole", "c", "w", F.lit(kept).alias("rows")))
    right = correlate(left, parts, key, size, lags)
    series = chunks.select(key, "whole", F.col("chunk").alias("c"), "v")
    many = F.least(F.col("c") * size + F.col("i") + 1, window, lags, F.col("whole") - F.col("c") * size - F.col("i"))
    weight = series.select(key, "whole", "c", F.posexplode("v").alias("i", "x"))
    total = {r[key]: r["t"] for r in weight.groupBy(key).agg(F.sum(many * F.col("x") * F.col("x")).alias("t")).collect()}

    def finish(frames):
        for pdf in frames:
            out = []
            for name, whole, c, w in zip(pdf[key], pdf["whole"], pdf["c"], pdf["w"]):
                place = c * size + np.arange(size)
                place = place[place < whole]
                cells = np.minimum(np.minimum(place + 1, whole - place), min(whole // 2, whole - whole // 2 + 1))
                values = np.asarray(w).reshape(kept, -1)[:, : len(place)] / cells
                for k in range(kept):
                    out.append((name, k, float(powers[name][k] / total[name]) if total[name] > 0 else 0.0, c, values[k]))
            yield pd.DataFrame(out, columns=[key, "component", "share", "chunk", "values"])

    sums = convolve(left, right, key, size).join(series.select(key, "whole", "c"), [key, "c"])
    return sums.select(key, "whole", "c", "w").mapInPandas(finish, f"{key} {kind}, component int, share double, chunk long, values array<double>")
