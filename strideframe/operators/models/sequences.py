"""Diagonal Gaussian mixtures and hidden Markov models by expectation maximisation.

One round is one Spark job: tasks turn their sequences into sums of expected
counts, values and squares, the sums are added up by Spark, and the driver
updates the few parameters. Here sequences are rows holding a bounded array of
frames; ``cut_sequences`` takes sequences of any length, in parts, and gives its
own ``expect`` to the fits.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLOOR = 1e-3
#: Frames of a block that is worked on at once.
BLOCK_FRAMES = 1 << 15
#: Models whose probabilities all reach this are summed as scaled products, others as logarithms.
SMALLEST_MOVE = 1e-100


def log_sum(values: np.ndarray, axis: int) -> np.ndarray:
    top = values.max(axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.squeeze(top, axis) + np.log(np.exp(values - top).sum(axis=axis))


@dataclass
class StateModel:
    """Start, transitions, and per state a mixture of diagonal Gaussians."""

    start: np.ndarray
    moves: np.ndarray
    weights: np.ndarray
    means: np.ndarray
    variances: np.ndarray
    history: list[float] = field(default_factory=list)

    def emissions(self, frames: np.ndarray) -> np.ndarray:
        """Log density of every part: (..., states, parts)."""
        quadratic = np.zeros((*frames.shape[:-1], *self.means.shape[:2]))
        for d in range(frames.shape[-1]):
            quadratic += (frames[..., d, None, None] - self.means[..., d]) ** 2 / self.variances[..., d]
        constant = np.log(2 * np.pi * self.variances).sum(axis=-1)
        with np.errstate(divide="ignore"):
            return np.log(self.weights) - 0.5 * (quadratic + constant)

    def logs(self) -> tuple[np.ndarray, np.ndarray]:
        with np.errstate(divide="ignore"):
            return np.log(self.start), np.log(self.moves)

    def forward(self, density: np.ndarray, active: np.ndarray | None = None) -> np.ndarray:
        """Log weights (time, sequences, states) of the states after every frame; the first ``active[t]`` sequences have a frame t."""
        start, moves = self.logs()
        active = np.full(len(density), density.shape[1]) if active is None else active
        out = np.full(density.shape, -np.inf)
        out[0] = start + density[0]
        for t in range(1, len(density)):
            k = active[t]
            out[t, :k] = log_sum(out[t - 1, :k, :, None] + moves, 1) + density[t, :k]
        return out

    def likelihood(self, frames: np.ndarray) -> np.ndarray:
        """Log likelihood of every sequence of a block of equally long ones."""
        n, length = frames.shape[:2]
        return self.likelihoods(frames.reshape(n * length, -1), np.full(n, length))

    def likelihoods(self, flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Log likelihood of every sequence; ``flat`` holds their frames below one another (0 for a sequence without frames)."""
        out = np.zeros(len(lengths))
        for at, n, active, frames in blocks(flat, lengths):
            alpha = self.forward(log_sum(self.emissions(frames), 3), active)
            out[at] = log_sum(alpha[n - 1, np.arange(len(n))], 1)
        return out

    def log_shares(self, density: np.ndarray, n: np.ndarray, active: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Likelihoods, state shares and summed state pairs of a block, by sums of logarithms."""
        _, moves = self.logs()
        alpha = self.forward(density, active)
        total = log_sum(alpha[n - 1, np.arange(len(n))], 1)
        beta = np.zeros(density.shape)
        pairs = np.zeros(self.moves.shape)
        for t in range(len(density) - 2, -1, -1):
            k = active[t + 1]
            ahead = density[t + 1, :k] + beta[t + 1, :k]
            beta[t, :k] = log_sum(moves + ahead[:, None, :], 2)
            pairs += np.exp(alpha[t, :k, :, None] + moves + ahead[:, None, :] - total[:k, None, None]).sum(axis=0)
        return total, np.exp(alpha + beta - total[:, None]), pairs

    def scaled_shares(self, density: np.ndarray, n: np.ndarray, active: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same by scaled products, for models where every state follows every other.

        A weight that leaves the doubles is below 1e-300 of its frame; no later
        frame can raise it by more than 1 / ``SMALLEST_MOVE``.
        """
        top = density.max(axis=2)
        weight = np.exp(density - top[..., None])
        alpha, scale = np.zeros(density.shape), np.ones(top.shape)
        for t in range(len(density)):
            k = active[t]
            now = (alpha[t - 1, :k] @ self.moves if t else self.start) * weight[t, :k]
            scale[t, :k] = now.sum(axis=1)
            alpha[t, :k] = now / scale[t, :k, None]
        total = np.where(np.arange(len(density))[:, None] < n, np.log(scale) + top, 0.0).sum(axis=0)
        beta = np.ones(density.shape)
        pairs = np.zeros(self.moves.shape)
        weight /= scale[..., None]
        for t in range(len(density) - 2, -1, -1):
            k = active[t + 1]
            ahead = weight[t + 1, :k] * beta[t + 1, :k]
            beta[t, :k] = ahead @ self.moves.T
            pairs += alpha[t, :k].T @ ahead
        return total, alpha * beta, pairs * self.moves

    def statistics(self, frames: np.ndarray) -> np.ndarray:
        """Flat sums over a block of equally long sequences (see ``update``)."""
        n, length = frames.shape[:2]
        return self.expected(frames.reshape(n * length, -1), np.full(n, length))

    def expected(self, flat: np.ndarray, lengths: np.ndarray) -> np.ndarray | float:
        """Flat sums (see ``update``) over sequences of any lengths; ``flat`` holds their frames below one another."""
        sums: np.ndarray | float = 0.0
        even = min(self.start.min(), self.moves.min()) >= SMALLEST_MOVE
        for _, n, active, frames in blocks(flat, lengths):
            parts = self.emissions(frames)
            density = log_sum(parts, 3)
            shares = self.scaled_shares if even and np.isfinite(density).all() else self.log_shares
            total, gamma, pairs = shares(density, n, active)
            gamma = np.where((np.arange(len(density))[:, None] < n)[..., None], gamma, 0.0)
            share = (gamma[..., None] * np.exp(parts - density[..., None])).reshape(-1, self.weights.size)
            frames = frames.reshape(len(share), -1)
            sums = sums + np.concatenate([
                [total.sum(), len(n)], gamma[0].sum(axis=0), pairs.ravel(), share.sum(axis=0), (share.T @ frames).ravel(), (share.T @ frames**2).ravel(),
            ])
        return sums

    def update(self, flat: np.ndarray, floor: float) -> StateModel:
        s, k, d = self.means.shape
        cuts = np.cumsum([2, s, s * s, s * k, s * k * d])
        head, start, pairs, mass, sums, squares = np.split(flat, cuts)
        mass = mass.reshape(s, k)
        safe = np.maximum(mass, 1e-12)[..., None]
        means = np.where(mass[..., None] > 1e-9, sums.reshape(s, k, d) / safe, self.means)
        variances = np.where(mass[..., None] > 1e-9, squares.reshape(s, k, d) / safe - means**2, self.variances)
        pairs = pairs.reshape(s, s)
        rows = pairs.sum(axis=1, keepdims=True)
        moves = np.where(rows > 1e-12, pairs / np.maximum(rows, 1e-12), self.moves)
        states = mass.sum(axis=1, keepdims=True)
        weights = np.where(states > 1e-12, mass / np.maximum(states, 1e-12), self.weights)
        first = start / start.sum() if start.sum() > 0 else self.start
        return StateModel(first, moves, weights, means, np.maximum(variances, floor), [*self.history, float(head[0])])

    def best_path(self, frames: np.ndarray) -> np.ndarray:
        """Most likely states of one sequence."""
        return self.best_paths(frames, np.array([len(frames)]))

    def best_paths(self, flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Most likely states of every sequence, below one another like the frames."""
        start, moves = self.logs()
        out, starts = np.zeros(len(flat), dtype=np.int32), np.cumsum(lengths) - lengths
        for at, n, active, frames in blocks(flat, lengths):
            density = log_sum(self.emissions(frames), 3)
            score, back = start + density[0], np.zeros(density.shape, dtype=np.int32)
            for t in range(1, len(density)):
                k = active[t]
                step = score[:k, :, None] + moves
                back[t, :k] = step.argmax(axis=1)
                score[:k] = step.max(axis=1) + density[t, :k]
            state = score.argmax(axis=1)
            for t in range(len(density) - 1, -1, -1):
                k = active[t]
                out[starts[at[:k]] + t] = state[:k]
                state[:k] = back[t, np.arange(k), state[:k]]
        return out


def blocks(flat: np.ndarray, lengths: np.ndarray):
    """Blocks of sequences of like length, longest first: their numbers, lengths, how many have a frame t, and frames (time, sequences, channels).

    A block holds about ``BLOCK_FRAMES`` frames or one sequence; shorter sequences repeat their last frame.
    """
    starts = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    while len(order):
        at = order[: max(1, BLOCK_FRAMES // int(lengths[order[0]]))]
        order = order[len(at) :]
        n = lengths[at]
        time = np.arange(n[0])[:, None]
        yield at, n, (time < n).sum(axis=1), flat[starts[at] + np.minimum(time, n - 1)]


def nested(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Frames of all sequences of an Arrow array below one another, and the number of frames of each."""
    lengths = pc.fill_null(pc.list_value_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    inner = values.flatten()
    flat = inner.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(inner), -1 if len(inner) else 0), lengths


def chosen(flat: np.ndarray, lengths: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sequences of a mask, as ``nested`` gives them."""
    return flat[np.repeat(mask, lengths)], lengths[mask]


def expectation(df: DataFrame, models: dict[int, StateModel], label: str, frames: str) -> dict[int, np.ndarray]:
    """Summed statistics per label: tasks emit one vector per label."""

    def work(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            flat, lengths = nested(batch.column(1))
            values = pc.fill_null(batch.column(0), -1).to_numpy(zero_copy_only=False)
            known = ~batch.column(0).is_null().to_numpy(zero_copy_only=False)
            for value in np.unique(values[known]):
                own = models[int(value)].expected(*chosen(flat, lengths, known & (values == value))) if int(value) in models else 0.0
                if not np.isscalar(own):
                    held[int(value)] = held[int(value)] + own if int(value) in held else own
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([v.tolist() for v in held.values()], pa.list_(pa.float64()))], names=["label", "flat"])

    rows = df.select(F.col(label).cast("int").alias("label"), F.col(frames).alias("frames"))
    parts = rows.mapInArrow(work, "label int, flat array<double>")
    sums = parts.groupBy("label").agg(vector_to_array(Summarizer.sum(array_to_vector("flat"))).alias("flat"))
    return {r["label"]: np.array(r["flat"]) for r in sums.collect()}


def fit_rounds(
    df: DataFrame, models: dict[int, StateModel], label: str, frames: str, rounds: int, floor: float, tolerance: float | None = None, expect: Callable = expectation
) -> dict[int, StateModel]:
    for _ in range(rounds):
        sums = expect(df, models, label, frames)
        models = {k: (m.update(sums[k], floor) if k in sums else m) for k, m in models.items()}
        if tolerance is not None and all(len(m.history) > 1 and m.history[-1] - m.history[-2] < tolerance for m in models.values()):
            break
    return models


def thirds(df: DataFrame, label: str, frames: str, states: int) -> DataFrame:
    """Per label and state: moments of the frames in that part of the sequences' time.

    Parts of sequences say with ``offset`` and ``whole`` where they lie.
    """
    cut = {"offset", "whole"} <= set(df.columns)
    n, first = (F.col("whole"), F.col("offset")) if cut else (F.size(frames), F.lit(0))
    long = df.select(F.col(label).cast("int").alias("label"), n.alias("n"), first.alias("o"), F.posexplode(frames).alias("t", "x"))
    long = long.withColumn("t", F.col("o") + F.col("t"))
    # The first (n mod states) parts are one frame longer.
    longer, short = F.col("n") % states, F.floor(F.col("n") / states)
    edge = longer * (short + 1)
    state = F.when(F.col("t") < edge, F.floor(F.col("t") / (short + 1))).otherwise(longer + F.floor((F.col("t") - edge) / F.greatest(short, F.lit(1))))
    stats = Summarizer.metrics("mean", "variance", "count").summary(array_to_vector("x")).alias("s")
    out = long.withColumn("state", state.cast("int")).groupBy("label", "state").agg(stats)
    return out.select("label", "state", "s.count", vector_to_array("s.mean").alias("mean"), vector_to_array("s.variance").alias("variance"))


def fit_left_right(df: DataFrame, label: str, frames: str = "frames", states: int = 3, rounds: int = 10, stay: float = 0.9, floor: float = FLOOR, expect: Callable = expectation) -> dict[int, StateModel]:
    """One left-to-right Gaussian model per class, started from equal parts of time."""
    moves = np.diag(np.full(states, stay)) + np.diag(np.full(states - 1, 1 - stay), k=1)
    moves[-1, -1] = 1.0
    models: dict[int, StateModel] = {}
    cells: dict[int, dict[int, tuple]] = {}
    for r in thirds(df, label, frames, states).collect():
        n = r["count"]
        cells.setdefault(r["label"], {})[r["state"]] = (np.array(r["mean"]), np.array(r["variance"]) * (n - 1) / n + floor, n)
    for k, parts in cells.items():
        # A class of short sequences leaves late states without frames; they start from the moments of the whole class.
        share = np.array([p[2] for p in parts.values()], dtype=float) / sum(p[2] for p in parts.values())
        middle = sum(s * p[0] for s, p in zip(share, parts.values()))
        spread = sum(s * (p[1] + (p[0] - middle) ** 2) for s, p in zip(share, parts.values()))
        parts = {i: parts.get(i, (middle, spread)) for i in range(states)}
        means = np.stack([parts[i][0] for i in range(states)])[:, None, :]
        variances = np.stack([parts[i][1] for i in range(states)])[:, None, :]
        models[k] = StateModel(np.eye(states)[0], moves, np.ones((states, 1)), means, variances)
    return fit_rounds(df, models, label, frames, rounds, floor, expect=expect)


def classify_sequences(models: dict[int, StateModel], frames: Column) -> Column:
    """Label whose model gives the sequence the highest likelihood."""
    labels = sorted(models)

    @F.arrow_udf("int")
    def best(values: pa.Array) -> pa.Array:
        flat, lengths = nested(values)
        scores = np.stack([models[k].likelihoods(flat, lengths) for k in labels], axis=1)
        return pa.array(np.where(lengths > 0, np.array(labels)[scores.argmax(axis=1)], 0).astype(np.int32))

    return best(frames)


def fit_ergodic(df: DataFrame, frames: str, states: int = 12, parts: int = 2, rounds: int = 20, seed: int = 42, floor: float = FLOOR, tolerance: float = 1e-2, expect: Callable = expectation) -> StateModel:
    """One model over all sequences with a mixture per state, started from k-means centres."""
    from strideframe.operators.models.ensembles import best_kmeans
    from strideframe.operators.prep import population_moments, to_vector

    points = df.select(F.explode(frames).alias("features"))
    centres = np.array(best_kmeans(to_vector(points), states, 1, seed).clusterCenters())
    states = len(centres)
    _, deviation, _ = population_moments(points)
    nudge = np.random.default_rng(seed).normal(scale=0.1, size=(states, parts, len(deviation))) * deviation
    start = StateModel(
        np.full(states, 1 / states), np.full((states, states), 1 / states), np.full((states, parts), 1 / parts), centres[:, None, :] + nudge,
        np.tile(np.maximum(deviation**2, floor), (states, parts, 1)),
    )
    return fit_rounds(df.withColumn("__one", F.lit(0)), {0: start}, "__one", frames, rounds, floor, tolerance, expect)[0]


def state_paths(model: StateModel, frames: Column) -> Column:
    @F.arrow_udf("array<int>")
    def paths(values: pa.Array) -> pa.Array:
        flat, lengths = nested(values)
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(model.best_paths(flat, lengths)))

    return paths(frames)


def fit_mixture(df: DataFrame, features: str = "features", parts: int = 12, rounds: int = 30, seed: int = 42, floor: float = 1e-6, tolerance: float = 1e-3) -> tuple[StateModel, bool]:
    """Diagonal Gaussian mixture: a one-state model on sequences of one frame. Also whether it settled."""
    from strideframe.operators.models.ensembles import best_kmeans
    from strideframe.operators.prep import population_moments, to_vector

    centres = np.array(best_kmeans(to_vector(df, features), parts, 1, seed).clusterCenters())
    parts = len(centres)
    _, deviation, n = population_moments(df, features)
    start = StateModel(np.ones(1), np.ones((1, 1)), np.full((1, parts), 1 / parts), centres[None], np.tile(np.maximum(deviation**2, floor), (1, parts, 1)))
    rows = df.select(F.array(F.col(features)).alias("frames"), F.lit(0).alias("__one"))
    model = fit_rounds(rows, {0: start}, "__one", "frames", rounds, floor, tolerance * n)[0]
    h = model.history
    return model, len(h) > 1 and h[-1] - h[-2] < tolerance * n


def mixture_part(model: StateModel, features: Column) -> Column:
    """Most likely part of the mixture for every row."""

    @F.pandas_udf("int")
    def part(values: pd.Series) -> pd.Series:
        rows = np.array(values.tolist(), dtype=np.float64)
        return pd.Series(model.emissions(rows)[:, 0, :].argmax(axis=1).astype(np.int32))

    return part(features)
