"""Hidden Markov models over sequences of any length.

A sequence is cut into parts of bounded length. A part on its own gives the
matrix that takes the states before it to the states at its end (sums of
probabilities for expectation, best paths for decoding). The matrices of a
sequence, a few hundred numbers for each part, are scanned from both ends: that
gives each part the states that enter it and what follows it. With these its
expected counts, or its best path, are those of the whole sequence, so results
do not depend on the cuts. Sequences of one part skip the scan.

A sequence without frames has no part; a label without a model takes no part.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.operators.models.sequences import StateModel, chosen, expectation, log_sum, nested
from strideframe.operators.ordered import attach, chunk_by_position

#: Frames of a part.
LONGEST = 1 << 14


def cut_frames(rows: DataFrame, key: str, features: str, label: str | None = None, pos: str = "pos", longest: int = LONGEST, whole: str | None = None) -> DataFrame:
    """(key, part, offset, whole, label, frames) from rows that are numbered 0.. within their sequence; ``whole`` names its length if the rows hold it."""
    named = rows.select(key, F.col(pos).cast("long").alias("pos"), F.col(features).alias("x"), (F.col(label) if label else F.lit(0)).cast("int").alias("label"), *([F.col(whole).cast("long").alias("whole")] if whole else []))
    if whole:
        sized = named
    else:
        sizes = named.groupBy(key).agg((F.max("pos") + 1).alias("whole"))
        sized = attach(chunk_by_position(named, "pos"), sizes, [key])
    sized = sized.withColumn("part", F.floor(F.col("pos") / longest).cast("long"))
    frames = F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("frames")
    return sized.groupBy(key, "part").agg(F.min("pos").alias("offset"), F.first("whole").alias("whole"), F.first("label").alias("label"), frames)


def _array(frames) -> np.ndarray:
    return np.array([np.asarray(f, dtype=np.float64) for f in frames]).reshape(len(frames), -1)


def _logs(model: StateModel) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(divide="ignore"):
        return np.log(model.start), np.log(model.moves)


def through(model: StateModel, frames: np.ndarray, first: bool, best: bool = False) -> np.ndarray:
    """Log weight from every state before a part (one row only if it is the first) to every state at its end.

    The weight is that of all paths, or with ``best`` of the best one.
    """
    start, moves = _logs(model)
    density = log_sum(model.emissions(frames), 2)
    meet = (lambda v: v.max(axis=1)) if best else (lambda v: log_sum(v, 1))
    now = (start if first else moves) + density[0]
    now = now[None] if first else now
    for d in density[1:]:
        now = meet(now[:, :, None] + moves[None]) + d
    return now


def part_statistics(model: StateModel, frames: np.ndarray, before: np.ndarray | None, after: np.ndarray, total: float) -> np.ndarray:
    """Sums as in ``StateModel.statistics`` of one part, given the log weights that enter and follow it."""
    start, moves = _logs(model)
    parts = model.emissions(frames)
    density = log_sum(parts, 2)
    alpha, beta = np.empty(density.shape), np.empty(density.shape)
    alpha[0] = (start if before is None else log_sum(before[:, None] + moves, 0)) + density[0]
    for t in range(1, len(density)):
        alpha[t] = log_sum(alpha[t - 1][:, None] + moves, 0) + density[t]
    beta[-1] = after
    for t in range(len(density) - 2, -1, -1):
        beta[t] = log_sum(moves + (density[t + 1] + beta[t + 1])[None], 1)
    ahead = density + beta
    pairs = np.zeros(moves.shape)
    for k in range(0, len(density) - 1, 4096):
        upto = min(k + 4096, len(density) - 1)
        pairs += np.exp(alpha[k:upto, :, None] + moves + ahead[k + 1 : upto + 1, None, :] - total).sum(axis=0)
    if before is not None:  # the step from the part before
        pairs += np.exp(before[:, None] + moves + ahead[0][None] - total)
    gamma = np.exp(alpha + beta - total)
    share = gamma[..., None] * np.exp(parts - density[..., None])
    sums, squares = np.einsum("tsk,td->skd", share, frames), np.einsum("tsk,td->skd", share, frames**2)
    opens = before is None
    return np.concatenate([[total if opens else 0.0, float(opens)], gamma[0] * opens, pairs.ravel(), share.sum(axis=0).ravel(), sums.ravel(), squares.ravel()])


def _kind(df: DataFrame, key: str) -> str:
    return dict(df.dtypes)[key]


def matrices(parts: DataFrame, key: str, models: dict[int, StateModel], every: bool = False, best: bool = False) -> DataFrame:
    """(key, model, part, w): what ``through`` gives by the model of the part's label, or by ``every`` model."""

    def run(frames):
        for pdf in frames:
            out = []
            for name, part, label, x in zip(pdf[key], pdf["part"], pdf["label"], pdf["frames"]):
                for number in models if every else [label] if label in models else []:
                    out.append((name, number, part, through(models[number], _array(x), part == 0, best).ravel()))
            yield pd.DataFrame(out, columns=[key, "model", "part", "w"])

    return parts.select(key, "part", "label", "frames").mapInPandas(run, f"{key} {_kind(parts, key)}, model int, part long, w array<double>")


def scanned(table: DataFrame, key: str, states: dict[int, int]) -> DataFrame:
    """(key, model, part, before, after, total): both scans over the matrices of every sequence."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        number = int(pdf["model"].iloc[0])
        steps = [np.asarray(w).reshape(-1, states[number]) for w in pdf["w"]]
        ways = [steps[0][0]]
        for w in steps[1:]:
            ways.append(log_sum(ways[-1][:, None] + w, 0))
        after = [np.zeros(states[number])]
        for w in reversed(steps[1:]):
            after.append(log_sum(w + after[-1][None], 1))
        out = pd.DataFrame({key: pdf[key], "model": pdf["model"], "part": pdf["part"]})
        out["before"] = [None, *ways[:-1]]
        out["after"] = after[::-1]
        out["total"] = float(log_sum(ways[-1], 0))
        return out

    schema = f"{key} {_kind(table, key)}, model int, part long, before array<double>, after array<double>, total double"
    return table.groupBy(key, "model").applyInPandas(run, schema)


def cut_expectation(parts: DataFrame, models: dict[int, StateModel], label: str = "label", frames: str = "frames", key: str = "recording") -> dict[int, np.ndarray]:
    """Summed statistics per label, as ``sequences.expectation`` gives for whole sequences."""
    alone = F.size("frames") == F.col("whole")
    sums = expectation(parts.filter(alone), models, "label", "frames")
    cut = parts.filter(~alone)
    edges = scanned(matrices(cut, key, models), key, {k: len(m.start) for k, m in models.items()})

    def run(batches):
        for pdf in batches:
            held: dict[int, np.ndarray] = {}
            for number, x, before, after, total in zip(pdf["model"], pdf["frames"], pdf["before"], pdf["after"], pdf["total"]):
                own = part_statistics(models[number], _array(x), None if before is None else np.asarray(before), np.asarray(after), total)
                held[number] = held[number] + own if number in held else own
            yield pd.DataFrame({"model": list(held), "flat": list(held.values())})

    met = cut.join(edges, [key, "part"]).select("model", "frames", "before", "after", "total")
    found = met.mapInPandas(run, "model int, flat array<double>").groupBy("model").agg(vector_to_array(Summarizer.sum(array_to_vector("flat"))).alias("flat"))
    for r in found.collect():
        sums[r["model"]] = sums.get(r["model"], 0.0) + np.array(r["flat"])
    return sums


def likelihoods(parts: DataFrame, key: str, models: dict[int, StateModel]) -> DataFrame:
    """(key, model, total): log likelihood of every sequence under every model."""
    alone = F.size("frames") == F.col("whole")

    def run(batches):
        for batch in batches:
            flat, lengths = nested(batch.column(1))
            for number, model in models.items():
                total = model.likelihoods(flat, lengths)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(total), number, dtype=np.int32)), pa.array(total)], names=[key, "model", "total"])

    whole = parts.filter(alone).select(key, "frames").mapInArrow(run, f"{key} {_kind(parts, key)}, model int, total double")
    edges = scanned(matrices(parts.filter(~alone), key, models, every=True), key, {k: len(m.start) for k, m in models.items()})
    return whole.unionByName(edges.filter("part = 0").select(key, "model", "total"))


def classify(parts: DataFrame, key: str, models: dict[int, StateModel]) -> DataFrame:
    """(key, guess): the model of the highest likelihood, the lower number on ties."""
    best = F.max_by("model", F.struct("total", -F.col("model"))).alias("guess")
    return likelihoods(parts, key, models).groupBy(key).agg(best)


def paths(parts: DataFrame, key: str, model: StateModel) -> DataFrame:
    """(key, pos, state): most likely states of whole sequences."""
    states = len(model.start)

    def edges(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        steps = [np.asarray(w).reshape(-1, states) for w in pdf["w"]]
        ways = [steps[0][0]]
        for w in steps[1:]:
            ways.append((ways[-1][:, None] + w).max(axis=0))
        end = [int(ways[-1].argmax())]
        for way, w in zip(ways[-2::-1], steps[:0:-1]):
            end.append(int((way + w[:, end[-1]]).argmax()))
        end.reverse()
        return pd.DataFrame({key: pdf[key], "part": pdf["part"], "enters": [-1, *end[:-1]], "leaves": end})

    kind = _kind(parts, key)
    alone = F.size("frames") == F.col("whole")
    cut = parts.filter(~alone)
    table = matrices(cut.withColumn("label", F.lit(0)), key, {0: model}, best=True)
    told = table.groupBy(key).applyInPandas(edges, f"{key} {kind}, part long, enters int, leaves int")

    def run(batches):
        start, moves = _logs(model)
        for pdf in batches:
            out = []
            for name, offset, x, enters, leaves in zip(pdf[key], pdf["offset"], pdf["frames"], pdf["enters"], pdf["leaves"]):
                density = log_sum(model.emissions(_array(x)), 2)
                score, back = (start if enters < 0 else moves[enters]) + density[0], np.zeros(density.shape, dtype=int)
                for t in range(1, len(density)):
                    step = score[:, None] + moves
                    back[t], score = step.argmax(axis=0), step.max(axis=0) + density[t]
                path = np.empty(len(density), dtype=int)
                path[-1] = leaves
                for t in range(len(density) - 1, 0, -1):
                    path[t - 1] = back[t, path[t]]
                out.append(pd.DataFrame({key: [name] * len(path), "pos": offset + np.arange(len(path)), "state": path}))
            if out:
                yield pd.concat(out, ignore_index=True)

    def run_whole(batches):
        for batch in batches:
            flat, lengths = nested(batch.column(1))
            for at in np.array_split(np.arange(len(lengths)), max(1, len(flat) >> 18)):  # a batch out holds some 2^18 frames
                mask = np.zeros(len(lengths), dtype=bool)
                mask[at] = True
                own, n = chosen(flat, lengths, mask)
                names = batch.column(0).take(pa.array(np.repeat(at, n)))
                pos = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
                yield pa.RecordBatch.from_arrays([names, pa.array(pos), pa.array(model.best_paths(own, n))], names=[key, "pos", "state"])

    schema = f"{key} {kind}, pos long, state int"
    whole = parts.filter(alone).select(key, "frames").mapInArrow(run_whole, schema)
    return whole.unionByName(cut.join(told, [key, "part"]).select(key, "offset", "frames", "enters", "leaves").mapInPandas(run, schema))
