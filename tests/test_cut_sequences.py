"""Hidden Markov models over cut sequences against the same models over whole ones."""

from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from strideframe.operators.models import cut_sequences as cut, sequences as seq


def made():
    rng = np.random.default_rng(4)
    out = {}
    for k in range(6):
        n = [150, 61, 40, 1, 97, 30][k]
        state = np.cumsum(rng.random(n) < 0.1) % 3
        out[k] = state[:, None] * np.array([1.0, -2.0]) + rng.normal(size=(n, 2)) + k % 2
    return out


def model():
    moves = np.array([[0.8, 0.2, 0.0], [0.1, 0.7, 0.2], [0.3, 0.0, 0.7]])
    means = np.random.default_rng(1).normal(size=(3, 2, 2))
    return seq.StateModel(np.array([0.6, 0.4, 0.0]), moves, np.array([[0.5, 0.5], [0.9, 0.1], [0.2, 0.8]]), means, np.full((3, 2, 2), 1.5))


def parts(spark, data, longest):
    rows = [(k, t, x.tolist(), k % 2) for k, v in data.items() for t, x in enumerate(v)]
    df = spark.createDataFrame(rows, "recording long, pos long, x array<double>, code int").repartition(4)
    return cut.cut_frames(df, "recording", "x", "code", longest=longest).cache()


@pytest.mark.parametrize("longest", [1, 7, 50, 1000])
def test_sums_likelihoods_and_paths_do_not_depend_on_cuts(spark, longest):
    data, models = made(), {0: model(), 1: model()}
    models[1].means += 1
    table = parts(spark, data, longest)
    sums = cut.cut_expectation(table, models)
    for label in models:
        want = sum(models[label].statistics(v[None]) for k, v in data.items() if k % 2 == label)
        np.testing.assert_allclose(sums[label], want, rtol=1e-8, atol=1e-8)
    total = {(r["recording"], r["model"]): r["total"] for r in cut.likelihoods(table, "recording", models).collect()}
    for k, v in data.items():
        for m in models:
            assert np.isclose(total[k, m], models[m].likelihood(v[None])[0])
    guess = {r["recording"]: r["guess"] for r in cut.classify(table, "recording", models).collect()}
    assert guess == {k: max(models, key=lambda m: (total[k, m], -m)) for k in data}
    found = {(r["recording"], r["pos"]): r["state"] for r in cut.paths(table, "recording", models[0]).collect()}
    assert found == {(k, t): int(s) for k, v in data.items() for t, s in enumerate(models[0].best_path(v))}


def test_fits_equal_those_of_whole_sequences(spark):
    data = made()
    whole = parts(spark, data, 1000)
    want = seq.fit_left_right(whole.drop("offset", "whole"), "label", rounds=10)
    got = seq.fit_left_right(parts(spark, data, 9), "label", rounds=10, expect=cut.cut_expectation)
    for k in want:
        for name in ("start", "moves", "weights", "means", "variances", "history"):
            np.testing.assert_allclose(getattr(got[k], name), getattr(want[k], name), rtol=1e-6, atol=1e-8)
    assert all(b >= a - 1e-6 for a, b in zip(got[0].history, got[0].history[1:]))
    start = {0: model()}
    fits = [seq.fit_rounds(t.withColumn("label", F.lit(0)), start, "label", "frames", 5, 1e-3, expect=e)[0] for t, e in ((whole, seq.expectation), (parts(spark, data, 13), partial(cut.cut_expectation, key="recording")))]
    np.testing.assert_allclose(fits[0].means, fits[1].means, rtol=1e-6)


def test_no_sequences(spark):
    table = parts(spark, {0: np.zeros((2, 2))}, 10).filter("recording < 0")
    assert cut.cut_expectation(table, {0: model()}) == {} and cut.paths(table, "recording", model()).count() == 0


def test_sequences_of_all_lengths_are_summed_side_by_side():
    """Expected counts, likelihoods and paths of a block of mixed lengths are those of each sequence, by products as by logarithms."""
    rng = np.random.default_rng(3)
    moves = rng.uniform(0.1, 1, (3, 3))
    even = seq.StateModel(np.full(3, 1 / 3), moves / moves.sum(axis=1, keepdims=True), np.full((3, 2), 0.5), rng.normal(size=(3, 2, 2)), np.full((3, 2, 2), 0.3))
    onward = seq.StateModel(np.eye(3)[0], np.array([[0.9, 0.1, 0], [0, 0.9, 0.1], [0, 0, 1.0]]), even.weights, even.means, even.variances)
    lengths = np.array([5, 0, 40, 1, 40, 17])
    data = [rng.normal(size=(n, 2)) for n in lengths]
    data[2][3] += 60.0  # a frame far from every state
    flat = np.concatenate(data)
    whole = [d for d in data if len(d)]
    for model in (even, onward):
        assert np.allclose(model.expected(flat, lengths), sum(model.statistics(d[None]) for d in whole))
        assert np.allclose(model.likelihoods(flat, lengths)[lengths > 0], [model.likelihood(d[None])[0] for d in whole])
        assert model.best_paths(flat, lengths).tolist() == np.concatenate([model.best_path(d) for d in whole]).tolist()
    n, active = np.array([40]), np.ones(40, dtype=int)
    density = seq.log_sum(even.emissions(data[2][:, None]), 3)
    for a, b in zip(even.log_shares(density, n, active), even.scaled_shares(density, n, active)):
        assert np.allclose(a, b)
