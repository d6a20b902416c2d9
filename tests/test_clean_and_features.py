"""Cleaning, windows, features and estimates against NumPy on tiny tables."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from strideframe.functions import arrays as A
from strideframe.operators import clean, features as feat, series as ser
from strideframe.operators.ordered import chunk_by_position
from strideframe.operators.windows import gather, majority_labels, nearest_window, seconds_to_samples, sliding_members


def table(spark, values, **more):
    pdf = pd.DataFrame({"recording": 1, "pos": range(len(values)), "v": values, **more})
    return chunk_by_position(spark.createDataFrame(pdf).withColumn("n", F.lit(len(values)).cast("long")))


def test_fill_and_dropped_stream(spark):
    rows = [(1, 0, None, None), (1, 1, 2.0, None), (1, 2, None, None), (1, 3, 5.0, None), (2, 0, 1.0, 4.0), (2, 1, None, None)]
    df = chunk_by_position(spark.createDataFrame(rows, "recording long, pos long, a double, b double"))
    out = clean.hold_last_valid(df, ["recording"], ["pos"], ["a", "b"]).toPandas().sort_values(["recording", "pos"])
    assert out["a"].tolist() == [2.0, 2.0, 2.0, 5.0, 1.0, 1.0]
    assert out["usable"].tolist() == [False] * 4 + [True] * 2
    assert out["filled"].tolist() == [2, 1, 2, 1, 0, 2]


def test_blocks_start_at_the_null_before_the_first_gesture(spark):
    labels = [1, 2, 2, 1, 3, 1, 2, 2, 3, 1]
    runs = clean.label_runs(table(spark, np.zeros(10), label=labels), ["recording"], ["pos"])
    out = clean.repetition_blocks(runs, ["recording"], 1).toPandas().sort_values("pos")
    assert out["block"].tolist() == [0] * 5 + [1] * 5
    held = clean.check_blocks(clean.repetition_blocks(runs, ["recording"], 1), ["recording"], 1, [2, 3]).toPandas()
    assert held["complete"].all()


def plain_filter(b, a, x, state):
    y, z = np.zeros(len(x)), state.copy()
    for i, value in enumerate(x):
        y[i] = b[0] * value + z[0]
        z[:-1] = z[1:] + b[1:-1] * value - a[1:-1] * y[i]
        z[-1] = b[-1] * value - a[-1] * y[i]
    return y


def test_decimation_equals_forward_backward_recursion(spark):
    draw = np.random.default_rng(3)
    x = np.cumsum(draw.normal(size=700))
    spark.conf.set("strideframe.chunk.rows", "300")
    try:
        out = clean.decimate(table(spark, x, label=1), ["recording"], "pos", ["v"], "label", halo=300).toPandas().sort_values("pos")
    finally:
        spark.conf.set("strideframe.chunk.rows", "8")
    b, a = clean.lowpass_coefficients()
    steady = np.linalg.solve(np.eye(8) - np.vstack([-a[1:], np.eye(8)[:-1]]).T, b[1:] - a[1:] * b[0])
    padded = np.concatenate([2 * x[0] - x[27:0:-1], x, 2 * x[-1] - x[-2:-29:-1]])
    y = plain_filter(b, a, padded, steady * padded[0])
    y = plain_filter(b, a, y[::-1], steady * y[-1])[::-1][27:-27]
    assert len(out) == 350
    assert np.abs(out["v"].to_numpy() - y[::2]).max() < 1e-4 * np.abs(x).max()


def test_window_counts_ties_and_mapping(spark):
    df = table(spark, np.arange(23.0), label=[1, 2] * 11 + [1])
    members = sliding_members(df, 6, 4)
    assert members.select("win").distinct().count() == (23 - 6) // 4 + 1
    lowest = majority_labels(members, ["win"]).toPandas()
    centred = majority_labels(members, ["win"], centre=F.col("pos") == F.col("win") * 4 + 3).toPandas()
    assert (lowest["label"] == 1).all() and (centred["label"] == 2).all()
    mapped = df.select("pos", nearest_window(F.col("pos"), 6, 4, F.lit(0), F.lit(4)).alias("w")).toPandas()
    centres = np.arange(5) * 4 + 2.5
    assert [np.abs(p - centres).argmin() for p in mapped["pos"]] == mapped["w"].tolist()
    assert seconds_to_samples(0.078125, 32) == 2 and seconds_to_samples(0.01, 32) == 1


def test_sine_constant_and_vectors(spark):
    t = np.arange(32)
    sine = np.sin(2 * np.pi * 4 * t / 32)
    df = spark.createDataFrame([(0, sine.tolist()), (1, [3.0] * 32)], "k int, v array<double>")
    out = feat.with_spectrum(df, "v").select("k", A.dominant_bin(F.col("power")).alias("bin"), A.entropy_bits(A.without_dc(F.col("power"))).alias("e")).toPandas().set_index("k")
    assert out.loc[0, "bin"] == 4 and abs(out.loc[0, "e"]) < 1e-9 and out.loc[1, "e"] == 0.0
    rows, names = feat.signal_features(df.select("k", *[F.col("v").alias(c) for c in "xyz"]), ["k"], {"p": ["x", "y", "z"]}, 32)
    flat = dict(zip(names, rows.filter("k = 1").first()["features"]))
    assert len(names) == 17 * 3 + 5 and flat["x_skewness"] == 0.0 and flat["p_correlationxy"] == 0.0


def test_recognizer_vector_equals_numpy(spark):
    draw = np.random.default_rng(0)
    x = draw.normal(size=(5, 120))
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "k int, a array<double>")
    out, names = feat.recognizer_features(df, ["k"], ["a"], 120, 60.0)
    got = np.array([r["features"] for r in out.orderBy("k").collect()])
    power = np.abs(np.fft.rfft(x - x.mean(axis=1, keepdims=True))) ** 2 / 120
    bins = [1, 2, 4, 8, 16, 32, 61]
    want = np.column_stack([x.mean(1), x.var(1), *[power[:, a:b].sum(1) for a, b in zip(bins, bins[1:])], (power[:, 1:].argmax(1) + 1) * 0.5])
    assert np.allclose(got, want, rtol=1e-5, atol=1e-6) and len(names) == 9


def test_cadence_of_a_known_stride(spark):
    rate = 50.0
    t = np.arange(3000) / rate
    signal = np.sin(2 * np.pi * 0.9 * t) + 0.8 * np.sin(2 * np.pi * 1.8 * t)
    df = table(spark, signal - signal.mean())
    density = ser.welch_density(df, "recording", "v", rate)
    steps = ser.harmonic_cadence(density, ["recording"], 0.5, 3.0).first()["steps_per_second"]
    acf = ser.autocorrelation_cadence(df, "recording", "recording", "v", rate, 0.5, 3.0).first()["steps_per_second"]
    assert abs(steps - 1.8) < 0.05 and abs(acf - 1.8) < 0.02


def test_singular_spectrum_adds_up_and_sine_fit(spark):
    x = np.sin(2 * np.pi * 0.11 * np.arange(60)) + 0.02 * np.arange(60)
    parts, singular = ser.decompose(x, 30, 30)
    assert np.allclose(parts.sum(axis=0), x) and (np.diff(singular) <= 1e-9).all()
    df = spark.range(60).select(F.lit(1).alias("k"), F.col("id").alias("pos"), F.sin(2 * np.pi * 0.11 * F.col("id") + 0.4).alias("v"))
    fit = ser.fit_sine(ser.chunked_series(df, "k", "v"), "k", 1.0, 0.5).first()
    assert abs(fit["frequency"] - 0.11) < 1e-4 and fit["r_squared"] > 0.9999
    long = spark.range(50).select(F.lit(1).alias("k"), F.col("id").alias("pos"), F.rand(1).alias("v"))
    try:
        ser.bounded_series(long, "k", "pos", "v", limit=40).collect()
        raise AssertionError("a long series must be refused")
    except Exception as error:
        assert "longer than" in str(error)


def test_long_series_are_answered_like_short_ones(spark):
    rng = np.random.default_rng(3)
    for n in (300, 301):
        x = 5 + np.sin(2 * np.pi * 0.11 * np.arange(n)) + 0.5 * np.sin(2 * np.pi * 0.031 * np.arange(n)) + rng.normal(0, 0.3, n)
        parts, singular = ser.decompose(x, n // 2, 3)
        got, shares = ser.leading_components(x, n // 2, 3)
        assert np.allclose(got, parts, atol=1e-7) and np.allclose(shares, (singular**2 / (singular**2).sum())[:3])
    rows = spark.range(4600).select(F.expr("if(id < 4500, 1, 2)").alias("k"), F.expr("if(id < 4500, id, id - 4500)").alias("pos"))
    rows = rows.withColumn("v", 3 + F.sin(2 * np.pi * 0.05 * F.col("pos")))
    found = {r["k"]: r for r in ser.walking_frequency(rows, "k", "v", 1.0).collect()}
    assert {k: r["windows"] for k, r in found.items()} == {1: 4500, 2: 100}
    assert all(abs(r["ssa_steps"] - 0.05) < 1e-3 for r in found.values())


def test_gather_keeps_order(spark):
    out = gather(sliding_members(table(spark, np.arange(10.0)), 4, 4), ["win"], ["v"]).orderBy("win").collect()
    assert [r["v"] for r in out] == [[0.0, 1.0, 2.0, 3.0], [4.0, 5.0, 6.0, 7.0]]


def test_window_scores_across_batches(spark):
    """Scores of windows cut by batches, over null streams and null samples, as plain sums give them."""
    from strideframe.operators.features import window_scores

    rng = np.random.default_rng(5)
    rows = [(r, i, *[float(v) for v in rng.normal(size=3)]) for r in (1, 2, None) for i in range(40)]
    rows[7] = (1, 7, None, 0.5, 0.25)
    df = spark.createDataFrame(rows, "recording long, pos long, x double, y double, z double").withColumn("n", F.lit(40))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        got = {(r["recording"], r["win"]): r for r in window_scores(sliding_members(df, 8, 4), ["recording"], [["x", "y", "z"]]).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 27
    for (recording, win), row in got.items():
        own = [np.array(r[2:], dtype=float) for r in rows if r[0] == recording][win * 4 : win * 4 + 8]
        norm = np.array([np.sqrt((v**2).sum()) for v in own])
        assert np.isclose(row["variance"], np.nanvar(norm))
        if not np.isnan(norm).any():
            power = np.abs(np.fft.rfft(norm - norm.mean())[1:]) ** 2
            share = power / power.sum()
            assert np.isclose(row["entropy"], -(share * np.log(share)).sum() / np.log(4))
        if win == 0:
            assert row["change"] is None
        else:
            was = [np.array(r[2:], dtype=float) for r in rows if r[0] == recording][win * 4 - 4 : win * 4 + 4]
            means, spreads = [np.nanmean(v, axis=0) for v in (own, was)], [np.nanstd(v, axis=0) for v in (own, was)]
            assert np.isclose(row["change"], np.linalg.norm(means[0] - means[1]) + np.linalg.norm(spreads[0] - spreads[1]))


def test_decimation_of_numbered_recordings(spark):
    """A known length gives the same rows, and short filters the same values as the response written out."""
    rng = np.random.default_rng(6)
    x = np.cumsum(rng.normal(size=90))
    df = table(spark, x, label=1).withColumn("n", F.lit(90))
    a = clean.decimate(df, ["recording"], "pos", ["v"], "label", halo=300).orderBy("pos").toPandas()
    b = clean.decimate(df, ["recording"], "pos", ["v"], "label", halo=300, n="n").orderBy("pos").toPandas()
    assert a.equals(b)
    response = clean.impulse_response(2, 8, 300)
    left, right = 2 * x[0] - x[27:0:-1], 2 * x[-1] - x[-2:-29:-1]
    run = lambda s: np.convolve(np.concatenate([np.full(300, s[0]), s]), response)[300 : 300 + len(s)]
    want = run(run(np.concatenate([left, x, right]))[::-1])[::-1][27:117]
    assert np.allclose(clean.zero_phase(x[:, None], response, 27, True, True)[:, 0], want)


def test_scores_after_a_spectrum_was_taken(spark):
    """A spectrum taken before leaves nothing in the module that cannot travel to a task."""
    from pyspark import cloudpickle

    from strideframe.functions import arrays
    from strideframe.operators.features import window_scores, with_spectrum

    packed = spark.createDataFrame([(1, [0.0, 1.0, 0.0, 1.0])], "k long, x array<double>")
    assert with_spectrum(packed, "x").first()["power"] == [0.0, 0.0, 4.0]
    assert cloudpickle.dumps(arrays)
    rows = [(1, i, float(i % 3), 0.5 * i, 1.0) for i in range(16)]
    df = spark.createDataFrame(rows, "recording long, pos long, x double, y double, z double").withColumn("n", F.lit(16))
    assert window_scores(sliding_members(df, 8, 4), ["recording"], [["x", "y", "z"]]).count() == 3


def test_signals_of_many_windows_equal_the_array_expressions(spark, monkeypatch):
    """Finite windows are worked out together, others by the expressions; both give the same features."""
    from strideframe.operators import features as feat

    rng = np.random.default_rng(8)
    rows = [(i, *[[float(v) for v in rng.normal(size=n)] for _ in range(3)]) for i, n in enumerate([8] * 30 + [7, 5, 3])]
    rows += [(50, [1.0] * 8, [0.0] * 8, [-0.0, 0.0] * 4), (51, [1.0, None, 2.0], [1.0] * 3, [2.0] * 3), (52, [1.0, float("inf"), 2.0], [1.0] * 3, [2.0] * 3), (53, None, [1.0], [2.0])]
    df = spark.createDataFrame(rows, "k long, x array<double>, y array<double>, z array<double>")
    placements = {"p": ["x", "y", "z"]}
    found, names = feat.signal_features(df, ["k"], placements, 8)
    together = {r["k"]: r["__sound"] for r in df.withColumn("__sound", feat.sound_signals(["x", "y", "z"], [["x", "y", "z"]], 8)).collect()}
    assert all((together[r[0]] is None) == (r[0] > 50) for r in rows)
    monkeypatch.setattr(feat, "sound_signals", lambda *a: F.lit(None).cast("array<double>"))
    want = {r["k"]: r["features"] for r in feat.signal_features(df, ["k"], placements, 8)[0].collect()}
    got = {r["k"]: r["features"] for r in found.collect()}
    assert len(names) == 56 and set(got) == set(want)
    for k, values in got.items():
        assert (values is None) == (want[k] is None)
        if values is not None:
            np.testing.assert_allclose(np.array(values, float), np.array(want[k], float), rtol=1e-12, atol=1e-13)


def test_entropies_of_many_windows_equal_the_array_expression(spark):
    import pyarrow as pa

    from strideframe.functions import arrays as A

    rng = np.random.default_rng(4)
    power = [(rng.normal(size=n) ** 2).tolist() for n in (5, 5, 9, 3)] + [[1.0, 0.0, 0.0, 0.0], [3.0, 2.0, 0.0, 1.0], [1.0, float("nan"), 2.0], [1.0, 2.0], [1.0]]
    found = A.flat_entropies(pa.array(power, pa.list_(pa.float64()))).to_pylist()
    df = spark.createDataFrame([(i, p) for i, p in enumerate(power[:7])], "k long, p array<double>")
    want = {r["k"]: r["e"] for r in df.select("k", A.flat_entropy(A.without_dc(F.col("p"))).alias("e")).collect()}
    np.testing.assert_allclose(found[:7], [want[i] for i in range(7)], rtol=1e-14, atol=0)
    assert found[7:] == [None, None]
