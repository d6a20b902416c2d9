"""Estimators of whole series: the same for any cut into chunks, and equal to one transform or decomposition of the whole."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strideframe.operators import long_series, series as ser


def made():
    rng = np.random.default_rng(5)
    t = np.arange(900)
    return {
        1: 0.01 * t + np.sin(t / 7) + 0.3 * rng.normal(size=900) + 2, 2: 100 + np.cos(0.31 * t[:501]) + rng.normal(size=501),
        3: rng.normal(size=130), 4: np.array([1.0, -1.0] * 40), 5: np.full(60, 3.0), 6: np.array([2.0]),
    }


def frame(spark, data):
    rows = [(k, i, float(x)) for k, v in data.items() for i, x in enumerate(v)]
    return spark.createDataFrame(rows, "k long, pos long, v double").repartition(5)


@pytest.fixture(params=[16, 97, 1 << 18])
def chunk(spark, request):
    spark.conf.set("strideframe.chunk.rows", str(request.param))
    yield request.param
    spark.conf.set("strideframe.chunk.rows", "8")


def test_periodogram_equals_one_transform(spark, chunk):
    data = made()
    chunks = ser.chunked_series(frame(spark, data), "k", "v").cache()
    for bins in (64, 1 << 16):
        got = {r["k"]: r for r in ser.periodogram(chunks, "k", 16, bins).collect()}
        for k, v in data.items():
            if k == 5:  # nothing but rounding
                continue
            power = np.abs(np.fft.rfft(v - v.mean(), 16 * len(v))) ** 2
            if len(v) > 1:
                assert got[k]["bin"] == 1 + power[1:].argmax() and np.isclose(got[k]["power"], power[1:].max())
    assert got[6]["whole"] == 1 and max(len(r["v"]) for r in chunks.collect()) <= chunk


def plain_fit(v, spacing, highest, start):
    t, best, reach = np.arange(len(v)) * spacing, start, 1 / (len(v) * spacing)

    def solve(f):
        design = np.column_stack([np.sin(2 * np.pi * f * t), np.cos(2 * np.pi * f * t), np.ones_like(t)])
        weights = np.linalg.lstsq(design, v, rcond=None)[0]
        return weights, float(((v - design @ weights) ** 2).sum())

    for _ in range(12):
        best = min(np.clip(np.linspace(best - reach, best + reach, 9), 1e-9, highest), key=lambda f: solve(f)[1])
        reach /= 3
    (a, b, c), rest = solve(best)
    return best, np.hypot(a, b), c, 1 - rest / ((v - v.mean()) ** 2).sum()


def test_sine_fit_equals_least_squares(spark, chunk):
    data = {k: v - 0.01 * np.arange(900) if k == 1 else v for k, v in made().items() if k in (1, 2, 3)}  # no trend to fit instead
    for r in ser.fit_sine(ser.chunked_series(frame(spark, data), "k", "v"), "k", 1.28, 0.5 / 1.28).collect():
        frequency, amplitude, offset, share = plain_fit(data[r["k"]], 1.28, 0.5 / 1.28, r["start"])
        assert np.isclose(r["frequency"], frequency, atol=1e-7) and np.isclose(r["amplitude"], amplitude, rtol=1e-5)
        assert np.isclose(r["offset"], offset, rtol=1e-5) and np.isclose(r["r_squared"], share, atol=1e-8) and r["n"] == len(data[r["k"]])


@pytest.mark.parametrize("longest", [200, 1 << 18])
def test_singular_spectrum_equals_the_dense_one(spark, longest):
    data = {k: v for k, v in made().items() if k in (1, 2, 3, 6)}
    found = ser.singular_spectrum(frame(spark, data), "k", "v", longest=longest).collect()
    assert not [r for r in found if r["k"] == 6]  # too short
    for k in (1, 2, 3):
        parts, singular = ser.decompose(data[k], len(data[k]) // 2, 3)
        for c in range(3):
            own = sorted((r["pos"], r["value"], r["share"]) for r in found if r["k"] == k and r["component"] == c)
            assert [p for p, _, _ in own] == list(range(len(data[k])))
            assert np.allclose([v for _, v, _ in own], parts[c], atol=1e-6)
            assert np.isclose(own[0][2], singular[c] ** 2 / (singular**2).sum())


def test_a_hopeless_decomposition_is_an_error():
    with pytest.raises(RuntimeError, match="residuals"):
        ser.leading_components(np.random.default_rng(1).normal(size=2000), 1000, 3, held=8, most=9)


def test_a_product_is_spread_over_tasks(spark):
    """One series: its correlation is made of as many rows as pairs of chunks, none longer than a chunk."""
    v = np.random.default_rng(2).normal(size=1000)
    rows = frame(spark, {1: v}).withColumn("chunk", F.floor(F.col("pos") / 100).cast("long"))
    chunks = rows.groupBy("k", "chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda p: p["v"]).alias("v")).withColumn("whole", F.lit(1000).cast("long"))
    parts = long_series.stretches(chunks, "k", 100)
    u = np.random.default_rng(3).normal(size=500)
    vectors = spark.createDataFrame([(1, 1000, 1, b, u[100 * b : 100 * (b + 1)].tolist()) for b in range(5)], "k long, whole long, rows int, c long, w array<double>")
    out = sorted(long_series.correlate(vectors, parts, "k", 100, F.lit(501)).collect(), key=lambda r: r["c"])
    assert [len(r["w"]) for r in out] == [100] * 5 + [1]
    assert np.allclose(np.concatenate([r["w"] for r in out]), np.correlate(v, u, "valid"))
