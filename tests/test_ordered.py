"""Chunked operators equal plain windows, also when one key holds most rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strideframe.operators.ordered import add_chunk, add_value_chunk, exact_quantiles, number_groups, number_runs, sweep
from strideframe.operators.ranking import largest_remainder, rank_rows


@pytest.fixture(scope="module")
def skewed():
    draw = np.random.default_rng(1)
    keys = np.where(draw.random(150) < 0.5, 0, draw.integers(1, 9, 150))
    return pd.DataFrame({"k": keys, "t": draw.permutation(150), "v": np.where(draw.random(150) < 0.3, np.nan, draw.normal(size=150)), "l": draw.integers(0, 3, 150)})


def frame(spark, pdf):
    df = spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    return add_chunk(df, ["k"], "t")


def test_chunks_bound_hot_key(spark, skewed):
    sizes = frame(spark, skewed).groupBy("k", "chunk").count().toPandas()
    assert sizes["count"].max() <= 16 < skewed["k"].value_counts().max()


def test_sweep_equals_pandas(spark, skewed):
    out = sweep(
        frame(spark, skewed), ["k"], ["t"], number="pos", prev={"p": F.col("l")}, following={"f": F.col("l")}, sums={"s": F.col("l")},
        last_valid={"b": F.col("v")}, next_valid={"a": F.col("v")}, totals={"n": ("sum", F.lit(1))},
    ).toPandas().sort_values(["k", "t"]).reset_index(drop=True)
    want = skewed.sort_values(["k", "t"]).reset_index(drop=True)
    g = want.groupby("k")
    assert (out["pos"] == g.cumcount()).all()
    assert (out["s"] == g["l"].cumsum()).all()
    assert (out["n"] == g["l"].transform("size")).all()
    for name, expected in {"p": g["l"].shift(), "f": g["l"].shift(-1), "b": g["v"].ffill(), "a": g["v"].bfill()}.items():
        assert np.allclose(out[name].astype(float), expected.astype(float), equal_nan=True), name


def test_runs_and_groups(spark, skewed):
    out = number_runs(frame(spark, skewed), ["k"], ["t"], {"l": F.col("l")}, lambda a, b: a["l"] != b["l"])
    out = out.toPandas().sort_values(["k", "t"]).reset_index(drop=True)
    g = out.groupby("k")["l"]
    start = g.shift() != out["l"]
    assert (out["run_start"] == start).all()
    assert (out["run"] == start.groupby(out["k"]).cumsum() - 1).all()
    numbers = number_groups(spark.createDataFrame(out[["k", "run"]]), "k", ["run"], "n").toPandas().sort_values(["k", "run"])
    assert numbers["n"].tolist() == list(range(len(numbers)))


def test_quantiles_and_ranks(spark, skewed):
    df = frame(spark, skewed)
    out = exact_quantiles(df, ["k"], "v", [0.25, 0.5], ["q1", "q2"]).toPandas().set_index("k").sort_index()
    want = skewed.groupby("k")["v"].quantile([0.25, 0.5]).unstack()
    assert np.allclose(out[["q1", "q2"]], want.loc[out.index])
    ranked = rank_rows(df, ["k"], F.col("l"), "t", "place", "average").toPandas()
    again = skewed.assign(neg=-skewed["l"]).sort_values(["k", "neg", "t"])
    again["place"] = again.groupby("k").cumcount()
    again["average"] = again.groupby("k")["neg"].rank(method="average")
    both = ranked.merge(again, on=["k", "t"])
    assert (both["place_x"] == both["place_y"]).all() and np.allclose(both["average_x"], both["average_y"])


def test_quotas_add_up(spark):
    strata = spark.createDataFrame([("a", 50), ("b", 30), ("c", 21)], "label string, size long")
    out = largest_remainder(strata, "size", F.lit(17), "label").toPandas().set_index("label")["quota"]
    assert out.sum() == 17 and abs(out["a"] - 17 * 50 / 101) < 1


def test_null_keys_clocks_and_scores_keep_their_rows(spark):
    rows = spark.createDataFrame([(1, 10, 5.0), (1, None, 6.0), (None, 3, 7.0), (None, None, 8.0), (1, 11, None), (1, 12, 9.0)], "k long, t long, v double")
    chunked = add_chunk(rows, ["k"], "t")
    out = {(r["k"], r["t"]): r for r in sweep(chunked, ["k"], ["t"], number="pos", prev={"was": F.col("v")}, totals={"n": ("sum", F.lit(1))}).collect()}
    assert len(out) == 6
    assert [out[1, t]["pos"] for t in (None, 10, 11, 12)] == [0, 1, 2, 3] and out[1, 10]["was"] == 6.0 and out[1, 12]["n"] == 4
    assert out[None, None]["pos"] == 0 and out[None, 3]["was"] == 8.0
    runs = number_runs(chunked, ["k"], ["t"], {"v": F.col("v")}, lambda a, b: a["v"] != b["v"]).collect()
    assert len(runs) == 6
    ranked = {(r["k"], r["t"]): r["place"] for r in rank_rows(rows.withColumn("id", F.coalesce("t", F.lit(0))), ["k"], F.col("v"), "id").collect()}
    assert ranked == {(1, 12): 0, (1, None): 1, (1, 10): 2, (1, 11): 3, (None, None): 0, (None, 3): 1}


def test_heavy_tails_and_bursts_spread_over_chunks(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    tail = [("tail", float(x)) for x in np.exp(rng.normal(0, 6, 4000))]
    burst = [("burst", 1000.0 * (k == 0) + k * 1e-6) for k in range(4000)]
    rows = spark.createDataFrame([*tail, *burst, ("small", 1.0), (None, 2.0), ("small", None)], "k string, v double")
    spark.conf.set("strideframe.chunk.rows", "500")
    try:
        cut = add_value_chunk(rows, ["k"], "v")
        assert cut.count() == rows.count()
        assert cut.groupBy("k", "chunk").count().agg(F.max("count")).first()[0] <= 500
        got = {r["k"]: r["q"] for r in exact_quantiles(rows, ["k"], "v", [0.3], ["q"]).collect()}
        assert abs(got["tail"] - np.quantile([v for _, v in tail], 0.3)) < 1e-9 and len(got) == 4
    finally:
        spark.conf.set("strideframe.chunk.rows", "8")


def test_decimation_does_not_show_its_cuts(spark):
    import numpy as np

    from strideframe.operators import clean

    rng = np.random.default_rng(4)
    wave = np.cumsum(rng.normal(0, 1, 1060))
    told = {}
    for n in (999, 1000, 1001, 1050):
        rows = spark.createDataFrame([(1, k, float(wave[k]), "a") for k in range(n)], "r long, pos long, x double, label string")
        for size in (100_000, 1000, 300):
            spark.conf.set("strideframe.chunk.rows", str(size))
            told[n, size] = [r["x"] for r in clean.decimate(rows, ["r"], "pos", ["x"], "label").orderBy("pos").collect()]
        assert np.allclose(told[n, 100_000], told[n, 1000], atol=1e-9) and np.allclose(told[n, 100_000], told[n, 300], atol=1e-9)
    spark.conf.set("strideframe.chunk.rows", "8")
