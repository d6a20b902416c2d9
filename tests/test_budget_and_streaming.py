"""Selection invariants, and stream = batch."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strideframe.operators import budget as bud
from strideframe.plans.catalogue import QUERIES
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def selected(spark):
    draw = np.random.default_rng(7)
    rows = []
    for stream, n in ((1, 7), (2, 20)):
        scores = np.round(draw.random((n, 3)), 1)  # many ties
        rows += [(stream, p, stream % 2, *[float(v) if p or i != 1 else None for i, v in enumerate(s)], int(draw.integers(0, 3)), int(draw.integers(0, 3))) for p, s in enumerate(scores)]
    df = spark.createDataFrame(rows, "stream long, pos long, fold long, accelerationVariance double, windowChange double, spectralEntropy double, truth long, full long").cache()
    out = bud.carry_forward(bud.select_windows(df, bud.trigger_thresholds(df, range(2))))
    return df.toPandas(), out.toPandas()


def test_budget_counts_and_first_window(selected):
    _, out = selected
    sizes = out.groupby(["method", "budget", "seed", "stream"], dropna=False)["kept"].agg(["sum", "size"]).reset_index()
    exact = sizes[sizes["method"] != "changeTrigger"]
    assert (exact["sum"] == np.ceil(exact["budget"] * exact["size"] / 100)).all()
    assert out[out["pos"] == 0]["kept"].all()
    full = out[out["budget"] == 100]
    assert full["kept"].all() and (full["final"] == full["full"]).all()


def test_top_scores_and_carry(selected):
    df, out = selected
    mine = out[(out["method"] == "spectralEntropy") & (out["budget"] == 20) & (out["stream"] == 2)].sort_values("pos")
    rows = df[(df["stream"] == 2)].sort_values("pos")
    later = rows.iloc[1:]
    top = later.iloc[np.argsort(-later["spectralEntropy"].to_numpy(), kind="stable")[:3]]["pos"]
    assert set(mine[mine["kept"]]["pos"]) == {0, *top}
    last = mine["full"].where(mine["kept"]).ffill()
    assert (mine["final"] == last).all()


@pytest.mark.parametrize("name", ["st_gap_sessions", "st_hold_last_valid", "st_change_trigger"])
def test_streams_equal_their_sql(spark, name):
    from tests.test_answers import check

    check(spark, name)


def test_unknown_method_is_an_error(spark, selected):
    df, _ = selected
    with pytest.raises(ValueError):
        bud.select_windows(spark.createDataFrame(df.fillna(0.0)), None, ["nonsense"])
    assert SMALL and QUERIES and F


@pytest.mark.parametrize("rows", ["8", "262144"])
def test_runs_are_marked_in_place_and_alike_for_short_and_long_streams(spark, selected, rows):
    """Windows are not copied for the runs; streams beyond a chunk go another way to the same marks."""
    df, out = selected
    plain = [None if v != v else float(v) for v in df["windowChange"]]
    table = spark.createDataFrame([(*r[:4], c, *r[5:]) for r, c in zip(df.itertuples(index=False, name=None), plain)], "stream long, pos long, fold long, accelerationVariance double, windowChange double, spectralEntropy double, truth long, full long")
    table = table.unionByName(table.withColumn("stream", F.col("stream") + 3_474_000_000).withColumn("pos", F.col("pos") + 0))
    levels = bud.trigger_thresholds(table, range(2))
    spark.conf.set("strideframe.chunk.rows", rows)
    try:
        windows = bud.run_windows(table, levels, prediction="full").toPandas()
        long = bud.final_predictions(table, levels).toPandas()
    finally:
        spark.conf.set("strideframe.chunk.rows", "8")
    assert len(windows) == 2 * len(df) and set(windows["kept"].map(len)) == {len(bud.runs_of())}
    keys = ["method", "budget", "seed", "stream", "pos"]
    mine, theirs = (t[t["stream"] < 10].fillna({"seed": -1}).sort_values(keys)[[*keys, "kept", "final"]].reset_index(drop=True) for t in (long, out))
    same = mine["method"] != "changeTrigger"  # its levels hold the copies as well
    assert len(mine) == len(theirs) and (mine[same].to_numpy() == theirs[same].to_numpy()).all()


def test_places_and_fills_of_ties_nulls_and_nans(spark):
    """Streams that fit a chunk are ranked together: the same places as windows of SQL give, in few plans."""
    from pyspark.sql import Window, functions as F

    values = [None, float("nan"), 0.0, -0.0, 1.0, 1.0, 2.0, float("inf"), None, 0.5]
    rows = [(s, p, *[values[(p * k + (s or 0)) % 10] for k in (1, 3, 7)], p % 5, "ABC"[p % 3] if p % 4 else None) for s in (1, 2, None) for p in range(23)]
    df = spark.createDataFrame(rows, "stream long, pos long, accelerationVariance double, windowChange double, spectralEntropy double, fold int, full string")
    got = bud.places_inside(df, ["accelerationVariance", "meanRank", "spectralEntropy", "windowChange"], [(20, 42)])
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
    whole, later = Window.partitionBy("stream"), df.filter("pos > 0")
    order = {s: (-F.col(s)).asc_nulls_last() for s in bud.SCORES}
    want = later.select("stream", "pos", *[(F.row_number().over(whole.orderBy(o, "pos")) - 1).alias(s) for s, o in order.items()],
                        sum((F.rank().over(whole.orderBy(o)) + F.count(F.lit(1)).over(whole.orderBy(o)) for o in order.values()), F.lit(0)).alias("ranks"),
                        (F.row_number().over(whole.orderBy(bud.drawn(F.col("stream"), F.col("pos"), F.lit(20), F.lit(42)), "pos")) - 1).alias("draw"))
    want = want.withColumn("mean", F.row_number().over(whole.orderBy("ranks", "pos")) - 1)
    theirs = {(r["stream"], r["pos"]): (*[r[s] for s in bud.SCORES], r["mean"], r["draw"], 23) for r in want.collect()}
    ours = {(r["stream"], r["pos"]): (*[r[f"place_{s}"] for s in bud.SCORES], r["place_meanRank"], r["place_20_42"], r["n"]) for r in got.collect()}
    assert {k: v for k, v in ours.items() if k[1] > 0} == theirs and ours[1, 0] == (*[None] * 5, 23)

    marked = got.select("stream", "pos", "full", F.array(F.col("pos") % 3 == 0, F.lit(False)).alias("kept"))
    final = {(r["stream"], r["pos"]): r["final"] for r in bud.filled_inside(marked, "full", 2).collect()}
    for s in (1, 2, None):
        last = None
        for p in range(23):
            last = "ABC"[p % 3] if p % 4 and p % 3 == 0 else last
            assert final[s, p] == [last, None]
