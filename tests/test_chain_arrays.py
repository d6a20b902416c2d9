"""Windows of the recognition chain as slices of stretches, against the operators on samples."""

import pytest
from pyspark.sql import functions as F

from strideframe.functions import arrays as A
from strideframe.operators.compare import purge_overlaps
from strideframe.operators.windows import gather, majority_labels, majority_of, sliding_arrays, sliding_members
from strideframe.plans import studies as st


def samples(spark, n=700):
    rows = [(r, i, m, float((i * 37 + r) % 11), (i * i + r) % 3 + 1) for r, m in ((1, n), (2, 7), (3, 8), (4, 261)) for i in range(m)]
    return spark.createDataFrame(rows, "recording long, pos long, n long, x double, code long")


@pytest.mark.parametrize("size,step", [(8, 4), (16, 4), (5, 3), (4, 4), (3, 5)])
def test_slices_are_the_gathered_members(spark, size, step):
    df, keys = samples(spark), ["recording", "win"]
    members = sliding_members(df, size, step)
    centre = F.col("pos") == F.col("win") * step + size // 2
    expected = gather(members, keys, ["x"]).join(majority_labels(members, keys, "code", centre), keys)
    found = sliding_arrays(df, ["recording"], ["x", "code"], size, step).withColumn("code", majority_of(F.col("code"), size // 2))
    assert sorted(map(tuple, found.select(*keys, "x", "code").collect())) == sorted(map(tuple, expected.select(*keys, "x", "code").collect()))


def test_null_codes_vote_as_before(spark):
    df = samples(spark, 40).withColumn("code", F.when(F.col("pos") % 3 != 0, F.col("code")))
    keys = ["recording", "win"]
    expected = majority_labels(sliding_members(df, 8, 4), keys, "code", F.col("pos") == F.col("win") * 4 + 4)
    found = sliding_arrays(df, ["recording"], ["code"], 8, 4).select(*keys, majority_of(F.col("code"), 4).alias("code"))
    assert set(map(tuple, found.collect())) == set(map(tuple, expected.collect()))


def test_levels_are_those_of_the_array_expressions(spark):
    df = spark.createDataFrame([([1.0, 2.5, -1.0, 0.0],), ([3.0, 3.0, 3.0],), ([1e300, 1.0],), ([None, 1.0],), ([],), (None,), ([float("nan"), 1.0],)], "a array<double>")
    v = F.col("a")
    plain = F.array(A.mean(v), F.greatest(A.moment(A.centred(v), 2), F.lit(0.0)), A.crossing_rate(v, F.lit(0.5)), A.crossing_rate(v, A.mean(v)))
    want = F.when(F.size(v) > 0, plain)
    rows = df.select(A.level_block(v, F.lit(0.5)).alias("got"), want.alias("want"), A.level_block(v).alias("two")).collect()
    for r in rows[:3]:
        assert r["got"] == r["want"] and r["two"] == r["want"][:2]
    assert [r["got"] for r in rows[3:]] == [None] * 4


def test_held_out_spans_purge_like_the_join(spark):
    frames = samples(spark).withColumns({"subject": F.lit(0).cast("long"), "block": F.floor(F.col("pos") * 3 / F.col("n")), "y": F.col("x"), "z": F.col("x")})
    table = st.chain_windows(frames, st.Configuration(), ["x"])
    mine = table.select("recording", "win", "block", "touched")
    for held in range(3):
        test = mine.filter(F.col("block") == held)
        near = test.groupBy("recording").agg((F.min("win") * 4).alias("span_start"), (F.max("win") * 4 + 8).alias("span_end"))
        other = mine.filter(F.col("block") != held)
        purged = purge_overlaps(other.select("recording", "win"), near, ["recording"], 8, 4)
        expected = other.join(purged, ["recording", "win"], "left_anti").select("recording", "win")
        train, _ = st.split_round(table, {"test": 0, "train": 0, "block": held})
        assert set(map(tuple, train.select("recording", "win").collect())) == set(map(tuple, expected.collect()))
        assert purged.count() > 0
