"""The pseudo-random order of keys that are far larger than those of the test tables."""

from pyspark.sql import functions as F

from strideframe.functions.scalars import HASH_FACTOR, HASH_SPACE, spread_order


def by_hand(key, seed=42):
    mixed = (key + seed) * HASH_FACTOR % HASH_SPACE
    return (mixed // 8192 + mixed * 40503) % HASH_SPACE


def test_large_keys_do_not_overflow(spark):
    keys = [0, 1, 3_474_000_000, 6_000_300_000, 60_000 * 100_003 + 104_729 * 44, (1 << 62) + 12_345]
    rows = spark.createDataFrame([(k,) for k in keys], "k long").select("k", spread_order(F.col("k")).alias("h")).collect()
    assert {r["k"]: r["h"] for r in rows} == {k: by_hand(k) for k in keys}
