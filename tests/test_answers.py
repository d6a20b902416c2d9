"""Registered queries against their SQL on the smallest tables, with tiny chunks."""

import duckdb
import pytest

from strideframe.plans.catalogue import ORACLES, QUERIES
from tests.conftest import SMALL
from tools.check import TABLES, compare

QUICK = [
    "flagship", "p4_drop_repeats", "t1_split_streams", "t2_hold_last_valid", "t7_repetition_blocks", "t10_fill_line", "t13_bouts", "w1_sliding_windows",
    "w4_majority_centre", "f2_crossing_rates", "f9_spectral_entropy", "f15_haar_wavelet", "f23_score_change", "g4_autocorrelation_cadence", "a6_describe",
    "b3_change_trigger", "j9_neighbour_leakage", "j12_curve_claims", "s3_align_files", "s9_read_raw_csv", "x6_stratified_split", "v9_anova_best",
    "m1_nearest_neighbours", "m5_naive_bayes", "e2_frame_scores", "e7_auc", "o3_best_rows",
]


def check(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    _, rows, verdict = compare(spark, con, SMALL, name, QUERIES[name], ORACLES[name])
    assert rows > 0 and verdict.startswith("ok"), verdict


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_its_sql(spark, name):
    check(spark, name)


def test_names_are_unique_and_answers_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
