"""Models and splits against brute force and invariants."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strideframe.operators import folds as fold, prep
from strideframe.operators.models import closed_form as closed, ensembles as ens, neighbours as knn, sequences as seq
from strideframe.plans.catalogue import QUERIES
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def blobs(spark):
    draw = np.random.default_rng(5)
    labels = np.arange(120) % 3
    x = draw.normal(size=(120, 4)) + labels[:, None] * 1.5
    x[:40] = x[0]  # a third of all rows are copies of one row
    rows = [(i, int(labels[i]), i % 6, x[i].tolist()) for i in range(120)]
    return spark.createDataFrame(rows, "key long, label int, who int, features array<double>").cache(), x, labels


def test_neighbours_equal_brute_force_with_hot_cell(spark, blobs):
    df, x, labels = blobs
    out = knn.nearest(df.filter("key % 5 <> 0"), df.filter("key % 5 = 0"), "key", "label", 3, pivots=7, block=8).toPandas()
    train = np.array([i for i in range(120) if i % 5])
    for key in range(0, 120, 5):
        d = ((x[train] - x[key]) ** 2).sum(axis=1)
        want = train[np.lexsort((train, d))[:3]]
        assert out[out["key"] == key].sort_values("place")["neighbour"].tolist() == want.tolist()
    assert set(out["neighbour_label"]) <= {0, 1, 2}


def test_closed_forms(spark, blobs):
    df, x, labels = blobs
    guess = closed.linear_discriminant(df, df, "label").orderBy("key").toPandas()["guess"].to_numpy()
    means = np.stack([x[labels == c].mean(axis=0) for c in range(3)])
    pooled = sum((x[labels == c] - means[c]).T @ (x[labels == c] - means[c]) for c in range(3)) / 120
    scores = x @ np.linalg.inv(pooled) @ means.T - 0.5 * np.einsum("cd,de,ce->c", means, np.linalg.inv(pooled), means)
    assert (guess == scores.argmax(axis=1)).all()


def test_assignment_is_optimal():
    draw = np.random.default_rng(2)
    for shape in ((4, 4), (5, 3), (3, 5)):
        counts = draw.integers(0, 20, shape)
        got = sum(counts[i, j] for i, j in enumerate(ens.assign_clusters(counts)) if j >= 0)
        size = max(shape)
        square = np.zeros((size, size), dtype=int)
        square[: shape[0], : shape[1]] = counts
        assert got == max(sum(square[i, p[i]] for i in range(size)) for p in itertools.permutations(range(size)))


def test_lightest_fold_rule_equals_one_by_one():
    draw = np.random.default_rng(4)
    for _ in range(20):
        loads = draw.integers(0, 30, 4).astype(float).tolist()
        size, count = int(draw.integers(1, 9)), int(draw.integers(1, 40))
        taken = fold.fill_lightest(loads, size, count)
        slow = list(loads)
        for _ in range(count):
            slow[int(np.argmin(slow))] += size
        assert sum(taken) == count
        assert sorted(a + t * size for a, t in zip(loads, taken)) == sorted(slow)


def test_group_folds_partition_and_balance(spark, blobs):
    df, _, _ = blobs
    uneven = df.withColumn("g", F.when(F.col("key") < 40, 0).otherwise(F.col("key") % 17 + 1))
    plan = fold.group_folds(uneven, "g", 3).toPandas()
    sizes = uneven.groupBy("g").count().toPandas().merge(plan, on="g")
    assert len(plan) == plan["g"].nunique() and sizes.groupby("fold")["count"].sum().tolist().count(40) >= 1
    assert sizes.groupby("fold")["count"].sum().max() - sizes.groupby("fold")["count"].sum().min() <= 5
    strata = fold.group_folds(uneven, "g", 3, strata="label").toPandas()
    assert set(strata["g"]) == set(plan["g"])


def test_draws_are_exact_and_repeatable(spark, blobs):
    df, _, _ = blobs
    capped = fold.cap_rows(df, "label", "key", 50)
    assert capped.count() == 50
    again = fold.cap_rows(df.repartition(3), "label", "key", 50)
    assert capped.select("key").exceptAll(again.select("key")).count() == 0
    folds = fold.stratified_folds(df, "label", "key", 4).groupBy("label", "fold").count().toPandas()
    assert folds["count"].tolist() == [10] * 12
    small = fold.subsample(df, ["who", "label"], "key", 0.01).groupBy("who", "label").count().toPandas()
    assert (small["count"] == 1).all()


def test_rounds_purge_only_overlaps(spark):
    rows = spark.range(30).select(F.lit(1).alias("who"), F.col("id").alias("win"), F.floor(F.col("id") / 10).alias("block"))
    roles = fold.round_windows(rows, "who", "block", "win", 8, 4).toPandas()
    middle = roles[roles["held"] == 1]
    assert sorted(middle[middle["role"] == "test"]["win"]) == list(range(10, 20))
    assert sorted(middle[middle["role"] == "purged"]["win"]) == [9, 20]
    sizes = fold.round_sizes(rows, fold.round_windows(rows, "who", "block", "win", 8, 4), "who").toPandas()
    assert (sizes[["test", "purged", "train"]].sum(axis=1) == 30).all()


def test_sequence_likelihood_rises_and_classifies(spark):
    draw = np.random.default_rng(6)
    rows = []
    for i in range(40):
        path = np.repeat([0.0, 2.0, 4.0], 4) * (1 if i % 2 else -1)
        rows.append((i, i % 2, (path[:, None] + draw.normal(scale=0.5, size=(12, 2))).tolist()))
    df = spark.createDataFrame(rows, "key int, code int, frames array<array<double>>")
    models = seq.fit_left_right(df, "code", rounds=4)
    for model in models.values():
        assert (np.diff(model.history) >= -1e-6).all()
        assert np.allclose(np.tril(model.moves, -1), 0)
    guess = df.select("code", seq.classify_sequences(models, F.col("frames")).alias("g")).toPandas()
    assert (guess["code"] == guess["g"]).all()
    whole = seq.fit_ergodic(df, "frames", 3, 2, 4, tolerance=-np.inf)
    assert (np.diff(whole.history) >= -1e-3).all() and np.allclose(whole.moves.sum(axis=1), 1)


def test_forward_backward_equals_enumeration():
    model = seq.StateModel(np.array([0.6, 0.4]), np.array([[0.7, 0.3], [0.2, 0.8]]), np.ones((2, 1)), np.array([[[0.0]], [[1.0]]]), np.ones((2, 1, 1)))
    frames = np.array([[[0.1], [0.9], [0.4]]])
    density = np.exp(seq.log_sum(model.emissions(frames), 3))[0]
    total = 0.0
    for path in itertools.product(range(2), repeat=3):
        p = model.start[path[0]] * density[0, path[0]]
        for t in (1, 2):
            p *= model.moves[path[t - 1], path[t]] * density[t, path[t]]
        total += p
    assert np.isclose(model.likelihood(frames)[0], np.log(total))


def test_stumps_and_mutual_information(spark, blobs):
    df, x, labels = blobs
    rows = prep.to_vector(df).withColumn("label", F.col("label").cast("double"))
    few, many = (ens.score(ens.stump_votes(ens.fit_stumps(rows, 3, n), rows, 3))[0] for n in (1, 12))
    assert many >= few
    coded = prep.discretise(df)
    got = prep.mutual_information(prep.joint_counts(coded, F.col("label"), 4)).toPandas().set_index("feature")["information"]
    mean, dev = x.mean(axis=0), x.std(axis=0)
    codes = 1 - (x < mean - dev) + (x > mean + dev)
    for f in range(4):
        joint = pd.crosstab(codes[:, f], labels).to_numpy() / 120
        outer = joint.sum(1, keepdims=True) * joint.sum(0, keepdims=True)
        assert np.isclose(got[f], (joint[joint > 0] * np.log(joint[joint > 0] / outer[joint > 0])).sum())
    order = [r["feature"] for r in prep.rank_by_redundancy(df, F.col("label"), 4).orderBy("place").collect()]
    assert sorted(order) == [0, 1, 2, 3] and order[0] == int(got.idxmax())


def test_short_sequences_and_hopeless_stumps_still_give_models(spark):
    rows = spark.createDataFrame([(0, [[0.0], [0.2]]), (0, [[0.1]]), (1, [[5.0], [5.1], [5.2], [5.3]]), (1, [[5.1], [5.2], [5.0], [5.4]])], "label int, frames array<array<double>>")
    models = seq.fit_left_right(rows, "label", states=3, rounds=2)
    got = rows.select("label", seq.classify_sequences(models, F.col("frames")).alias("g")).collect()
    assert all(r["label"] == r["g"] for r in got)

    flat = prep.to_vector(spark.createDataFrame([(float(k % 3), [1.0]) for k in range(9)], "label double, features array<double>"))
    assert len(ens.fit_stumps(flat, 3, rounds=4)) == 1


def test_studies_cover_every_round_and_activity(spark):
    got = {tuple(r) for r in QUERIES["q3_classifier_by_name"](spark, SMALL).select("scheme", "subject", "train_subject", "held", "classifier").collect()}
    rounds = {r[:4] for r in got}
    assert rounds == {("personDependent", s, s, b) for s in (0, 1) for b in (0, 1)} | {("personIndependent", 0, 1, -1), ("personIndependent", 1, 0, -1)}
    assert len(got) == 5 * len(rounds)
    assert {r["activity"] for r in QUERIES["q7_participant_identification"](spark, SMALL).collect()} == {"A", "N", "R"}
