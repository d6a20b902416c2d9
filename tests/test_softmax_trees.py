"""Boosting over many classes against trees grown without bins or Spark."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strideframe.operators import prep
from strideframe.operators.models import ensembles as ens, softmax_trees as soft


def grown_by_hand(x, label, classes, rounds, depth, rate, least_rows, penalty):
    """The same trees with a sum over all rows for every possible cut."""
    margin = np.tile(np.log(np.maximum(np.bincount(label, minlength=classes) / len(label), 1e-15)), (len(x), 1))
    cuts = []
    for r in range(rounds):
        slope, bend = (v / soft.UNIT for v in soft.slopes(margin, label))
        step = np.zeros_like(margin)
        for c in range(classes):
            parts = [np.arange(len(x))]
            g, h = slope[:, c], bend[:, c]
            worth = lambda rows: g[rows].sum() ** 2 / (h[rows].sum() + penalty)
            step[:, c] = -rate * g.sum() / (h.sum() + penalty)
            for level in range(depth):
                halves = []
                for node, rows in enumerate(parts):
                    best = None
                    for f in range(x.shape[1]):
                        for v in np.unique(x[rows, f])[:-1]:
                            a, b = rows[x[rows, f] <= v], rows[~(x[rows, f] <= v)]
                            if min(len(a), len(b)) < least_rows or min(h[a].sum(), h[b].sum()) < 1e-3:
                                continue
                            gain = (worth(a) + worth(b) - worth(rows)) / 2
                            if gain > 0 and (best is None or gain > best[0] + 1e-12):
                                best = gain, f, v, a, b
                    if best is None:
                        halves += [rows[:0], rows[:0]]
                        continue
                    cuts.append((r, c, (1 << level) - 1 + node, best[1], best[2]))
                    for side in best[3:]:
                        step[side, c] = -rate * g[side].sum() / (h[side].sum() + penalty)
                    halves += best[3:]
                parts = halves
        margin += step
    return margin, cuts


@pytest.fixture(scope="module")
def table(spark):
    draw = np.random.default_rng(11)
    label = np.arange(180) % 4
    x = np.round(draw.normal(size=(180, 3)) + np.stack([label, label % 2, np.zeros(180)], axis=1), 1)
    x[:60], label[:60] = x[1], 1  # a third of all rows are copies of one row
    df = spark.createDataFrame([(i, float(label[i]), x[i].tolist()) for i in range(180)], "key long, label double, features array<double>")
    return prep.to_vector(df).cache(), x, label


def test_trees_equal_those_of_all_cuts_for_any_partitions(table, monkeypatch):
    df, x, label = table
    learner = soft.SoftmaxBoosting(rounds=4, depth=3, rate=0.3, least_rows=5, penalty=1.0, settle_every=2)
    model = learner.fit(df)
    margin, cuts = grown_by_hand(x, label, 4, 4, 3, 0.3, 5, 1.0)
    r, c, place = np.nonzero(model.features >= 0)
    found = list(zip(r, c, place, model.features[r, c, place], model.cuts[r, c, place]))
    assert sorted(found) == sorted(cuts) and len(cuts) > 30
    ours = np.tile(model.prior, (180, 1))
    soft.add_trees(ours, x, model.features, model.cuts, model.leaves)
    assert np.allclose(ours, margin, atol=1e-9)
    guess = [row["guess"] for row in ens.guesses(model, df).orderBy("key").collect()]
    assert guess == ours.argmax(axis=1).tolist()

    monkeypatch.setattr(soft, "HISTOGRAM", 1)  # one class in turn
    again = learner.fit(df.repartition(7))
    assert (again.features == model.features).all() and (again.leaves == model.leaves).all()


def test_importances_sum_the_cuts(spark, table):
    df, _, _ = table
    model = soft.SoftmaxBoosting(rounds=2, depth=2, least_rows=5).fit(df)
    rows = model.importances(spark, 3).orderBy("feature").collect()
    assert [r["feature"] for r in rows] == [0, 1, 2]
    assert sum(r["splits"] for r in rows) == (model.features >= 0).sum()
    assert sum(r["gain"] for r in rows) == pytest.approx(model.gains.sum())


def test_nulls_missing_numbers_one_class_and_no_rows(spark, table):
    df, x, _ = table
    learner = soft.SoftmaxBoosting(rounds=2, depth=2, least_rows=5)
    nulls = df.withColumn("vector", F.when(F.col("key") % 9 != 0, F.col("vector"))).withColumn("label", F.when(F.col("key") % 7 != 0, F.col("label")))
    out = ens.guesses(learner.fit(nulls), nulls).collect()
    assert all((r["guess"] is None) == (r["key"] % 9 == 0) for r in out) and len(out) == 180

    gone = prep.to_vector(df.select("key", "label", F.transform("features", lambda v, i: F.when((i == 1) & (F.col("key") % 3 == 0), F.lit(float("nan"))).otherwise(v)).alias("features")))
    assert ens.guesses(learner.fit(gone), gone).filter("guess IS NULL").count() == 0

    single = df.filter("label = 0")
    assert {r["guess"] for r in ens.guesses(learner.fit(single), df).collect()} == {0.0}
    with pytest.raises(ValueError):
        learner.fit(df.limit(0))


def test_more_rounds_learn_the_training_rows(table):
    df, x, label = table
    model = soft.SoftmaxBoosting(rounds=12, depth=4, rate=0.3, least_rows=1).fit(df)
    accuracy, _ = ens.score(ens.guesses(model, df))
    assert accuracy > 0.95


def test_groups_get_the_models_they_get_alone(spark, table, monkeypatch):
    df, _, _ = table
    monkeypatch.setattr(soft, "ROWS", 7)  # many blocks
    learner = soft.SoftmaxBoosting(rounds=3, depth=3, least_rows=3, settle_every=2)
    parts = df.withColumn("part", F.when(F.col("key") % 3 == 0, 4).when(F.col("label") < 3, 9))  # other classes, rows of none
    together = learner.fit_groups(parts.repartition(5), "part")
    assert sorted(together) == [4, 9]
    for part, model in together.items():
        alone = learner.fit(parts.filter(F.col("part") == part))
        assert (alone.features == model.features).all() and (alone.cuts == model.cuts).all() and (alone.leaves == model.leaves).all() and (alone.prior == model.prior).all()
    assert [m.leaves.shape[1] for m in together.values()] == [4, 3]


def test_deep_and_shallow_trees_route_alike(monkeypatch):
    draw = np.random.default_rng(3)
    values = draw.normal(size=(50, 2))
    values[::9] = np.nan
    features, cuts = draw.integers(-1, 2, (4, 15)), draw.normal(size=(4, 15))
    shallow = soft.route(values, features, cuts, 4)
    monkeypatch.setattr(soft, "SHALLOW", 0)
    assert (soft.route(values, features, cuts, 4) == shallow).all() and len(np.unique(shallow)) > 8


def test_participants_are_identified_with_all_rounds(spark, monkeypatch, tmp_path):
    """The query fits the operator's default boosting in the default folds, as the study does."""
    import __spark_entry__ as entry
    from strideframe.plans import studies

    asked = {}
    monkeypatch.setattr(studies, "identify_participants", lambda table, activities, learner, **more: asked.update(a=list(activities), learner=learner, more=more))
    entry.queries()["q7_participant_identification"](spark, "/root/testdata/sf0.001")
    assert asked == {"a": ["A", "N", "R"], "learner": soft.SoftmaxBoosting(), "more": {}} and soft.SoftmaxBoosting().rounds == 100
