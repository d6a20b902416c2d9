"""Queries of preparation (V) and models (M) with their SQL answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from strideframe.functions.scalars import spread_order
from strideframe.operators import prep
from strideframe.operators.models import cut_sequences as cut, closed_form as closed, ensembles as ens, kernel_grid, neighbours as knn, sequences as seq, softmax_trees as soft
from strideframe.plans.inputs import KEYS, frame_windows, frames, load, long_vectors, r6, r9, vectors, windows
from strideframe.plans.registry import query, table
from strideframe.session import settle

P = 64


def train_test(spark, d):
    rows = vectors(spark, d)
    return rows.filter("split = 'Train'"), rows.filter("split = 'Test'")


def model_tables(spark, d, width=P):
    """Training and test tables with a vector of the features, standardised on the training rows."""
    train, test = (prep.pick(df, range(width)) for df in train_test(spark, d))
    (train, test), _ = prep.fit_standardise(train, test)
    out = [settle(prep.to_vector(df).withColumn("label", F.col("label").cast("double"))) for df in (train, test)]
    return out[0], out[1]


def long(df):
    return df.select("vec_id", F.posexplode("features").alias("feature", "x"))


table("mom", "SELECT feature, avg(x) AS m, stddev_pop(x) AS s, min(x) AS lo, max(x) AS hi FROM lv WHERE split = 'Train' GROUP BY 1", "lv")
table("std", "SELECT lv.*, (x - m) / CASE WHEN s > 0 THEN s ELSE 1 END AS z, (x - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1 END AS u FROM lv JOIN mom USING (feature)", "lv mom")


@query("v1_standardise", "std", "SELECT vec_id, feature, round(z, 6) AS x FROM std")
def _(spark, d):
    (out,), _ = prep.fit_standardise(train_test(spark, d)[0], vectors(spark, d))[0][1:], 0
    return long(out).withColumn("x", F.round("x", 6))


@query("v2_unit_range", "std", "SELECT vec_id, feature, round(u, 6) AS x FROM std")
def _(spark, d):
    out = prep.unit_range(train_test(spark, d)[0], vectors(spark, d))[1]
    return long(out).withColumn("x", F.round("x", 6))


@query("v3_unit_norm", "lv", "SELECT vec_id, feature, round(x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)), 6) AS x FROM lv")
def _(spark, d):
    return long(prep.unit_norm(vectors(spark, d))).withColumn("x", F.round("x", 6))


@query("v4_binarise", "lv", "SELECT vec_id, feature, CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS x FROM lv")
def _(spark, d):
    return long(prep.binarise(vectors(spark, d)))


@query("v5_label_codes", "", "SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS code FROM (SELECT DISTINCT event_type FROM events)")
def _(spark, d):
    return prep.label_codes(load(spark, d, "events"), "event_type")


@query("v6_preparation_checks", "lv", """WITH f AS (SELECT feature, avg(x) AS m, stddev_pop(x) AS s, min(x) AS lo, max(x) AS hi FROM lv GROUP BY 1), z AS (SELECT lv.*, (x - m) / s AS z, (x - lo) / (hi - lo) AS u FROM lv JOIN f USING (feature)), n AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM lv GROUP BY 1)
  SELECT 'scaling' AS step, 'smallest value' AS "check", round(min(x), 6) AS before, round(min(u), 6) AS after FROM z UNION ALL SELECT 'scaling', 'largest value', round(max(x), 6), round(max(u), 6) FROM z
  UNION ALL SELECT 'normalization', 'smallest norm', round(min(n), 6), 1.0 FROM n UNION ALL SELECT 'normalization', 'largest norm', round(max(n), 6), 1.0 FROM n
  UNION ALL SELECT 'binarization', 'share above threshold', round(avg(CASE WHEN x > 0 THEN 1 ELSE 0 END), 6), round(avg(CASE WHEN x > 0 THEN 1 ELSE 0 END), 6) FROM lv
  UNION ALL SELECT 'standardization', 'largest absolute mean', round(max(abs(m)), 6), 0.0 FROM f UNION ALL SELECT 'standardization', 'smallest deviation', round(min(s), 6), 1.0 FROM f UNION ALL SELECT 'standardization', 'largest deviation', round(max(s), 6), 1.0 FROM f""")
def _(spark, d):
    out = prep.preparation_checks(settle(vectors(spark, d)))
    return out.select("step", "check", r6(F.col("before"), "before"), (F.round("after", 6) + F.lit(0.0)).alias("after"))


@query("v7_components")
def _(spark, d):
    (train,), _ = prep.fit_standardise(train_test(spark, d)[0])
    _, shares = prep.components(train, 10)
    return prep.share_table(train, shares).select("component", r6(F.col("share"), "share"), r6(F.col("cumulative"), "cumulative"))


CHI_SQL = """SELECT feature, sum((o - e) * (o - e) / e) AS score FROM (SELECT feature, o, sum(o) OVER (PARTITION BY feature) * n / sum(n) OVER (PARTITION BY feature) AS e FROM (SELECT feature, label, sum(u) AS o, count(*)::DOUBLE AS n FROM std WHERE split = 'Train' GROUP BY ALL)) GROUP BY 1"""
F_SQL = """SELECT feature, (sum(n * (m - g) * (m - g)) / (count(*) - 1)) / (sum(w) / (sum(n) - count(*))) AS score FROM (SELECT *, sum(n * m) OVER (PARTITION BY feature) / sum(n) OVER (PARTITION BY feature) AS g FROM (SELECT feature, label, avg(x) AS m, var_pop(x) * count(*) AS w, count(*)::DOUBLE AS n FROM lv WHERE split = 'Train' GROUP BY ALL)) GROUP BY 1"""


@query("v8_chi_squared", "std", f"SELECT feature, round(score, 6) AS score FROM ({CHI_SQL})")
def _(spark, d):
    (train,) = prep.unit_range(train_test(spark, d)[0])
    return prep.chi_squared(train, "label").select("feature", r6(F.col("score"), "score"))


@query("v9_anova_best", "lv", f"SELECT feature, round(score, 6) AS score FROM ({F_SQL}) ORDER BY score DESC, feature LIMIT 20")
def _(spark, d):
    scores = prep.anova_f(train_test(spark, d)[0], "label")
    return scores.orderBy(F.col("score").desc(), "feature").limit(20).select("feature", r6(F.col("score"), "score"))


@query("v10_recursive_elimination")
def _(spark, d):
    (train,), _ = prep.fit_standardise(train_test(spark, d)[0])
    return prep.eliminate(train, "label", 20, share=0.25, iterations=30)


@query("v11_tree_importances")
def _(spark, d):
    return prep.forest_importances(train_test(spark, d)[0], "label", trees=20, depth=6).drop("upto")


@query("v12_smallest_set")
def _(spark, d):
    return prep.smallest_set(prep.forest_importances(train_test(spark, d)[0], "label", trees=20, depth=6))


table("codes", """SELECT vec_id, label, feature, CASE WHEN x < m - s THEN 0 WHEN x > m + s THEN 2 ELSE 1 END AS level FROM lv JOIN (SELECT feature, avg(x) AS m, stddev_pop(x) AS s FROM lv GROUP BY 1) USING (feature)""", "lv")
table("mi", """SELECT feature, sum(p * ln(p / (a * b))) AS information FROM (SELECT feature, n / t AS p, sum(n) OVER (PARTITION BY feature, level) / t AS a, sum(n) OVER (PARTITION BY feature, label) / t AS b FROM (SELECT *, sum(n) OVER (PARTITION BY feature) AS t FROM (SELECT feature, level, label, count(*)::DOUBLE AS n FROM codes GROUP BY ALL))) GROUP BY 1""", "codes")


@query("v13_discretise", "codes", "SELECT vec_id, feature, level FROM codes")
def _(spark, d):
    return prep.discretise(vectors(spark, d)).select("vec_id", F.posexplode("codes").alias("feature", "level"))


@query("v14_mutual_information", "mi", "SELECT feature, round(information, 9) AS information FROM mi")
def _(spark, d):
    coded = prep.discretise(vectors(spark, d))
    return prep.mutual_information(prep.joint_counts(coded, F.col("label"), P)).select("feature", r9(F.col("information"), "information"))


@query("v15_redundancy_ranking")
def _(spark, d):
    return prep.rank_by_redundancy(vectors(spark, d), F.col("label"), 6)


@query("v16_joined_blocks")
def _(spark, d):
    (train, test), _ = prep.fit_standardise(*train_test(spark, d))
    _, both = prep.joined_blocks(train, test, "label", 5)
    from pyspark.ml.functions import vector_to_array

    return both.select("vec_id", F.posexplode(vector_to_array("vector")).alias("feature", "x")).withColumn("x", F.round(F.abs("x"), 4))


@query("v17_feature_sets")
def _(spark, d):
    train, test = (settle(df.withColumn("label", F.col("label").cast("double"))) for df in prep.fit_standardise(*train_test(spark, d))[0])
    rows = train.count()
    best = prep.best_features(prep.chi_squared(prep.unit_range(train)[0], "label"), 10)
    (ptrain, ptest), _ = prep.components(train, 10, test)
    sets = {"best by chi squared": [prep.pick(df, best) for df in (train, test)], "components": [ptrain, ptest]}
    out = []
    for name, (a, b) in sets.items():
        _, accuracy, f1 = ens.fit_and_score(prep.logistic(rows, 30), prep.to_vector(a), prep.to_vector(b))
        out.append((name, 10, accuracy, f1))
    return spark.createDataFrame(out, "method string, kept int, test_accuracy double, test_macro_f1 double")


# ---- models with closed answers ------------------------------------------------------------------------

table("nn", """SELECT test, neighbour, neighbour_label, d, row_number() OVER (PARTITION BY test ORDER BY d, neighbour) AS place FROM (SELECT a.vec_id AS test, b.vec_id AS neighbour, b.label AS neighbour_label,
  list_sum(list_transform(list_zip(a.features, b.features), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM fw a JOIN fw b ON a.split = 'Test' AND b.split = 'Train')""", "fw")


def neighbours(spark, d, k=5):
    train, test = train_test(spark, d)
    return knn.nearest(train, test, "vec_id", "label", k)


@query("m1_nearest_neighbours", "nn", "SELECT test AS vec_id, place::INTEGER AS place, neighbour, neighbour_label, round(d, 6) AS distance FROM nn WHERE place <= 5")
def _(spark, d):
    return neighbours(spark, d).withColumn("distance", F.round("distance", 6))


@query("m1_neighbour_vote", "nn", "SELECT vec_id, guess FROM (SELECT test AS vec_id, neighbour_label AS guess, row_number() OVER (PARTITION BY test ORDER BY count(*) DESC, neighbour_label) AS k FROM nn WHERE place <= 5 GROUP BY test, neighbour_label) WHERE k = 1")
def _(spark, d):
    return knn.vote(neighbours(spark, d), "vec_id")


@query("m2_tune_neighbours", "nn fw", """WITH g AS (SELECT k, test, neighbour_label AS guess FROM (SELECT k, test, neighbour_label, row_number() OVER (PARTITION BY k, test ORDER BY count(*) DESC, neighbour_label) AS r FROM nn JOIN (SELECT unnest([1, 3, 5]) AS k) ON place <= k GROUP BY k, test, neighbour_label) WHERE r = 1),
  a AS (SELECT k, avg(CASE WHEN guess = label THEN 1 ELSE 0 END) AS accuracy FROM g JOIN fw ON test = vec_id GROUP BY 1) SELECT k::INTEGER AS k, round(accuracy, 9) AS accuracy, k = (SELECT arg_max(k, (accuracy, -k)) FROM a) AS best FROM a""")
def _(spark, d):
    out = knn.tune_neighbours(neighbours(spark, d), train_test(spark, d)[1], "vec_id", "label", (1, 3, 5))
    return out.withColumn("accuracy", F.round("accuracy", 9))


table("cst", "SELECT label, feature, avg(x) AS m, var_pop(x) AS v, count(*)::DOUBLE AS n FROM lv WHERE split = 'Train' GROUP BY ALL", "lv")


@query("m3_nearest_centroid", "lv cst", """SELECT vec_id, arg_min(label, (d, label)) AS guess FROM (SELECT vec_id, cst.label, sum((x - m) * (x - m)) AS d FROM lv JOIN cst USING (feature) WHERE split = 'Test' GROUP BY ALL) GROUP BY 1""")
def _(spark, d):
    return closed.nearest_centroid(*train_test(spark, d), "label").select("vec_id", "guess")


@query("m4_linear_discriminant")
def _(spark, d):
    return closed.linear_discriminant(*train_test(spark, d), "label").select("vec_id", "label", "guess")


@query("m5_naive_bayes", "lv cst", """WITH e AS (SELECT 1e-9 * max(v) AS e FROM (SELECT var_pop(x) AS v FROM lv WHERE split = 'Train' GROUP BY feature)), t AS (SELECT count(*)::DOUBLE AS t FROM fw WHERE split = 'Train')
  SELECT vec_id, arg_min(label, (d, label)) AS guess FROM (SELECT vec_id, cst.label, sum(ln(2 * pi() * (v + e)) + (x - m) * (x - m) / (v + e)) - 2 * ln(max(n) / max(t)) AS d FROM lv JOIN cst USING (feature) CROSS JOIN e CROSS JOIN t WHERE split = 'Test' GROUP BY ALL) GROUP BY 1""".replace("GROUP BY ALL) GROUP BY 1", "GROUP BY vec_id, cst.label) GROUP BY 1"))
def _(spark, d):
    return closed.naive_bayes(*train_test(spark, d), "label").select("vec_id", "guess")


# ---- MLlib learners ------------------------------------------------------------------------------------

def guess_query(make, tables=model_tables):
    def run(spark, d):
        train, test = tables(spark, d)
        model = make(train).fit(train)
        return ens.guesses(model, test).select("vec_id", "label", "guess")

    return run


query("m6_kernel_machine")(lambda spark, d: kernel_query(spark, d))
query("m8_random_forest")(guess_query(lambda train: ens.random_forest(20, depth=6)))
query("m10_decision_tree")(guess_query(lambda train: ens.decision_tree(depth=8)))
query("m11_logistic_regression")(guess_query(lambda train: prep.logistic(train.count(), 50)))
query("m12_bagged_trees")(guess_query(lambda train: ens.bagged_trees(20, depth=6)))


def kernel_query(spark, d):
    train, test = model_tables(spark, d)
    machine = kernel_grid.fit_one(train, 10.0, 0.01, P)
    return kernel_grid.guess_labels(test, machine).select("vec_id", "label", "guess")


@query("m7_stump_boosting")
def _(spark, d):
    train, test = model_tables(spark, d)
    stumps = ens.fit_stumps(train, 10, rounds=5)
    return ens.stump_votes(stumps, test, 10).select("vec_id", "label", "guess")


@query("m9_tune_trees")
def _(spark, d):
    train, test = model_tables(spark, d)
    model = ens.random_forest(10, depth=5).fit(train)
    return ens.tune_trees(model, test, (5, 10), 10)


@query("m13_hard_vote")
def _(spark, d):
    train, test = model_tables(spark, d)
    rows = train.count()
    models = [prep.logistic(rows, 20).fit(train), ens.decision_tree(depth=5).fit(train), ens.random_forest(5, depth=5).fit(train)]
    return ens.hard_vote(models, test).select("vec_id", "label", "guess")


def boosted(spark, d):
    train, test = model_tables(spark, d)
    return soft.SoftmaxBoosting(rounds=20).fit(train), test


@query("m14_gradient_boosting")
def _(spark, d):
    model, test = boosted(spark, d)
    return ens.guesses(model, test).select("vec_id", "label", "guess")


@query("m15_split_importances")
def _(spark, d):
    model, _ = boosted(spark, d)
    return model.importances(spark, P)


def regression_tables(spark, d):
    """First feature of the vectors from all others."""
    out = []
    for df in train_test(spark, d):
        target = F.col("features")[0]
        out.append(settle(prep.to_vector(prep.pick(df.withColumn("label", target), range(1, P)))))
    return out[0], out[1]


query("m16_linear_regression")(guess_query(lambda train: ens.linear_regression(), regression_tables))
query("m17_forest_regression")(guess_query(lambda train: ens.forest_regression(10, depth=5), regression_tables))


def sequences(spark, d, size=8):
    """Windows of three-channel frames as sequences with the code of their majority label."""
    from strideframe.operators.windows import gather, majority_labels

    members = frame_windows(spark, d)
    packed = gather(members, ["recording", "win"], ["x", "y", "z"])
    rows = packed.withColumn("frames", F.transform(F.arrays_zip("x", "y", "z"), lambda f: F.array(f["x"], f["y"], f["z"])))
    labels = majority_labels(members, ["recording", "win"])
    code = F.when(F.col("label") == "A", 0).when(F.col("label") == "N", 1).otherwise(2)
    return settle(rows.join(labels, ["recording", "win"]).select("recording", "win", "frames", code.alias("code")))


@query("m18_left_right_states")
def _(spark, d):
    rows = sequences(spark, d)
    models = seq.fit_left_right(rows.filter("recording % 4 <> 0"), "code", rounds=3)
    test = rows.filter("recording % 4 = 0")
    return test.select("recording", "win", "code", seq.classify_sequences(models, F.col("frames")).alias("guess"))


@query("m19_mixture_states")
def _(spark, d):
    rows = sequences(spark, d)
    model = seq.fit_ergodic(rows, "frames", 4, 2, 3)
    return rows.select("recording", "win", F.posexplode(seq.state_paths(model, F.col("frames"))).alias("t", "state"))


def recordings(spark, d):
    """Whole recordings as sequences of three-channel frames with a class of each."""
    rows = frames(spark, d).select("recording", "pos", "n", F.array("x", "y", "z").alias("features"), (F.col("recording") % 3).alias("code"))
    return settle(cut.cut_frames(rows, "recording", "features", "code", whole="n"))


@query("m18_whole_recordings")
def _(spark, d):
    parts = recordings(spark, d)
    models = seq.fit_left_right(parts.filter("recording % 4 <> 0"), "label", expect=cut.cut_expectation)
    test = parts.filter("recording % 4 = 0")
    found = cut.classify(test, "recording", models)
    return found.join(test.select("recording", "whole", F.col("label").alias("code")).distinct(), "recording")


@query("m19_whole_recordings")
def _(spark, d):
    parts = recordings(spark, d).withColumn("label", F.lit(0))
    model = seq.fit_ergodic(parts, "frames", expect=cut.cut_expectation)
    return cut.paths(parts, "recording", model)


def cluster_table(spark, d):
    return settle(prep.to_vector(vectors(spark, d)))


@query("m20_kmeans")
def _(spark, d):
    rows = cluster_table(spark, d)
    return ens.guesses(ens.best_kmeans(rows, 6, 2), rows).select("vec_id", "label", F.col("guess").alias("cluster"))


@query("m21_diagonal_mixture")
def _(spark, d):
    rows = cluster_table(spark, d)
    model, _ = seq.fit_mixture(rows, parts=6, rounds=5)
    return rows.select("vec_id", "label", seq.mixture_part(model, F.col("features")).alias("cluster"))


@query("m22_hierarchical")
def _(spark, d):
    rows = cluster_table(spark, d)
    return ens.guesses(ens.hierarchical(rows, 6), rows).select("vec_id", "label", F.col("guess").alias("cluster"))


@query("m23_match_clusters")
def _(spark, d):
    rows = settle(cluster_table(spark, d).withColumn("cluster", (spread_order(F.col("vec_id")) % 3 + F.col("label")) % 10))
    return ens.match_clusters(rows, "cluster", "label")
