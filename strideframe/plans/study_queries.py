"""Queries of whole studies (Q), model comparisons (M24-M27), the flagship and the streaming twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from strideframe.operators import aggregate as agg, budget as bud, clean, features as feat, fold_statistics as stats, folds as fold, metrics as met, prep
from strideframe.operators.models import ensembles as ens, softmax_trees as soft
from strideframe.operators.ordering import union_tables
from strideframe.operators.windows import gather
from strideframe.plans import budget_queries as bq, cleaning_queries as cq, comparison_queries as jq, measure_queries as mq, model_queries as vq, series_queries as sq, studies as st
from strideframe.plans.inputs import KEYS, ORDER, frame_windows, frames, r6, r9, vectors, windows
from strideframe.plans.registry import query, table
from strideframe.session import scratch_path, settle
from strideframe.streaming import twins

WIN = ["recording", "win"]

# ---- flagship: windows, features, folds, nearest centroid, scores ------------------------------------------

table("ft", """SELECT w.recording, w.win, w.recording % 5 AS fold, l.guess AS label, avg(v) AS m, var_pop(v) AS s FROM win w JOIN wlab l ON w.recording = l.recording AND w.win = l.win GROUP BY ALL""", "win wlab")
table("fguess", """SELECT recording, win, fold, label AS truth, arg_min(g, (d, g)) AS guess FROM (SELECT ft.*, c.label AS g, (m - cm) * (m - cm) + (s - c.cs) * (s - c.cs) AS d FROM ft JOIN (
  SELECT f.fold, label, avg(m) AS cm, avg(s) AS cs FROM (SELECT DISTINCT fold FROM ft) f JOIN ft ON ft.fold <> f.fold GROUP BY f.fold, label) c ON c.fold = ft.fold) GROUP BY ALL""", "ft")


def flagship_guesses(spark, d):
    members = windows(spark, d)
    rows = settle(feat.window_table(members, WIN, ["v"]).withColumn("fold", F.col("recording") % 5))
    return st.cross_fold_centroids(rows, "fold", "label", ["mean_v", "variance_v"])


@query("flagship", "fguess lab", """WITH c AS (SELECT fold, lab.label, coalesce(sum(1) FILTER (truth = lab.label AND guess = lab.label), 0)::DOUBLE AS h, coalesce(sum(1) FILTER (guess = lab.label), 0)::DOUBLE AS g, coalesce(sum(1) FILTER (truth = lab.label), 0)::DOUBLE AS a FROM fguess CROSS JOIN lab GROUP BY ALL)
  SELECT fold, round(avg(CASE WHEN g > 0 THEN h / g ELSE 0 END), 9) AS precision_all, round(avg(CASE WHEN a > 0 THEN h / a END), 9) AS recall_all FROM c GROUP BY 1""")
def _(spark, d):
    guessed = flagship_guesses(spark, d)
    out = met.score_frames(met.pair_counts(guessed, ["fold"], "label", "guess"), mq.LABELS, mq.NULL, ["fold"])
    return out.select("fold", r9(F.col("precision_all"), "precision_all"), r9(F.col("recall_all"), "recall_all"))


# ---- recognition chain ----------------------------------------------------------------------------------------

def chain_frames(spark, d):
    """Frames of two subjects (suppliers by parity), each recording in two repetition blocks, flags as codes."""
    rows = frames(spark, d)
    code = F.when(F.col("label") == "A", 1).when(F.col("label") == "N", 2).otherwise(3).cast("long")
    return settle(
        rows.select((F.col("recording") % 2).alias("subject"), "recording", "pos", "n", "x", "y", "z", code.alias("code"), F.floor(F.col("pos") * 2 / F.col("n")).alias("block"))
    )


def chain(spark, d, configurations):
    out = st.sweep_configurations(chain_frames(spark, d), configurations, [1, 2, 3], 1)
    return out.drop("null")


@query("q2_chain_configuration")
def _(spark, d):
    return chain(spark, d, [st.Configuration()])


@query("q3_classifier_by_name")
def _(spark, d):
    rows = chain_frames(spark, d)
    table = settle(st.chain_windows(rows, st.Configuration(), ["x", "y", "z"]))
    names = ["nearestClassCentroid", "gaussianNaiveBayes", "linearDiscriminant", "kNearestNeighbour"]
    chosen = {**{n: st.Configuration(classifier=n) for n in names}, "ranked prefix of 2": st.Configuration(feature_count=2)}
    work = [(plan, n) for plan in st.rounds_of(table) for n in chosen]
    parts = st.in_parallel(lambda w: st.predict_round(table, w[0], chosen[w[1]]).withColumn("classifier", F.lit(w[1])), work)
    keys = ["classifier", "scheme", "subject", "train_subject", "held"]
    counts = met.pair_counts(st.union(parts).fillna(-1, ["held"]), keys, "code", "guess")
    return met.score_fold(counts, [1, 2, 3], keys)


@query("q4_feature_and_size_sweeps")
def _(spark, d):
    base = st.Configuration()
    return chain(spark, d, [*st.sweep_of(base, "features", ["Simple"]), *st.sweep_of(base, "size", [16])])


@query("q5_sensor_and_classifier_sweeps")
def _(spark, d):
    base = st.Configuration()
    return chain(spark, d, [*st.sweep_of(base, "channels", [("x",), ("y", "z")]), *st.sweep_of(base, "classifier", ["gaussianNaiveBayes"])])


@query("q9_round_tables")
def _(spark, d):
    base = st.Configuration()
    basic = chain(spark, d, [base]).withColumn("section", F.lit("basic"))
    ranked = chain(spark, d, st.sweep_of(base, "feature_count", [2])).withColumn("section", F.lit("selection")).drop("event_precision_all")
    return union_tables([basic, ranked])


@query("q8_segment_inventory", "runs segs", f"""WITH {cq.BLOCK_SQL}, k AS (SELECT recording, bool_and(ok) AS blocks_complete FROM (SELECT recording, block, coalesce(list_sort(list(label) FILTER (br = 1 AND label <> 'error')) = ['click','purchase','signup','view'], false) AS ok FROM blocks GROUP BY ALL) GROUP BY 1)
  SELECT s.recording, label, count(*) AS segments, sum(frames)::BIGINT AS frames, max(frames / 2.0::DOUBLE) AS max_seconds, median(frames / 2.0::DOUBLE) AS median_seconds, blocks_complete FROM segs s JOIN k ON s.recording = k.recording GROUP BY ALL""")
def _(spark, d):
    runs = settle(cq.runs(spark, d))
    blocks = settle(clean.repetition_blocks(runs, KEYS, "error"))
    out = st.segment_inventory(runs, blocks, KEYS, 2.0, "error", ["click", "purchase", "signup", "view"], 1.0, 4.0)
    return out.select("recording", "label", "segments", "frames", "max_seconds", "median_seconds", "blocks_complete")


# ---- window selection pilot --------------------------------------------------------------------------------------

@query("q1_selection_pilot")
def _(spark, d):
    members = frame_windows(spark, d)
    packed = gather(members, WIN, ["x", "y", "z"])
    vectors_, _names = feat.recognizer_features(packed, WIN, ["x", "y", "z"], 8, 4.0, (0.5, 1.0, 2.0))
    scored = bq.scored_windows(spark, d)
    code = F.when(F.col("truth") == "A", 0).when(F.col("truth") == "N", 1).otherwise(2)
    table = vectors_.select(F.col("recording").alias("stream"), F.col("win").alias("pos"), "features").join(scored.drop("fold"), ["stream", "pos"])
    table = table.select("stream", "pos", F.col("stream").alias("who"), code.alias("code"), "features", *bud.SCORES)
    curves, _ = st.pilot(settle(table), [0, 1, 2], folds=3, trees=5, budgets=(20, 100), methods=("uniformStride", "random", "windowChange", "changeTrigger"))
    return curves


# ---- protocol comparison ---------------------------------------------------------------------------------------------

def protocol_rows(spark, d):
    rows = vectors(spark, d)
    return settle(rows.select(F.col("vec_id").alias("key"), F.col("participant").alias("who"), F.col("label").cast("long").alias("code"), "features"))


@query("q6_protocol_comparison")
def _(spark, d):
    rows = protocol_rows(spark, d)
    part = settle(fold.subsample(rows, ["who", "code"], "key", 0.1))
    names, labels = list(stats.SETTINGS), list(range(10))
    tables = []
    for variant, source, keep in (("full", rows, None), ("subsample", part, None), ("selected", rows, 16)):
        for protocol in st.PROTOCOLS:
            scores = stats.fold_scores(stats.evaluate_folds(source, protocol, names, keep=keep), labels)
            tables.append(settle(scores.select(F.lit(variant).alias("variant"), F.lit(protocol).alias("protocol"), "*")))
    return agg.summarise_folds(st.union(tables), ["variant", "protocol", "classifier"], ["accuracy", "macro_f1"], ["accuracy", "macro_f1"])


@query("m26_fold_statistics", "fw", f"""WITH f AS (SELECT vec_id AS key, label::BIGINT AS code, features, (row_number() OVER (PARTITION BY label ORDER BY {sq.hash_sql('vec_id')}, vec_id) - 1) % 10 AS fold FROM fw WHERE label IS NOT NULL AND features IS NOT NULL),
  o AS (SELECT unnest(range(10)) AS o),
  r AS (SELECT o, key, code, (row_number() OVER (PARTITION BY o, code ORDER BY {sq.hash_sql('key', 7)}, key) - 1) % 3 = 0 AS valid FROM f JOIN o ON o <> fold),
  l AS (SELECT key, code, fold, unnest(features) AS x, unnest(range(len(features))) AS i FROM f),
  rows AS (SELECT 'final' AS phase, o, key, true AS train FROM r UNION ALL SELECT 'final', fold, key, false FROM f UNION ALL SELECT 'inner', o, key, NOT valid FROM r),
  scale AS (SELECT o, i, var_pop(x) AS spread FROM r JOIN l USING (key) GROUP BY o, i),
  whole AS (SELECT phase, o, i, avg(x) AS mu, var_pop(x) / any_value(spread) AS share FROM rows JOIN l USING (key) JOIN scale USING (o, i) WHERE train GROUP BY phase, o, i),
  most AS (SELECT phase, o, max(share) AS share FROM whole GROUP BY phase, o),
  c AS (SELECT phase, o, code, i, count(*)::DOUBLE AS n, avg(x) AS m, var_pop(x) AS v FROM rows JOIN l USING (key) WHERE train GROUP BY phase, o, code, i),
  t AS (SELECT phase, o, code, sum(n) OVER (PARTITION BY phase, o) AS rows, n FROM c WHERE i = 0),
  s AS (SELECT * FROM (VALUES ('nearestClassCentroid', 0.0::DOUBLE), ('nearestClassCentroid', 0.25), ('nearestClassCentroid', 0.5), ('gaussianNaiveBayes', 1e-9), ('gaussianNaiveBayes', 1e-3), ('gaussianNaiveBayes', 1e-1)) x(classifier, setting)),
  m AS (SELECT phase, o, c.code, i, classifier, setting, spread, CASE classifier WHEN 'gaussianNaiveBayes' THEN c.m ELSE mu * setting + c.m * (1 - setting) END AS m,
      CASE classifier WHEN 'gaussianNaiveBayes' THEN c.v + setting * most.share * spread ELSE spread END AS v FROM c JOIN whole USING (phase, o, i) JOIN most USING (phase, o) JOIN scale USING (o, i), s),
  d AS (SELECT rows.phase, rows.o, key, l.code AS truth, classifier, setting, m.code AS g, sum((x - m) * (x - m) / v + CASE classifier WHEN 'gaussianNaiveBayes' THEN ln(2 * pi() * v / spread) ELSE 0 END) AS d
      FROM rows JOIN l USING (key) JOIN m ON m.phase = rows.phase AND m.o = rows.o AND m.i = l.i WHERE NOT train GROUP BY ALL),
  e AS (SELECT d.phase, d.o, key, truth, classifier, setting, g, d - CASE classifier WHEN 'gaussianNaiveBayes' THEN 2 * ln(n / rows) ELSE 0 END AS d FROM d JOIN t ON t.phase = d.phase AND t.o = d.o AND t.code = g),
  p AS (SELECT phase, o, key, truth, classifier, setting, arg_min(g, (d, g)) AS guess FROM e GROUP BY ALL),
  k AS (SELECT DISTINCT code FROM f),
  h AS (SELECT o, classifier, setting, k.code, count(*) FILTER (truth = k.code AND guess = k.code)::DOUBLE AS hits, count(*) FILTER (truth = k.code) AS a, count(*) FILTER (guess = k.code) AS b FROM p, k WHERE phase = 'inner' GROUP BY ALL),
  f1 AS (SELECT o, classifier, setting, round(avg(CASE WHEN hits > 0 THEN 2 * (hits / a) * (hits / b) / (hits / a + hits / b) ELSE 0 END), 12) AS f1 FROM h GROUP BY ALL),
  best AS (SELECT o, classifier, arg_min(setting, (-f1, setting)) AS setting FROM f1 GROUP BY ALL)
  SELECT key, o::INTEGER AS fold, classifier, setting, truth, guess FROM p JOIN best USING (o, classifier, setting) WHERE phase = 'final'""")
def _(spark, d):
    return stats.evaluate_folds(protocol_rows(spark, d), "shuffledFolds", ["nearestClassCentroid", "gaussianNaiveBayes"])


@query("m26_unseen_participants")
def _(spark, d):
    return stats.evaluate_folds(protocol_rows(spark, d), "leaveOneSubjectOut", list(stats.SETTINGS), keep=16)


@query("m26_fold_jobs")
def _(spark, d):
    rows = protocol_rows(spark, d)
    supervised = st.run_folds(rows, "features", "shuffledFolds", ["gaussianNaiveBayes", "kNearestNeighbour"], 2, list(range(10)), keep=10)
    clusters = st.run_clusters(rows, "shuffledFolds", ["kMeans", "gaussianMixture"], 2, 10, list(range(10)))
    return st.union([supervised, clusters])


def fold_tables(spark, d):
    """Standardised training and test tables with a group-fold column."""
    train, test = vq.model_tables(spark, d)
    plan = fold.group_folds(train, "participant", 5)
    a = train.join(plan, "participant").select("vec_id", "participant", "features", "vector", "label", "fold")
    return settle(a), settle(test.select("vec_id", "features", "vector", "label"))


@query("m24_grid_search")
def _(spark, d):
    train, test = fold_tables(spark, d)
    table, best = st.grid_search(train, test, (1.0, 10.0, 100.0), (0.0001, 0.001, 0.01), "fold", vq.P)
    refit = best.select("cost", "gamma", "test_accuracy", "test_macro_f1")
    return table.join(refit, ["cost", "gamma"], "left")


@query("m25_workflows")
def _(spark, d):
    return st.workflow_scores(*fold_tables(spark, d), "fold", 20, 3)


@query("m27_compare_models")
def _(spark, d):
    train, test = vq.model_tables(spark, d)
    rows = train.count()
    learners = {"logisticRegression": prep.logistic(rows, 20), "decisionTree": ens.decision_tree(depth=5), "randomForest": ens.random_forest(5, depth=5), "bagging": ens.bagged_trees(5, depth=5), "gradientBoosting": soft.SoftmaxBoosting(rounds=10, depth=3)}
    first = st.compare_learners(train, test, learners)
    a, b = vq.regression_tables(spark, d)
    second = st.compare_regressors(a, b, {"linear": ens.linear_regression(), "forest": ens.forest_regression(5, depth=4)})
    third = st.compare_clusterings(train, {"kMeans": ens.best_kmeans(train, 6, 2), "hierarchical": ens.hierarchical(train, 6)}, "label").withColumnRenamed("method", "model")
    return union_tables([first, second, third])


@query("q7_participant_identification")
def _(spark, d):
    members = frame_windows(spark, d)
    rows = feat.window_table(members, WIN, ["x", "y", "z"])
    names = [f"{s}_{c}" for c in "xyz" for s in ("mean", "variance")]
    table = rows.select(
        (F.col("recording") * 100_000 + F.col("win")).alias("key"), F.col("win").alias("row"), (F.col("recording") * 1000 + F.floor(F.col("win") / 8)).alias("bout"),
        (F.col("recording") % 4).alias("who"), F.col("label").alias("activity"), F.array(*names).alias("features"),
    )
    table = settle(table)
    return st.identify_participants(table, ("A", "N", "R"), soft.SoftmaxBoosting())


@query("q10_descriptive_statistics", "fw lv", """WITH c AS (SELECT label, count(*) FILTER (split = 'Train') AS a, count(*) FILTER (split = 'Test') AS b FROM fw GROUP BY 1),
  s AS (SELECT feature, avg(x) AS mean, median(x) AS median, skewness(x) AS skew FROM lv GROUP BY 1),
  r AS (SELECT corr(a.x, b.x) AS r FROM lv a JOIN lv b ON a.vec_id = b.vec_id AND a.feature < b.feature GROUP BY a.feature, b.feature)
  SELECT 'classes' AS "table", 'Train ' || label AS entry, round(a / sum(a) OVER ()::DOUBLE, 6) AS value FROM c UNION ALL SELECT 'classes', 'Test ' || label, round(b / sum(b) OVER ()::DOUBLE, 6) FROM c
  UNION ALL SELECT 'statistics', m || ' ' || feature, round(v, 6) FROM (SELECT feature, unnest(['mean', 'median', 'skew']) AS m, unnest([mean, median, skew]) AS v FROM s)
  UNION ALL SELECT 'counts', 'skewed', count(*) FILTER (abs(skew) > 0.1)::DOUBLE FROM s UNION ALL SELECT 'counts', 'pairs', count(*)::DOUBLE FROM r
  UNION ALL SELECT 'counts', 'correlated', count(*) FILTER (abs(r) > 0.05)::DOUBLE FROM r UNION ALL SELECT 'counts', 'undefined', count(*) FILTER (r IS NULL OR isnan(r))::DOUBLE FROM r""")
def _(spark, d):
    return st.describe_study(settle(vectors(spark, d)), "label", "split", ["Train", "Test"], 0.1, 0.05).withColumn("value", F.round("value", 6))


@query("q11_load_study", "fw", """SELECT 'rows' AS measure, count(*) AS value FROM fw UNION ALL SELECT 'participants', count(DISTINCT participant) FROM fw UNION ALL SELECT 'activities', count(DISTINCT label) FROM fw UNION ALL SELECT 'rows that differ between two readers', 0""")
def _(spark, d):
    from strideframe.sources import recordings as rec

    matrix, subject, label, names = jq.vector_files(spark, d)
    codes = rec.read_codes(spark, names)
    frame = settle(rec.read_split(spark, matrix, subject, label, codes, "Train", 64))
    again = rec.read_split(spark, matrix, subject, label, codes, "Train", 64)
    return agg.overview({
        "rows": frame.agg(F.count(F.lit(1))),
        "participants": frame.agg(F.count_distinct("subject")),
        "activities": frame.agg(F.count_distinct("Activity")),
        "rows that differ between two readers": frame.exceptAll(again).agg(F.count(F.lit(1))),
    })


# ---- streaming twins ------------------------------------------------------------------------------------------------------

def event_stream(spark, d):
    events = twins.read_table(spark, d, "events.parquet")
    return events.select(F.col("user_id").alias("recording"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.radians("value").alias("v"), F.col("event_type").alias("label"))


@query("st_gap_sessions", "raw", """SELECT recording, count(*) AS samples, min(t) AS first, max(t) AS last FROM (SELECT *, sum(br) OVER (PARTITION BY recording ORDER BY t, event_id) AS s FROM (
  SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY recording ORDER BY t, event_id) <= 86400000000 THEN 0 ELSE 1 END AS br FROM raw)) GROUP BY recording, s""")
def _(spark, d):
    sessions = twins.gap_sessions(event_stream(spark, d), KEYS, "ts", "24 hours")
    return twins.drain(sessions, "complete").select("recording", "samples", F.unix_micros("first").alias("first"), F.unix_micros("last").alias("last"))


@query("st_event_windows", "raw", "SELECT recording, t // 86400000000 AS day, count(*) AS samples, round(avg(v), 6) AS mean FROM raw GROUP BY ALL")
def _(spark, d):
    tumbling = twins.event_windows(event_stream(spark, d), KEYS, "ts", "1 day", None, [F.count(F.lit(1)).alias("samples"), F.avg("v").alias("mean")])
    out = twins.drain(tumbling, "complete")
    return out.select("recording", F.floor(F.unix_micros(F.col("window.start")) / 86_400_000_000).alias("day"), "samples", r6(F.col("mean"), "mean"))


@query("st_hold_last_valid", "gap", "SELECT recording, event_id, round(last_value(v IGNORE NULLS) OVER (PARTITION BY recording ORDER BY t, event_id ROWS UNBOUNDED PRECEDING), 6) AS v FROM gap")
def _(spark, d):
    stream = event_stream(spark, d).select("recording", "event_id", F.when(F.col("event_id") % 11 != 0, F.col("v")).alias("v"), F.unix_micros("ts").alias("t"))
    return twins.drain(twins.hold_last_valid(stream, "recording", ORDER, ["v"])).select("recording", "event_id", r6(F.col("v"), "v"))


def in_thirds(df, pos, spark):
    """A table in three files, earlier positions first, to be streamed one file at a time."""
    path = scratch_path(spark, "thirds")
    for i in range(3):
        df.filter(F.least(F.floor(F.col(pos) / 5), F.lit(2)) == i).coalesce(1).write.mode("append").parquet(path)
    folder, name = path.rsplit("/", 1)
    return twins.read_table(spark, folder, name)


@query("st_change_trigger", "fscore", "SELECT recording, win, round(change, 6) AS change, change IS NULL OR change >= 0.5 AS kept FROM fscore")
def _(spark, d):
    stats = frame_windows(spark, d).groupBy(*WIN).agg(F.array(*[F.avg(c) for c in "xyz"]).alias("means"), F.array(*[F.stddev_pop(c) for c in "xyz"]).alias("deviations"))
    out = twins.drain(twins.change_trigger(in_thirds(settle(stats), "win", spark), "recording", "win", "means", "deviations", 0.5))
    return out.select("recording", "win", F.round(F.nanvl("change", F.lit(None)), 6).alias("change"), "kept")


@query("st_carry_forward", "fin", "SELECT stream, pos, kept, final FROM fin WHERE method = 'uniformStride' AND budget = 20")
def _(spark, d):
    chosen = settle(bq.selected(spark, d, ["uniformStride"], [20]).select("stream", "pos", "kept", F.col("full").alias("guess")))
    return twins.drain(twins.carry_forward(in_thirds(chosen, "pos", spark), "stream", "pos", "kept", "guess")).select("stream", "pos", "kept", "final")


