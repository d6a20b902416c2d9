"""Queries of quality measures (E), aggregates (A), order and set operators (O) with their SQL answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from strideframe.operators import aggregate as agg, clean, metrics as met, ordering as order
from strideframe.operators.ordered import sweep
from strideframe.plans.cleaning_queries import runs, segs
from strideframe.plans.feature_queries import r9_
from strideframe.plans.inputs import KEYS, ORDER, load, long_vectors, predictions, r6, r9, raw_samples, samples, vectors, windows
from strideframe.plans.registry import query, table

LABELS = ["click", "error", "purchase", "signup", "view"]
NULL = "error"

table("pc", "SELECT recording % 5 AS fold, truth, guess, count(*) AS n FROM pr GROUP BY ALL", "pr")
table("pcr", "SELECT recording AS fold, truth, guess, count(*) AS n FROM pr GROUP BY ALL", "pr")
table("lab", f"SELECT unnest({LABELS}) AS label")
for _cc, _pc in (("cc", "pc"), ("ccr", "pcr")):
    table(_cc, f"""SELECT fold, label, coalesce(sum(n) FILTER (truth = label AND guess = label), 0)::DOUBLE AS hits, coalesce(sum(n) FILTER (guess = label), 0)::DOUBLE AS predicted,
      coalesce(sum(n) FILTER (truth = label), 0)::DOUBLE AS actual, sum(n)::DOUBLE AS nrows FROM {_pc} CROSS JOIN lab GROUP BY ALL""", f"{_pc} lab")
table("cs", """SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1 FROM (SELECT *, CASE WHEN predicted > 0 THEN hits / predicted ELSE 0 END AS p, CASE WHEN actual > 0 THEN hits / actual ELSE 0 END AS r,
  CASE WHEN nrows - actual > 0 THEN (nrows - actual - predicted + hits) / (nrows - actual) ELSE 0 END AS sp FROM cc)""", "cc")


def fold_counts(spark, d, by="fold"):
    rows = predictions(spark, d).withColumn("fold", F.col("recording") % 5 if by == "fold" else F.col("recording"))
    return met.pair_counts(rows, ["fold"])


@query("e1_confusion_long", "pc lab", """SELECT f.fold, a.label AS truth, b.label AS guess, coalesce(n, 0) AS n FROM (SELECT DISTINCT fold FROM pc) f CROSS JOIN lab a CROSS JOIN lab b
  LEFT JOIN pc ON pc.fold = f.fold AND pc.truth = a.label AND pc.guess = b.label""")
def _(spark, d):
    return met.confusion_long(fold_counts(spark, d), LABELS, ["fold"])


@query("e1_confusion_wide", "pc", "SELECT fold, truth, " + ", ".join(f"coalesce(sum(n) FILTER (guess = '{v}'), 0)::BIGINT AS as_{v}" for v in LABELS) + " FROM pc GROUP BY ALL")
def _(spark, d):
    return met.confusion_wide(fold_counts(spark, d), LABELS, ["fold"])


@query("e2_frame_scores", "ccr", """SELECT fold, round(avg(coalesce(p, 0)), 9) AS precision_all, round(avg(r), 9) AS recall_all, round(avg(coalesce(p, 0)) FILTER (label <> 'error'), 9) AS precision_non_null,
  round(avg(r) FILTER (label <> 'error'), 9) AS recall_non_null, round(avg(p), 9) AS precision_all_defined, round(avg(p) FILTER (label <> 'error'), 9) AS precision_non_null_defined,
  count(*) FILTER (predicted = 0) AS never_predicted, count(*) FILTER (actual = 0) AS absent FROM (SELECT *, CASE WHEN predicted > 0 THEN hits / predicted END AS p, CASE WHEN actual > 0 THEN hits / actual END AS r FROM ccr) GROUP BY ALL""")
def _(spark, d):
    out = met.score_frames(fold_counts(spark, d, "recording"), LABELS, NULL, ["fold"])
    return out.select("fold", *[r9(F.col(c), c) for c in out.columns[1:7]], "never_predicted", "absent")


FOLD_SQL = """SELECT fold, round(sum(hits) / sum(actual), 9) AS accuracy, round(avg(p), 9) AS macro_precision, round(avg(r), 9) AS macro_recall, round(avg(sp), 9) AS macro_specificity, round(avg(f1), 9) AS macro_f1 FROM cs GROUP BY ALL"""


@query("e3_fold_scores", "cs", FOLD_SQL)
def _(spark, d):
    out = met.score_fold(fold_counts(spark, d), LABELS, ["fold"]).drop("f_of_means")
    return out.select("fold", *[r9(F.col(c), c) for c in out.columns[1:]])


@query("e4_f_of_means", "cs", "SELECT fold, round(2 * avg(p) * avg(r) / (avg(p) + avg(r)), 9) AS f FROM cs GROUP BY ALL")
def _(spark, d):
    return met.score_fold(fold_counts(spark, d), LABELS, ["fold"]).select("fold", r9(F.col("f_of_means"), "f"))


@query("e5_class_report", "pc lab", """WITH c AS (SELECT label, coalesce(sum(n) FILTER (truth = label AND guess = label), 0)::DOUBLE AS h, coalesce(sum(n) FILTER (guess = label), 0)::DOUBLE AS g, coalesce(sum(n) FILTER (truth = label), 0)::DOUBLE AS a, sum(n)::DOUBLE AS t FROM pc CROSS JOIN lab GROUP BY 1),
  s AS (SELECT label, h / g AS p, h / a AS r, (t - a - g + h) / (t - a) AS sp, a FROM c), f AS (SELECT *, 2 * p * r / (p + r) AS f1 FROM s)
  SELECT label, round(p, 9) AS precision, round(r, 9) AS recall, round(f1, 9) AS f1, round(sp, 9) AS specificity, a::BIGINT AS support FROM f
  UNION ALL SELECT 'macro average', round(avg(p), 9), round(avg(r), 9), round(avg(f1), 9), round(avg(sp), 9), sum(a)::BIGINT FROM f
  UNION ALL SELECT 'weighted average', round(sum(p * a) / sum(a), 9), round(sum(r * a) / sum(a), 9), round(sum(f1 * a) / sum(a), 9), round(sum(sp * a) / sum(a), 9), sum(a)::BIGINT FROM f""")
def _(spark, d):
    out = met.class_report(met.pair_counts(predictions(spark, d)), LABELS)
    return out.select("label", *[r9(F.col(c), c) for c in ("precision", "recall", "f1", "specificity")], "support")


@query("e6_headline", "pr", """SELECT round(avg(CASE WHEN truth = guess THEN 1 ELSE 0 END), 9) AS accuracy, count(*) AS test_windows, count(DISTINCT recording) AS test_participants FROM pr WHERE recording % 4 = 0""")
def _(spark, d):
    rows = predictions(spark, d).filter(F.col("recording") % 4 == 0)
    return rows.agg(r9(F.avg((F.col("truth") == F.col("guess")).cast("double")), "accuracy"), F.count(F.lit(1)).alias("test_windows"), F.count_distinct("recording").alias("test_participants"))


@query("e7_auc", "lv", """SELECT class, round((sum(rk) FILTER (hit = 1) - p * (p + 1) / 2) / (p * q), 9) AS auc FROM (SELECT feature AS class, CASE WHEN label = feature THEN 1 ELSE 0 END AS hit,
    rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2 AS rk, sum(CASE WHEN label = feature THEN 1 ELSE 0 END) OVER (PARTITION BY feature)::DOUBLE AS p,
    sum(CASE WHEN label <> feature THEN 1 ELSE 0 END) OVER (PARTITION BY feature)::DOUBLE AS q FROM (SELECT label, feature, round(x, 2) AS x FROM lv) WHERE feature < 10) GROUP BY class, p, q""")
def _(spark, d):
    scores = long_vectors(spark, d).filter("feature < 10").withColumn("x", F.round("x", 2))
    out = met.auc_one_vs_rest(scores, label="feature", truth="label", score="x")
    return out.select(F.col("feature").alias("class"), r9(F.col("auc"), "auc"))


@query("e8_log_loss", "fw", """SELECT split, round(avg(-ln(exp(features[label + 1]) / list_sum([exp(features[i]) for i in range(1, 11)]))), 6) AS log_loss FROM fw GROUP BY 1""")
def _(spark, d):
    ten = F.slice("features", 1, 10)
    norm = F.aggregate(ten, F.lit(0.0), lambda s, x: s + F.exp(x))
    probability = F.exp(F.element_at("features", F.col("label") + 1)) / norm
    return met.log_loss(vectors(spark, d), probability, ["split"]).select("split", r6(F.col("log_loss"), "log_loss"))


@query("e9_adjusted_rand", "pc", """SELECT a.fold, round((b - s * t / m) / ((s + t) / 2 - s * t / m), 9) AS adjusted_rand FROM (SELECT fold, sum(n * (n - 1) / 2)::DOUBLE AS b, sum(n)::DOUBLE * (sum(n)::DOUBLE - 1) / 2 AS m FROM pc GROUP BY 1) a
  JOIN (SELECT fold, sum(k * (k - 1) / 2)::DOUBLE AS s FROM (SELECT fold, truth, sum(n)::DOUBLE AS k FROM pc GROUP BY ALL) GROUP BY 1) x ON a.fold = x.fold
  JOIN (SELECT fold, sum(k * (k - 1) / 2)::DOUBLE AS t FROM (SELECT fold, guess, sum(n)::DOUBLE AS k FROM pc GROUP BY ALL) GROUP BY 1) y ON a.fold = y.fold""")
def _(spark, d):
    return met.adjusted_rand(fold_counts(spark, d), ["fold"]).select("fold", r9(F.col("adjusted_rand"), "adjusted_rand"))


@query("e10_regression_scores", "fw", """SELECT split, round(avg(abs(a - b)), 6) AS mae, round(avg((a - b) * (a - b)), 6) AS mse, round(1 - avg((a - b) * (a - b)) / var_pop(a), 6) AS r2 FROM (SELECT split, features[1] AS a, features[2] AS b FROM fw) GROUP BY 1""")
def _(spark, d):
    out = met.regression_scores(vectors(spark, d), F.element_at("features", 1), F.element_at("features", 2), ["split"])
    return out.select("split", *[r6(F.col(c), c) for c in ("mae", "mse", "r2")])


table("wlab", """SELECT recording, win, label AS guess FROM (SELECT recording, win, label, row_number() OVER (PARTITION BY recording, win ORDER BY count(*) DESC, label) AS r FROM win GROUP BY recording, win, label) WHERE r = 1""", "win")
table("wev", "SELECT wlab.*, runs.label AS truth, runs.run FROM wlab JOIN runs ON wlab.recording = runs.recording AND runs.pos = wlab.win * 4 + 4", "wlab runs")


def centre_events(spark, d):
    """Every window with its majority label and the label and run of its centre frame."""
    from strideframe.operators.compare import join_centres
    from strideframe.operators.windows import majority_labels

    guesses = majority_labels(windows(spark, d), ["recording", "win"]).withColumnRenamed("label", "guess")
    return join_centres(guesses, runs(spark, d), KEYS, F.col("win") * 4 + 4)


@query("e11_event_scores", "wev lab", """WITH c AS (SELECT label, coalesce(sum(1) FILTER (truth = label AND guess = label), 0)::DOUBLE AS h, coalesce(sum(1) FILTER (guess = label), 0)::DOUBLE AS g, coalesce(sum(1) FILTER (truth = label), 0)::DOUBLE AS a FROM wev CROSS JOIN lab GROUP BY 1)
  SELECT round(avg(CASE WHEN g > 0 THEN h / g ELSE 0 END), 9) AS event_precision_all, round(avg(CASE WHEN a > 0 THEN h / a END), 9) AS event_recall_all FROM c""")
def _(spark, d):
    out = met.score_frames(met.pair_counts(centre_events(spark, d)), LABELS, NULL)
    return out.select(r9(F.col("precision_all"), "event_precision_all"), r9(F.col("recall_all"), "event_recall_all"))


@query("e12_detected_segments", "wev segs", """SELECT s.recording, count(*) AS gesture_segments, count(h.run) AS detected FROM (SELECT * FROM segs WHERE label <> 'error') s
  LEFT JOIN (SELECT DISTINCT recording, run FROM wev WHERE truth = guess) h ON s.recording = h.recording AND s.run = h.run GROUP BY 1""")
def _(spark, d):
    hits = centre_events(spark, d).filter(F.col("truth") == F.col("guess"))
    return met.detected_segments(segs(spark, d), hits, KEYS, NULL)


@query("e13_pooled_confusion", "pc", "SELECT truth, guess, sum(n)::BIGINT AS n FROM pc GROUP BY ALL")
def _(spark, d):
    return met.pool(fold_counts(spark, d))


@query("e14_row_percentages", "pc lab", """SELECT truth, guess, round_even(100.0::DOUBLE * n / sum(n) OVER (PARTITION BY truth), 2) AS percent FROM (SELECT a.label AS truth, b.label AS guess, coalesce(sum(n), 0)::DOUBLE AS n FROM lab a CROSS JOIN lab b LEFT JOIN pc ON truth = a.label AND guess = b.label GROUP BY ALL)""")
def _(spark, d):
    return met.row_percentages(met.pair_counts(predictions(spark, d)), LABELS)


@query("e15_event_and_time", "cs wev lab", """WITH c AS (SELECT label, coalesce(sum(1) FILTER (truth = label AND guess = label), 0)::DOUBLE AS h, coalesce(sum(1) FILTER (guess = label), 0)::DOUBLE AS g, coalesce(sum(1) FILTER (truth = label), 0)::DOUBLE AS a FROM wev CROSS JOIN lab GROUP BY 1)
  SELECT 'time' AS kind, round(avg(CASE WHEN g > 0 THEN h / g ELSE 0 END), 9) AS precision_all, round(avg(CASE WHEN a > 0 THEN h / a END), 9) AS recall_all FROM (SELECT label, sum(hits) AS h, sum(predicted) AS g, sum(actual) AS a FROM cs GROUP BY 1)
  UNION ALL SELECT 'event', round(avg(CASE WHEN g > 0 THEN h / g ELSE 0 END), 9), round(avg(CASE WHEN a > 0 THEN h / a END), 9) FROM c""")
def _(spark, d):
    time = met.score_frames(met.pair_counts(predictions(spark, d)), LABELS, NULL).withColumn("kind", F.lit("time"))
    event = met.score_frames(met.pair_counts(centre_events(spark, d)), LABELS, NULL).withColumn("kind", F.lit("event"))
    return time.unionByName(event).select("kind", r9(F.col("precision_all"), "precision_all"), r9(F.col("recall_all"), "recall_all"))


@query("e16_fold_records", "cs", f"SELECT *, CASE WHEN fold % 2 = 0 THEN (fold + 1)::INTEGER END AS neighbours, CASE WHEN fold % 2 = 1 THEN fold > 1 END AS converged FROM ({FOLD_SQL})")
def _(spark, d):
    out = met.score_fold(fold_counts(spark, d), LABELS, ["fold"]).drop("f_of_means")
    return out.select("fold", *[r9(F.col(c), c) for c in out.columns[1:]], F.when(F.col("fold") % 2 == 0, (F.col("fold") + 1).cast("int")).alias("neighbours"), F.when(F.col("fold") % 2 == 1, F.col("fold") > 1).alias("converged"))


# ---- aggregates --------------------------------------------------------------------------------------

def labelled_split(spark, d):
    return load(spark, d, "events").select("user_id", "event_type", F.when(F.col("user_id") % 4 == 0, "Test").otherwise("Train").alias("Data"), "value")


table("ls", "SELECT user_id, event_type, CASE WHEN user_id % 4 = 0 THEN 'Test' ELSE 'Train' END AS Data, value FROM events")


@query("a1_crosstab", "ls lab", """SELECT label AS event_type, "Train"::BIGINT AS "Train", "Test"::BIGINT AS "Test", ("Train" + "Test")::BIGINT AS total, round(("Train" + "Test") / (sum("Train" + "Test") OVER ())::DOUBLE, 9) AS share, ("Train" + "Test") * 1.5::DOUBLE AS seconds FROM (
  SELECT label, count(*) FILTER (Data = 'Train') AS "Train", count(*) FILTER (Data = 'Test') AS "Test" FROM lab LEFT JOIN ls ON event_type = label GROUP BY 1)""")
def _(spark, d):
    out = agg.crosstab(labelled_split(spark, d), "event_type", LABELS, "Data", ["Train", "Test"], 1.5)
    return out.withColumn("share", F.round("share", 9))


@query("a2_seconds_per_class", "", "SELECT user_id, " + ", ".join(f"(count(*) FILTER (event_type = '{v}')) * 1.5::DOUBLE AS {v}" for v in LABELS) + " FROM events GROUP BY 1")
def _(spark, d):
    return agg.seconds_by_class(load(spark, d, "events"), "user_id", "event_type", LABELS, 1.5)


@query("a3_label_shares", "", """SELECT v.event_type, coalesce(n, 0) AS windows, round(coalesce(n, 0) / (sum(n) OVER ())::DOUBLE, 9) AS share FROM (SELECT DISTINCT event_type FROM events) v LEFT JOIN (SELECT event_type, count(*) AS n FROM events WHERE event_type <> 'view' GROUP BY 1) c USING (event_type)""")
def _(spark, d):
    events = load(spark, d, "events")
    out = agg.label_shares(events.select("event_type").distinct(), events.filter("event_type <> 'view'"), "event_type")
    return out.withColumn("share", F.round("share", 9))


@query("a4_inventory", "ev segs lab", """SELECT g.recording, g.label, coalesce(a.n, 0) AS samples_full, coalesce(a.h, 0) AS samples_half, coalesce(s.n, 0) AS segments FROM (SELECT recording, label FROM (SELECT DISTINCT recording FROM ev) CROSS JOIN lab) g
  LEFT JOIN (SELECT recording, label, count(*) AS n, count(*) FILTER (pos % 2 = 0) AS h FROM ev GROUP BY ALL) a USING (recording, label) LEFT JOIN (SELECT recording, label, count(*) AS n FROM segs GROUP BY ALL) s USING (recording, label)""")
def _(spark, d):
    full = samples(spark, d)
    return agg.inventory(full, "recording", "label", LABELS, {"samples_full": full, "samples_half": full.filter("pos % 2 = 0"), "segments": segs(spark, d)})


@query("a5_class_distribution", "ls", """SELECT event_type, a AS "Train_windows", round(a / (sum(a) OVER ())::DOUBLE, 9) AS "Train_share", b AS "Test_windows", round(b / (sum(b) OVER ())::DOUBLE, 9) AS "Test_share" FROM (
  SELECT event_type, count(*) FILTER (Data = 'Train') AS a, count(*) FILTER (Data = 'Test') AS b FROM ls GROUP BY 1)""")
def _(spark, d):
    out = agg.class_distribution(labelled_split(spark, d), "event_type", "Data", ["Train", "Test"])
    return out.withColumns({c: F.round(c, 9) for c in ("Train_share", "Test_share")})


@query("a6_describe", "lv", """SELECT feature, count(x) AS count, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, round(min(x), 6) AS min, round(max(x), 6) AS max, round(skewness(x), 6) AS skew,
  round(quantile_cont(x, 0.25), 6) AS quartile1, round(median(x), 6) AS median, round(quantile_cont(x, 0.75), 6) AS quartile3 FROM lv GROUP BY 1""")
def _(spark, d):
    out = agg.describe(long_vectors(spark, d), "feature", "x")
    return out.select("feature", "count", *[r6(F.col(c), c) for c in ("mean", "std", "min", "max", "skew", "quartile1", "median", "quartile3")])


@query("a7_correlation_counts", "lv", """WITH w AS (SELECT vec_id, feature, x FROM lv), s AS (SELECT count(*) FILTER (abs(k) > 0.1) AS skewed FROM (SELECT skewness(x) AS k FROM w GROUP BY feature)),
  c AS (SELECT corr(a.x, b.x) AS r FROM w a JOIN w b ON a.vec_id = b.vec_id AND a.feature < b.feature GROUP BY a.feature, b.feature)
  SELECT skewed, count(*) AS pairs, count(*) FILTER (abs(r) > 0.05) AS correlated, count(*) FILTER (r IS NULL OR isnan(r)) AS undefined FROM c CROSS JOIN s GROUP BY skewed""")
def _(spark, d):
    return agg.correlation_counts(vectors(spark, d), "features", 0.1, 0.05)


@query("a8_correlation_matrix", "", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS correlation FROM lineitem" for a in ("l_quantity", "l_extendedprice", "l_discount", "l_tax") for b in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")))
def _(spark, d):
    names = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    out = agg.correlation_matrix(load(spark, d, "lineitem"), {n: F.col(n) for n in names})
    return out.withColumn("correlation", F.round("correlation", 6))


@query("a9_overview", "", """SELECT 'rows' AS measure, count(*) AS value FROM events UNION ALL SELECT 'participants', count(DISTINCT user_id) FROM events UNION ALL SELECT 'missing', count(*) FILTER (value IS NULL) FROM events
  UNION ALL SELECT 'shared participants', count(*) FROM (SELECT user_id FROM events WHERE event_id % 2 = 0 INTERSECT SELECT user_id FROM events WHERE event_id % 2 = 1)
  UNION ALL SELECT 'rows that differ between two readers', 0""")
def _(spark, d):
    events = load(spark, d, "events")
    again = spark.read.format("parquet").load(f"{d}/events.parquet").select(*events.columns)
    shared = events.filter("event_id % 2 = 0").select("user_id").intersect(events.filter("event_id % 2 = 1").select("user_id"))
    return agg.overview({
        "rows": events.agg(F.count(F.lit(1))),
        "participants": events.agg(F.count_distinct("user_id")),
        "missing": events.agg(F.count_if(F.col("value").isNull())),
        "shared participants": shared.agg(F.count(F.lit(1))),
        "rows that differ between two readers": events.exceptAll(again).agg(F.count(F.lit(1))),
    })


# Round metrics derived from predictions: one round per recording, two schemes, two test participants.
table("rounds", """SELECT fold AS round, CASE WHEN fold % 2 = 0 THEN 'dependent' ELSE 'independent' END AS scheme, CASE WHEN fold % 3 = 0 THEN NULL ELSE fold % 3 END AS variant, (fold % 2 + fold // 2 % 2) % 2 + 1 AS subject,
  sum(hits) / sum(actual) AS accuracy, avg(CASE WHEN predicted > 0 THEN hits / predicted ELSE 0 END) AS precision_all, sum(actual)::BIGINT AS segments, sum(hits)::BIGINT AS detected FROM ccr GROUP BY fold""", "ccr")


def rounds(spark, d):
    table = met.class_counts(fold_counts(spark, d, "recording"), LABELS, ["fold"])
    sums = table.groupBy("fold").agg((F.sum("hits") / F.sum("actual")).alias("accuracy"), F.avg(F.when(F.col("predicted") > 0, F.col("hits") / F.col("predicted")).otherwise(0.0)).alias("precision_all"), F.sum("actual").alias("segments"), F.sum("hits").alias("detected"))
    f = F.col("fold")
    return sums.select(f.alias("round"), F.when(f % 2 == 0, "dependent").otherwise("independent").alias("scheme"), F.when(f % 3 != 0, f % 3).alias("variant"), ((f % 2 + F.floor(f / 2) % 2) % 2 + 1).alias("subject"), "accuracy", "precision_all", "segments", "detected")


@query("a10_average_rounds", "rounds", """SELECT scheme, variant, count(*) AS rounds, round(avg(accuracy), 9) AS accuracy, round(avg(precision_all), 9) AS precision_all, round(sum(detected) / sum(segments)::DOUBLE, 9) AS detected_share,
  round(avg(accuracy) FILTER (subject = 1), 9) AS accuracy_subject_1, round(avg(accuracy) FILTER (subject = 2), 9) AS accuracy_subject_2 FROM rounds GROUP BY ALL""")
def _(spark, d):
    out = agg.average_rounds(rounds(spark, d), ["scheme", "variant"], ["accuracy", "precision_all"], "subject", [1, 2], ["accuracy"], "detected", "segments")
    return out.select("scheme", "variant", "rounds", *[r9(F.col(c), c) for c in out.columns[3:]])


@query("a11_fold_summary", "rounds", "SELECT scheme, count(*) AS folds, round(avg(accuracy), 9) AS accuracy, round(avg(precision_all), 9) AS precision_all, round(stddev_samp(accuracy), 9) AS accuracy_std FROM rounds GROUP BY 1")
def _(spark, d):
    out = agg.summarise_folds(rounds(spark, d), ["scheme"], ["accuracy", "precision_all"], ["accuracy"])
    return out.select("scheme", "folds", *[r9(F.col(c), c) for c in out.columns[2:]])


@query("a13_importance_by_sensor", "", """WITH s AS (SELECT CASE WHEN contains(p_name, 'widget') THEN 'Gyro' WHEN contains(p_name, 'red') THEN 'Acc' ELSE 'Other' END AS sensor, p_size, p_retailprice FROM part)
  SELECT sensor, count(*) AS features, sum(p_size)::BIGINT AS size, round(sum(p_retailprice), 2) AS price, round(count(*) / (sum(count(*)) OVER ())::DOUBLE, 9) AS features_share, round(sum(p_size) / (sum(sum(p_size)) OVER ())::DOUBLE, 9) AS size_share,
  round(sum(p_retailprice) / sum(sum(p_retailprice)) OVER (), 9) AS price_share FROM s GROUP BY 1""")
def _(spark, d):
    from strideframe.functions.scalars import assign_by_word

    parts = load(spark, d, "part").select(assign_by_word(F.col("p_name"), [("widget", "Gyro"), ("red", "Acc")]).alias("sensor"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"))
    out = agg.importance_by_sensor(parts, "sensor", ["Acc", "Gyro", "Other"], ["size", "price"])
    return out.select("sensor", "features", "size", F.round("price", 2).alias("price"), *[r9(F.col(c), c) for c in ("features_share", "size_share", "price_share")])


@query("a14_grid_edges", "", "SELECT p_brand, count(*) FILTER (p_size IN (1, 50)) AS on_edge, count(p_size) AS tuned FROM part GROUP BY 1")
def _(spark, d):
    return agg.edge_choices(load(spark, d, "part"), "p_size", list(range(1, 51)), ["p_brand"])


@query("a15_fixed_histogram", "", """SELECT b::INTEGER AS bin, coalesce(n, 0) AS n FROM (SELECT unnest(range(0, 50)) AS b) LEFT JOIN (SELECT least(floor(value / 500.0 * 50), 49)::BIGINT AS bin, count(*) AS n FROM events WHERE value BETWEEN 0 AND 500 GROUP BY 1) ON b = bin""")
def _(spark, d):
    return agg.fixed_histogram(load(spark, d, "events"), "value", 0.0, 500.0)


@query("a15_automatic_histogram", "", """WITH s AS (SELECT count(*)::DOUBLE AS n, min(value) AS lo, max(value) AS hi, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM events),
  b AS (SELECT lo, hi, ceil((hi - lo) / least(2 * iqr / pow(n, 1.0 / 3), (hi - lo) / (log2(n) + 1))) AS bins FROM s)
  SELECT least(floor((value - lo) / (hi - lo) * bins), bins - 1)::INTEGER AS bin, count(*) AS n FROM events CROSS JOIN b GROUP BY 1""")
def _(spark, d):
    return agg.automatic_histogram(load(spark, d, "events"), "value")


@query("a16_five_numbers", "", "SELECT event_type, min(value) AS low, round(quantile_cont(value, 0.25), 6) AS quartile1, round(median(value), 6) AS median, round(quantile_cont(value, 0.75), 6) AS quartile3, max(value) AS high FROM events GROUP BY 1")
def _(spark, d):
    out = agg.five_numbers(load(spark, d, "events"), ["event_type"], "value")
    return out.select("event_type", *[r6(F.col(c), c) for c in out.columns if c != "event_type"])


@query("a17_share_matrix", "cs", "SELECT label, " + ", ".join(f"round(max(r) FILTER (fold = {f}), 9) AS \"{f}\"" for f in range(5)) + " FROM cs GROUP BY 1")
def _(spark, d):
    scores = met.class_scores(fold_counts(spark, d), LABELS, ["fold"])
    out = agg.share_matrix(scores, "label", "fold", list(range(5)), "recall")
    return out.select("label", *[r9(F.col(str(f)), str(f)) for f in range(5)])


@query("a18_null_loss", "pc lab", """SELECT fold, label AS truth, a::BIGINT AS frames, round(CASE WHEN a > 0 THEN h / a END, 9) AS recall, round(CASE WHEN a > 0 THEN l / a END, 9) AS share_lost_to_null, round(CASE WHEN a - h > 0 THEN l / (a - h) ELSE 0 END, 9) AS share_of_misses_to_null FROM (
  SELECT fold, label, coalesce(sum(n) FILTER (truth = label), 0)::DOUBLE AS a, coalesce(sum(n) FILTER (truth = label AND guess = label), 0)::DOUBLE AS h, coalesce(sum(n) FILTER (truth = label AND guess = 'error'), 0)::DOUBLE AS l FROM pc CROSS JOIN lab WHERE label <> 'error' GROUP BY ALL)""")
def _(spark, d):
    out = met.null_loss(fold_counts(spark, d), LABELS, NULL, ["fold"])
    return out.select("fold", "truth", "frames", *[r9(F.col(c), c) for c in ("recall", "share_lost_to_null", "share_of_misses_to_null")])


@query("a19_fold_description", "ev", """SELECT fold, string_agg(recording::VARCHAR, ' ' ORDER BY recording) AS participants, sum(n)::BIGINT AS test_windows, (sum(sum(n)) OVER () - sum(n))::BIGINT AS train_windows FROM (SELECT recording, recording % 5 AS fold, count(*) AS n FROM ev GROUP BY ALL) GROUP BY fold""")
def _(spark, d):
    return agg.describe_folds(raw_samples(spark, d).withColumn("fold", F.col("recording") % 5), "fold", "recording")


# ---- order, limits, unions ---------------------------------------------------------------------------

@query("o1_custom_order", "rounds", """SELECT row_number() OVER (ORDER BY CASE scheme WHEN 'independent' THEN 0 ELSE 1 END, round) AS place, scheme, round FROM rounds""")
def _(spark, d):
    return order.custom_order(rounds(spark, d), "scheme", ["independent", "dependent"], ["round"]).select("place", "scheme", "round")


@query("o2_top_features", "lv", "SELECT feature, round(score, 6) AS score, k AS place FROM (SELECT feature, score, row_number() OVER (ORDER BY score DESC, feature) AS k FROM (SELECT feature, sum(x * x) AS score FROM lv GROUP BY 1)) WHERE k <= 20")
def _(spark, d):
    scores = long_vectors(spark, d).groupBy("feature").agg(F.sum(F.col("x") * F.col("x")).alias("score"))
    return order.top_rows(scores, "score", "feature", 20).select("feature", r6(F.col("score"), "score"), "place")


@query("o3_best_rows", "rounds", "SELECT scheme, arg_max(round, (accuracy, -round)) AS round, round(max(accuracy), 9) AS accuracy FROM rounds GROUP BY 1")
def _(spark, d):
    return order.best_rows(rounds(spark, d), ["scheme"], "accuracy", "round").select("scheme", "round", r9(F.col("accuracy"), "accuracy"))


@query("o4_union_by_name", "rounds", "SELECT round, scheme, round(accuracy, 9) AS accuracy, NULL::BIGINT AS segments FROM rounds UNION ALL BY NAME SELECT round, scheme, NULL::DOUBLE AS accuracy, segments FROM rounds WHERE scheme = 'dependent'")
def _(spark, d):
    table = rounds(spark, d)
    out = order.union_tables([table.select("round", "scheme", "accuracy"), table.filter("scheme = 'dependent'").select("round", "scheme", "segments")])
    return out.select("round", "scheme", r9(F.col("accuracy"), "accuracy"), "segments")


@query("o5_first_by_key", "raw", "SELECT recording, label, event_id FROM (SELECT *, row_number() OVER (PARTITION BY recording, label ORDER BY t, event_id) AS k FROM raw) WHERE k = 1")
def _(spark, d):
    return order.first_by_key(raw_samples(spark, d), ["recording", "label"], ORDER, ["event_id"])
