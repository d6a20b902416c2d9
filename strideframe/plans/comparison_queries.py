"""Queries of joins and comparisons (J) and of sources and sinks (S) with their SQL answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from strideframe.operators import compare as cmp, folds as fold, metrics as met
from strideframe.plans import cleaning_queries as clean_q, measure_queries as mq, series_queries as sq
from strideframe.plans.inputs import KEYS, STEP, WINDOW, load, predictions, r6, r9, raw_samples, samples, vectors, windows
from strideframe.plans.registry import query, table
from strideframe.session import scratch_path, settle
from strideframe.sources import recordings as rec, results as res


@query("j1_lookup", "", "SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def _(spark, d):
    nations = load(spark, d, "nation").join(load(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return load(spark, d, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name", "r_name")


# Reference values per fold: printed points with two decimals, two folds of which we never ran.
table("refv", "SELECT fold, round(100 * avg(v), 2) AS accuracy, round(avg(v) * 60, 2) AS macro_f1 FROM (SELECT recording % 7 AS fold, v FROM raw) GROUP BY 1", "raw")
table("fs", """SELECT fold, sum(hits) / sum(actual) AS accuracy, avg(p) AS macro_precision, avg(r) AS macro_recall, avg(f1) AS macro_f1 FROM cs GROUP BY fold""", "cs")


def reference_values(spark, d):
    rows = raw_samples(spark, d).groupBy((F.col("recording") % 7).alias("fold")).agg(F.avg("v").alias("a"))
    return rows.select("fold", F.round(100 * F.col("a"), 2).alias("accuracy"), F.round(F.col("a") * 60, 2).alias("macro_f1"))


def fold_scores(spark, d):
    return met.score_fold(mq.fold_counts(spark, d), mq.LABELS, ["fold"])


@query("j2_reference_differences", "refv fs", """SELECT r.fold, r.accuracy, r.macro_f1, round(100 * f.accuracy, 6) AS our_accuracy, round(100 * f.macro_f1, 6) AS our_macro_f1, round(100 * f.accuracy - r.accuracy, 6) AS difference_accuracy, round(100 * f.macro_f1 - r.macro_f1, 6) AS difference_macro_f1 FROM refv r LEFT JOIN fs f ON r.fold = f.fold""")
def _(spark, d):
    out = cmp.compare_with_reference(fold_scores(spark, d), reference_values(spark, d), ["fold"], ["accuracy", "macro_f1"])
    return out.select("fold", "accuracy", "macro_f1", *[r6(F.col(c), c) for c in out.columns[3:]])


table("prot", "SELECT round // 2 AS variant, scheme, accuracy, precision_all FROM rounds", "rounds")


def protocols(spark, d):
    return mq.rounds(spark, d).select(F.floor(F.col("round") / 2).alias("variant"), "scheme", "accuracy", "precision_all")


@query("j3_protocol_drops", "prot", """SELECT a.variant, round(a.accuracy, 9) AS accuracy_dependent, round(a.precision_all, 9) AS precision_all_dependent, round(b.accuracy, 9) AS accuracy_independent, round(b.precision_all, 9) AS precision_all_independent,
  round(100 * (a.accuracy - b.accuracy), 6) AS accuracy_drop_independent, round(100 * (a.precision_all - b.precision_all), 6) AS precision_all_drop_independent FROM (SELECT * FROM prot WHERE scheme = 'dependent') a LEFT JOIN (SELECT * FROM prot WHERE scheme = 'independent') b ON a.variant = b.variant""")
def _(spark, d):
    values, metrics = ["dependent", "independent"], ["accuracy", "precision_all"]
    out = cmp.add_drops(cmp.spread(protocols(spark, d), ["variant"], "scheme", values, metrics), values, metrics)
    return out.select("variant", *[(r6 if "_drop_" in c else r9)(F.col(c), c) for c in out.columns if c != "variant"])


@query("j4_single_match", "refv rounds", """SELECT fold, variant, subject, round FROM (SELECT r.fold, s.variant, s.subject, s.round, count(*) OVER (PARTITION BY r.fold) AS n FROM (SELECT fold, fold % 3 AS variant, fold * 11 % 31 AS grp FROM refv) r JOIN (SELECT *, round % 31 AS grp FROM rounds) s ON r.variant = s.variant AND r.grp = s.grp) WHERE n = 1
  UNION ALL SELECT -1 AS fold, variant, subject, arg_max(round, (precision_all, -round)) FROM rounds WHERE scheme = 'dependent' GROUP BY ALL""")
def _(spark, d):
    from strideframe.operators.ordering import best_rows

    rounds = settle(mq.rounds(spark, d))
    rows = rounds.withColumn("grp", F.col("round") % 31)
    wanted = reference_values(spark, d).select("fold", (F.col("fold") % 3).alias("variant"), (F.col("fold") * 11 % 31).alias("grp"))
    single = cmp.match_single(wanted, rows, ["variant", "grp"], "fold").select("fold", "variant", "subject", "round")
    kept = rounds.filter("scheme = 'dependent'").select("variant", "subject", "precision_all", "round")
    best = best_rows(kept, ["variant", "subject"], "precision_all", "round")
    return single.unionByName(best.select(F.lit(-1).cast("long").alias("fold"), "variant", "subject", "round"))


@query("j5_repeated_rows", "", """SELECT o_orderkey, CASE WHEN k > 1 THEN f END AS duplicate_of FROM (SELECT o_orderkey, first_value(o_orderkey) OVER w AS f, row_number() OVER w AS k FROM orders WINDOW w AS (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey))""")
def _(spark, d):
    orders = load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    rows = orders.withColumn("id", F.col("o_orderkey"))
    return cmp.name_repeats(rows, ["o_custkey", "o_orderstatus"], "o_orderkey", "id").select("o_orderkey", "duplicate_of")


table("conv", """SELECT fold, avg(coalesce(p, 0)) AS paz, avg(p) AS pad, avg(coalesce(p, 0)) FILTER (label <> 'error') AS pgz, avg(p) FILTER (label <> 'error') AS pgd, avg(r) AS ra, avg(r) FILTER (label <> 'error') AS rg FROM (SELECT *, CASE WHEN predicted > 0 THEN hits / predicted END AS p, CASE WHEN actual > 0 THEN hits / actual END AS r FROM ccr) GROUP BY 1""", "ccr")


@query("j6_closest_convention", "conv", """SELECT fold, round(a, 6) AS best_gap_all, round(g, 6) AS best_gap_gesture, CASE WHEN a < g THEN 'all classes' WHEN g < a THEN 'gesture classes' ELSE 'tie' END AS closer_set, round(abs(a - g), 6) AS set_margin,
  CASE WHEN z = q THEN 'same' WHEN z < q THEN 'zero precision closer' ELSE 'defined precision closer' END AS precision_convention FROM (SELECT *, CASE WHEN g < a THEN gz ELSE az END AS z, CASE WHEN g < a THEN gd ELSE ad END AS q FROM (SELECT *, least(az, ad) AS a, least(gz, gd) AS g FROM (
  SELECT fold, abs(100 * paz - 22.0) + abs(100 * ra - 24.0) AS az, abs(100 * pad - 22.0) + abs(100 * ra - 24.0) AS ad, abs(100 * pgz - 22.0) + abs(100 * rg - 24.0) AS gz, abs(100 * pgd - 22.0) + abs(100 * rg - 24.0) AS gd FROM conv)))""")
def _(spark, d):
    s = met.score_frames(mq.fold_counts(spark, d, "recording"), mq.LABELS, mq.NULL, ["fold"])
    rows = s.select(
        "fold", F.col("precision_all").alias("precision_all_zero"), F.col("precision_all_defined").alias("precision_all_defined"), F.col("precision_non_null").alias("precision_gesture_zero"),
        F.col("precision_non_null_defined").alias("precision_gesture_defined"), *[F.col("recall_all").alias(f"recall_all_{k}") for k in ("zero", "defined")], *[F.col("recall_non_null").alias(f"recall_gesture_{k}") for k in ("zero", "defined")],
    ).withColumns({"p": F.lit(22.0), "r": F.lit(24.0)})
    out = cmp.closest_convention(rows, "p", "r")
    return out.select("fold", *[r6(F.col(c), c) for c in ("best_gap_all", "best_gap_gesture", "set_margin")], "closer_set", "precision_convention")


@query("j7_centre_segments", "wev", "SELECT recording, win, truth, run::BIGINT AS run FROM wev")
def _(spark, d):
    return mq.centre_events(spark, d).select("recording", "win", "truth", "run")


@query("j8_metric_changes", "rounds", """SELECT a.round, round(a.accuracy, 9) AS accuracy_published, round(b.precision_all, 9) AS accuracy_rerun, round(b.precision_all - a.accuracy, 9) AS accuracy_change FROM rounds a JOIN rounds b ON a.round = b.round WHERE b.scheme = 'dependent'""")
def _(spark, d):
    before = settle(mq.rounds(spark, d))
    after = before.filter("scheme = 'dependent'").select("round", F.col("precision_all").alias("accuracy"))
    out = cmp.metric_changes(before, after, ["round"], ["accuracy"])
    return out.select("round", *[r9(F.col(c), c) for c in out.columns[1:]])


@query("j9_neighbour_leakage", "bouts", """SELECT bout, "row" FROM (SELECT *, lag("row" % 3 <> 0) OVER (PARTITION BY bout ORDER BY "row") AS p, lead("row" % 3 <> 0) OVER (PARTITION BY bout ORDER BY "row") AS f FROM bouts) WHERE "row" % 3 = 0 AND (coalesce(p, false) OR coalesce(f, false))""")
def _(spark, d):
    return cmp.neighbour_leakage(clean_q.bouts(spark, d).select("bout", "row"), "bout", "row", F.col("row") % 3 != 0)


@query("j10_unseen_and_shared", "", """SELECT 'unseen' AS kind, user_id FROM (SELECT user_id FROM events WHERE event_id % 10 = 0 EXCEPT SELECT user_id FROM events WHERE event_id % 10 <> 0)
  UNION ALL SELECT 'shared', user_id FROM (SELECT user_id FROM events WHERE event_id % 10 = 0 INTERSECT SELECT user_id FROM events WHERE event_id % 10 <> 0)""")
def _(spark, d):
    events = load(spark, d, "events")
    test = events.filter("event_id % 10 = 0").select("user_id").distinct()
    train = events.filter("event_id % 10 <> 0").select("user_id").distinct()
    unseen = test.join(train, "user_id", "left_anti").select(F.lit("unseen").alias("kind"), "user_id")
    return unseen.unionByName(test.intersect(train).select(F.lit("shared").alias("kind"), "user_id"))


@query("j11_purged_windows", "win", """SELECT DISTINCT recording, win FROM win WHERE win * 4 < 21 AND win * 4 + 8 > 9""")
def _(spark, d):
    members = windows(spark, d).select("recording", "win").distinct()
    spans = samples(spark, d).groupBy("recording").agg(F.lit(9).alias("span_start"), F.lit(21).alias("span_end"))
    return cmp.purge_overlaps(members, spans, KEYS, WINDOW, STEP)


@query("j12_curve_claims", "rounds", """WITH c AS (SELECT scheme, round, precision_all AS p, accuracy AS r, row_number() OVER (PARTITION BY scheme ORDER BY precision_all DESC, round) AS k, accuracy <= lag(accuracy) OVER (PARTITION BY scheme ORDER BY round) AS falls FROM rounds)
  SELECT scheme, max(round) FILTER (k = 1) AS peak, max(round) FILTER (k = 2) AS runner_up, round(100 * (max(p) FILTER (k = 1) - max(p) FILTER (k = 2)), 6) AS lead_points, arg_max(round, (r, -round)) AS recall_peak, bool_and(coalesce(falls, true)) AS recall_never_rises FROM c GROUP BY 1""")
def _(spark, d):
    out = cmp.curve_claims(settle(mq.rounds(spark, d)), ["scheme"], "round", "precision_all", "accuracy")
    return out.withColumn("lead_points", F.round("lead_points", 6))


@query("j12_stated_choice", "rounds", """SELECT scheme, arg_max(variant, (accuracy, -variant)) AS best_by_accuracy, arg_max(variant, (precision_all, -variant)) AS best_by_precision_all, round(100 * (max(accuracy) FILTER (variant = 1) - max(accuracy) FILTER (variant <> 1)), 6) AS accuracy_change,
  round(100 * (max(precision_all) FILTER (variant = 1) - max(precision_all) FILTER (variant <> 1)), 6) AS precision_all_change, (max(accuracy) FILTER (variant = 1)) > (max(accuracy) FILTER (variant <> 1)) AS accuracy_holds, (max(precision_all) FILTER (variant = 1)) > (max(precision_all) FILTER (variant <> 1)) AS precision_all_holds
  FROM (SELECT scheme, variant, avg(accuracy) AS accuracy, avg(precision_all) AS precision_all FROM rounds WHERE variant IS NOT NULL GROUP BY ALL) GROUP BY 1""")
def _(spark, d):
    table = mq.rounds(spark, d).filter("variant IS NOT NULL").groupBy("scheme", "variant").agg(F.avg("accuracy").alias("accuracy"), F.avg("precision_all").alias("precision_all"))
    out = cmp.stated_choice(table, ["scheme"], "variant", 1, ["accuracy", "precision_all"])
    return out.withColumns({c: F.round(c, 6) for c in ("accuracy_change", "precision_all_change")})


@query("j13_recomputed_f", "fs", """SELECT fold, round(2 * macro_recall * macro_precision / (macro_precision + macro_recall), 9) AS recomputed, abs(2 * macro_recall * macro_precision / (macro_precision + macro_recall) - macro_f1) <= 0.001 AS matches FROM fs""")
def _(spark, d):
    out = cmp.recomputed_f(fold_scores(spark, d), "macro_precision", "macro_recall", "macro_f1", tolerance=0.001)
    return out.select("fold", r9(F.col("recomputed"), "recomputed"), "matches")


@query("j14_differing_rows", "rounds", """SELECT round, a AS left_value, b AS right_value FROM (SELECT round, segments AS a FROM rounds WHERE round % 5 <> 0) x FULL JOIN (SELECT round, detected + 30 AS b FROM rounds WHERE round % 7 <> 0) y USING (round) WHERE a IS DISTINCT FROM b""")
def _(spark, d):
    rounds = settle(mq.rounds(spark, d))
    left = rounds.filter("round % 5 <> 0").select("round", F.col("segments").alias("value"))
    right = rounds.filter("round % 7 <> 0").select("round", (F.col("detected") + 30).alias("value"))
    return cmp.differing_rows(left, right, ["round"], "value")


# ---- sources and sinks: tables written by Spark, read back by the readers ------------------------------

def vector_files(spark, d):
    """The vectors as whitespace-separated text with side files, one line per row."""

    rows = vectors(spark, d).orderBy("vec_id")
    matrix, subject, label = (scratch_path(spark, n) for n in ("matrix", "subject", "label"))
    text = F.concat(F.lit("  "), F.array_join(F.transform("features", lambda x: F.format_string("%.7e", x)), "  "))
    rows.select(text.alias("value")).write.text(matrix)
    rows.select(F.col("participant").cast("string").alias("value")).write.text(subject)
    rows.select(F.col("label").cast("string").alias("value")).write.text(label)
    names = scratch_path(spark, "names")
    rows.select("label").distinct().select(F.concat(F.col("label").cast("string"), F.lit(" CLASS "), (F.col("label") + 100).cast("string")).alias("value")).write.text(names)
    return matrix, subject, label, names


@query("s1_read_matrix", "lv", "SELECT (row_number() OVER (ORDER BY vec_id, feature) - 1) // 64 AS row, feature, round(x, 4) + 0.0::DOUBLE AS x FROM lv")
def _(spark, d):
    matrix, *_ = vector_files(spark, d)
    return rec.read_matrix(spark, matrix, 64).select("row", F.posexplode("values").alias("feature", "x")).withColumn("x", F.round("x", 4))


@query("s2_combine_splits", "fw", "SELECT vec_id, split AS \"Data\" FROM fw")
def _(spark, d):
    rows = vectors(spark, d).select("vec_id", "split")
    train = rows.filter("split = 'Train'").select("vec_id", F.lit("Train").alias("Data"))
    test = rows.filter("split = 'Test'").select("vec_id", F.lit("Test").alias("Data"))
    return rec.combine_splits(train, test)


@query("s3_align_files", "fw", "SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row, participant AS subject, 'CLASS ' || (label + 100) AS \"Activity\", 'Train' AS \"Data\", round(features[1], 4) AS first FROM fw")
def _(spark, d):
    matrix, subject, label, names = vector_files(spark, d)
    frame = rec.read_split(spark, matrix, subject, label, rec.read_codes(spark, names), "Train", 64)
    return frame.select("row", "subject", "Activity", "Data", F.round(F.col("features")[0], 4).alias("first"))


@query("s4_read_codes", "fw", "SELECT DISTINCT label AS code, 'CLASS ' || (label + 100) AS name FROM fw")
def _(spark, d):
    return rec.read_codes(spark, vector_files(spark, d)[3])


@query("s5_rename_repeats", "", """SELECT p_partkey, p_name, CASE WHEN k = 0 THEN p_name ELSE p_name || '.' || k END AS unique_name, (k + 1)::INTEGER AS occurrence, n AS name_count, k > 0 AS renamed FROM (
  SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) - 1 AS k, count(*) OVER (PARTITION BY p_name) AS n FROM part)""")
def _(spark, d):
    return rec.rename_repeats(load(spark, d, "part").select("p_partkey", "p_name"), "p_partkey", "p_name")


@query("s6_read_signals", "fw", "SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row, round(list_sum(features[1:32]), 3) AS first_half FROM fw")
def _(spark, d):
    matrix, *_ = vector_files(spark, d)
    half = F.aggregate(F.slice("values", 1, 32), F.lit(0.0), lambda s, x: s + x)
    return rec.read_matrix(spark, matrix, 64).select("row", F.round(half, 3).alias("first_half"))


def log_files(spark, d):
    """Samples as tab-separated logs of 24 columns, one folder member per participant."""
    rows = samples(spark, d).withColumn("subject", F.col("recording") % 4 + 1)
    code = F.when(F.col("label") == "error", 0).otherwise(F.ascii("label") - 98)
    cells = [F.format_string("%.12f", F.col("v") * (i + 1)) for i in range(23)] + [code.cast("string")]
    root = scratch_path(spark, "logs")
    text = rows.select("subject", "recording", "pos", F.concat_ws("\t", *cells).alias("value"))
    rows = text.repartitionByRange("subject", "recording", "pos").sortWithinPartitions("subject", "recording", "pos")
    rows.select("subject", "value").write.partitionBy("subject").text(root)
    return root


table("logs", """SELECT (recording % 4 + 1)::INTEGER AS subject, row_number() OVER (PARTITION BY recording % 4 ORDER BY recording, pos) - 1 AS frame, round(v, 4) AS chest_x, round(v * 8, 4) AS "leftAnkle_z", CASE WHEN label = 'error' THEN 0 ELSE ascii(label) - 98 END AS label FROM ev""", "ev")


def read_logs(spark, d, which="*"):
    log = rec.number_log(rec.read_log(spark, f"{log_files(spark, d)}/subject={which}"))
    return log.select("subject", "frame", F.round("chest_x", 4).alias("chest_x"), F.round("leftAnkle_z", 4).alias("leftAnkle_z"), "label")


@query("s7_read_log", "logs", "SELECT * FROM logs WHERE subject = 1")
def _(spark, d):
    return read_logs(spark, d, "1")


@query("s8_read_all_logs", "logs", "SELECT * FROM logs")
def _(spark, d):
    return read_logs(spark, d)


def raw_csv(spark, d):
    """Samples as raw motion csv of one sensor, with empty increments on every eleventh event."""
    rows = raw_samples(spark, d)
    value = F.when(F.col("event_id") % 11 != 0, F.col("v"))
    columns = [(value if c.startswith(("dq_", "dv")) else F.lit(0.0)).alias(c) for c in rec.raw_header(["LF"])[:-2]]
    path = scratch_path(spark, "raw")
    rows.select(*columns, F.col("t").alias("SampleTimeFine"), F.col("label").alias("activity")).write.option("header", True).csv(path)
    return path


@query("s9_read_raw_csv", "raw", """SELECT t AS "SampleTimeFine", label AS activity, CASE WHEN event_id % 11 <> 0 THEN round(v, 4) END AS dv FROM raw""")
def _(spark, d):
    rows = rec.read_raw_csv(spark, raw_csv(spark, d), ["LF"])
    return rows.select("SampleTimeFine", "activity", F.round(F.col("`dv[1]_LF`"), 4).alias("dv"))


@query("s10_recordings_table", "raw", "SELECT recording, recording % 8 AS participant, t, round(v::FLOAT::DOUBLE, 4) AS v FROM raw")
def _(spark, d):
    path = scratch_path(spark, "recordings")
    rows = raw_samples(spark, d).select("recording", (F.col("recording") % 8).alias("participant"), "t", F.col("v").cast("float").alias("v"))
    rec.write_recordings(rows, path)
    back = rec.read_recordings(spark, path)
    return back.select("recording", F.col("participant").cast("long").alias("participant"), "t", F.round(F.col("v").cast("double"), 4).alias("v"))


@query("s11_index_tables", "raw", """SELECT 'recording ' || recording AS entry, count(*) AS samples FROM raw GROUP BY ALL UNION ALL SELECT 'label ' || (row_number() OVER (ORDER BY label) - 1) || ' ' || label, n FROM (SELECT label, count(*) AS n FROM raw GROUP BY 1)""".replace("GROUP BY ALL UNION", "GROUP BY recording UNION"))
def _(spark, d):
    tables = rec.index_tables(raw_samples(spark, d), "recording", "label", {"LF_accX": "m/s^2", "LF_gyroX": "rad/s"})
    first = tables["recordingIndex"].select(F.concat(F.lit("recording "), F.col("recording").cast("string")).alias("entry"), "samples")
    labels = tables["labelNames"].select(F.concat_ws(" ", F.lit("label"), F.col("code").cast("string"), "label").alias("entry"), "samples")
    return first.unionByName(labels)


@query("s12_convert_recordings", "raw", """SELECT t, label, round(CASE WHEN event_id % 11 <> 0 THEN (v / 0.5)::FLOAT::DOUBLE END, 4) AS acc_x,
  round(CASE WHEN event_id % 11 <> 0 THEN (v * (2 * atan2(sqrt(3.0::DOUBLE) * v, v) / (sqrt(3.0::DOUBLE) * v) / 0.5))::FLOAT::DOUBLE END, 4) AS gyro_x FROM raw""")
def _(spark, d):
    rows = rec.read_raw_csv(spark, raw_csv(spark, d), ["LF"])
    out = rec.convert_raw(rows, ["LF"], F.lit(0.5))
    return out.select("t", "label", F.round(F.col("LF_accX").cast("double"), 4).alias("acc_x"), F.round(F.col("LF_gyroX").cast("double"), 4).alias("gyro_x"))


@query("s13_write_fixed_format", "raw", "SELECT event_id, printf('%.6f', v) AS v FROM raw")
def _(spark, d):
    path = scratch_path(spark, "result")
    res.write_result(raw_samples(spark, d).select("event_id", "v"), path, "csv")
    return res.read_result(spark, path, "event_id bigint, v string")


@query("s14_read_result", "raw", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'NULL' WHEN event_id % 3 = 1 THEN label END AS note FROM raw")
def _(spark, d):
    path = scratch_path(spark, "result")
    note = F.when(F.col("event_id") % 3 == 0, F.lit("NULL")).when(F.col("event_id") % 3 == 1, F.col("label"))
    res.write_result(raw_samples(spark, d).select("event_id", note.alias("note")), path, "csv")
    return res.read_result(spark, path, "event_id bigint, note string")


@query("s15_gesture_frames", "fr", "SELECT recording AS subject, pos AS frame, label, round(x, 6) AS first FROM fr")
def _(spark, d):
    from strideframe.plans.inputs import frames

    path = scratch_path(spark, "gestures")
    rows = frames(spark, d).select(F.col("recording").alias("subject"), F.col("pos").alias("frame"), F.array(*(F.col(c) for c in "xyzxyzxyzxyzxyz")).alias("ch"), "label")
    rows.write.parquet(path)
    return rec.read_gestures(spark, path).select("subject", "frame", "label", r6(F.col("ch")[0], "first"))
