"""Queries of window selection under a budget (B, A12) with their SQL answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from strideframe.operators import budget as bud
from strideframe.operators.features import window_scores
from strideframe.operators.ordered import chunk_by_position, sweep
from strideframe.operators.windows import majority_labels, sliding_members
from strideframe.plans import feature_queries  # noqa: F401  (its SQL tables are used below)
from strideframe.plans.inputs import KEYS, STEP, WINDOW, frames, r6, r9
from strideframe.plans.registry import query, table
from strideframe.session import settle

FLAGS = ["A", "N", "R"]

table("flab", """SELECT recording, win, label FROM (SELECT recording, win, label, row_number() OVER (PARTITION BY recording, win ORDER BY count(*) DESC, label) AS r FROM fwin GROUP BY recording, win, label) WHERE r = 1""", "fwin")
table("sel", """SELECT s.recording AS stream, s.win AS pos, s.recording % 5 AS fold, variance AS accelerationVariance, change AS windowChange, entropy AS spectralEntropy, label AS truth,
  coalesce(lag(label) OVER (PARTITION BY s.recording ORDER BY s.win), label) AS full_guess, count(*) OVER (PARTITION BY s.recording) AS n FROM fscore s JOIN flab f ON s.recording = f.recording AND s.win = f.win""", "fscore flab")
table("bud", "SELECT unnest([5, 10, 20, 50, 100]) AS budget")
table("thr", """SELECT f.fold, budget, CASE WHEN budget = 100 THEN '-Infinity'::DOUBLE ELSE quantile_cont(windowChange, 1 - budget / 100.0) END AS threshold FROM (SELECT DISTINCT fold FROM sel) f JOIN sel ON sel.fold <> f.fold CROSS JOIN bud GROUP BY f.fold, budget""".replace(
    "quantile_cont(windowChange, 1 - budget / 100.0)", "CASE budget WHEN 5 THEN quantile_cont(windowChange, 0.95) WHEN 10 THEN quantile_cont(windowChange, 0.9) WHEN 20 THEN quantile_cont(windowChange, 0.8) ELSE quantile_cont(windowChange, 0.5) END"), "sel bud")
table("rk", """SELECT stream, pos, row_number() OVER (PARTITION BY stream ORDER BY accelerationVariance DESC, pos) - 1 AS pv, row_number() OVER (PARTITION BY stream ORDER BY windowChange DESC, pos) - 1 AS pch, row_number() OVER (PARTITION BY stream ORDER BY spectralEntropy DESC, pos) - 1 AS pe,
  row_number() OVER (PARTITION BY stream ORDER BY ra + rb + rc, pos) - 1 AS pm FROM (SELECT *, rank() OVER (PARTITION BY stream ORDER BY accelerationVariance DESC) + (count(*) OVER (PARTITION BY stream, accelerationVariance) - 1) / 2 AS ra,
  rank() OVER (PARTITION BY stream ORDER BY windowChange DESC) + (count(*) OVER (PARTITION BY stream, windowChange) - 1) / 2 AS rb, rank() OVER (PARTITION BY stream ORDER BY spectralEntropy DESC) + (count(*) OVER (PARTITION BY stream, spectralEntropy) - 1) / 2 AS rc FROM sel WHERE pos > 0)""", "sel")
table("rnd", """SELECT stream, pos, budget, seed, row_number() OVER (PARTITION BY stream, budget, seed ORDER BY (m // 8192 + m * 40503) % 4294967296, pos) - 1 AS pr FROM (
  SELECT stream, pos, budget, seed, ((stream * 100003 + pos * 101 + budget * 7919 + seed * 104729 + 42) * 2654435761) % 4294967296 AS m FROM sel CROSS JOIN bud CROSS JOIN (SELECT unnest([42, 43, 44]) AS seed) WHERE pos > 0)""", "sel bud")
table("kept", """SELECT method, p.budget, p.seed, s.stream, s.pos, s.fold, truth, full_guess, s.pos = 0 OR coalesce(CASE method WHEN 'changeTrigger' THEN windowChange >= threshold
    WHEN 'uniformStride' THEN ceil(s.pos * k / n::DOUBLE) < k AND floor(ceil(s.pos * k / n::DOUBLE) * n / k) = s.pos WHEN 'random' THEN pr < k - 1
    WHEN 'accelerationVariance' THEN pv < k - 1 WHEN 'windowChange' THEN pch < k - 1 WHEN 'spectralEntropy' THEN pe < k - 1 WHEN 'meanRank' THEN pm < k - 1 END, false) AS kept
  FROM (SELECT *, (budget * n + 99) // 100 AS k FROM sel CROSS JOIN (SELECT method, budget, seed FROM (SELECT unnest(['changeTrigger', 'uniformStride', 'accelerationVariance', 'windowChange', 'spectralEntropy', 'meanRank']) AS method, NULL::INTEGER AS seed
    UNION ALL SELECT 'random', unnest([42, 43, 44])) CROSS JOIN bud)) s JOIN (SELECT 1) ON true
  LEFT JOIN rk ON rk.stream = s.stream AND rk.pos = s.pos LEFT JOIN rnd ON rnd.stream = s.stream AND rnd.pos = s.pos AND rnd.budget = s.budget AND rnd.seed = s.seed LEFT JOIN thr ON thr.fold = s.fold AND thr.budget = s.budget""".replace("p.budget, p.seed", "s.budget, s.seed").replace(" JOIN (SELECT 1) ON true", ""), "sel bud rk rnd thr")
table("fin", """SELECT *, last_value(CASE WHEN kept THEN full_guess END IGNORE NULLS) OVER (PARTITION BY method, budget, seed, stream ORDER BY pos ROWS UNBOUNDED PRECEDING) AS final FROM kept""", "kept")
table("bruns", """SELECT method, budget, seed, realised_budget, accuracy, macro_f1 FROM (SELECT method, budget, seed, avg(CASE WHEN kept THEN 1 ELSE 0 END) AS realised_budget, avg(CASE WHEN truth = final THEN 1 ELSE 0 END) AS accuracy FROM fin GROUP BY ALL) a
  JOIN (SELECT method AS m2, budget AS b2, coalesce(seed, -1) AS s2, avg(CASE WHEN h > 0 THEN 2 * h / (g + a) ELSE 0 END) AS macro_f1 FROM (SELECT method, budget, seed, l.label, (count(*) FILTER (truth = l.label AND final = l.label))::DOUBLE AS h, (count(*) FILTER (final = l.label))::DOUBLE AS g, (count(*) FILTER (truth = l.label))::DOUBLE AS a
    FROM fin CROSS JOIN (SELECT unnest(['A', 'N', 'R']) AS label) l GROUP BY ALL) GROUP BY ALL) f ON a.method = m2 AND a.budget = b2 AND coalesce(a.seed, -1) = s2""", "fin")


def scored_windows(spark, d):
    """Windows of every stream with scores, majority label, and the label before as full prediction."""
    members = sliding_members(settle(frames(spark, d).select("recording", "pos", "n", "x", "y", "z", "label")), WINDOW, STEP)
    scores = window_scores(members, KEYS, [["x", "y", "z"]])
    labels = majority_labels(members, ["recording", "win"])
    rows = chunk_by_position(labels, "win", "__c")
    guessed = sweep(rows, KEYS, ["win"], chunk="__c", prev={"__p": F.col("label")})
    table = scores.join(guessed, ["recording", "win"])
    out = table.select(
        F.col("recording").alias("stream"), F.col("win").alias("pos"), (F.col("recording") % 5).alias("fold"), F.col("variance").alias("accelerationVariance"),
        F.col("change").alias("windowChange"), F.col("entropy").alias("spectralEntropy"), F.col("label").alias("truth"), F.coalesce("__p", "label").alias("full"),
    )
    return settle(out)


def thresholds(df):
    return bud.trigger_thresholds(df, range(5))


def selected(spark, d, methods=bud.METHODS, budgets=bud.BUDGETS):
    df = scored_windows(spark, d)
    return bud.select_windows(df, thresholds(df) if "changeTrigger" in methods else None, methods, budgets)


def final(spark, d, methods=bud.METHODS, budgets=bud.BUDGETS):
    df = scored_windows(spark, d)
    return bud.final_predictions(df, thresholds(df) if "changeTrigger" in methods else None, methods, budgets)


@query("b1_keep_counts", "sel bud", "SELECT stream, budget::INTEGER AS budget, (budget * count(*) + 99) // 100 AS keep FROM sel CROSS JOIN bud GROUP BY stream, budget")
def _(spark, d):
    sizes = scored_windows(spark, d).groupBy("stream").agg(F.count(F.lit(1)).alias("n"))
    rows = sizes.withColumn("budget", F.explode(F.array(*[F.lit(b) for b in bud.BUDGETS])))
    return rows.select("stream", "budget", bud.keep_count(F.col("budget"), F.col("n")).alias("keep"))


@query("b2_trigger_thresholds", "thr", "SELECT fold, budget::INTEGER AS budget, round(threshold, 6) AS threshold FROM thr WHERE budget < 100")
def _(spark, d):
    return thresholds(scored_windows(spark, d)).filter("budget < 100").select(F.col("fold").cast("long").alias("fold"), "budget", r6(F.col("threshold"), "threshold"))


for _key, _method in (
    ("b3_change_trigger", "changeTrigger"), ("b4_uniform_stride", "uniformStride"), ("b5_random_draw", "random"),
    ("b6_top_scores", "accelerationVariance"), ("b7_mean_rank", "meanRank"),
):
    query(_key, "kept", f"SELECT seed, stream, pos, kept FROM kept WHERE method = '{_method}' AND budget = 20")(
        lambda spark, d, m=_method: selected(spark, d, [m], [20]).select("seed", "stream", "pos", "kept")
    )


@query("b8_carry_forward", "fin", "SELECT stream, pos, kept, final FROM fin WHERE method = 'spectralEntropy' AND budget = 10")
def _(spark, d):
    return final(spark, d, ["spectralEntropy"], [10]).select("stream", "pos", "kept", "final")


@query("b9_activity_scores", "fin", """SELECT truth AS activity, count(*) AS windows, round(avg(CASE WHEN kept THEN 1 ELSE 0 END), 9) AS kept_share, round(avg(CASE WHEN truth = final THEN 1 ELSE 0 END), 9) AS recall FROM fin WHERE method = 'meanRank' AND budget = 20 GROUP BY 1""")
def _(spark, d):
    _, activities = bud.score_selection(final(spark, d, ["meanRank"], [20]), FLAGS)
    return activities.select("activity", "windows", r9(F.col("kept_share"), "kept_share"), r9(F.col("recall"), "recall"))


@query("b10_budget_runs", "bruns", "SELECT method, budget::INTEGER AS budget, seed, round(realised_budget, 9) AS realised_budget, round(macro_f1, 9) AS macro_f1, round(accuracy, 9) AS accuracy FROM bruns")
def _(spark, d):
    runs, _ = bud.score_selection(final(spark, d), FLAGS)
    return runs.select("method", "budget", "seed", *[r9(F.col(c), c) for c in ("realised_budget", "macro_f1", "accuracy")])


@query("b11_full_budget_check", "fin", "SELECT method, count(*) FILTER (NOT kept OR final <> full_guess) AS violations FROM fin WHERE budget = 100 GROUP BY 1")
def _(spark, d):
    return bud.full_budget_violations(final(spark, d, budgets=[100]))


@query("a12_budget_curves", "bruns", """SELECT method, budget::INTEGER AS budget, round(avg(realised_budget), 9) AS realised_budget, round(avg(macro_f1), 9) AS macro_f1, round(stddev_samp(macro_f1), 9) AS macro_f1_std, round(avg(accuracy), 9) AS accuracy, count(*) AS runs FROM bruns GROUP BY ALL""")
def _(spark, d):
    runs, _ = bud.score_selection(final(spark, d), FLAGS)
    out = bud.average_seeds(runs)
    return out.select("method", "budget", *[r9(F.col(c), c) for c in ("realised_budget", "macro_f1", "macro_f1_std", "accuracy")], "runs")
