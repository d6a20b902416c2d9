"""Queries of cleaning, runs and windowing (T, W) with their SQL answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from strideframe.operators import clean, windows as win
from strideframe.operators.ordered import sweep
from strideframe.plans.inputs import (
    FRAME_ORDER, KEYS, ORDER, frame_windows, frames, gapped_samples, load, members_sql, r6, raw_samples, samples, vectors, windows,
)
from strideframe.plans.registry import query, table

HOUR = 3_600_000_000
GAP_STEP = 24 * HOUR  # nominal step of the sparse event clock

table("streams", f"""SELECT *, sum(br) OVER (PARTITION BY recording ORDER BY t, event_id) - 1 AS stream FROM (
  SELECT *, CASE WHEN coalesce(t - lag(t) OVER (PARTITION BY recording ORDER BY t, event_id) <= {1.5 * GAP_STEP}, false) THEN 0 ELSE 1 END AS br FROM gap)""", "gap")
table("runs", """SELECT *, sum(br) OVER (PARTITION BY recording ORDER BY t, event_id) - 1 AS run FROM (
  SELECT *, CASE WHEN lag(label) OVER (PARTITION BY recording ORDER BY t, event_id) = label THEN 0 ELSE 1 END AS br FROM ev)""", "ev")
table("segs", """SELECT recording, run, label, min(pos) AS start, max(pos) + 1 AS "end", count(*) AS frames FROM runs GROUP BY ALL""", "runs")


def streams(spark, d):
    return clean.split_streams(gapped_samples(spark, d), KEYS, ORDER, step=GAP_STEP)


def runs(spark, d):
    return clean.label_runs(samples(spark, d), KEYS, ORDER)


def segs(spark, d):
    return clean.segments(runs(spark, d), KEYS)


@query("p4_drop_repeats", "raw", f"""SELECT recording, t // {HOUR} AS hour, event_id FROM (
  SELECT *, lag(t // {HOUR}) OVER (PARTITION BY recording ORDER BY t, event_id) AS b FROM raw) WHERE b IS NULL OR t // {HOUR} > b""")
def _(spark, d):
    coarse = raw_samples(spark, d).withColumn("hour", F.floor(F.col("t") / HOUR).cast("long"))
    return clean.drop_repeats(coarse, KEYS, ORDER, "hour").select("recording", "hour", "event_id")


@query("p4_count_repeats", "raw", f"""SELECT recording, count(*) FILTER (t // {HOUR} <= b) AS repeated FROM (
  SELECT *, lag(t // {HOUR}) OVER (PARTITION BY recording ORDER BY t, event_id) AS b FROM raw) GROUP BY 1""")
def _(spark, d):
    coarse = raw_samples(spark, d).withColumn("hour", F.floor(F.col("t") / HOUR).cast("long"))
    return clean.flag_repeats(coarse, KEYS, ORDER, "hour").groupBy("recording").agg(F.count_if("repeated").alias("repeated"))


@query("t1_split_streams", "streams", "SELECT recording, event_id, stream::BIGINT AS stream FROM streams")
def _(spark, d):
    return streams(spark, d).select("recording", "event_id", "stream")


@query("t2_hold_last_valid", "streams", """SELECT recording, stream::BIGINT AS stream, event_id, round(coalesce(
  last_value(v IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING), first_value(v IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS v,
  CASE WHEN v IS NULL THEN 1 ELSE 0 END AS filled, count(v) OVER (PARTITION BY recording, stream) > 0 AS usable
  FROM streams WINDOW w AS (PARTITION BY recording, stream ORDER BY t, event_id)""")
def _(spark, d):
    held = clean.hold_last_valid(streams(spark, d), ["recording", "stream"], ORDER, ["v"])
    return held.select("recording", "stream", "event_id", r6(F.col("v"), "v"), "filled", "usable")


@query("t3_sample_period", "ev", """SELECT recording, count(*) FILTER (s < 0) AS backwards, median(s) FILTER (s > 0) AS period
  FROM (SELECT recording, (t - lag(t) OVER (PARTITION BY recording ORDER BY t, event_id))::DOUBLE AS s FROM ev) GROUP BY 1""")
def _(spark, d):
    return clean.sample_periods(raw_samples(spark, d), KEYS, ORDER).select("recording", "backwards", "period")


@query("t3_shared_period_check", "ev", """SELECT periods, backwards::BIGINT AS backwards FROM (SELECT count(DISTINCT period) AS periods, sum(backwards) AS backwards FROM (
  SELECT count(*) FILTER (s < 0) AS backwards, median(s) FILTER (s > 0) AS period
  FROM (SELECT recording, (t - lag(t) OVER (PARTITION BY recording ORDER BY t, event_id))::DOUBLE AS s FROM ev) GROUP BY recording)) WHERE periods <> 1 OR backwards > 0""")
def _(spark, d):
    return clean.require_shared_period(clean.sample_periods(raw_samples(spark, d), KEYS, ORDER))


@query("t4_profile", "gap", f"""SELECT recording, count(*) AS samples, count(*) FILTER (h = ph) AS repeated_times, count(*) FILTER (h - ph > 36) AS gaps,
  count(*) FILTER (v IS NULL) AS missing_samples, count(DISTINCT label) AS labels, count(*) FILTER (label <> pl) AS label_changes, round(median(abs(v)), 6) AS median_magnitude
  FROM (SELECT *, t // {HOUR} AS h, lag(t // {HOUR}) OVER w AS ph, lag(label) OVER w AS pl FROM gap WINDOW w AS (PARTITION BY recording ORDER BY t, event_id)) GROUP BY 1""")
def _(spark, d):
    coarse = gapped_samples(spark, d).withColumn("h", F.floor(F.col("t") / HOUR).cast("long"))
    out = clean.profile_recordings(coarse, KEYS, ORDER, "h", ["v"], F.abs("v"), gap=36)
    return out.withColumn("median_magnitude", F.round("median_magnitude", 6))


@query("t5_missing_runs", "gap", """SELECT recording, count(*) FILTER (m) AS missing_runs, coalesce(max(k) FILTER (m), 0) AS longest_run FROM (
  SELECT recording, g, m, count(*) AS k FROM (SELECT *, sum(c) OVER (PARTITION BY recording ORDER BY t, event_id) AS g FROM (
    SELECT *, v IS NULL AS m, CASE WHEN (v IS NULL) = lag(v IS NULL) OVER (PARTITION BY recording ORDER BY t, event_id) THEN 0 ELSE 1 END AS c FROM gap)) GROUP BY ALL) GROUP BY 1""")
def _(spark, d):
    return clean.missing_runs(gapped_samples(spark, d), KEYS, ORDER, F.col("v").isNull())


@query("t6_label_runs", "segs", 'SELECT recording, run::BIGINT AS run, label, start, "end", frames FROM segs')
def _(spark, d):
    return segs(spark, d)


BLOCK_SQL = """b0 AS (SELECT recording, pos, run, label, lag(label) OVER w AS was, lead(label) OVER w AS nxt,
    first_value(CASE WHEN label <> 'error' THEN label END IGNORE NULLS) OVER (PARTITION BY recording ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS g
    FROM runs WHERE br = 1 WINDOW w AS (PARTITION BY recording ORDER BY pos)),
  b1 AS (SELECT recording, pos FROM b0 WHERE (label = g AND coalesce(was <> 'error', true)) OR (label = 'error' AND nxt = g)),
  blocks AS (SELECT runs.*, greatest(0, sum(CASE WHEN b1.pos IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY runs.recording ORDER BY runs.pos) - 1)::BIGINT AS block
    FROM runs LEFT JOIN b1 USING (recording, pos))"""


def blocks(spark, d):
    return clean.repetition_blocks(runs(spark, d), KEYS, "error")


@query("t7_repetition_blocks", "runs", f"WITH {BLOCK_SQL} SELECT recording, pos, block FROM blocks")
def _(spark, d):
    return blocks(spark, d).select("recording", "pos", "block")


@query("t8_block_check", "runs", f"""WITH {BLOCK_SQL} SELECT recording, block, coalesce(list_sort(list(label) FILTER (br = 1 AND label <> 'error')) = ['click','purchase','signup','view'], false) AS complete
  FROM blocks GROUP BY ALL""")
def _(spark, d):
    held = clean.check_blocks(blocks(spark, d), KEYS, "error", ["click", "purchase", "signup", "view"])
    every = blocks(spark, d).select("recording", "block").distinct()
    return every.join(held, ["recording", "block"], "left").select("recording", "block", F.coalesce("complete", F.lit(False)).alias("complete"))


@query("t9_fill_mean", "fr", """SELECT recording, pos, round(CASE WHEN filled THEN avg(x) FILTER (NOT filled) OVER (PARTITION BY recording) ELSE x END, 6) AS x,
  round(CASE WHEN filled THEN avg(y) FILTER (NOT filled) OVER (PARTITION BY recording) ELSE y END, 6) AS y FROM fr""")
def _(spark, d):
    out = clean.replace_filled_by_mean(frames(spark, d), KEYS, ["pos"], F.col("filled"), ["x", "y"])
    return out.select("recording", "pos", r6(F.col("x"), "x"), r6(F.col("y"), "y"))


@query("t10_fill_line", "fr", """SELECT recording, pos, round(CASE WHEN NOT filled THEN x ELSE coalesce(b.x + (a.x - b.x) * (pos - b.p) / (a.p - b.p), b.x, a.x) END, 6) AS x FROM (
  SELECT recording, pos, x, filled, last_value(CASE WHEN NOT filled THEN {'p': pos, 'x': x} END IGNORE NULLS) OVER (PARTITION BY recording ORDER BY pos ROWS UNBOUNDED PRECEDING) AS b,
    first_value(CASE WHEN NOT filled THEN {'p': pos, 'x': x} END IGNORE NULLS) OVER (PARTITION BY recording ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a FROM fr)""")
def _(spark, d):
    out = clean.replace_filled_by_line(frames(spark, d), KEYS, F.col("filled"), ["x"])
    return out.select("recording", "pos", r6(F.col("x"), "x"))


@query("t11_fill_inventory", "fr", """WITH m AS (SELECT recording, label, avg(x) AS mx FROM fr GROUP BY ALL),
  q AS (SELECT *, sum(c) OVER (PARTITION BY recording ORDER BY pos) AS g FROM (SELECT *, CASE WHEN filled = lag(filled) OVER (PARTITION BY recording ORDER BY pos) THEN 0 ELSE 1 END AS c FROM fr)),
  p AS (SELECT q.recording, g, q.label, count(*) AS k, min(pos) AS lo, max(pos) AS hi, bool_and(abs(x - mx) <= 0.4) AS same FROM q JOIN m ON q.recording = m.recording AND q.label = m.label WHERE filled GROUP BY ALL)
  SELECT recording, min(lo) AS run_start, max(hi) + 1 AS run_end, sum(k)::BIGINT AS frames, string_agg(label || ':' || k, ' ' ORDER BY label) AS label_counts, bool_and(same) AS equals_class_mean
  FROM p GROUP BY recording, g""")
def _(spark, d):
    return clean.fill_inventory(frames(spark, d), KEYS, ["pos"], F.col("filled"), ["x"], tolerance=0.4)


# Half-overlapping windows of the label codes of neighbouring vectors: rows of eight values, step four.
table("hw", """SELECT w AS "row", (w // 16) AS part, list(code ORDER BY i) AS sig FROM (
    SELECT w, i, (event_id * 7 + CASE WHEN w % 5 = 0 AND i >= 4 THEN 1 ELSE 0 END)::DOUBLE AS code FROM (SELECT event_id, unnest([event_id // 4, event_id // 4 - 1]) AS w FROM events) x,
      LATERAL (SELECT event_id - 4 * w AS i) y WHERE w >= 0) GROUP BY ALL HAVING count(*) = 8""")
table("cont", """SELECT *, coalesce(lead("row") OVER w = "row" + 1 AND sig[5:8] = lead(sig) OVER w [1:4], false) AS continues FROM hw WINDOW w AS (PARTITION BY part ORDER BY "row")""".replace("lead(sig) OVER w [1:4]", "(lead(sig) OVER w)[1:4]"), "hw")
table("bouts", """SELECT *, (coalesce(sum(CASE WHEN continues THEN 0 ELSE 1 END) OVER (ORDER BY "row" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS bout FROM cont""", "cont")


def half_windows(spark, d):
    ids = load(spark, d, "events").select("event_id", F.explode(F.array(F.floor(F.col("event_id") / 4), F.floor(F.col("event_id") / 4) - 1)).alias("row"))
    ids = ids.filter("row >= 0").withColumn("i", F.col("event_id") - 4 * F.col("row"))
    code = (F.col("event_id") * 7 + F.when((F.col("row") % 5 == 0) & (F.col("i") >= 4), 1).otherwise(0)).cast("double")
    packed = ids.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("i", code.alias("c")))).alias("s"))
    rows = packed.filter(F.size("s") == 8).select("row", F.floor(F.col("row") / 16).alias("part"), F.transform("s", lambda s: s["c"]).alias("sig"))
    from strideframe.operators.ordered import chunk_by_position

    return clean.continued_windows(chunk_by_position(rows, "row"), ["part"], "row", ["sig"], 4)


@query("t12_continued_windows", "cont", 'SELECT "row", continues FROM cont')
def _(spark, d):
    return half_windows(spark, d).select("row", "continues")


def bouts(spark, d):
    return clean.label_bouts(half_windows(spark, d), "row")


@query("t13_bouts", "bouts", 'SELECT "row", bout FROM bouts')
def _(spark, d):
    return bouts(spark, d).select("row", "bout")


@query("t14_stitch_bouts", "bouts", """SELECT bout, k * 4 + i AS sample, sig[i + 1] AS value FROM (
  SELECT *, row_number() OVER (PARTITION BY bout ORDER BY "row") - 1 AS k, unnest(range(0, 8)) AS i FROM bouts) WHERE k = 0 OR i >= 4""")
def _(spark, d):
    return clean.stitch_bouts(bouts(spark, d), "bout", "row", "sig", 4)


def decimate_sql() -> str:
    """Both runs of the filter as sums over its impulse response, on the signal with its odd extensions."""
    b, a = ([repr(float(v)) for v in side] for side in clean.lowpass_coefficients())
    pad = 3 * len(a)
    first = f"[{', '.join(b)}]"
    back = f"[{', '.join(a[1:])}]"

    def run(name: str, source: str) -> str:
        return f"""{name} AS (SELECT a.recording, a.ch, a.n, a.pad, a.k, sum(r.h * b.v) + any_value(s.v) * (any_value(g.acc) - any_value(t.acc)) AS v
          FROM {source} a JOIN {source} b ON a.recording = b.recording AND a.ch = b.ch AND b.k <= a.k JOIN r ON r.k = a.k - b.k
          JOIN {source} s ON a.recording = s.recording AND a.ch = s.ch AND s.k = 0 JOIN r t ON t.k = a.k CROSS JOIN (SELECT acc FROM r WHERE k = 4095) g GROUP BY ALL)"""

    return f"""SELECT recording, k // 2 AS pos, label, x, y, z FROM (WITH RECURSIVE
      imp AS (SELECT 0 AS k, {b[0]}::DOUBLE AS h, [{b[0]}::DOUBLE, 0, 0, 0, 0, 0, 0, 0] AS past UNION ALL
        SELECT k + 1, u, list_concat([u], past[1:7]) FROM (SELECT k, past, coalesce(({first}::DOUBLE[])[k + 2], 0) - list_dot_product({back}::DOUBLE[], past) AS u FROM imp WHERE k < 4095)),
      r AS (SELECT k, h, sum(h) OVER (ORDER BY k) AS acc FROM imp),
      w AS (SELECT *, least({pad}, n - 1) AS pad FROM ({' UNION ALL '.join(f"SELECT recording, '{c}' AS ch, pos, n, {c}::DOUBLE AS v FROM fr" for c in 'xyz')})),
      ends AS (SELECT recording, ch, arg_min(v, pos) AS v0, arg_max(v, pos) AS v1 FROM w GROUP BY ALL),
      e AS (SELECT recording, ch, n, pad, pos + pad AS k, v FROM w
        UNION ALL SELECT recording, ch, n, pad, pad - pos, 2 * v0 - v FROM w JOIN ends USING (recording, ch) WHERE pos BETWEEN 1 AND pad
        UNION ALL SELECT recording, ch, n, pad, pad + 2 * (n - 1) - pos, 2 * v1 - v FROM w JOIN ends USING (recording, ch) WHERE pos BETWEEN n - 1 - pad AND n - 2),
      {run('ahead', 'e')},
      turned AS (SELECT recording, ch, n, pad, n + 2 * pad - 1 - k AS k, v FROM ahead),
      {run('back', 'turned')},
      done AS (SELECT recording, ch, n - 1 + pad - k AS k, v FROM back WHERE n - 1 + pad - k BETWEEN 0 AND n - 1)
      SELECT d.recording, d.k, f.label, {', '.join(f"round(max(d.v) FILTER (d.ch = '{c}'), 6) AS {c}" for c in 'xyz')}
      FROM done d JOIN fr f ON d.recording = f.recording AND d.k = f.pos WHERE d.k % 2 = 0 GROUP BY ALL)"""


@query("t15_decimate", "fr", decimate_sql())
def _(spark, d):
    out = clean.decimate(frames(spark, d), KEYS, "pos", ["x", "y", "z"], "label", n="n")
    return out.select("recording", "pos", "label", *[r6(F.col(c), c) for c in "xyz"])


@query("t16_sample_table", "segs runs", """WITH k AS (SELECT recording, run, row_number() OVER (ORDER BY recording, run) - 1 AS segment FROM segs WHERE label <> 'error')
  SELECT recording, pos, label, segment FROM runs JOIN k USING (recording, run)""")
def _(spark, d):
    active = runs(spark, d).filter(F.col("label") != "error")
    return clean.number_segments(active, "recording", "run").select("recording", "pos", "label", "segment")


@query("t17_global_streams", "streams", """WITH k AS (SELECT recording, stream, row_number() OVER (ORDER BY recording, stream) - 1 AS number FROM (SELECT DISTINCT recording, stream FROM streams))
  SELECT recording, event_id, number, recording % 8 AS participant FROM streams JOIN k USING (recording, stream)""")
def _(spark, d):
    out = clean.number_segments(streams(spark, d), "recording", "stream", "number")
    return out.select("recording", "event_id", "number", (F.col("recording") % 8).alias("participant"))


@query("t18_stream_ranges", "streams", """WITH k AS (SELECT recording, stream, row_number() OVER (ORDER BY recording, stream) - 1 AS stream_no FROM (SELECT DISTINCT recording, stream FROM streams))
  SELECT stream_no AS stream, min(event_id) AS first_window, max(event_id) + 1 AS end_window FROM streams JOIN k USING (recording, stream) GROUP BY 1""")
def _(spark, d):
    out = clean.number_segments(streams(spark, d), "recording", "stream", "number").drop("stream").withColumnRenamed("number", "stream")
    return clean.stream_ranges(out, "stream", "event_id")


@query("t19_segment_durations", "segs", """SELECT recording, label, count(*) AS segments, sum(frames)::BIGINT AS frames, min(frames / 2.0::DOUBLE) AS min_seconds, max(frames / 2.0::DOUBLE) AS max_seconds,
  round(avg(CASE WHEN frames / 2.0::DOUBLE BETWEEN 1 AND 4 THEN 1.0 ELSE 0.0 END), 9)::DOUBLE AS share_in_range, median(frames / 2.0::DOUBLE) AS median_seconds FROM segs GROUP BY ALL""")
def _(spark, d):
    out = clean.segment_durations(segs(spark, d), KEYS, 2.0, shortest=1.0, longest=4.0)
    return out.withColumn("share_in_range", F.round("share_in_range", 9))


# ---- windows -----------------------------------------------------------------------------------------

@query("w1_sliding_windows", "win", 'SELECT recording, win, min(pos) AS start, min(pos) + 4 AS centre, count(*) AS members FROM win GROUP BY ALL')
def _(spark, d):
    return windows(spark, d).groupBy("recording", "win").agg(F.min("pos").alias("start"), (F.min("pos") + 4).alias("centre"), F.count(F.lit(1)).alias("members"))


def stream_windows(spark, d, size=4):
    held = clean.hold_last_valid(streams(spark, d), ["recording", "stream"], ORDER, ["v"]).filter("usable")
    placed = sweep(held, ["recording", "stream"], ORDER, number="pos", totals={"n": ("sum", F.lit(1))})
    return win.tumbling_members(placed, size)


table("swin", """SELECT *, pos2 // 4 AS win FROM (SELECT *, row_number() OVER (PARTITION BY recording, stream ORDER BY t, event_id) - 1 AS pos2, count(*) OVER (PARTITION BY recording, stream) AS n2,
  count(v) OVER (PARTITION BY recording, stream) AS k, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY recording, stream ORDER BY t, event_id ROWS UNBOUNDED PRECEDING),
  first_value(v IGNORE NULLS) OVER (PARTITION BY recording, stream ORDER BY t, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS held FROM streams) WHERE k > 0 AND (pos2 // 4 + 1) * 4 <= n2""", "streams")


@query("w2_tumbling_windows", "swin", "SELECT recording, stream::BIGINT AS stream, win, count(*) AS members, round(avg(held), 6) AS mean FROM swin GROUP BY ALL")
def _(spark, d):
    return stream_windows(spark, d).groupBy("recording", "stream", "win").agg(F.count(F.lit(1)).alias("members"), r6(F.avg("v"), "mean"))


@query("w2_tail_counts", "streams swin", """SELECT s.recording, s.samples, coalesce(w.windowed, 0) AS windowed, s.samples - coalesce(w.windowed, 0) AS tail FROM
  (SELECT recording, count(*) AS samples FROM streams GROUP BY 1) s LEFT JOIN (SELECT recording, count(*) AS windowed FROM swin GROUP BY 1) w USING (recording)""")
def _(spark, d):
    every = raw_samples(spark, d).groupBy("recording").agg(F.count(F.lit(1)).alias("samples"))
    cut = stream_windows(spark, d).groupBy("recording").agg(F.count(F.lit(1)).alias("windowed"))
    return every.join(cut, "recording", "left").select("recording", "samples", F.coalesce("windowed", F.lit(0)).alias("windowed"), (F.col("samples") - F.coalesce("windowed", F.lit(0))).alias("tail"))


def segment_windows(spark, d, size=2, step=1):
    active = runs(spark, d).drop("pos", "n").filter(F.col("label") != "error")
    placed = sweep(active, ["recording", "run"], ORDER, number="pos", totals={"n": ("sum", F.lit(1))})
    return win.sliding_members(placed, size, step)


@query("w3_segment_windows", "runs", f"""WITH a AS (SELECT recording, run, label, event_id, v, row_number() OVER (PARTITION BY recording, run ORDER BY t, event_id) - 1 AS pos, count(*) OVER (PARTITION BY recording, run) AS n FROM runs WHERE label <> 'error'),
  b AS ({members_sql('a', 2, 1)}) SELECT recording, run::BIGINT AS run, win, label, count(*) AS members FROM b GROUP BY ALL""")
def _(spark, d):
    return segment_windows(spark, d).groupBy("recording", "run", "win", "label").agg(F.count(F.lit(1)).alias("members"))


@query("w4_majority_centre", "win", """SELECT recording, win, label FROM (SELECT recording, win, label, row_number() OVER (PARTITION BY recording, win ORDER BY count(*) DESC, max(CASE WHEN pos = win * 4 + 4 THEN 1 ELSE 0 END) DESC, label) AS r
  FROM win GROUP BY ALL) WHERE r = 1""".replace("GROUP BY ALL", "GROUP BY recording, win, label"))
def _(spark, d):
    return win.majority_labels(windows(spark, d), ["recording", "win"], centre=F.col("pos") == F.col("win") * 4 + 4)


@query("w5_majority_lowest", "win", """SELECT recording, win, label FROM (SELECT recording, win, label, row_number() OVER (PARTITION BY recording, win ORDER BY count(*) DESC, label) AS r
  FROM win GROUP BY recording, win, label) WHERE r = 1""")
def _(spark, d):
    return win.majority_labels(windows(spark, d), ["recording", "win"])


@query("w6_window_arrays", "win", """SELECT recording, win, array_to_string(list(event_id ORDER BY pos), ',') AS ids FROM win GROUP BY ALL""")
def _(spark, d):
    packed = win.gather(windows(spark, d), ["recording", "win"], ["event_id"])
    return packed.select("recording", "win", F.array_join(F.col("event_id").cast("array<string>"), ",").alias("ids"))


@query("w7_covered_frames", "win", "SELECT DISTINCT recording, pos FROM win WHERE win % 3 = 0")
def _(spark, d):
    members = windows(spark, d)
    kept = members.filter(F.col("win") % 3 == 0).select("recording", "win").distinct()
    return win.covered_frames(members, kept, KEYS)


@query("w8_window_span", "win", """SELECT recording, first_win * 4 AS span_start, last_win * 4 + 8 AS span_end FROM (SELECT recording, min(win) AS first_win, max(win) AS last_win FROM win GROUP BY 1)""")
def _(spark, d):
    edges = windows(spark, d).groupBy("recording").agg(F.min("win").alias("a"), F.max("win").alias("b"))
    start, end = win.window_span(F.col("a"), F.col("b"), 8, 4)
    return edges.select("recording", start.alias("span_start"), end.alias("span_end"))


@query("w9_frames_to_windows", "ev", """SELECT recording, pos, greatest(0, least((n - 8) // 4, ceil((2 * pos + 1 - 12) / 8.0)::BIGINT)) AS win FROM ev WHERE n >= 8""")
def _(spark, d):
    rows = samples(spark, d).filter("n >= 8")
    last = F.floor((F.col("n") - 8) / 4).cast("long")
    return rows.select("recording", "pos", win.nearest_window(F.col("pos"), 8, 4, F.lit(0), last).alias("win"))
