"""Queries of series estimators (G) and splits (X) with their SQL answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from strideframe.functions.scalars import magnitude
from strideframe.operators import fold_statistics as stats, folds as fold, series as ser
from strideframe.operators.ordered import exact_quantiles
from strideframe.plans import cleaning_queries as clean_q
from strideframe.plans.inputs import KEYS, STEP, WINDOW, frames, load, members_sql, r6, r9, raw_samples, samples, vectors, windows
from strideframe.plans.registry import query, table
from strideframe.session import settle

RATE, LOW, HIGH, SEGMENT, FFT = 4.0, 0.5, 1.5, 16, 64

# Centred magnitudes: a bout per supplier, eight participants.
table("mag", "SELECT recording, recording % 8 AS who, pos, n, m - avg(m) OVER (PARTITION BY recording) AS m, x, y FROM (SELECT *, sqrt(x*x + y*y + z*z) AS m FROM fr)", "fr")
table("seg16", members_sql("mag", SEGMENT, SEGMENT // 2), "mag")
table("bden", f"""SELECT recording, bin, avg(p) AS density FROM (SELECT recording, win, bin, (pow(sum(w * cos(2 * pi() * bin * i / {FFT})), 2) + pow(sum(w * sin(2 * pi() * bin * i / {FFT})), 2)) * CASE WHEN bin IN (0, 32) THEN 1 ELSE 2 END / ({RATE} * 6.0) AS p FROM (
    SELECT recording, win, i, (m - avg(m) OVER (PARTITION BY recording, win)) * (0.5 - 0.5 * cos(2 * pi() * i / 16)) AS w, unnest(range(0, 33)) AS bin FROM (SELECT *, pos - 8 * win AS i FROM seg16)) GROUP BY recording, win, bin) GROUP BY recording, bin""", "seg16")
table("den", f"""SELECT who, bin, bin * {RATE / FFT}::DOUBLE AS f, sum(density * n) / sum(n) AS density FROM bden JOIN (SELECT DISTINCT recording, who, n FROM mag) USING (recording) GROUP BY who, bin""", "bden mag")


def magnitudes(spark, d):
    size = magnitude(F.col("x"), F.col("y"), F.col("z"))
    rows = frames(spark, d, __s=size)
    return rows.select("recording", (F.col("recording") % 8).alias("who"), "pos", "n", (size - F.col("__s") / F.col("n")).alias("m"), "x", "y")


def density(spark, d):
    rows = magnitudes(spark, d)
    lengths = rows.groupBy("recording").agg(F.max("who").alias("who"), F.max("n").alias("n"))
    return ser.pooled_density(ser.welch_density(rows, "recording", "m", RATE, SEGMENT, FFT), lengths, "who", "recording")


@query("g1_welch_density", "den", "SELECT who, bin::INTEGER AS bin, round(f, 6) AS frequency, round(density, 6) AS density FROM den")
def _(spark, d):
    return density(spark, d).select("who", "bin", r6(F.col("frequency"), "frequency"), r6(F.col("density"), "density"))


@query("g2_dominant_peak", "den", f"""SELECT who, arg_max(f, (peak, density, -bin)) AS dominant_hz FROM (SELECT *, CASE WHEN density > lag(density) OVER w AND density > lead(density) OVER w THEN 1 ELSE 0 END AS peak FROM den WINDOW w AS (PARTITION BY who ORDER BY bin)) WHERE f BETWEEN {LOW} AND {HIGH} GROUP BY 1""")
def _(spark, d):
    return ser.dominant_peak(density(spark, d), ["who"], LOW, HIGH)


@query("g3_harmonic_cadence", "den", f"""SELECT who, 2 * arg_max(f, (s, -c)) AS steps_per_second, arg_max(f, (s, -c)) AS stride_hz FROM (SELECT a.who, a.bin AS c, a.f, sum(b.density) AS s FROM (SELECT *, unnest([1, 2, 3, 4]) AS h FROM den WHERE f BETWEEN {LOW / 2} AND {HIGH / 2}) a
  JOIN den b ON a.who = b.who AND b.bin = least(a.bin * h, 32) GROUP BY ALL) GROUP BY 1""")
def _(spark, d):
    return ser.harmonic_cadence(density(spark, d), ["who"], LOW, HIGH)


@query("g4_autocorrelation_cadence", "mag", f"""WITH s AS (SELECT a.recording, a.who, a.n, l AS lag, sum(a.m * b.m) AS s FROM (SELECT *, unnest(range(0, 17)) AS l FROM mag) a LEFT JOIN mag b ON a.recording = b.recording AND b.pos = a.pos + l GROUP BY ALL),
  r AS (SELECT s.who, s.lag, sum(coalesce(s.s, 0) / z.s * s.n) / sum(s.n) AS r FROM s JOIN s z ON s.recording = z.recording AND z.lag = 0 GROUP BY ALL),
  p AS (SELECT *, lag(r) OVER w AS a, lead(r) OVER w AS b FROM r WINDOW w AS (PARTITION BY who ORDER BY lag)),
  q AS (SELECT who, arg_max(lag, (r, -lag)) AS l, arg_max(r, (r, -lag)) AS r, arg_max(a, (r, -lag)) AS a, arg_max(b, (r, -lag)) AS b FROM p WHERE r > a AND r > b AND lag BETWEEN {2 * RATE / HIGH} AND 16 GROUP BY 1)
  SELECT who, round(2 / ((l + 0.5 * (a - b) / (a - 2 * r + b)) / {RATE}), 6)::DOUBLE AS steps_per_second, round((l + 0.5 * (a - b) / (a - 2 * r + b)) / {RATE}, 6)::DOUBLE AS stride_seconds FROM q""")
def _(spark, d):
    out = ser.autocorrelation_cadence(magnitudes(spark, d), "who", "recording", "m", RATE, LOW, HIGH)
    return out.select("who", r6(F.col("steps_per_second"), "steps_per_second"), r6(F.col("stride_seconds"), "stride_seconds"))


def bouts(spark, d):
    return ser.bout_cadence(magnitudes(spark, d), "recording", "m", "y", RATE, LOW, HIGH, 64, 256).withColumn("who", F.col("recording") % 8)


def long_density(channel: str) -> str:
    """Welch density per recording with segments of 64 samples and transforms of 256."""
    return f"""SELECT recording, bin, bin * {RATE / 256}::DOUBLE AS f, avg(p) AS density FROM (
      SELECT recording, win, bin, (pow(sum(w * cos(2 * pi() * bin * i / 256)), 2) + pow(sum(w * sin(2 * pi() * bin * i / 256)), 2)) * CASE WHEN bin IN (0, 128) THEN 1 ELSE 2 END / ({RATE} * 24.0) AS p FROM (
      SELECT recording, win, i, ({channel} - avg({channel}) OVER (PARTITION BY recording, win)) * (0.5 - 0.5 * cos(2 * pi() * i / 64)) AS w, unnest(range(0, 129)) AS bin FROM (SELECT *, pos - 32 * win AS i FROM seg64)) GROUP BY recording, win, bin) GROUP BY recording, bin"""


def long_peak(name: str) -> str:
    return f"""SELECT recording, arg_max(f, (peak, density, -bin)) AS hz FROM (SELECT *, CASE WHEN density > lag(density) OVER w AND density > lead(density) OVER w THEN 1 ELSE 0 END AS peak
      FROM {name} WINDOW w AS (PARTITION BY recording ORDER BY bin)) WHERE f BETWEEN {LOW} AND {HIGH} GROUP BY 1"""


table("seg64", members_sql("mag", 64, 32), "mag")
table("mden", long_density("m"), "seg64")
table("yden", long_density("y"), "seg64")


@query("g5_bout_cadence", "mag mden yden", f"""WITH t AS (SELECT recording, count(*) AS samples FROM mag GROUP BY 1),
  h AS (SELECT recording, 2 * arg_max(f, (s, -c)) AS steps FROM (SELECT a.recording, a.bin AS c, a.f, sum(b.density) AS s FROM (SELECT *, unnest([1, 2, 3, 4]) AS h FROM mden WHERE f BETWEEN {LOW / 2} AND {HIGH / 2}) a
    JOIN mden b ON a.recording = b.recording AND b.bin = least(a.bin * h, 128) GROUP BY ALL) GROUP BY 1),
  s AS (SELECT a.recording, l AS lag, sum(a.m * b.m) AS s FROM (SELECT *, unnest(range(0, 17)) AS l FROM mag WHERE n >= 64) a LEFT JOIN mag b ON a.recording = b.recording AND b.pos = a.pos + l GROUP BY ALL),
  r AS (SELECT s.recording, s.lag, coalesce(s.s, 0) / z.s AS r FROM s JOIN s z ON s.recording = z.recording AND z.lag = 0),
  p AS (SELECT *, lag(r) OVER w AS a, lead(r) OVER w AS b FROM r WINDOW w AS (PARTITION BY recording ORDER BY lag)),
  q AS (SELECT recording, arg_max(lag, (r, -lag)) AS l, arg_max(r, (r, -lag)) AS r, arg_max(a, (r, -lag)) AS a, arg_max(b, (r, -lag)) AS b FROM p WHERE r > a AND r > b AND lag BETWEEN {2 * RATE / HIGH} AND 16 GROUP BY 1)
  SELECT recording, samples, samples / {RATE}::DOUBLE AS seconds, samples >= 64 AS used, round(h.steps, 6) AS fft_steps, round(2 / ((q.l + 0.5 * (q.a - q.b) / (q.a - 2 * q.r + q.b)) / {RATE}), 6)::DOUBLE AS acf_steps,
  round(y.hz, 6) AS vertical_steps, round(m.hz, 6) AS dominant_hz, recording % 8 AS who
  FROM t LEFT JOIN h USING (recording) LEFT JOIN q USING (recording) LEFT JOIN ({long_peak("mden")}) m USING (recording) LEFT JOIN ({long_peak("yden")}) y USING (recording)""")
def _(spark, d):
    return bouts(spark, d).withColumns({c: F.round(c, 6) for c in ("fft_steps", "acf_steps", "vertical_steps", "dominant_hz")})


# Bout rows for the summary: per supplier, with stand-in estimates taken from its channels.
table("bout", "SELECT recording, recording % 8 AS who, count(*) / 4.0::DOUBLE AS seconds, recording % 3 <> 0 AS used, avg(x) AS fft_steps, avg(y) AS acf_steps, avg(x) + avg(y) AS vertical_steps FROM mag GROUP BY 1", "mag")


@query("g6_participant_summary", "bout", """SELECT *, round(acf_steps / fft_steps - 1, 6) AS acf_relative, round(vertical_steps / fft_steps - 1, 6) AS vertical_relative, round(peak_hz / fft_steps, 6) AS peak_ratio, abs(peak_hz / fft_steps - 0.5) < abs(peak_hz / fft_steps - 1) AS peak_is_stride FROM (
  SELECT who, count(*) AS bouts, count(*) FILTER (used) AS used_bouts, coalesce(sum(seconds) FILTER (used), 0)::DOUBLE AS used_seconds, round(min(fft_steps) FILTER (used), 6) AS fft_min, round(max(fft_steps) FILTER (used), 6) AS fft_max,
  round(median(fft_steps) FILTER (used), 6) AS fft_steps, round(median(acf_steps) FILTER (used), 6) AS acf_steps, round(median(vertical_steps) FILTER (used), 6) AS vertical_steps, round(max(fft_steps) FILTER (used), 6) AS peak_hz FROM bout GROUP BY 1)""".replace(
    "SELECT *, round(acf", "SELECT *, round(acf"))
def _(spark, d):
    rows = magnitudes(spark, d).groupBy("recording", "who").agg((F.count(F.lit(1)) / F.lit(RATE)).alias("seconds"), F.avg("x").alias("fft_steps"), F.avg("y").alias("acf_steps"), (F.avg("x") + F.avg("y")).alias("vertical_steps"))
    table = settle(rows.withColumn("used", F.col("recording") % 3 != 0))
    peak = table.filter("used").groupBy("who").agg(F.max("fft_steps").alias("dominant_hz"))
    out = ser.participant_cadence(table, peak, "who")
    base = ["fft_min", "fft_max", "fft_steps", "acf_steps", "vertical_steps", "peak_hz"]
    rounded = out.select("who", "bouts", "used_bouts", "used_seconds", *[r6(F.col(c), c) for c in base], "peak_is_stride")
    return rounded.select("*", r6(F.col("acf_steps") / F.col("fft_steps") - 1, "acf_relative"), r6(F.col("vertical_steps") / F.col("fft_steps") - 1, "vertical_relative"), r6(F.col("peak_hz") / F.col("fft_steps"), "peak_ratio"))


def series_samples(spark, d):
    return samples(spark, d).select(F.col("recording").alias("who"), "pos", "v")


def series_chunks(spark, d):
    return settle(ser.chunked_series(series_samples(spark, d), "who", "v"))


@query("g7_participant_cadence")
def _(spark, d):
    rows = ser.bout_stretches(magnitudes(spark, d), "recording", ["m", "y"], RATE, LOW, 64)
    table = settle(ser.bout_cadence(rows, "recording", "m", "y", RATE, LOW, HIGH, 64, 256).withColumn("who", F.col("recording") % 8))
    lengths = rows.table.groupBy("recording").agg(F.max("n").alias("n")).withColumn("who", F.col("recording") % 8)
    pooled = ser.pooled_density(ser.welch_density(rows, "recording", "m", RATE, 64, 256), lengths, "who", "recording")
    # every series of a participant counts: the median of their walking frequencies
    walks = ser.walking_frequency(settle(series_samples(spark, d)), "who", "v", 1.28).withColumn("who", F.col("who") % 8)
    ssa = exact_quantiles(walks, ["who"], "ssa_steps", [0.5], ["ssa_steps"])
    return ser.participant_cadence(table, ser.dominant_peak(pooled, ["who"], LOW, HIGH), "who", ssa)


@query("g8_singular_spectrum")
def _(spark, d):
    parts = ser.singular_spectrum(settle(series_samples(spark, d)), "who", "v")
    return parts.select("who", "component", r6(F.col("share"), "share"), F.col("pos").cast("int").alias("pos"), r6(F.col("value"), "value"))


@query("g9_w_correlation", "fr", """SELECT recording, round(abs(sum(w * x * y)) / (sqrt(sum(w * x * x)) * sqrt(sum(w * y * y))), 6) AS w_correlation FROM (SELECT *, least(pos + 1, least(n // 2, n - n // 2 + 1), n - pos) AS w FROM fr) GROUP BY 1""")
def _(spark, d):
    out = ser.weighted_correlation(frames(spark, d), KEYS, F.col("x"), F.col("y"), F.col("pos"), F.col("n"), F.floor(F.col("n") / 2))
    return out.select("recording", r6(F.col("w_correlation"), "w_correlation"))


@query("g10_periodogram_peak", "ev", """WITH s AS (SELECT recording AS who, row_number() OVER (PARTITION BY recording ORDER BY t, event_id) - 1 AS pos, v FROM ev),
  m AS (SELECT who, count(*) AS n, avg(v) AS mu FROM s GROUP BY 1), f AS (SELECT *, unnest(range(1, 8 * n + 1)) AS k FROM m),
  p AS (SELECT f.who, f.n, f.k, pow(sum((v - mu) * cos(pi() * k * pos / (8.0::DOUBLE * n))), 2) + pow(sum((v - mu) * sin(pi() * k * pos / (8.0::DOUBLE * n))), 2) AS power FROM f JOIN s USING (who) GROUP BY ALL)
  SELECT who, n::INT AS n, round(arg_max(k, power) / (16 * n * 1.28::DOUBLE), 6) AS peak_hz FROM p GROUP BY who, n""")
def _(spark, d):
    out = ser.periodogram_peak(series_chunks(spark, d), "who", 1.28)
    return out.select("who", F.col("n").cast("int").alias("n"), r6(F.col("peak_hz"), "peak_hz"))


@query("g11_sine_fit", "ev", """WITH RECURSIVE s AS (SELECT recording AS who, row_number() OVER (PARTITION BY recording ORDER BY t, event_id) - 1 AS pos, v FROM ev),
  m AS (SELECT who, count(*) AS n, avg(v) AS mu FROM s GROUP BY 1), f AS (SELECT *, unnest(range(1, 8 * n + 1)) AS k FROM m),
  p AS (SELECT f.who, f.n, f.k, pow(sum((v - mu) * cos(pi() * k * pos / (8.0::DOUBLE * n))), 2) + pow(sum((v - mu) * sin(pi() * k * pos / (8.0::DOUBLE * n))), 2) AS power FROM f JOIN s USING (who) GROUP BY ALL),
  x AS (SELECT who, n, pos * 1.28::DOUBLE AS t, v - mu AS y, mu FROM s JOIN m USING (who)),
  z AS (SELECT who, sum(y * y) AS total FROM x GROUP BY 1),
  g AS (SELECT who, 0 AS round, least(arg_max(k, power) / (16 * n * 1.28::DOUBLE), 0.5 / 1.28::DOUBLE) AS best, 1 / (n * 1.28::DOUBLE) AS reach, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS rest FROM p GROUP BY who, n
    UNION ALL SELECT who, round + 1, w.f, reach, w.a, w.b, w.rest FROM (
      SELECT who, round, any_value(reach) / 3 AS reach, min({'rest': rest, 'f': f, 'a': a, 'b': b}) AS w FROM (
        SELECT who, round, reach, f, a, b, total - a * vs - b * vc AS rest FROM (
          SELECT *, CASE WHEN flat THEN CASE WHEN ss >= cc AND ss > 0 THEN vs / ss ELSE 0 END ELSE (vs * cc - vc * sc) / det END AS a, CASE WHEN flat THEN CASE WHEN cc > ss THEN vc / cc ELSE 0 END ELSE (vc * ss - vs * sc) / det END AS b FROM (
            SELECT *, ss * cc - sc * sc AS det, ss * cc - sc * sc <= 1e-6 * greatest(ss, cc) * greatest(ss, cc) AS flat FROM (
              SELECT who, round, reach, f, sum(sin(2 * pi() * f * t) * y) AS vs, sum(cos(2 * pi() * f * t) * y) AS vc, sum(pow(sin(2 * pi() * f * t), 2)) - pow(sum(sin(2 * pi() * f * t)), 2) / count(*) AS ss,
                sum(pow(cos(2 * pi() * f * t), 2)) - pow(sum(cos(2 * pi() * f * t)), 2) / count(*) AS cc, sum(sin(2 * pi() * f * t) * cos(2 * pi() * f * t)) - sum(sin(2 * pi() * f * t)) * sum(cos(2 * pi() * f * t)) / count(*) AS sc
              FROM (SELECT DISTINCT who, round, reach, greatest(1e-9, least(0.5 / 1.28::DOUBLE, best - reach + 2 * reach * unnest(range(9)) / 8)) AS f FROM g WHERE round < 12) q JOIN x USING (who) GROUP BY who, round, reach, f)) JOIN z USING (who))) GROUP BY who, round))
  SELECT who, round(h.best, 6) AS start, round(sqrt(g.a * g.a + g.b * g.b), 6) AS amplitude, round(g.best, 6) AS frequency, round(CASE WHEN total > 0 THEN 1 - g.rest / total ELSE 0 END, 6) AS r_squared
  FROM g JOIN g h USING (who) JOIN z USING (who) WHERE g.round = 12 AND h.round = 0""")
def _(spark, d):
    out = ser.fit_sine(series_chunks(spark, d), "who", 1.28, 0.5 / 1.28)
    return out.select("who", *[r6(F.col(c), c) for c in ("start", "amplitude", "frequency", "r_squared")])


@query("g12_walking_frequency")
def _(spark, d):
    return ser.walking_frequency(settle(series_samples(spark, d)), "who", "v", 1.28)


# ---- splits ------------------------------------------------------------------------------------------

def hash_sql(key: str, seed: int = 42) -> str:
    m = f"((({key} + {seed}) * 2654435761) % 4294967296)"
    return f"(({m} // 8192 + {m} * 40503) % 4294967296)"


def events(spark, d):
    return raw_samples(spark, d).select("recording", "event_id", "label", "t")


@query("x1_group_folds")
def _(spark, d):
    return fold.group_folds(events(spark, d), "recording", 5)


@query("x2_stratified_folds", "raw", f"SELECT event_id, label, ((row_number() OVER (PARTITION BY label ORDER BY {hash_sql('event_id')}, event_id) - 1) % 10)::INTEGER AS fold FROM raw")
def _(spark, d):
    return fold.stratified_folds(events(spark, d), "label", "event_id", 10).select("event_id", "label", "fold")


@query("x3_leave_one_out", "raw", "SELECT recording AS fold, count(*) AS test_rows, (SELECT count(*) FROM raw) - count(*) AS train_rows FROM raw GROUP BY 1")
def _(spark, d):
    return fold.leave_one_out(events(spark, d), "recording")


@query("x4_inner_participants", "fw", """WITH p AS (SELECT DISTINCT participant FROM fw) SELECT fold, participant, CASE WHEN (row_number() OVER (PARTITION BY fold ORDER BY participant) - 1) % 3 = 0 THEN 'valid' ELSE 'train' END AS role
  FROM p JOIN (SELECT participant AS fold FROM p) ON participant <> fold""")
def _(spark, d):
    return fold.inner_participants(vectors(spark, d), "participant")


@query("x4_inner_rules", "fw", """WITH p AS (SELECT participant, row_number() OVER (ORDER BY participant) - 1 AS place FROM fw GROUP BY participant)
  SELECT participant, place, CASE WHEN place % 3 = 0 THEN 'valid' ELSE 'train' END AS role_if_later_held, CASE WHEN (place - 1) % 3 = 0 THEN 'valid' ELSE 'train' END AS role_if_earlier_held FROM p""")
def _(spark, d):
    return stats.inner_rules(vectors(spark, d), "participant")


@query("x4_inner_folds", "raw", f"""WITH o AS (SELECT event_id, label, (row_number() OVER (PARTITION BY label ORDER BY {hash_sql('event_id')}, event_id) - 1) % 10 AS f FROM raw)
  SELECT g.f::INTEGER AS outer_fold, event_id, label, CASE WHEN (row_number() OVER (PARTITION BY g.f, label ORDER BY {hash_sql('event_id', 7)}, event_id) - 1) % 3 = 0 THEN 'valid' ELSE 'train' END AS role FROM o JOIN (SELECT DISTINCT f FROM o) g ON o.f <> g.f""")
def _(spark, d):
    outer = fold.stratified_folds(events(spark, d), "label", "event_id", 10)
    return stats.inner_roles(stats.inner_places(outer, "label", "event_id", 10), 10).select("outer_fold", "event_id", "label", "role")


@query("x5_stratified_group_folds")
def _(spark, d):
    return fold.group_folds(events(spark, d), "recording", 4, strata="label")


QUOTA = "floor(e) + CASE WHEN row_number() OVER (ORDER BY e - floor(e) DESC, label) <= total - sum(floor(e)) OVER () THEN 1 ELSE 0 END"


@query("x6_stratified_split", "raw", f"""WITH q AS (SELECT label, {QUOTA} AS q FROM (SELECT label, total, total * n / sum(n) OVER () AS e FROM (SELECT label, count(*)::DOUBLE AS n, (SELECT ceil(0.25 * count(*)) FROM raw) AS total FROM raw GROUP BY 1)))
  SELECT event_id, label, CASE WHEN k < q THEN 'Test' ELSE 'Train' END AS split FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {hash_sql('event_id')}, event_id) - 1 AS k FROM raw) JOIN q USING (label)""")
def _(spark, d):
    rows = events(spark, d)
    wanted = rows.agg(F.ceil(F.lit(0.25) * F.count(F.lit(1)))).scalar()
    return fold.stratified_split(rows, "label", "event_id", wanted).select("event_id", "label", "split")


@query("x7_share_per_group", "raw", f"""SELECT event_id, recording, label FROM (SELECT *, row_number() OVER (PARTITION BY recording, label ORDER BY {hash_sql('event_id')}, event_id) - 1 AS k, count(*) OVER (PARTITION BY recording, label) AS n FROM raw) WHERE k < greatest(1, round_even(0.1::DOUBLE * n, 0))""")
def _(spark, d):
    return fold.subsample(events(spark, d), ["recording", "label"], "event_id", 0.1).select("event_id", "recording", "label")


@query("x8_cap_rows", "raw", f"""WITH q AS (SELECT label, {QUOTA} AS q FROM (SELECT label, total, total * n / sum(n) OVER () AS e FROM (SELECT label, count(*)::DOUBLE AS n, (SELECT least(777, count(*))::DOUBLE FROM raw) AS total FROM raw GROUP BY 1)))
  SELECT event_id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {hash_sql('event_id')}, event_id) - 1 AS k FROM raw) JOIN q USING (label) WHERE k < q""")
def _(spark, d):
    return fold.cap_rows(events(spark, d), "label", "event_id", 777).select("event_id", "label")


def window_blocks(spark, d):
    """Windows with the repetition block of their centre frame."""
    from strideframe.operators.compare import join_centres

    starts = windows(spark, d).select("recording", "win").distinct()
    blocks = clean_q.blocks(spark, d).withColumn("run", F.col("block"))
    joined = join_centres(starts, blocks, KEYS, F.col("win") * STEP + WINDOW // 2)
    return joined.select("recording", "win", F.col("run").alias("block"), (F.col("win") * STEP).alias("start"))


table("wblk", f"""WITH {clean_q.BLOCK_SQL} SELECT DISTINCT w.recording, w.win, b.block, w.win * 4 AS start FROM win w JOIN blocks b ON b.recording = w.recording AND b.pos = w.win * 4 + 4""", "win runs")


@query("x9_rounds", "wblk fw", """SELECT DISTINCT 'personDependent' AS scheme, recording AS test, recording AS train, block FROM wblk
  UNION ALL SELECT 'personIndependent', a.participant, b.participant, NULL FROM (SELECT DISTINCT participant FROM fw) a JOIN (SELECT DISTINCT participant FROM fw) b ON a.participant <> b.participant""")
def _(spark, d):
    return fold.repetition_rounds(window_blocks(spark, d), "recording", "block").unionByName(fold.cross_rounds(vectors(spark, d), "participant"))


table("wrole", """SELECT w.recording, w.win, h.block AS held, CASE WHEN w.block = h.block THEN 'test' WHEN w.start < b AND w.start + 8 > a THEN 'purged' ELSE 'train' END AS role
  FROM wblk w JOIN (SELECT recording, block, min(start) AS a, max(start) + 8 AS b FROM wblk GROUP BY ALL) h ON w.recording = h.recording""", "wblk")


@query("x10_round_windows", "wrole", "SELECT * FROM wrole WHERE role <> 'train'")
def _(spark, d):
    return fold.round_windows(window_blocks(spark, d), "recording", "block", "win", WINDOW, STEP).select("recording", "win", "held", "role")


@query("x10_round_sizes", "wrole", """SELECT recording, held, count(*) FILTER (role = 'test') AS test, count(*) FILTER (role = 'purged') AS purged, count(*) FILTER (role = 'train') AS train FROM wrole GROUP BY ALL""")
def _(spark, d):
    rows = settle(window_blocks(spark, d))
    roles = fold.round_windows(rows, "recording", "block", "win", WINDOW, STEP)
    return fold.round_sizes(rows, roles, "recording")
