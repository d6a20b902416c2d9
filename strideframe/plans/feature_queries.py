"""Queries of projections (P) and per-window features (F) with their SQL answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from strideframe.functions import arrays as A, scalars as S
from strideframe.operators import features as feat
from strideframe.operators.ordered import attach, sweep
from strideframe.operators.windows import gather
from strideframe.plans.cleaning_queries import runs
from strideframe.plans.inputs import KEYS, ORDER, frame_windows, frames, load, r6, raw_samples, samples, vectors, windows
from strideframe.plans.registry import query, table

WIN = ["recording", "win"]
RATE = 4.0


def packed(spark, d):
    return gather(windows(spark, d), WIN, ["v"])


def spectra(spark, d):
    return feat.with_spectrum(packed(spark, d), "v")


table("spec", """SELECT recording, win, k, re * re + im * im AS p FROM (
  SELECT recording, win, k, sum((v - m) * cos(2 * pi() * k * (pos - 4 * win) / 8)) AS re, sum((v - m) * sin(2 * pi() * k * (pos - 4 * win) / 8)) AS im
  FROM (SELECT *, avg(v) OVER (PARTITION BY recording, win) AS m, unnest(range(0, 5)) AS k FROM win) GROUP BY ALL)""", "win")


# ---- projections -------------------------------------------------------------------------------------

@query("p1_select_channels", "fr", "SELECT recording, pos, round(x, 6) AS acc_1_x, round(y, 6) AS acc_1_y FROM fr")
def _(spark, d):
    named = frames(spark, d).withColumnsRenamed({"x": "acc_1_x", "y": "acc_1_y", "z": "gyr_1_x"})
    kept = S.select_channels(named.columns, ["acc_1"])
    return named.select("recording", "pos", *[r6(F.col(c), c) for c in kept])


@query("p2_filled_frames", "", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice % 1 <> 0 AND l_discount % 1 <> 0 AND l_tax % 1 <> 0 AS filled FROM lineitem""")
def _(spark, d):
    mark = S.all_fractional(F.col("l_extendedprice"), F.col("l_discount"), F.col("l_tax"))
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", mark.alias("filled"))


@query("p3_drop_null_label", "runs", "SELECT recording, pos, run::BIGINT AS run, label FROM runs WHERE label <> 'error'")
def _(spark, d):
    return runs(spark, d).filter(F.col("label") != "error").select("recording", "pos", "run", "label")


@query("p5_split_rows", "fw", "SELECT vec_id, label, split FROM fw WHERE split = 'Train'")
def _(spark, d):
    return vectors(spark, d).filter(F.col("split") == "Train").select("vec_id", "label", "split")


@query("p6_name_groups", "", """SELECT g AS name_group, count(*) AS names, min(p_partkey) AS first_seen FROM (
  SELECT p_partkey, split_part(split_part(p_name || '-' || p_brand || '(' || p_type, '-', 1), '(', 1) AS g FROM part) GROUP BY 1""")
def _(spark, d):
    name = F.concat("p_name", F.lit("-"), "p_brand", F.lit("("), "p_type")
    named = load(spark, d, "part").select("p_partkey", S.name_group(name).alias("name_group"))
    return named.groupBy("name_group").agg(F.count(F.lit(1)).alias("names"), F.min("p_partkey").alias("first_seen"))


@query("p7_assign_sensor", "", """SELECT p_partkey, CASE WHEN contains(p_name, 'widget') THEN 'Gyro' WHEN contains(p_name, 'red') THEN 'Acc' ELSE 'Other' END AS sensor FROM part""")
def _(spark, d):
    return load(spark, d, "part").select("p_partkey", S.assign_by_word(F.col("p_name"), [("widget", "Gyro"), ("red", "Acc")]).alias("sensor"))


@query("p8_participant_number", "", "SELECT s_suppkey, split_part('walk_sub' || s_suppkey, '_sub', 2)::INTEGER AS participant FROM supplier")
def _(spark, d):
    name = F.concat(F.lit("walk_sub"), F.col("s_suppkey").cast("string"))
    return load(spark, d, "supplier").select("s_suppkey", S.participant_of(name).alias("participant"))


@query("p9_magnitude", "fr", "SELECT recording, pos, round(sqrt(x*x + y*y + z*z), 6) AS magnitude FROM fr")
def _(spark, d):
    return frames(spark, d).select("recording", "pos", r6(S.magnitude(F.col("x"), F.col("y"), F.col("z")), "magnitude"))


@query("p10_centred_magnitude", "fr", "SELECT recording, pos, round(m - avg(m) OVER (PARTITION BY recording), 6) AS magnitude FROM (SELECT *, sqrt(x*x + y*y + z*z) AS m FROM fr)")
def _(spark, d):
    rows = frames(spark, d).withColumn("m", S.magnitude(F.col("x"), F.col("y"), F.col("z")))
    rows = sweep(rows, KEYS, ["pos"], totals={"s": ("sum", F.col("m"))})
    return rows.select("recording", "pos", r6(F.col("m") - F.col("s") / F.col("n"), "magnitude"))


@query("p11_vertical_acceleration", "fr", """SELECT recording, pos, round(a - avg(a) OVER (PARTITION BY recording), 6) AS vertical FROM (
  SELECT recording, pos, (x * y + y * z + z * (x + 1)) / sqrt(y*y + z*z + (x + 1)*(x + 1)) AS a FROM fr)""")
def _(spark, d):
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    rows = frames(spark, d).withColumn("a", S.vertical_part([x, y, z], [x + y, y + z, z + x + 1]))
    rows = sweep(rows, KEYS, ["pos"], totals={"s": ("sum", F.col("a"))})
    return rows.select("recording", "pos", r6(F.col("a") - F.col("s") / F.col("n"), "vertical"))


@query("p12_angular_rate", "fr", """SELECT recording, pos, round(x * sg * sc, 6) + 0.0::DOUBLE AS gyro_x, round(y * sg * sc, 6) + 0.0::DOUBLE AS gyro_y, round(z * sg * sc, 6) + 0.0::DOUBLE AS gyro_z FROM (
  SELECT *, 2 * atan2(nrm, w * sg) / CASE WHEN nrm > 0 THEN nrm ELSE 1 END / 0.25 AS sc FROM (SELECT *, y - 0.8 AS w, CASE WHEN y - 0.8 < 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS sg, sqrt(x*x + y*y + z*z) AS nrm FROM fr))""")
def _(spark, d):
    rates = S.angular_rate(F.col("y") - 0.8, [F.col("x"), F.col("y"), F.col("z")], F.lit(0.25))
    return frames(spark, d).select("recording", "pos", *[r6(r, f"gyro_{c}") for r, c in zip(rates, "xyz")])


@query("p13_velocity_to_acceleration", "raw", """SELECT recording, event_id, round((v / (p / 1e6))::FLOAT::DOUBLE * 1e6, 3) AS acceleration FROM raw JOIN (
  SELECT recording, median(s) FILTER (s > 0) AS p FROM (SELECT recording, (t - lag(t) OVER (PARTITION BY recording ORDER BY t, event_id))::DOUBLE AS s FROM raw) GROUP BY 1) USING (recording)""")
def _(spark, d):
    from strideframe.operators.clean import sample_periods

    rows = raw_samples(spark, d)
    periods = sample_periods(rows, KEYS, ORDER)
    value = (F.col("v") / (F.col("period") / 1e6)).cast("float").cast("double")
    return attach(rows, periods, KEYS).select("recording", "event_id", F.round(value * 1e6, 3).alias("acceleration"))


@query("p14_encode_labels", "", """WITH k AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS code, n FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1))
  SELECT event_id, code, n AS samples FROM events JOIN k USING (event_type)""")
def _(spark, d):
    from strideframe.sources.recordings import encode_labels

    coded, _names = encode_labels(load(spark, d, "events"), "event_type")
    return coded.select("event_id", "code", "samples")


@query("p15_up_down_ratio", "", """SELECT user_id, up * 1.28 AS up_seconds, down * 1.28 AS down_seconds, round((up * 1.28) / (down * 1.28), 9) AS ratio FROM (
  SELECT user_id, (count(*) FILTER (event_type = 'click'))::DOUBLE AS up, (count(*) FILTER (event_type = 'view'))::DOUBLE AS down FROM events GROUP BY 1) WHERE down > 0""")
def _(spark, d):
    from strideframe.operators.aggregate import seconds_by_class, up_down_ratio

    table = seconds_by_class(load(spark, d, "events"), "user_id", "event_type", ["click", "view"], 1.28)
    out = up_down_ratio(table, "user_id", "click", "view")
    return out.select("user_id", F.col("up").alias("up_seconds"), F.col("down").alias("down_seconds"), r9_(F.col("ratio"), "ratio"))


def r9_(value, name):
    return F.round(value, 9).alias(name)


# ---- features ----------------------------------------------------------------------------------------

@query("f1_mean_variance", "fwin", """SELECT recording, win, round(avg(x), 6) AS mean_x, round(var_pop(x), 6) AS variance_x, round(avg(y), 6) AS mean_y, round(var_pop(y), 6) AS variance_y FROM fwin GROUP BY ALL""")
def _(spark, d):
    out = feat.mean_variance(frame_windows(spark, d), WIN, ["x", "y"])
    return out.select(*WIN, *[r6(F.col(c), c) for c in out.columns if c not in WIN])


@query("f2_crossing_rates", "ev win", """SELECT recording, win, round(sum(CASE WHEN pos > win * 4 AND a <> pa THEN 1 ELSE 0 END) / 7.0::DOUBLE, 9) AS zero_rate, round(sum(CASE WHEN pos > win * 4 AND b <> pb THEN 1 ELSE 0 END) / 7.0::DOUBLE, 9) AS mean_rate FROM (
  SELECT *, lag(a) OVER w AS pa, lag(b) OVER w AS pb FROM (SELECT win.*, v >= c AS a, v >= avg(v) OVER (PARTITION BY recording, win) AS b FROM win JOIN (SELECT recording, avg(v) AS c FROM ev GROUP BY 1) USING (recording)) WINDOW w AS (PARTITION BY recording, win ORDER BY pos)) GROUP BY ALL""")
def _(spark, d):
    rows = sweep(samples(spark, d), KEYS, ORDER, totals={"s": ("sum", F.col("v"))}).withColumn("c", F.col("s") / F.col("n"))
    from strideframe.operators.windows import sliding_members

    members = sliding_members(rows, 8, 4)
    a = gather(members, WIN, ["v", "c"])
    centre = F.element_at("c", 1)
    return a.select(*WIN, r9_(A.crossing_rate(F.col("v"), centre), "zero_rate"), r9_(A.crossing_rate(F.col("v"), A.mean(F.col("v"))), "mean_rate"))


@query("f3_sign_changes", "win", """SELECT recording, win, count(*) FILTER (s <> ps) AS changes FROM (SELECT *, lag(s) OVER (PARTITION BY recording, win ORDER BY pos) AS ps FROM (
  SELECT *, v - avg(v) OVER (PARTITION BY recording, win) < 0 AS s FROM win)) GROUP BY ALL""")
def _(spark, d):
    return packed(spark, d).select(*WIN, A.sign_changes(A.centred(F.col("v"))).cast("long").alias("changes"))


@query("f4_power_spectrum", "spec", "SELECT recording, win, k::INTEGER AS k, round(p, 6) AS power FROM spec")
def _(spark, d):
    return spectra(spark, d).select(*WIN, F.posexplode("power").alias("k", "power")).withColumn("power", F.round("power", 6))


@query("f5_hertz_bands", "spec", """SELECT recording, win, round(sum(p) FILTER (k = 1), 6) AS band_1, round(sum(p) FILTER (k IN (2, 3)), 6) AS band_2, round(sum(p) FILTER (k = 4), 6) AS band_3 FROM spec GROUP BY ALL""")
def _(spark, d):
    bands = A.hertz_bands(8, RATE, (0.5, 1.0, 2.0))
    return spectra(spark, d).select(*WIN, *[r6(A.band_power(F.col("power"), lo, hi), f"band_{i}") for i, (lo, hi) in enumerate(bands, 1)])


@query("f6_log_bands", "spec", """SELECT recording, win, 0.0::DOUBLE AS band_1, round(sum(p) FILTER (k = 1), 6) AS band_2, round(sum(p) FILTER (k = 2), 6) AS band_3, round(sum(p) FILTER (k IN (3, 4)), 6) AS band_4 FROM spec GROUP BY ALL""")
def _(spark, d):
    return spectra(spark, d).select(*WIN, *[r6(A.band_power(F.col("power"), lo, hi), f"band_{i}") for i, (lo, hi) in enumerate(A.log_bands(8), 1)])


@query("f7_dominant_frequency", "spec", "SELECT recording, win, arg_max(k, p) * 0.5::DOUBLE AS hertz FROM spec WHERE k >= 1 GROUP BY ALL")
def _(spark, d):
    return spectra(spark, d).select(*WIN, (A.dominant_bin(F.col("power")) * (RATE / 8)).alias("hertz"))


@query("f8_cepstrum", "spec", """SELECT recording, win, j::INTEGER AS coefficient, round(sqrt(0.5) * sum(ln(p + 1e-10) * cos(pi() * (2 * (k - 1) + 1) * j / 8)), 4) AS value
  FROM (SELECT *, unnest([1, 2, 3]) AS j FROM spec WHERE k >= 1) GROUP BY ALL""")
def _(spark, d):
    out = spectra(spark, d).withColumn("c", A.cepstrum(A.without_dc(F.col("power")), 3))
    return out.select(*WIN, F.posexplode("c").alias("i", "value")).select(*WIN, (F.col("i") + 1).alias("coefficient"), F.round("value", 4).alias("value"))


@query("f9_spectral_entropy", "spec", """SELECT recording, win, round(-sum(CASE WHEN p > 0 THEN p / t * log2(p / t) ELSE 0 END), 6) AS entropy FROM (
  SELECT *, sum(p) OVER (PARTITION BY recording, win) AS t FROM spec WHERE k >= 1) GROUP BY ALL""")
def _(spark, d):
    return spectra(spark, d).select(*WIN, r6(A.entropy_bits(A.without_dc(F.col("power"))), "entropy"))


@query("f10_spectral_energy", "spec", "SELECT recording, win, round(sum(p) / 8, 6) AS energy FROM spec WHERE k >= 1 GROUP BY ALL")
def _(spark, d):
    return spectra(spark, d).select(*WIN, r6(A.total(A.without_dc(F.col("power"))) / 8, "energy"))


SHAPE_SQL = """SELECT recording, win, round(avg(c*c*c) / pow(avg(c*c), 1.5), 6) AS skewness, round(avg(c*c*c*c) / pow(avg(c*c), 2) - 3, 6) AS kurtosis,
  round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 6) AS interquartile_range, round(sqrt(avg(v*v)), 6) AS rms,
  round(max(v) - min(v), 6) AS peak_to_peak, round(max(abs(v)) / sqrt(avg(v*v)), 6) AS crest_factor, round(abs(avg(v)), 6) AS dc_component
  FROM (SELECT *, v - avg(v) OVER (PARTITION BY recording, win) AS c FROM win) GROUP BY ALL"""


def shape(spark, d, *names):
    out = feat.shape_statistics(windows(spark, d), WIN, "v")
    return out.select(*WIN, *[r6(F.col(c), c) for c in names])


@query("f11_dc_component", "win", f"SELECT recording, win, dc_component FROM ({SHAPE_SQL})")
def _(spark, d):
    return shape(spark, d, "dc_component")


@query("f12_skewness_kurtosis", "win", f"SELECT recording, win, skewness, kurtosis FROM ({SHAPE_SQL})")
def _(spark, d):
    return shape(spark, d, "skewness", "kurtosis")


@query("f13_median_quartiles", "win", f"SELECT recording, win, median, interquartile_range FROM ({SHAPE_SQL})")
def _(spark, d):
    return shape(spark, d, "median", "interquartile_range")


@query("f14_rms_range_crest", "win", f"SELECT recording, win, rms, peak_to_peak, crest_factor FROM ({SHAPE_SQL})")
def _(spark, d):
    return shape(spark, d, "rms", "peak_to_peak", "crest_factor")


@query("f15_haar_wavelet", "win", """WITH l AS (SELECT recording, win, list(v ORDER BY pos) AS a FROM win GROUP BY ALL),
  s1 AS (SELECT *, [(a[2*i+1] + a[2*i+2]) / sqrt(2) for i in range(0, 4)] AS b, [(a[2*i+1] - a[2*i+2]) / sqrt(2) for i in range(0, 4)] AS d1 FROM l),
  s2 AS (SELECT *, [(b[2*i+1] + b[2*i+2]) / sqrt(2) for i in range(0, 2)] AS c, [(b[2*i+1] - b[2*i+2]) / sqrt(2) for i in range(0, 2)] AS d2 FROM s1),
  s3 AS (SELECT recording, win, list_concat(list_concat(d1, d2), [(c[1] - c[2]) / sqrt(2)]) AS dd FROM s2)
  SELECT recording, win, round(list_sum(dd), 6) AS wavelet_sum, round(list_sum(dd) * list_sum(dd), 6) AS squared_sum, round(list_sum([x * x for x in dd]), 6) AS energy FROM s3""")
def _(spark, d):
    out = packed(spark, d).withColumn("h", A.haar_details("v"))
    s = A.total(F.col("h"))
    return out.select(*WIN, r6(s, "wavelet_sum"), r6(s * s, "squared_sum"), r6(A.total(F.transform("h", lambda x: x * x)), "energy"))


@query("f16_axis_correlation", "fwin", """SELECT recording, win, round(CASE WHEN stddev_pop(x) * stddev_pop(y) > 1e-12 THEN covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)) ELSE 0 END, 6) AS correlation_xy,
  round(CASE WHEN stddev_pop(x) * stddev_pop(z) > 1e-12 THEN covar_pop(x, z) / (stddev_pop(x) * stddev_pop(z)) ELSE 0 END, 6) AS correlation_xz,
  round(CASE WHEN stddev_pop(y) * stddev_pop(z) > 1e-12 THEN covar_pop(y, z) / (stddev_pop(y) * stddev_pop(z)) ELSE 0 END, 6) AS correlation_yz FROM fwin GROUP BY ALL""")
def _(spark, d):
    out = feat.axis_correlations(frame_windows(spark, d), WIN, ["x", "y", "z"])
    return out.select(*WIN, *[r6(F.col(c), c) for c in ("correlation_xy", "correlation_xz", "correlation_yz")])


@query("f17_axis_norm", "fwin", """SELECT recording, win, round(avg(m), 6) AS norm_mean, round(var_pop(m), 6) AS norm_variance FROM (SELECT *, sqrt(x*x + y*y + z*z) AS m FROM fwin) GROUP BY ALL""")
def _(spark, d):
    out = feat.axis_correlations(frame_windows(spark, d), WIN, ["x", "y", "z"])
    return out.select(*WIN, r6(F.col("norm_mean"), "norm_mean"), r6(F.col("norm_variance"), "norm_variance"))


@query("f18_raw_frames", "win", "SELECT recording, win, (pos - 4 * win)::INTEGER AS i, round(v, 6) AS value FROM win")
def _(spark, d):
    out, _names = feat.typed_features(packed(spark, d), WIN, ["v"], "Raw", {}, 8)
    return out.select(*WIN, F.posexplode("features").alias("i", "value")).withColumn("value", F.round("value", 6))


def continuous_windows(spark, d):
    """Frame windows whose channels have no repeated values, so no sample ties with its window mean."""
    return frame_windows(spark, d).withColumns({"x": F.col("x") + F.col("y"), "z": F.col("z") + F.col("y")})


def typed(spark, d, kind):
    rows = gather(continuous_windows(spark, d), WIN, ["x", "y", "z"])
    centres = {"x": F.lit(0.45), "y": F.lit(0.9), "z": F.lit(0.09)}
    out, names = feat.typed_features(rows, WIN, ["x", "y", "z"], kind, centres, 8, cepstral=3)
    labels = F.array(*[F.lit(n) for n in names])
    return out.select(*WIN, F.posexplode("features").alias("i", "value")).select(*WIN, F.element_at(labels, F.col("i") + 1).alias("feature"), F.round("value", 4).alias("value"))


# Three channels of the frame windows, one row per (window, channel, sample), and what the vectors hold of them.
table("fwx", "SELECT * REPLACE (x + y AS x, z + y AS z) FROM fwin", "fwin")
table("ch", """SELECT recording, win, pos - 4 * win AS i, c AS channel, CASE c WHEN 'x' THEN x WHEN 'y' THEN y ELSE z END AS v, CASE c WHEN 'x' THEN 0.45 WHEN 'y' THEN 0.9 ELSE 0.09 END::DOUBLE AS centre
  FROM (SELECT *, unnest(['x', 'y', 'z']) AS c FROM fwx)""", "fwx")
table("chc", "SELECT *, avg(v) OVER w AS m, v - avg(v) OVER w AS c FROM ch WINDOW w AS (PARTITION BY recording, win, channel)", "ch")
table("chs", """SELECT recording, win, channel, k, pow(sum(c * cos(2 * pi() * k * i / 8)), 2) + pow(sum(c * sin(2 * pi() * k * i / 8)), 2) AS p FROM (SELECT *, unnest(range(0, 5)) AS k FROM chc) GROUP BY recording, win, channel, k""", "chc")
CROSSING_SQL = """(SELECT *, lag(a) OVER o AS pa, lag(b) OVER o AS pb FROM (SELECT *, v >= centre AS a, v >= m AS b FROM chc) WINDOW o AS (PARTITION BY recording, win, channel ORDER BY i))"""
BLOCKS = {
    "Raw": ["SELECT recording, win, 'raw' || i || '_' || channel AS feature, v AS value FROM ch"],
    "VerySimple": ["SELECT recording, win, 'mean_' || channel AS feature, avg(v) AS value FROM ch GROUP BY recording, win, channel", "SELECT recording, win, 'variance_' || channel, var_pop(v) FROM ch GROUP BY recording, win, channel"],
    "Rates": [
        f"SELECT recording, win, 'zeroCrossingRate_' || channel AS feature, sum(CASE WHEN a <> pa THEN 1 ELSE 0 END) / 7.0::DOUBLE AS value FROM {CROSSING_SQL} GROUP BY recording, win, channel",
        f"SELECT recording, win, 'meanCrossingRate_' || channel, sum(CASE WHEN b <> pb THEN 1 ELSE 0 END) / 7.0::DOUBLE FROM {CROSSING_SQL} GROUP BY recording, win, channel",
    ],
    "FFT": [
        "SELECT recording, win, 'fftBand1_' || channel AS feature, 0.0::DOUBLE AS value FROM ch GROUP BY recording, win, channel",
        *[f"SELECT recording, win, 'fftBand{b}_' || channel, sum(p) FROM chs WHERE k IN ({ks}) GROUP BY recording, win, channel" for b, ks in ((2, "1"), (3, "2"), (4, "3, 4"))],
        "SELECT recording, win, 'cepstrum' || j || '_' || channel, sqrt(0.5) * sum(ln(p + 1e-10) * cos(pi() * (2 * (k - 1) + 1) * j / 8)) FROM (SELECT *, unnest([1, 2, 3]) AS j FROM chs WHERE k >= 1) GROUP BY recording, win, channel, j",
        "SELECT recording, win, 'spectralEntropy_' || channel, -sum(CASE WHEN p > 0 THEN p / t * log2(p / t) ELSE 0 END) FROM (SELECT *, sum(p) OVER (PARTITION BY recording, win, channel) AS t FROM chs WHERE k >= 1) GROUP BY recording, win, channel",
        "SELECT recording, win, 'energy_' || channel, sum(p) / 8 FROM chs WHERE k >= 1 GROUP BY recording, win, channel",
    ],
}
BLOCKS["Simple"] = BLOCKS["VerySimple"] + BLOCKS["Rates"]
BLOCKS["All"] = BLOCKS["Simple"] + BLOCKS["FFT"]

for _kind in feat.FEATURE_TYPES:
    query(f"f19_features_{_kind.lower()}", "chs chc", "SELECT recording, win, feature, round(value, 4) + 0.0::DOUBLE AS value FROM (" + " UNION ALL ".join(BLOCKS[_kind]) + ")")(
        lambda spark, d, kind=_kind: typed(spark, d, kind)
    )


@query("f20_recognizer_vector", "chs chc", """SELECT recording, win, (CASE channel WHEN 'x' THEN 0 WHEN 'y' THEN 6 ELSE 12 END + o)::INTEGER AS feature, round(value::FLOAT::DOUBLE, 3) + 0.0::DOUBLE AS value FROM (
  SELECT recording, win, channel, 0 AS o, avg(v) AS value FROM ch GROUP BY recording, win, channel UNION ALL SELECT recording, win, channel, 1, var_pop(v) FROM ch GROUP BY recording, win, channel
  UNION ALL SELECT recording, win, channel, CASE k WHEN 1 THEN 2 WHEN 4 THEN 4 ELSE 3 END, sum(p) / 8 FROM chs WHERE k >= 1 GROUP BY ALL UNION ALL SELECT recording, win, channel, 5, arg_max(k, p) * 0.5 FROM chs WHERE k >= 1 GROUP BY recording, win, channel)""".replace("sum(p) / 8 FROM chs WHERE k >= 1 GROUP BY ALL", "sum(p) / 8 FROM chs WHERE k >= 1 GROUP BY recording, win, channel, CASE k WHEN 1 THEN 2 WHEN 4 THEN 4 ELSE 3 END"))
def _(spark, d):
    rows = gather(continuous_windows(spark, d), WIN, ["x", "y", "z"])
    out, names = feat.recognizer_features(rows, WIN, ["x", "y", "z"], 8, RATE, (0.5, 1.0, 2.0))
    return out.select(*WIN, F.posexplode("features").alias("feature", "value")).withColumn("value", F.round(F.col("value").cast("double"), 3))


_STATS = ["avg(v)", "var_pop(v)", "quantile_cont(v, 0.5)", "quantile_cont(v, 0.75) - quantile_cont(v, 0.25)", "CASE WHEN avg(c*c) > 1e-12 THEN avg(c*c*c) / pow(avg(c*c), 1.5) ELSE 0 END", "CASE WHEN avg(c*c) > 1e-12 THEN avg(c*c*c*c) / pow(avg(c*c), 2) - 3 ELSE 0 END", "sqrt(avg(v*v))"]
_CHANNEL = "CASE channel WHEN 'x' THEN 0 WHEN 'y' THEN 17 ELSE 34 END"
_BY = "GROUP BY recording, win, channel"
_SIGNAL_SQL = [f"SELECT recording, win, {_CHANNEL} + {i} AS feature, {e} AS value FROM chc {_BY}" for i, e in enumerate(_STATS)]
_SIGNAL_SQL += [f"SELECT recording, win, {_CHANNEL} + 7, sum(CASE WHEN s <> ps THEN 1 ELSE 0 END)::DOUBLE FROM (SELECT *, c < 0 AS s, lag(c < 0) OVER (PARTITION BY recording, win, channel ORDER BY i) AS ps FROM chc) {_BY}"]
_SIGNAL_SQL += [f"SELECT recording, win, {_CHANNEL} + {i}, {e} FROM chc {_BY}" for i, e in ((8, "max(v) - min(v)"), (9, "CASE WHEN avg(v*v) > 0 THEN max(abs(v)) / sqrt(avg(v*v)) ELSE 0 END"), (10, "max(v) - min(v)"), (11, "abs(avg(v))"))]
_SIGNAL_SQL += [f"SELECT recording, win, {_CHANNEL} + 12, sum(p) / 8 FROM chs WHERE k >= 1 {_BY}", f"SELECT recording, win, {_CHANNEL} + 13, -sum(CASE WHEN p > 0 THEN p / t * log2(p / t) ELSE 0 END) FROM (SELECT *, sum(p) OVER (PARTITION BY recording, win, channel) AS t FROM chs WHERE k >= 1) {_BY}"]
table("haar", """SELECT recording, win, channel, list_concat(list_concat(d1, d2), [(c[1] - c[2]) / sqrt(2)]) AS dd FROM (SELECT *, [(b[2*i+1] + b[2*i+2]) / sqrt(2) for i in range(0, 2)] AS c, [(b[2*i+1] - b[2*i+2]) / sqrt(2) for i in range(0, 2)] AS d2 FROM (
  SELECT *, [(a[2*i+1] + a[2*i+2]) / sqrt(2) for i in range(0, 4)] AS b, [(a[2*i+1] - a[2*i+2]) / sqrt(2) for i in range(0, 4)] AS d1 FROM (SELECT recording, win, channel, list(v ORDER BY i) AS a FROM ch GROUP BY recording, win, channel)))""", "ch")
_SIGNAL_SQL += [f"SELECT recording, win, {_CHANNEL} + {i}, {e} FROM haar" for i, e in ((14, "list_sum(dd)"), (15, "list_sum(dd) * list_sum(dd)"), (16, "list_sum([x * x for x in dd])"))]
_SIGNAL_SQL += [f"SELECT recording, win, {51 + i}, {e} FROM (SELECT *, sqrt(x*x + y*y + z*z) AS g FROM fwx) GROUP BY recording, win" for i, e in enumerate(
    [*[f"CASE WHEN stddev_pop({a}) * stddev_pop({b}) > 1e-12 THEN covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b})) ELSE 0 END" for a, b in (("x", "y"), ("x", "z"), ("y", "z"))], "avg(g)", "var_pop(g)"]
)]


@query("f21_signal_vector", "chs chc haar fwx", "SELECT recording, win, feature::INTEGER AS feature, round(value, 5) + 0.0::DOUBLE AS value FROM (" + " UNION ALL ".join(_SIGNAL_SQL) + ")")
def _(spark, d):
    rows = gather(continuous_windows(spark, d), WIN, ["x", "y", "z"])
    out, names = feat.signal_features(rows, WIN, {"wrist": ["x", "y", "z"]}, 8)
    return out.select(*WIN, F.posexplode("features").alias("feature", "value")).withColumn("value", F.round("value", 5))


table("fscore", """SELECT a.recording, a.win, variance, entropy, sqrt(pow(mx - lag(mx) OVER w, 2) + pow(my - lag(my) OVER w, 2) + pow(mz - lag(mz) OVER w, 2))
    + sqrt(pow(sx - lag(sx) OVER w, 2) + pow(sy - lag(sy) OVER w, 2) + pow(sz - lag(sz) OVER w, 2)) AS change FROM (
    SELECT recording, win, var_pop(sqrt(x*x + y*y + z*z)) AS variance, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, stddev_pop(x) AS sx, stddev_pop(y) AS sy, stddev_pop(z) AS sz FROM fwin GROUP BY ALL) a
  JOIN (SELECT recording, win, -sum(CASE WHEN p > 0 THEN p / tt * ln(p / tt) ELSE 0 END) / ln(4) AS entropy FROM (SELECT *, sum(p) OVER (PARTITION BY recording, win) AS tt FROM (
    SELECT recording, win, k, pow(sum((g - gm) * cos(2 * pi() * k * (pos - 4 * win) / 8)), 2) + pow(sum((g - gm) * sin(2 * pi() * k * (pos - 4 * win) / 8)), 2) AS p
    FROM (SELECT *, avg(g) OVER (PARTITION BY recording, win) AS gm, unnest([1, 2, 3, 4]) AS k FROM (SELECT *, sqrt(x*x + y*y + z*z) AS g FROM fwin)) GROUP BY ALL)) GROUP BY ALL) e
    ON a.recording = e.recording AND a.win = e.win WINDOW w AS (PARTITION BY a.recording ORDER BY a.win)""", "fwin")


def scores(spark, d):
    return feat.window_scores(frame_windows(spark, d), KEYS, [["x", "y", "z"]])


for _key, _name in (("f22_score_variance", "variance"), ("f23_score_change", "change"), ("f24_score_entropy", "entropy")):
    query(_key, "fscore", f"SELECT recording, win, round({_name}, 6) AS {_name} FROM fscore")(
        lambda spark, d, name=_name: scores(spark, d).select(*WIN, r6(F.col(name), name))
    )
