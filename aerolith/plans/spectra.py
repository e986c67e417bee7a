"""Queries on spectra, filters, latency and fits. SQL twins use plain cosine and sine sums, and recursion for filters."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from aerolith.functions.columns import biquad_columns, one_pole_gain
from aerolith.operators import fit as T
from aerolith.operators import servo as V
from aerolith.operators import spectral as P
from aerolith.operators import stats as S
from aerolith.operators.timeaxis import magnitude
from aerolith.plans.basics import r, rounded
from aerolith.plans.dynamics import CORR_SQL, WIN, header_templates
from aerolith.sources.virtual_logs import FRAMES_SQL, axis_frames, flight_frames

FS = 100.0
L = 32


def q_welch(spark, d):
    return rounded(P.db(P.welch_psd(axis_frames(flight_frames(spark, d)), "gyro", FS, L)))


def q_peaks(spark, d):
    return rounded(P.spectrum_peaks(P.welch_psd(axis_frames(flight_frames(spark, d)), "gyro", FS, L), 5.0, 45.0, 3, 2.0))


def q_stft(spark, d):
    return rounded(P.stft_columns(axis_frames(flight_frames(spark, d)), "gyro", FS, L))


def q_stft_speed(spark, d):
    f = flight_frames(spark, d)
    cols = P.stft_columns(axis_frames(f), "gyro", FS, L)
    return rounded(P.stft_by_speed(cols, f.select("log_id", "frame_idx", F.col("gps_speed").alias("speed")), FS, L, bins=4))


def q_transfer(spark, d):
    return rounded(P.transfer_function(axis_frames(flight_frames(spark, d)), "sp", "gyro", FS, L), 5)


def q_bandwidth(spark, d):
    tf = P.transfer_function(axis_frames(flight_frames(spark, d)), "sp", "gyro", FS, L)
    return rounded(P.bandwidth(tf, plateau=(0.5, 12.0)))


def q_step(spark, d):
    return rounded(P.step_response(axis_frames(flight_frames(spark, d)), FS, L, seconds=0.16).drop("response"))


def q_speed_step(spark, d):
    f = flight_frames(spark, d)
    return rounded(P.speed_step_response(axis_frames(f), f.select("log_id", "frame_idx", (F.lit(8.0) + F.col("frame_idx") * 0.2).alias("speed")), FS, 16))


def q_xcorr(spark, d):
    f = flight_frames(spark, d).select("log_id", "frame_idx", F.col("setpoint_0").alias("a"), F.col("gyroADC_0").alias("b"))
    return rounded(P.cross_correlation(f, 8))


def align(spark, d):
    f = flight_frames(spark, d)
    g = f.select("log_id", "frame_idx", magnitude(*(F.col(f"gyroADC_{a}") for a in range(3))).alias("b"))
    ref = g.where("log_id = 0").select("frame_idx", F.col("b").alias("a"))
    return f, P.align_logs(P.cross_correlation(g.join(ref, "frame_idx"), 12), hz=FS, exclude_sec=0.02)


def q_align(spark, d):
    from aerolith.operators.diagnostics import first_crossing

    f, aligned = align(spark, d)
    first = first_crossing(f, level=1400.0)
    chosen = P.align_policy(aligned, first, 0.25)
    return rounded(aligned.join(chosen.withColumnRenamed("offset_sec", "chosen_sec"), "log_id"))


def q_low_modes(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    order = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_partkey", "l_linenumber")) - 1
    rows = li.select(F.col("l_suppkey").alias("log_id"), (F.col("l_suppkey") % 3).cast("int").alias("axis"), order.alias("frame_idx"), F.col("l_quantity").alias("x"))
    return rounded(P.low_frequency_modes(rows, "x", 20.0))


def q_pt1(spark, d):
    f = flight_frames(spark, d)
    return rounded(T.low_pass(f, "v", 8.0, FS))


def q_filter_gains(spark, d):
    hz = spark.range(1, 46).select(F.col("id").cast("double").alias("hz"))
    dt = F.lit(1 / FS)
    lp, notch = biquad_columns(F.col("hz"), dt, F.lit(1 / math.sqrt(2)), "lowpass"), biquad_columns(F.col("hz"), dt, F.lit(3.0), "notch")
    names = ("b0", "b1", "b2", "a1", "a2")
    return rounded(hz.select("hz", *(one_pole_gain(F.col("hz"), dt, k).alias(f"pt{k}") for k in (1, 2, 3)), *(c.alias(f"lp_{n}") for n, c in zip(names, lp)), *(c.alias(f"notch_{n}") for n, c in zip(names, notch))), 9)


def q_chain(spark, d):
    """Fidelity of the simulated filter chain with the parameters of a header against the logged gyro."""
    from aerolith.operators.headers import filter_params

    p = filter_params(header_templates(spark)).where("log_id = 1").drop("log_id")
    a = axis_frames(flight_frames(spark, d)).withColumn("throttle", F.lit(0.5)).withColumn("erpm_0", F.lit(30.0) + F.col("frame_idx") % 7)
    a = a.withColumnsRenamed({"sp": "raw", "gyro": "ref"})
    ids = a.select("log_id").distinct().join(F.broadcast(p), F.lit(True))
    return rounded(S.model_fidelity(T.simulate_chain(a, ids, 1000.0), ("log_id", "axis"), warmup=5))


def q_input_chain(spark, d):
    f = flight_frames(spark, d)
    s = V.axis_aggregate(f, S.axis_correlations(f))
    a = axis_frames(f).join(s, ["log_id", "axis", "frame_idx"])
    rc = f.selectExpr("log_id", "frame_idx", "stack(3, 0, rcCommand_0, 1, rcCommand_1, 2, rcCommand_2) AS (axis, rc)")
    return rounded(V.chain_tones(V.input_chain(a.join(rc, ["log_id", "axis", "frame_idx"]), FS, win_sec=0.3, step_sec=0.15, most_ms=80.0)))


def q_hunt(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    order = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_partkey", "l_linenumber")) - 1
    rows = li.select(F.col("l_suppkey").alias("log_id"), F.lit(0).alias("servo"), order.alias("frame_idx"), (F.col("l_quantity") * 4.0 + 1400.0).alias("pwm"), (F.col("l_discount") * 100.0).alias("sp"))
    return rounded(V.servo_hunt(rows, 200.0))


def q_zigzag(spark, d):
    return rounded(V.pilot_style(flight_frames(spark, d), least_sec=0.3))


def q_roles(spark, d):
    f = flight_frames(spark, d)
    corr = S.axis_correlations(f)
    return V.roles_from_correlation(corr, f)


def airspeed_inputs(spark, d):
    f = flight_frames(spark, d)
    gps = f.where("frame_idx % 5 = 0").select("log_id", "time_sec", "gps_speed")
    return T.airspeed_inputs(f.drop("gps_speed"), gps)


def q_airspeed_inputs(spark, d):
    return rounded(airspeed_inputs(spark, d))


def q_airspeed_euler(spark, d):
    f = airspeed_inputs(spark, d)
    fixed = f.select("log_id").distinct().select("log_id", F.lit(1000.0).alias("delay_ms"), F.lit(50.0).alias("gravity_pct"))
    return rounded(T.whole_log_airspeed(f, fixed))


def q_fit_airspeed(spark, d):
    return rounded(T.fit_airspeed(airspeed_inputs(spark, d)), 4)


def tpa_points(spark, d):
    f = flight_frames(spark, d).select("log_id", "frame_idx", F.least(F.col("v") * 8.0, F.lit(1000.0)).alias("arg"))
    f = f.withColumn("factor", F.lit(2000.0) - F.col("arg"))
    return T.tpa_inputs(f, "arg", "factor")


def q_tpa_coverage(spark, d):
    return rounded(T.tpa_coverage(tpa_points(spark, d), 0.01))


def q_fit_hyperbolic(spark, d):
    p = tpa_points(spark, d)
    got = T.fit_hyperbolic(p)
    return rounded(got.join(T.trusted_fit(got, p, 30), "log_id").join(T.curve_cli(got).select("log_id", "stall_throttle"), "log_id"), 4)


QUERIES = {
    "welch_psd": q_welch, "psd_peaks": q_peaks, "stft": q_stft, "stft_speed_grid": q_stft_speed, "transfer_fn": q_transfer, "bandwidth": q_bandwidth, "step_response": q_step, "speed_step_response": q_speed_step,
    "cross_correlation": q_xcorr, "xcorr_align": q_align, "low_freq_modes": q_low_modes, "pt1_filter": q_pt1, "filter_gains": q_filter_gains, "chain_fidelity": q_chain, "input_chain": q_input_chain, "hunt_score": q_hunt,
    "zigzag_strokes": q_zigzag, "correlation_roles": q_roles, "airspeed_inputs": q_airspeed_inputs, "airspeed_euler": q_airspeed_euler, "fit_airspeed": q_fit_airspeed, "tpa_coverage": q_tpa_coverage, "fit_hyperbolic": q_fit_hyperbolic,
}

HANN = f"0.5 * (1 - cos(2 * pi() * j / {L - 1}))"
WSUM = sum((0.5 * (1 - math.cos(2 * math.pi * j / (L - 1)))) ** 2 for j in range(L))
SEG_SQL = f"""n_ AS (SELECT log_id, count(*) AS n FROM frames GROUP BY log_id),
seg AS (SELECT log_id, n, unnest(generate_series(0, (n - {L}) // {L // 2})) AS seg FROM n_ WHERE n >= {L}),
jj AS (SELECT unnest(generate_series(0, {L - 1})) AS j), bb AS (SELECT unnest(generate_series(0, {L // 2})) AS bin),
sx AS (SELECT a.log_id, a.axis, seg, j, sp, gyro FROM seg CROSS JOIN jj JOIN axes a ON a.log_id = seg.log_id AND a.frame_idx = seg * {L // 2} + j)"""
PSD_SQL = f"""{SEG_SQL},
ft AS (SELECT log_id, axis, seg, bin, sum(gyro * {HANN} * cos(2 * pi() * j * bin / {L})) AS re, sum(gyro * {HANN} * sin(2 * pi() * j * bin / {L})) AS im FROM sx CROSS JOIN bb GROUP BY 1, 2, 3, 4),
pw AS (SELECT *, (re * re + im * im) * CASE WHEN bin IN (0, {L // 2}) THEN 1 ELSE 2 END / ({FS} * {WSUM!r}) AS power FROM ft),
psd0 AS (SELECT log_id, axis, bin, bin * {FS} / {L} AS freq, avg(power) AS psd, count(*) AS n_segments FROM pw GROUP BY 1, 2, 3),
psd AS (SELECT * FROM psd0 UNION ALL SELECT log_id, axis, bin, bin * {FS} / {L}, 0.0, 0 FROM n_ CROSS JOIN bb CROSS JOIN (VALUES (0), (1), (2)) AS v(axis) WHERE n < {L})"""
TF_SQL = f"""{SEG_SQL},
mm AS (SELECT log_id, axis, seg, avg(sp) AS ms, avg(gyro) AS mg FROM sx GROUP BY 1, 2, 3),
ft AS (SELECT log_id, axis, seg, bin, sum((sp - ms) * {HANN} * cos(2 * pi() * j * bin / {L})) AS ar, -sum((sp - ms) * {HANN} * sin(2 * pi() * j * bin / {L})) AS ai,
  sum((gyro - mg) * {HANN} * cos(2 * pi() * j * bin / {L})) AS br, -sum((gyro - mg) * {HANN} * sin(2 * pi() * j * bin / {L})) AS bi FROM sx JOIN mm USING (log_id, axis, seg) CROSS JOIN bb GROUP BY 1, 2, 3, 4),
cs AS (SELECT log_id, axis, bin, sum(ar * ar + ai * ai) AS sxx, sum(br * br + bi * bi) AS syy, sum(ar * br + ai * bi) AS re, sum(ar * bi - ai * br) AS im, count(*) AS n FROM ft GROUP BY 1, 2, 3)"""

#: Inputs of the airspeed model, unrounded.
AIR_SQL = f"""{FRAMES_SQL}, g AS (SELECT log_id, time_sec AS t, gps_speed AS v FROM frames WHERE frame_idx % 5 = 0), e AS (SELECT log_id, min(t) AS g0, max(t) AS g1 FROM g GROUP BY log_id),
xa AS (SELECT f.* FROM frames f JOIN e ON e.log_id = f.log_id WHERE f.time_sec BETWEEN g0 AND g1), ia AS (SELECT log_id, floor(least(greatest(max(vbatLatest) * 100, 420), 8400) + 0.5) / 100.0 AS volts FROM xa GROUP BY log_id HAVING count(*) >= 10),
ac AS (SELECT xa.log_id, frame_idx, time_sec - lag(time_sec) OVER (PARTITION BY xa.log_id ORDER BY frame_idx) AS dt,
  4 * CAST(9.81 AS DOUBLE) * greatest(least(greatest(least((rcCommand_3 - 1000) / 1000.0, 1), 0) * vbatLatest / volts, 1), 0) - CAST(9.81 AS DOUBLE) * sin(radians(-attitude_1 / 10.0)) AS push,
  atanh(CAST(0.5 AS DOUBLE)) * atanh(CAST(0.5 AS DOUBLE)) / (4 * CAST(9.81 AS DOUBLE)) AS drag FROM xa JOIN ia ON ia.log_id = xa.log_id)"""

ORACLE_SQL = {
    "welch_psd": f"WITH {FRAMES_SQL}, {PSD_SQL} SELECT log_id, axis, bin, {r('freq', 'freq')}, {r('psd', 'psd')}, n_segments, {r('CASE WHEN psd <= 1e-12 THEN -120.0 ELSE 10 * log10(psd) END', 'db')} FROM psd",
    "psd_peaks": f"""WITH {FRAMES_SQL}, {PSD_SQL}, k AS (SELECT *, lag(psd) OVER w AS l, lead(psd) OVER w AS g, (sum(psd) FILTER (WHERE psd > 0) OVER (w ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) - CASE WHEN psd > 0 THEN psd ELSE 0 END) / nullif(count(*) FILTER (WHERE psd > 0) OVER (w ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) - CASE WHEN psd > 0 THEN 1 ELSE 0 END, 0) AS m
        FROM psd WINDOW w AS (PARTITION BY log_id, axis ORDER BY bin)) SELECT log_id, axis, bin, {r('freq', 'freq')}, {r('psd', 'psd')}, {r('10 * log10(psd / m)', 'ratio_db')} FROM k WHERE bin >= 3 AND bin <= {L // 2 - 3} AND psd > l AND psd > g AND freq BETWEEN 5 AND 45 AND m > 0 AND 10 * log10(psd / m) >= 2""",
    "stft": f"WITH {FRAMES_SQL}, {PSD_SQL} SELECT log_id, axis, seg AS col, {r(f'(seg * {L // 2} + {(L - 1) / 2}) / {FS}', 'centre_sec')}, bin, {r(f'bin * {FS} / {L}', 'freq')}, {r('power', 'power')} FROM pw",
    "stft_speed_grid": f"""WITH {FRAMES_SQL}, {PSD_SQL}, at0 AS (SELECT DISTINCT pw.log_id, axis, seg, least(CAST(floor(seg * {L // 2} + {(L - 1) / 2} + 0.5) AS BIGINT), n - 1) AS i FROM pw JOIN n_ USING (log_id)),
        at1 AS (SELECT at0.*, f.gps_speed AS s, min(f.gps_speed) OVER (PARTITION BY at0.log_id, axis) AS lo, max(f.gps_speed) OVER (PARTITION BY at0.log_id, axis) AS hi FROM at0 JOIN frames f ON f.log_id = at0.log_id AND f.frame_idx = i),
        at2 AS (SELECT *, least(CAST(floor((s - lo) / (CASE WHEN hi > lo THEN hi ELSE lo + 1 END - lo) * 4) AS BIGINT), 3) AS speed_bin FROM at1)
        SELECT pw.log_id, pw.axis, speed_bin, bin, {r('avg(power)', 'power')}, count(*) AS n FROM pw JOIN at2 ON at2.log_id = pw.log_id AND at2.axis = pw.axis AND at2.seg = pw.seg GROUP BY 1, 2, 3, 4""",
    "cross_correlation": f"""WITH {FRAMES_SQL}, x AS (SELECT log_id, frame_idx, setpoint_0 - avg(setpoint_0) OVER (PARTITION BY log_id) AS a, gyroADC_0 - avg(gyroADC_0) OVER (PARTITION BY log_id) AS b FROM frames),
        nn AS (SELECT log_id, sqrt(sum(a * a) * sum(b * b)) AS norm FROM x GROUP BY log_id), lg AS (SELECT unnest(generate_series(-8, 8)) AS lag)
        SELECT nn.log_id, lag, {r('coalesce(sum(x.a * y.b), 0) / min(norm)', 'r')} FROM nn CROSS JOIN lg JOIN x ON x.log_id = nn.log_id LEFT JOIN x y ON y.log_id = x.log_id AND y.frame_idx = x.frame_idx + lag GROUP BY 1, 2""",
    "pt1_filter": f"""WITH RECURSIVE {FRAMES_SQL}, k AS (SELECT 2 * pi() * 8.0 * 0.01 / (2 * pi() * 8.0 * 0.01 + 1) AS k), y(log_id, frame_idx, s) AS (
        SELECT log_id, frame_idx, k * v FROM frames, k WHERE frame_idx = 0 UNION ALL SELECT f.log_id, f.frame_idx, y.s + k * (f.v - y.s) FROM y JOIN frames f ON f.log_id = y.log_id AND f.frame_idx = y.frame_idx + 1, k)
        SELECT log_id, frame_idx, {r('s', 'filtered')} FROM y""",
    "filter_gains": "WITH t AS (SELECT CAST(i AS DOUBLE) AS hz, 2 * pi() * i * CAST(0.01 AS DOUBLE) AS w FROM (SELECT unnest(generate_series(1, 45)) AS i)) SELECT hz, "
    + ", ".join(r(f"{c} * w / ({c} * w + 1)", f"pt{k}", 9) for k, c in ((1, 1.0), (2, 1.553773974), (3, 1.961459177))) + ", "
    + ", ".join(r(f"({e}) / (1 + sin(w) / sqrt(2))", f"lp_{n}", 9) for n, e in (("b0", "(1 - cos(w)) / 2"), ("b1", "1 - cos(w)"), ("b2", "(1 - cos(w)) / 2"), ("a1", "-2 * cos(w)"), ("a2", "1 - sin(w) / sqrt(2)"))) + ", "
    + ", ".join(r(f"({e}) / (1 + sin(w) / 6)", f"notch_{n}", 9) for n, e in (("b0", "1"), ("b1", "-2 * cos(w)"), ("b2", "1"), ("a1", "-2 * cos(w)"), ("a2", "1 - sin(w) / 6"))) + " FROM t",
    "correlation_roles": f"""WITH {FRAMES_SQL}, {CORR_SQL}, k AS (SELECT c1.log_id, c1.servo, axis, CASE axis WHEN 0 THEN r0 END AS rr, count(*) FILTER (WHERE axis = 0) OVER (PARTITION BY log_id) AS n, count(*) FILTER (WHERE axis = 1) OVER (PARTITION BY log_id) AS np, row_number() OVER (PARTITION BY log_id, axis ORDER BY CASE axis WHEN 0 THEN r0 END, servo) AS i FROM c1),
        two AS (SELECT log_id, min(servo) AS s0, max(servo) AS s1 FROM k WHERE axis = 0 AND n = 2 GROUP BY log_id),
        pr AS (SELECT two.log_id, coalesce(corr(a.pwm, b.pwm), 0) AS pair_r FROM two JOIN l a ON a.log_id = two.log_id AND a.servo = s0 JOIN l b ON b.log_id = two.log_id AND b.servo = s1 AND b.frame_idx = a.frame_idx GROUP BY two.log_id)
        SELECT k.log_id, servo, CASE WHEN axis = 0 AND n = 2 THEN CASE WHEN np > 0 THEN 'aileron-' ELSE 'elevon-' END || CASE WHEN pair_r >= 0.5 THEN 'paired' WHEN i = 1 THEN 'l' ELSE 'r' END WHEN axis = 0 THEN 'other' WHEN axis = 1 THEN 'elevator' WHEN axis = 2 THEN 'rudder' ELSE 'unknown' END AS role FROM k LEFT JOIN pr ON pr.log_id = k.log_id""",
    "tpa_coverage": f"""WITH {FRAMES_SQL}, x AS (SELECT log_id, least(v * 8.0, 1000.0) / 1000.0 AS x FROM frames), y AS (SELECT *, min(x) OVER (PARTITION BY log_id) AS lo, max(x) OVER (PARTITION BY log_id) AS hi FROM x WHERE x >= 0.05)
        SELECT log_id, {r('min(x)', 'x_min')}, {r('max(x)', 'x_max')}, {r("count(*) FILTER (WHERE x <= lo + (hi - lo) / 3.0) * CAST(0.01 AS DOUBLE)", 'low_sec')}, {r("count(*) FILTER (WHERE x > lo + (hi - lo) / 3.0 AND x < lo + (hi - lo) * 2.0 / 3.0) * CAST(0.01 AS DOUBLE)", 'mid_sec')},
          {r("count(*) FILTER (WHERE x >= lo + (hi - lo) * 2.0 / 3.0) * CAST(0.01 AS DOUBLE)", 'high_sec')}, count(*) AS n FROM y GROUP BY log_id""",
    "transfer_fn": f"""WITH {FRAMES_SQL}, {TF_SQL}, k AS (SELECT *, CASE WHEN sxx > 0 THEN sqrt(re * re + im * im) / sxx ELSE 0 END AS h FROM cs)
        SELECT log_id, axis, bin, {r(f'bin * {FS} / {L}', 'freq', 5)}, {r('CASE WHEN h > 1e-6 THEN 20 * log10(h) ELSE -120.0 END', 'db', 5)}, {r('degrees(atan2(im, re))', 'phase_deg', 5)}, {r('CASE WHEN sxx > 0 AND syy > 0 THEN least((re * re + im * im) / (sxx * syy), 1) ELSE 0 END', 'coherence', 5)}, n AS n_segments FROM k
        UNION ALL SELECT log_id, axis, bin, {r(f'bin * {FS} / {L}', 'freq', 5)}, -120.0, 0.0, 0.0, 0 FROM n_ CROSS JOIN bb CROSS JOIN (VALUES (0), (1), (2)) AS v(axis) WHERE n < {L}""",
    "airspeed_inputs": f"""WITH {FRAMES_SQL}, g AS (SELECT log_id, time_sec AS t, gps_speed AS v FROM frames WHERE frame_idx % 5 = 0), e AS (SELECT log_id, min(t) AS g0, max(t) AS g1 FROM g GROUP BY log_id),
        x AS (SELECT f.*, (SELECT max(t) FROM g WHERE g.log_id = f.log_id AND g.t <= f.time_sec) AS tb, (SELECT min(t) FROM g WHERE g.log_id = f.log_id AND g.t >= f.time_sec) AS ta FROM frames f JOIN e ON e.log_id = f.log_id WHERE f.time_sec BETWEEN g0 AND g1),
        i AS (SELECT log_id, max(vbatLatest) AS peak FROM x GROUP BY log_id HAVING count(*) >= 10)
        SELECT x.log_id, frame_idx, {r('time_sec', 'time_sec')}, {r('greatest(least((rcCommand_3 - 1000) / 1000.0, 1), 0)', 'throttle')}, {r('vbatLatest', 'vbat')}, {r('radians(-attitude_1 / 10.0)', 'pitch')}, {r('CASE WHEN ta <= tb THEN b.v ELSE b.v + (a.v - b.v) * (x.time_sec - tb) / (ta - tb) END', 'gps_speed')},
          {r('floor(least(greatest(peak * 100, 420), 8400) + 0.5) / 100.0', 'full_volts')}, FALSE AS pitch_missing FROM x JOIN i ON i.log_id = x.log_id JOIN g a ON a.log_id = x.log_id AND a.t = ta JOIN g b ON b.log_id = x.log_id AND b.t = tb""",
    "airspeed_euler": f"""WITH RECURSIVE {AIR_SQL}, y(log_id, frame_idx, v) AS (SELECT log_id, frame_idx, CAST(0 AS DOUBLE) FROM ac WHERE frame_idx = 0
        UNION ALL SELECT ac.log_id, ac.frame_idx, greatest(y.v + (push - drag * y.v * y.v) * dt, 0) FROM y JOIN ac ON ac.log_id = y.log_id AND ac.frame_idx = y.frame_idx + 1)
        SELECT log_id, frame_idx, {r("v", "airspeed")} FROM y""",
    "xcorr_align": f"""WITH {FRAMES_SQL}, z AS (SELECT log_id, frame_idx, sqrt(gyroADC_0 * gyroADC_0 + gyroADC_1 * gyroADC_1 + gyroADC_2 * gyroADC_2) AS g FROM frames), p AS (SELECT z.log_id, z.frame_idx, r0.g AS a0, z.g AS b0 FROM z JOIN (SELECT * FROM z WHERE log_id = 0) r0 USING (frame_idx)),
        x AS (SELECT log_id, frame_idx, a0 - avg(a0) OVER (PARTITION BY log_id) AS a, b0 - avg(b0) OVER (PARTITION BY log_id) AS b FROM p), nn AS (SELECT log_id, sqrt(sum(a * a) * sum(b * b)) AS norm FROM x GROUP BY log_id), lg AS (SELECT unnest(generate_series(-12, 12)) AS lag),
        cc AS (SELECT nn.log_id, lag, coalesce(sum(x.a * y.b), 0) / min(norm) AS r FROM nn CROSS JOIN lg JOIN x ON x.log_id = nn.log_id LEFT JOIN x y ON y.log_id = x.log_id AND y.frame_idx = x.frame_idx + lag GROUP BY 1, 2),
        top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY r DESC, lag) AS k FROM cc) WHERE k = 1), far AS (SELECT cc.log_id, max(cc.r) AS rival FROM cc JOIN top ON top.log_id = cc.log_id AND abs(cc.lag - top.lag) > 2 GROUP BY 1),
        al AS (SELECT top.log_id, -top.lag / {FS} AS offset_sec, top.r AS ncc, CASE WHEN rival > 0 THEN top.r / rival END AS ratio FROM top LEFT JOIN far ON far.log_id = top.log_id),
        c0 AS (SELECT log_id, frame_idx, time_sec, rcCommand_3 AS c, lag(rcCommand_3) OVER w AS b FROM frames {WIN}), c1_ AS (SELECT log_id, CASE WHEN max(CASE WHEN frame_idx = 0 AND c >= 1400 THEN 1 ELSE 0 END) = 0 THEN min(CASE WHEN b < 1400 AND c >= 1400 THEN time_sec END) END AS t FROM c0 GROUP BY log_id)
        SELECT al.log_id, {r("offset_sec", "offset_sec")}, {r("ncc", "ncc")}, {r("ratio", "peak_ratio")}, {r("CASE WHEN ncc >= 0.4 AND coalesce(ratio, 1e308) >= 1.5 THEN offset_sec WHEN t IS NOT NULL THEN 0.25 - t ELSE offset_sec END", "chosen_sec")},
          CASE WHEN ncc >= 0.4 AND coalesce(ratio, 1e308) >= 1.5 THEN 'correlation' WHEN t IS NOT NULL THEN 'first-throttle' ELSE 'low-confidence' END AS method FROM al LEFT JOIN c1_ ON c1_.log_id = al.log_id""",
}
