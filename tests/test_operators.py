import numpy as np
from pyspark.sql import functions as F

from aerolith.flight import FlightSession
from aerolith.functions import kernels as K
from aerolith.functions.columns import half_up
from aerolith.operators import diagnostics as D
from aerolith.operators import fit as T
from aerolith.operators import headers as H
from aerolith.operators import maneuver as M
from aerolith.operators import recommend as R
from aerolith.operators import registry as G
from aerolith.operators import servo as V
from aerolith.operators import spectral as P
from aerolith.operators import stats as S
from aerolith.operators import timeaxis as X
from aerolith.operators.segments import frames_in, in_bin_regions
from aerolith.sources import logs as L
from tests.frames import axis_log, log, ramp

RNG = np.random.default_rng(2)


def test_flat_setpoint_has_no_manoeuvre(spark):
    assert M.detect_maneuvers(log(spark)).count() == 0
    assert M.detect_maneuvers(log(spark).where("false")).count() == 0
    assert M.detect_maneuvers(log(spark, n=1)).count() == 0


def test_roll_ramp_is_one_window(spark):
    got = M.detect_maneuvers(log(spark, setpoint_0=ramp())).collect()
    assert len(got) == 1 and got[0].kind == "roll" and got[0].start_idx < 1000 and got[0].end_idx > 1050 and got[0].peak > 1500


def test_two_axes_at_once_are_mixed_and_logs_do_not_leak(spark):
    two = log(spark, setpoint_0=ramp(), setpoint_1=ramp()).unionByName(log(spark, log_id=2, setpoint_1=ramp(at=3000)))
    got = {r.log_id: r for r in M.detect_maneuvers(two).collect()}
    assert got[1].kind == "mixed" and got[2].kind == "pitch" and got[2].start_idx > 2800


def test_injected_coupling_is_found(spark):
    bump = np.zeros(4000)
    bump[1000:1100] = 200 * np.sin(np.pi * np.arange(100) / 100)
    f = log(spark, setpoint_0=ramp(), gyroADC_0=bump, gyroADC_1=0.3 * bump)
    m = {(r.cmd_axis, r.resp_axis): r.ratio for r in M.axis_coupling(f, M.detect_maneuvers(f)).collect()}
    assert abs(m[0, 1] - 0.3) < 0.01 and m[0, 0] == 1.0 and abs(m[0, 2]) < 1e-9
    worst = M.worst_coupling(M.axis_coupling(f, M.detect_maneuvers(f))).first()
    assert worst.resp_axis == 1


def test_feedforward_verdicts(spark):
    sp = ramp()
    f = log(spark, setpoint_0=sp)
    w = M.detect_maneuvers(f)
    for ff, p, over, verdict in ((10, 1, 0, "healthy"), (1, 10, 0, "undergained"), (10, 1, 90, "overgained")):
        gyro = sp.copy()
        gyro[1030:1100] += over
        a = axis_log(spark, sp=sp, gyro=gyro, f=np.full(4000, ff), p=np.full(4000, p))
        assert M.feedforward(M.feedforward_windows(a, w)).first().verdict == verdict


def test_gate_events(spark):
    spa, i = np.ones(1000), np.zeros(1000)
    spa[100:500] = 0
    i[100:500] = np.linspace(0, 10, 400)
    i[500:] = 10
    got = D.gate_events(axis_log(spark, fs=100.0, spa=spa, i=i)).collect()
    wind = [r for r in got if r.kind == "wind_up"]
    assert len(wind) == 1 and abs(wind[0].time_sec - 1.0) < 0.02 and wind[0].severity > 0.5
    spa[:] = 1
    spa[200:210] = 0
    assert D.gate_events(axis_log(spark, fs=100.0, spa=spa, i=i)).count() == 0


def test_trim(spark):
    f = log(spark, fs=100.0, n=3000)
    for i, severity in ((np.full(3000, 50.0), "trim-error"), (50 * np.sin(np.arange(3000) / 5), "balanced")):
        got = D.trim_bias(f, axis_log(spark, fs=100.0, i=i)).first()
        assert got.severity == severity
    banked = log(spark, fs=100.0, n=3000, attitude_0=np.full(3000, 300.0))
    assert D.trim_bias(banked, axis_log(spark, fs=100.0, i=np.full(3000, 50.0))).first().severity == "unknown"


def test_saturation(spark):
    f = log(spark, n=12, servo_0=[1000] * 4 + [1500] * 4 + [2000] * 4)
    got = D.saturation_runs(V.pwm_long(f, (0,)), fs=500.0).orderBy("start_idx").collect()
    assert [(r.kind, r.start_idx, r.end_idx, r.duration_ms) for r in got] == [("low", 0, 4, 8.0), ("high", 8, 12, 8.0)]


def test_first_crossing_needs_a_rise(spark):
    f = log(spark, n=10).withColumn("rcCommand_3", F.when(F.col("frame_idx") < 5, 1000.0).otherwise(1500.0))
    assert D.first_crossing(f).first().first_sec == 0.005
    assert not D.first_crossing(f.withColumn("rcCommand_3", F.lit(1500.0))).first().detected


def test_resampling(spark):
    src = spark.createDataFrame([(1, 0.0, 10.0), (1, 1.0, 20.0)], "log_id long, time_sec double, v double")
    dst = spark.createDataFrame([(1, 0, -1.0), (1, 1, 0.5), (1, 2, 9.0), (2, 0, 1.0)], "log_id long, frame_idx long, time_sec double")
    got = {(r.log_id, r.frame_idx): r.v for r in X.interpolate(src, dst, "v").collect()}
    assert got == {(1, 0): 10.0, (1, 1): 15.0, (1, 2): 20.0, (2, 0): 0.0}
    rate = X.sample_rates(log(spark, fs=250.0, n=100)).first()
    assert abs(rate.midpoint_hz - 250) < 1e-6 and abs(rate.mean_hz - 250) < 1e-6
    assert X.sample_rates(log(spark, n=1)).first().mean_hz == 1000.0
    assert spark.range(1).select(half_up(F.lit(-2.5)).alias("x")).first().x == -2


def test_attenuation_of_a_silent_term(spark):
    f = log(spark, n=10).withColumns({"a": F.lit(0.0), "b": F.lit(5.0)})
    got = D.attenuation(f, "a", post="b").first()
    assert got.active_n == 0 and got.attenuation == 0 and got.mean_factor == 1


def test_shares_sum_to_one_and_ties_go_to_the_first(spark):
    got = S.term_shares(axis_log(spark, p=[1, -1], i=[1, 1], d=[0, 0])).first()
    assert got.p_share == got.i_share == 0.5 and got.dominant == "P"
    assert S.term_shares(axis_log(spark, p=[0, 0])).first().dominant is None


def test_correlation_of_a_constant_is_zero(spark):
    got = S.axis_correlations(log(spark, n=50, servo_0=np.arange(50), setpoint_1=np.arange(50))).orderBy("servo").collect()
    assert got[0].dominant_axis == 1 and got[0].r0 == 0 and got[1].dominant_axis is None


def test_registry(spark):
    caps = [("log", ["wingSpa[0]", "debug[0]", "debug[1]"], "SPA", True, 100, "4.5.0", {"wingSpa[0]": (True, 0.0, 0.0), "debug[0]": (False, 0.0, 900.0), "debug[1]": (True, 0.0, 0.0)})]
    got = {(r.signal, r.axis): r for r in G.resolve_signals(spark.createDataFrame(caps, G.SCHEMA), G.signal_sources(spark)).collect()}
    assert got["spa", 0].state == "resolved" and got["spa", 0].kind == "debug"
    assert got["spa", 1].state == "inactive" and got["spa", 2].state == "missing" and len(got) == 24
    v = spark.createDataFrame([("Betafork / X 4.5.1 (abc)",), ("4.10",), ("none",), (None,)], "s string").select(G.version(F.col("s")).alias("v")).collect()
    assert [tuple(r.v) if r.v else None for r in v] == [(4, 5, 1), (4, 10, 0), None, None]


def test_headers(spark):
    h = {"gyro_lpf1_type": "PT1", "gyro_lpf1_static_hz": "100", "smix0": "3,0,100,0,0,100,0", "smix1": "2,0,-100,0,0,100,0", "smix2": "x", "servoParam0": "100,1000,2000,1500,0", "gyro_lpf2_type": "OFF"}
    logs = spark.createDataFrame([(1, h)], "log_id long, header_params map<string,string>")
    delay = {r.stage: r.delay_ms for r in H.delay_budget(H.filter_config(logs)).collect()}
    assert abs(delay["gyro_lpf1"] - 1.592) < 1e-3 and delay["total"] == delay["gyro_lpf1"]
    roles = {r.servo: r.role for r in V.roles_from_mixer(spark.createDataFrame([(1, s) for s in (2, 3, 4)], "log_id long, servo int"), H.smix_rules(logs)).collect()}
    assert roles == {2: "aileron-l", 3: "aileron-r", 4: "unknown"}
    assert H.servo_params(logs).count() == 1 and H.search_params(logs, "LPF1").count() == 2


def test_hunting_and_input_chain(spark):
    t = np.arange(4000) / 1000
    move = 100 * np.sin(2 * np.pi * t)
    pwm = lambda x, sp: spark.createDataFrame([(1, 0, i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, sp))], "log_id long, servo int, frame_idx long, pwm double, sp double")
    assert V.servo_hunt(pwm(1500 + move + 30 * np.sin(2 * np.pi * 45 * t), move), 1000.0).first().severity == "hunt"
    assert V.servo_hunt(pwm(1500 + move, move), 1000.0).first().severity == "ok"
    t = np.arange(6000) / 1000
    rc = 200 * np.sin(2 * np.pi * 0.8 * t) + RNG.normal(size=6000)
    rows = [(1, 0, i, *map(float, v)) for i, v in enumerate(zip(rc, np.roll(rc, 5), np.roll(rc, 25), np.roll(rc, 55)))]
    got = V.input_chain(spark.createDataFrame(rows, "log_id long, axis int, frame_idx long, rc double, sp double, servo_sum double, gyro double"), 1000.0).first()
    assert 3 <= got.a_ms <= 7 and 18 <= got.b_ms <= 22 and got.c_ms >= 28 and abs(got.total_ms - got.a_ms - got.b_ms - got.c_ms) < 1e-9


def test_alignment_and_low_modes(spark):
    bump = lambda at: np.exp(-(((np.arange(1000) - at) / 10) ** 2))
    rows = [(1, i, float(a), float(b)) for i, (a, b) in enumerate(zip(bump(200), bump(300)))]
    x = P.cross_correlation(spark.createDataFrame(rows, "log_id long, frame_idx long, a double, b double"), 400)
    got = P.align_logs(x, hz=100.0).first()
    assert got.offset_sec == -1.0 and got.ncc > 0.9 and (got.peak_ratio is None or got.peak_ratio > 2)
    t = np.arange(24000) / 200
    wave = np.sin(2 * np.pi * 0.5 * t) + 0.05 * RNG.normal(size=24000)
    modes = P.low_frequency_modes(axis_log(spark, axis=1, gyro=wave), "gyro", 200.0).collect()
    assert any(0.45 < m.freq < 0.55 and m["mode"] == "short-period" for m in modes)


def test_speed_bins(spark):
    speed = log(spark, n=60).select("log_id", "frame_idx", (F.floor(F.col("frame_idx") / 20) * 5.0).alias("speed"))
    got = in_bin_regions(speed, "speed", 5.0, 10.0, 10).collect()
    assert [(r.start_idx, r.end_idx) for r in got] == [(20, 40)]


def test_pilot_style(spark):
    square = np.where(np.arange(4000) // 500 % 2 == 0, 150.0, -150.0)
    got = V.pilot_style(log(spark, rcCommand_0=square)).first()
    assert got.profile == "sport" and got.character in ("active", "busy") and got.stroke_p90_0 == 150.0
    assert V.pilot_style(log(spark)).first().profile is None


def test_rules(spark):
    shares = spark.createDataFrame([(1, 0, 0.5, 0.45, 0.02, 0.01, 0.01)], "log_id long, axis int, p_share double, i_share double, d_share double, f_share double, s_share double")
    got = {r.rec_id: r for r in R.gather(R.share_rules(shares)).collect()}
    assert set(got) == {"pidfs-high-p-low-d-r", "pidfs-i-dominance-r", "pidfs-s-barely-r"} and got["pidfs-i-dominance-r"].severity == "low"
    fit = spark.createDataFrame([(1, 1000.0, 50.0, 0.9, 1.0, 10, True), (2, 1000.0, 50.0, 0.3, 1.0, 10, False)], "log_id long, delay_ms double, gravity_pct double, r2 double, rms double, iterations long, converged boolean")
    cover = spark.createDataFrame([(i, 0.0, 20.0, 5.0, 0.1) for i in (1, 2)], "log_id long, speed_min double, speed_max double, jumps_per_min double, sag double")
    window = spark.createDataFrame([(i, 30.0, False) for i in (1, 2)], "log_id long, window_sec double, pitch_missing boolean")
    rec = {r.log_id: r for r in R.airspeed_rule(fit, cover, window).collect()}
    assert rec[1].confidence == "green" and len(rec[1].cli) == 3 and rec[2].confidence == "red" and rec[2].cli == []
    prof = R.with_profile(spark.createDataFrame([("3d",), ("huh",), (None,)], "p string"), F.col("p")).select("delay_limit").collect()
    assert sorted(r[0] for r in prof) == [6.0, 8.0, 8.0]


def test_session_and_sources(spark, tmp_path):
    f = log(spark, n=64).unionByName(log(spark, n=100, log_id=2))
    s = FlightSession(f)
    s.offset(2, 0.5)
    assert s.reference().agg(F.min("time_sec")).first()[0] == 0.5 and s.reference().count() == 100
    s.hide(2)
    assert s.frames.select("log_id").distinct().count() == 1
    s.remove(1)
    s.remove(1)
    assert s.frames.count() == 0
    L.write_frames(f, f"{tmp_path}/frames")
    back = L.read_frames(spark, f"{tmp_path}/frames")
    assert back.count() == 164
    checks = {r.log_id: r.checks["servo_0"] for r in L.sample_checks(f, ["servo_0"]).collect()}
    assert checks[1].all_zero and checks[1].value_min == 0.0
    assert L.sample_checks(log(spark, n=10, servo_0=[5] * 10), ["servo_0"]).first().checks["servo_0"].all_zero
    assert L.hydrate(f, ["servo_1", "nope"]).columns == ["log_id", "frame_idx", "time_sec", "servo_1", "nope"]


def test_airspeed_inputs_need_samples(spark):
    f = log(spark, n=20).withColumns({"rcCommand_3": F.lit(1500.0), "vbatLatest": F.lit(16.0), "attitude_1": F.lit(None).cast("double")})
    gps = f.select("log_id", "time_sec", F.lit(10.0).alias("gps_speed"))
    got = T.airspeed_inputs(f, gps).first()
    assert got.pitch == 0 and got.pitch_missing and got.full_volts == 16.0 and got.throttle == 0.5
    assert T.airspeed_inputs(f.where("frame_idx < 5"), gps).count() == 0


def test_long_logs_stay_linear(spark):
    """A log of 200,000 frames: running values, buckets and sums, no pair of all frames."""
    import time

    n = 200_000
    f = spark.range(n).select(F.lit(1).cast("long").alias("log_id"), F.col("id").alias("frame_idx"), (F.col("id") * 0.001).alias("time_sec"), F.sin(F.col("id") * 0.01).alias("v"))
    began = time.time()
    src = f.where("frame_idx % 10 = 0").select("log_id", "time_sec", "v")
    off = X.interpolate(src, f, "v").join(f.select("frame_idx", F.col("v").alias("w")), "frame_idx").where("frame_idx < 199990").agg(F.max(F.abs(F.col("v") - F.col("w")))).first()[0]
    assert off < 0.01
    cursors = spark.range(2000).select(F.lit(1).cast("long").alias("log_id"), (F.col("id") * 0.0999 + 0.0002).alias("at_sec"))
    assert X.nearest_index(f, cursors).where("abs(frame_idx * 0.001 - at_sec) > 0.00051").count() == 0
    windows = spark.range(2000).select(F.lit(1).cast("long").alias("log_id"), (F.col("id") * 100).alias("start_idx"), (F.col("id") * 100 + 150).alias("end_idx"))
    plan = frames_in(f, windows)
    assert plan.count() == 2000 * 150 - 50
    pairs = f.select("log_id", "frame_idx", F.col("v").alias("a"), F.lag("v", 3).over(X.ordered()).alias("b")).fillna(0.0)
    best = P.cross_correlation(pairs, 50).orderBy(F.desc("r")).first()
    assert best.lag == 3
    assert time.time() - began < 120


def test_filter_chain_parts_against_plain_loops():
    rng = np.random.default_rng(3)
    p = {"rpm_harmonics": 2, "rpm_weights": [1.0, 0.5], "motor_poles": 14, "rpm_lpf_hz": 150, "rpm_min_hz": 100, "rpm_fade_hz": 50, "rpm_q": 5, "notch_count": 2, "notch_min_hz": 80, "notch_max_hz": 300, "notch_q": 3,
         "lpf1_type": "PT2", "lpf1_static_hz": 120, "lpf1_dyn_min_hz": 75, "lpf1_dyn_max_hz": 200, "lpf1_dyn_expo": 5}
    erpm = [500 + 100 * rng.random(400), 700 + 50 * rng.random(400)]
    centre, weight = K.harmonics(np.stack(erpm), p, 1000.0)
    for m, e in enumerate(erpm):
        hz = K.poles(e * 100 / 60 / 7, 150, 0.001)
        for h in (1, 2):
            f = np.clip(h * hz, 100, 480)
            assert np.allclose(centre[2 * m + h - 1], f) and np.allclose(weight[2 * m + h - 1], np.clip((f - 100) / 50, 0, 1) * (1.0, 0.5)[h - 1])
    assert K.rpm_notches(np.ones(400), [None, erpm[0][:100]], p, 1000.0).tolist() == [1.0] * 400
    assert K.lowpass_cutoff(p, None) == 120 and K.lowpass_cutoff(p | {"lpf1_dyn_min_hz": 0}, 0.3) == 120
    assert np.allclose(K.lowpass_cutoff(p, [0.0, 0.5, 1.0]), [75, 75 + 125 * (0.5 + 0.125), 200])
    assert np.allclose(K.lowpass_cutoff(p | {"lpf1_dyn_expo": 0}, [0.0, 1.0]), [75, 200])
    t = np.arange(2000) / 1000.0
    x = np.sin(2 * np.pi * 150 * t) + 0.5 * np.sin(2 * np.pi * 250 * t)
    tracks = K.notch_tracks(x, p, 1000.0)
    assert tracks.shape == (2, 2000) and np.abs(tracks[0] - 150).max() < 4 and np.abs(tracks[1] - 250).max() < 4
    assert (K.notch_tracks(x[:100], p, 1000.0) == 300).all() and K.notch_tracks(x, p | {"notch_count": 0}, 1000.0).shape == (0, 2000)
