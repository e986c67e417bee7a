"""Queries on sources, sessions, servo roles and the remaining tuning rules, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerolith.flight import FlightSession
from aerolith.operators import headers as H
from aerolith.operators import recommend as R
from aerolith.operators import registry as G
from aerolith.operators import servo as V
from aerolith.operators import spectral as P
from aerolith.operators import stats as S
from aerolith.operators import timeaxis as T
from aerolith.plans import basics, dynamics, series_sql, spectra
from aerolith.plans.basics import WIN, r, rounded
from aerolith.sources import logs as L
from aerolith.sources.virtual_logs import FRAMES_SQL, axis_frames, flight_frames

NAMES = {"error": "disarm", "click": "flight_mode", "view": "sync"}


def q_event_track(spark, d):
    """Events of the virtual logs, timed by frames of which every seventh is missing."""
    f = flight_frames(spark, d)
    name = F.coalesce(*(F.when(F.col("event_type") == k, F.lit(v)) for k, v in NAMES.items()), F.lit("end"))
    whole = F.floor("v").cast("long")
    raw = f.select("log_id", F.col("frame_idx").alias("seq"), F.col("frame_idx").alias("after_frame"), name.alias("name"), F.when(whole % 5 > 0, whole.cast("string")).alias("code"), whole.alias("flags"))
    return rounded(L.map_events(raw, f.where("frame_idx % 7 <> 3")))


GPS_FIELDS = ["gps:GPS_speed", "gps:GPS_coord[0]", "gps:GPS_altitude", "gps:GPS_ground_course", "gps:none"]


def q_gps_track(spark, d):
    f = flight_frames(spark, d).withColumn("time_us", F.col("frame_idx") * 10000 + 1000)
    whole = lambda x: F.floor(x).cast("long")
    gps = f.where("frame_idx % 5 = 0").select(
        "log_id", (F.col("frame_idx") / 5).cast("long").alias("frame_idx"), (F.col("time_us") - 3500).alias("time_us"), whole(F.col("v") * 10).alias("GPS_speed"), whole(F.col("v") * 1e5).alias("GPS_coord[0]"),
        whole(F.col("v") * 3).alias("GPS_altitude"), whole(F.col("v") * 7).alias("GPS_ground_course"),
    )
    got = L.hydrate_gps(gps, f, GPS_FIELDS)
    return rounded(got.select("log_id", "frame_idx", "time_sec", *(F.col(f"`{g}`").cast("double").alias(n) for g, n in zip(GPS_FIELDS, ("speed", "coord", "altitude", "course", "absent")))), 4)


def q_raw_units(spark, d):
    f = flight_frames(spark, d)
    raw = f.select("log_id", "frame_idx", "time_sec", F.floor(F.col("vbatLatest") * 100).cast("long").alias("vbatLatest"), F.floor("v").cast("long").alias("amperageLatest"), F.floor(F.col("v") * 3).cast("long").alias("motor[0]"))
    got = L.hydrate(L.in_si(raw, ["vbatLatest", "amperageLatest", "motor[0]"]), ["vbatLatest", "amperageLatest", "motor[0]", "lost"])
    turn, acc = L.rotation(F.col("`motor[0]`"), F.lit(2.0e-8)), L.acceleration(F.col("`motor[0]`"), F.lit(2048.0))
    return rounded(got.select("log_id", "frame_idx", *(c.cast("double").alias(n) for c, n in ((F.col("vbatLatest"), "volts"), (F.col("amperageLatest"), "amperes"), (turn, "deg_s"), (acc, "m_s2"), (F.col("lost"), "lost")))), 2)


def q_strict(spark, d):
    f = flight_frames(spark, d)
    x = F.when(F.col("event_type") != "error", F.col("v"))
    return rounded(f.select("log_id", "frame_idx", T.strict_boxcar(x, 5, T.ordered()).alias("w5")))


def session(spark, d) -> FlightSession:
    f = flight_frames(spark, d)
    return FlightSession(f, f.select("log_id").distinct().select("log_id", (F.col("log_id") * 0.004).alias("offset_sec")))


def q_session(spark, d):
    """One signal of all visible logs on the session's reference axis."""
    s = session(spark, d)
    s.hide(0)
    s.remove(1)
    s.offset(2, 0.25)
    return rounded(s.on_reference("v").select("log_id", "ref_idx", "v"))


def q_servo_roles(spark, d):
    """Roles by mixer for every third log, by correlation for the others."""
    f = flight_frames(spark, d)
    third = f.where("log_id % 3 = 0").select("log_id").distinct()
    rules = third.select("log_id", F.explode(F.array(*(F.struct(F.lit(t).alias("target"), F.lit(i).alias("input"), F.lit(x).alias("rate")) for t, i, x in ((0, 0, 100), (1, 0, -100), (2, 1, 100))))).alias("x")).select("log_id", "x.*")
    servos = third.select("log_id", F.explode(F.array(*map(F.lit, range(4)))).alias("servo"))
    got = V.classify_servos(V.roles_from_mixer(servos, rules), V.roles_from_correlation(S.axis_correlations(f), f))
    return rounded(got.select("log_id", F.col("servo").cast("long"), "role", "via"))


def q_severity_counts(spark, d):
    return R.severity_counts(dynamics.recommended(spark, d))


def shown(recs, *more):
    return recs.select("log_id", "rec_id", "severity", "confidence", F.array_join("cli", "; ").alias("cli"), F.array_join("failed", ",").alias("failed"), *more)


def q_debug_hints(spark, d):
    caps = dynamics.caps(spark)
    return shown(R.debug_mode(G.module_report(caps, G.signal_sources(spark)), caps))


def header_logs(spark, d):
    """A header for each virtual log, with a notch range and a low-pass that differ from log to log."""
    ids = flight_frames(spark, d).select("log_id").distinct()
    text = lambda c: c.cast("string")
    pairs = {
        "dyn_notch_count": F.lit("2"), "dyn_notch_min_hz": text(8 + F.col("log_id") % 3 * 10), "dyn_notch_max_hz": text(20 + F.col("log_id") % 4 * 8), "dyn_notch_q": F.lit("300"),
        "gyro_lpf1_type": F.lit("PT2"), "gyro_lpf1_static_hz": text(40 + F.col("log_id") % 7 * 40),
    }
    return ids.select("log_id", F.create_map(*(x for k, v in pairs.items() for x in (F.lit(k), v))).alias("header_params"))


def q_filter_rules(spark, d):
    f = flight_frames(spark, d)
    config = H.filter_config(header_logs(spark, d))
    peaks = P.spectrum_peaks(P.welch_psd(axis_frames(f), "gyro", spectra.FS, spectra.L), 5.0, 45.0, 3, 2.0)
    style = f.select("log_id").distinct().select("log_id", F.when(F.col("log_id") % 3 == 0, "cruise").when(F.col("log_id") % 3 == 1, "3d").alias("profile"))
    return shown(R.gather(R.notch_rule(peaks, config), R.delay_rule(H.delay_budget(config), style)))


def q_airspeed_rules(spark, d):
    """The airspeed rule on given fits and the logs' own coverage."""
    f = flight_frames(spark, d)
    rows = f.select("log_id", "frame_idx", "time_sec", F.col("gps_speed").alias("speed"), ((F.col("rcCommand_3") - 1000.0) / 1000.0).alias("throttle"), F.radians(-F.col("attitude_1") / 10.0).alias("pitch"), F.col("vbatLatest").alias("vbat"))
    n = F.col("log_id")
    ids = f.select("log_id").distinct()
    fits = ids.select("log_id", (1000.0 + n * 7.3).alias("delay_ms"), (20.0 + n % 9 * 5.5).alias("gravity_pct"), (0.5 + n % 10 * 0.05).alias("r2"), (n % 7 != 0).alias("converged"))
    window = ids.select("log_id", (n % 13 * 3.0).alias("window_sec"), (n % 5 == 0).alias("pitch_missing"))
    return shown(R.airspeed_rule(fits, S.speed_coverage(rows), window))


def q_curve_rules(spark, d):
    """The gain-curve rule on given fits and the logs' own points, each standing for 0.25 s."""
    n = F.col("log_id")
    fits = flight_frames(spark, d).select("log_id").distinct().select("log_id", (2.0 + n % 5 * 0.31).alias("thr0"), (0.4 + n % 3 * 0.07).alias("thr100"), (n % 4 * 0.11).alias("stall"), (n % 23 - 11.0).alias("expo"), (n % 9 * 0.03).alias("rms"), (n % 8 != 3).alias("converged"))
    cover = points_covered(spark, d)
    return shown(R.curve_rule(fits, cover))


def points_covered(spark, d):
    from aerolith.operators.fit import tpa_coverage

    return tpa_coverage(spectra.tpa_points(spark, d), 0.25).withColumn("n", F.col("n") * 4)


def q_chain_rules(spark, d):
    f = flight_frames(spark, d)
    a = axis_frames(f).join(V.axis_aggregate(f, S.axis_correlations(f)), ["log_id", "axis", "frame_idx"])
    rc = f.selectExpr("log_id", "frame_idx", "stack(3, 0, rcCommand_0, 1, rcCommand_1, 2, rcCommand_2) AS (axis, rc)")
    chain = V.input_chain(a.join(rc, ["log_id", "axis", "frame_idx"]), spectra.FS, win_sec=0.3, step_sec=0.15, most_ms=80.0)
    return shown(R.chain_rule(chain, 20.0, 60.0, 0.4, 0.36))


#: Fields of the virtual logs by the names the registry knows.
KNOWN_FIELDS = {f"axis{t}[{a}]": f"axis{t}_{a}" for t in "PIDFS" for a in range(3)} | {f"wingSpa[{a}]": f"wingSpa_{a}" for a in range(3)} | {"gps:GPS_speed": "gps_speed"}
MORE_FIELDS = {"wingTpaArg": "v * 8.0", "wingTpaFactor": "2000.0 - v", "debug[4]": "v * 10.0", "debug[1]": "v - 50.0", "wingSTermRaw[1]": "v * 0.0"}


def log_caps(spark, d):
    """Capabilities scanned from the virtual logs; what a log has, its debug mode and firmware follow from its number."""
    f = flight_frames(spark, d)
    frames = f.select("log_id", "frame_idx", *(F.col(c).alias(k) for k, c in KNOWN_FIELDS.items()), *(F.expr(e).alias(k) for k, e in MORE_FIELDS.items()))
    n = F.col("log_id")
    has = {"wingTpaArg": n % 2 == 0, "wingTpaFactor": n % 4 < 3, "axisS[2]": n % 7 > 0, "gps:GPS_speed": n % 5 > 0}
    names = [*KNOWN_FIELDS, *MORE_FIELDS]
    fields = F.filter(F.array(*(F.when(has.get(k, F.lit(True)), F.lit(k)) for k in names)), lambda x: x.isNotNull())
    logs = f.select("log_id").distinct().select("log_id", fields.alias("fields"), F.when(n % 3 == 0, "TPA").when(n % 3 == 1, "SPA").alias("debug_mode"), (n % 5 > 0).alias("gps_present"), F.lit("4.5.1").alias("firmware"))
    return L.capabilities(frames, logs, names, 8)


def q_log_signals(spark, d):
    return G.resolve_signals(log_caps(spark, d), G.signal_sources(spark)).select("log_id", "signal", F.col("axis").cast("long"), "state", "kind", "field")


def q_log_modules(spark, d):
    return G.module_report(log_caps(spark, d), G.signal_sources(spark)).select("log_id", "module", F.col("axis").cast("long"), "state")


QUERIES = {
    "log_signals": q_log_signals, "log_modules": q_log_modules,
    "event_track": q_event_track, "gps_track": q_gps_track, "raw_units": q_raw_units, "strict_boxcar": q_strict, "session_reference": q_session, "servo_roles": q_servo_roles, "severity_counts": q_severity_counts,
    "debug_hints": q_debug_hints, "filter_rules": q_filter_rules, "airspeed_rules": q_airspeed_rules, "curve_rules": q_curve_rules, "chain_rules": q_chain_rules,
}


def _failed(cases: dict[str, str]) -> str:
    """Names of the conditions that do not hold, in order."""
    return "[x FOR x IN [" + ", ".join(f"CASE WHEN NOT coalesce({c}, FALSE) THEN '{n}' END" for n, c in cases.items()) + "] IF x IS NOT NULL]"


_fields = KNOWN_FIELDS | MORE_FIELDS
CAPS_SQL = (
    f"{FRAMES_SQL}, c AS (SELECT log_id, CASE log_id % 3 WHEN 0 THEN 'TPA' WHEN 1 THEN 'SPA' END AS mode, log_id % 5 > 0 AS gps, count(*) AS n, '4.5.1' AS fw FROM frames GROUP BY log_id), "
    + "ck AS (" + " UNION ALL ".join(f"SELECT log_id, '{k}' AS field, max(CASE WHEN {e} <> 0 THEN 1 ELSE 0 END) = 0 AS zero, min({e}) AS lo, max({e}) AS hi FROM frames WHERE (frame_idx + 1) % 8 = 0 GROUP BY log_id" for k, e in _fields.items()) + "), "
    + "fl AS (SELECT log_id, field FROM c, (SELECT unnest([" + ", ".join(f"'{k}'" for k in _fields) + "]) AS field) WHERE CASE field WHEN 'wingTpaArg' THEN log_id % 2 = 0 WHEN 'wingTpaFactor' THEN log_id % 4 < 3 WHEN 'axisS[2]' THEN log_id % 7 > 0 WHEN 'gps:GPS_speed' THEN log_id % 5 > 0 ELSE TRUE END), "
    + dynamics.CAPS_SQL[dynamics.CAPS_SQL.index("src(") :]
)
_grade = lambda soft: f"CASE WHEN len(failed) = 0 THEN 'green' WHEN len(failed) <= 2 AND {soft} THEN 'yellow' ELSE 'red' END"
_whole = lambda x: f"CAST(CAST(floor({x} + 0.5) AS BIGINT) AS VARCHAR)"
_none = "'' AS cli, '' AS failed"
_sp = dynamics._sp

ORACLE_SQL = {
    "log_signals": f"WITH {CAPS_SQL} SELECT * FROM rs",
    "log_modules": f"WITH {CAPS_SQL}{dynamics.MODULES_SQL[len(dynamics.CAPS_SQL) :]}",
    "event_track": f"""WITH {FRAMES_SQL}, x AS (SELECT log_id, frame_idx AS seq, CASE event_type WHEN 'error' THEN 'disarm' WHEN 'click' THEN 'flight_mode' WHEN 'view' THEN 'sync' ELSE 'end' END AS name, CAST(floor(v) AS BIGINT) AS w,
        coalesce((SELECT max(g.time_sec) FROM frames g WHERE g.log_id = f.log_id AND g.frame_idx <= f.frame_idx AND g.frame_idx % 7 <> 3), 0) AS t FROM frames f)
        SELECT log_id, seq, CASE name WHEN 'flight_mode' THEN 'flight_mode_change' WHEN 'sync' THEN 'other' ELSE 'disarming' END AS kind, {r('t', 'time_sec')}, CASE WHEN name IN ('disarm', 'end') AND w % 5 > 0 THEN CASE name WHEN 'disarm' THEN 'code:' ELSE 'end:' END || w END AS reason,
          CASE WHEN name = 'flight_mode' THEN w END AS flags, CASE WHEN name = 'sync' THEN name END AS name FROM x""",
    "gps_track": f"""WITH {FRAMES_SQL} SELECT log_id, frame_idx // 5 AS frame_idx, {r('greatest(frame_idx * 10000 + 1000 - 3500 - 1000, 0) / 1e6', 'time_sec', 4)}, {r('floor(v * 10) * 0.01', 'speed', 4)}, {r('floor(v * 1e5) * 1e-7', 'coord', 4)},
        {r('floor(v * 3) * 0.1', 'altitude', 4)}, {r('floor(v * 7) * 0.1', 'course', 4)}, CAST(NULL AS DOUBLE) AS absent FROM frames WHERE frame_idx % 5 = 0""",
    "raw_units": f"WITH {FRAMES_SQL} SELECT log_id, frame_idx, {r('floor(vbatLatest * 100) * 0.01', 'volts', 2)}, {r('floor(v) * 0.01', 'amperes', 2)}, {r('degrees(floor(v * 3) * 2.0e-8 * 1e6)', 'deg_s', 2)}, {r('floor(v * 3) / 2048.0 * 9.80665', 'm_s2', 2)}, CAST(NULL AS DOUBLE) AS lost FROM frames",
    "strict_boxcar": f"""WITH {FRAMES_SQL}, x AS (SELECT log_id, frame_idx, CASE WHEN event_type <> 'error' THEN v END AS x FROM frames)
        SELECT log_id, frame_idx, {r("CASE WHEN count(x) OVER (w ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) = count(*) OVER (w ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) THEN avg(x) OVER (w ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) END", "w5")} FROM x {WIN}""",
    "session_reference": f"""WITH {FRAMES_SQL}, vis AS (SELECT *, CASE WHEN log_id = 2 THEN 0.25 ELSE log_id * CAST(0.004 AS DOUBLE) END AS off FROM frames WHERE log_id > 1), g AS (SELECT log_id, min(time_sec) AS t0, (max(time_sec) - min(time_sec)) / (count(*) - 1) AS dt, count(*) AS n, min(off) AS off FROM vis GROUP BY log_id),
        b AS (SELECT log_id FROM g ORDER BY n DESC, log_id LIMIT 1), ref AS (SELECT frame_idx AS ref_idx, time_sec + off AS t FROM vis JOIN b USING (log_id)),
        x AS (SELECT g.log_id, ref_idx, n, CAST(floor((t - off - t0) / dt + 0.5) AS BIGINT) AS i FROM g, ref)
        SELECT x.log_id, ref_idx, {r('v', 'v')} FROM x LEFT JOIN frames f ON f.log_id = x.log_id AND f.frame_idx = CASE WHEN i BETWEEN 0 AND n - 1 THEN i END""",
    "servo_roles": f"""WITH c AS ({spectra.ORACLE_SQL['correlation_roles']}) SELECT log_id, servo, role, 'correlation' AS via FROM c WHERE log_id % 3 <> 0
        UNION ALL SELECT log_id, servo, ['aileron-r', 'aileron-l', 'elevator', 'unknown'][servo + 1], 'mixer' FROM c WHERE log_id % 3 = 0""",
    "severity_counts": f"SELECT log_id, severity, count(*) AS n FROM ({dynamics.ORACLE_SQL['recommendations']}) GROUP BY 1, 2",
    "debug_hints": f"""WITH m AS (WITH {dynamics.MODULES_SQL}), c AS (SELECT * FROM (VALUES {', '.join(f"('{x[0]}', {dynamics._sql(x[2])})" for x in dynamics.CAPS)}) AS v(log_id, mode)),
        g AS (SELECT log_id, count(*) FILTER (WHERE module IN ('airspeed_crosscheck', 'tpa_curve') AND state = 'blocked') > 0 AS t, count(*) FILTER (WHERE module = 'spa_effect' AND state = 'blocked') >= 3 AS s, count(*) FILTER (WHERE module = 'sterm_viz' AND state = 'blocked') >= 3 AS z FROM m GROUP BY 1),
        u AS (SELECT log_id, 'TPA' AS k FROM g WHERE t UNION ALL SELECT log_id, 'SPA' FROM g WHERE s UNION ALL SELECT log_id, 'S_TERM' FROM g WHERE z)
        SELECT u.log_id, 'debug-mode-' || lower(k) AS rec_id, 'low' AS severity, 'green' AS confidence, 'set debug_mode = ' || k || '; save' AS cli, '' AS failed FROM u JOIN c ON c.log_id = u.log_id WHERE coalesce(mode, 'NONE') <> k""",
    "filter_rules": f"""WITH pk AS ({spectra.ORACLE_SQL['psd_peaks']}), h AS (SELECT DISTINCT user_id AS log_id, 8 + user_id % 3 * 10 AS lo, 20 + user_id % 4 * 8 AS hi, 40 + user_id % 7 * 40 AS lpf FROM events),
        o AS (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY psd DESC, axis, freq) AS k FROM pk JOIN h USING (log_id) WHERE hi > lo AND (freq < lo OR freq > hi)),
        dl AS (SELECT log_id, 1000 / (2 * pi()) / lpf * 2 + 3 / (pi() * lo) * 1000 * 2 AS ms, CASE log_id % 3 WHEN 0 THEN 11.0 WHEN 1 THEN 6.0 ELSE 8.0 END AS lim FROM h)
        SELECT log_id, 'spectrum-notch-coverage' AS rec_id, 'medium' AS severity, 'yellow' AS confidence, 'set dyn_notch_min_hz = ' || CASE WHEN freq < lo THEN CAST(greatest(floor((freq - 10) / 10) * 10, 20) AS BIGINT) ELSE lo END || '; set dyn_notch_max_hz = ' || CASE WHEN freq > hi THEN CAST(ceil((freq + 25) / 50) * 50 AS BIGINT) ELSE hi END AS cli, '' AS failed FROM o WHERE k = 1
        UNION ALL SELECT log_id, 'spectrum-filter-delay', CASE WHEN ms > 15 THEN 'high' ELSE 'medium' END, 'yellow', {_none} FROM dl WHERE ms > lim""",
    "airspeed_rules": f"""WITH s AS ({basics.ORACLE_SQL['speed_coverage']}), t AS (SELECT log_id, 1000.0 + log_id * CAST(7.3 AS DOUBLE) AS delay_ms, 20.0 + log_id % 9 * CAST(5.5 AS DOUBLE) AS gravity, CAST(0.5 AS DOUBLE) + log_id % 10 * CAST(0.05 AS DOUBLE) AS r2, log_id % 7 <> 0 AS conv, log_id % 13 * 3.0 AS win, log_id % 5 = 0 AS miss, speed_max - speed_min AS span, jumps_per_min, sag FROM s),
        f AS (SELECT *, {_failed({'r2': 'r2 >= 0.85', 'speed range': 'span >= 8', 'throttle changes': 'jumps_per_min >= 3', 'voltage sag': 'sag <= 0.15', 'converged': 'conv', 'window': 'win >= 15', 'pitch': 'NOT miss'})} AS failed FROM t), k AS (SELECT *, {_grade('r2 >= 0.6')} AS c FROM f)
        SELECT log_id, 'airspeed-basic-model-fit' AS rec_id, CASE c WHEN 'red' THEN 'low' ELSE 'medium' END AS severity, c AS confidence, CASE c WHEN 'red' THEN '' ELSE 'set tpa_speed_type = BASIC; set tpa_speed_basic_delay = ' || {_whole('delay_ms')} || '; set tpa_speed_basic_gravity = ' || {_whole('gravity')} END AS cli, array_to_string(failed, ',') AS failed FROM k""",
    "curve_rules": f"""WITH {FRAMES_SQL}, x AS (SELECT log_id, least(v * 8.0, 1000.0) / 1000.0 AS x FROM frames), y AS (SELECT *, min(x) OVER (PARTITION BY log_id) AS lo, max(x) OVER (PARTITION BY log_id) AS hi FROM x WHERE x >= 0.05),
        s AS (SELECT log_id, max(x) - min(x) AS span, count(*) FILTER (WHERE x <= lo + (hi - lo) / 3.0) * 0.25 AS low_sec, count(*) FILTER (WHERE x >= lo + (hi - lo) * 2.0 / 3.0) * 0.25 AS high_sec, count(*) * 4 AS n FROM y GROUP BY log_id),
        t AS (SELECT *, 2.0 + log_id % 5 * CAST(0.31 AS DOUBLE) AS thr0, CAST(0.4 AS DOUBLE) + log_id % 3 * CAST(0.07 AS DOUBLE) AS thr100, log_id % 4 * CAST(0.11 AS DOUBLE) AS stall, log_id % 23 - 11 AS expo, log_id % 9 * CAST(0.03 AS DOUBLE) AS rms, log_id % 8 <> 3 AS conv FROM s),
        f AS (SELECT *, {_failed({'rms': 'rms <= 0.08', 'low dwell': 'low_sec >= 5', 'high dwell': 'high_sec >= 5', 'range': 'span >= 0.6', 'points': 'n >= 200', 'converged': 'conv'})} AS failed FROM t), k AS (SELECT *, {_grade('rms <= 0.20')} AS c FROM f)
        SELECT log_id, 'tpa-curve-hyperbolic-fit' AS rec_id, CASE c WHEN 'red' THEN 'low' ELSE 'medium' END AS severity, c AS confidence, CASE c WHEN 'red' THEN '' ELSE 'set tpa_curve_type = HYPERBOLIC; set tpa_curve_stall_throttle = ' || {_whole('stall * 100')} || '; set tpa_curve_pid_thr0 = ' || {_whole('thr0 * 100')} || '; set tpa_curve_pid_thr100 = ' || {_whole('thr100 * 100')}
          || CASE WHEN conv AND abs(expo) > 5 THEN '; set tpa_curve_expo = ' || expo ELSE '' END END AS cli, array_to_string(failed, ',') AS failed FROM k""",
    "chain_rules": f"""WITH c AS ({series_sql.ORACLE_SQL['input_chain']}) SELECT log_id, 'input-chain.' || lower({_sp.format('axis')}) || '.stage-' || CASE greatest(a_ms, b_ms, c_ms) WHEN a_ms THEN 'a' WHEN b_ms THEN 'b' ELSE 'c' END AS rec_id, CASE WHEN total_ms >= 60 THEN 'high' ELSE 'medium' END AS severity, 'yellow' AS confidence, {_none}
        FROM c WHERE total_ms >= 20 AND greatest(a_ms, b_ms, c_ms) >= total_ms * 0.4 AND least(a_r, b_r, c_r) >= 0.36""",
}
