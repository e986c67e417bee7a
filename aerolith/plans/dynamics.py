"""Queries on manoeuvres, diagnostics, servos, headers and readiness, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerolith.functions.columns import hyperbolic
from aerolith.operators import diagnostics as D
from aerolith.operators import headers as H
from aerolith.operators import maneuver as M
from aerolith.operators import recommend as R
from aerolith.operators import registry as G
from aerolith.operators import servo as V
from aerolith.operators import stats as S
from aerolith.operators.segments import frames_in
from aerolith.plans.basics import r, rounded
from aerolith.sources.logs import sample_checks
from aerolith.sources.virtual_logs import FRAMES_SQL, axis_frames, flight_frames
from aerolith.staging import staged

#: Trigger levels that suit the virtual logs' steps.
LEVELS = {"enter": 12000.0, "leave": 6000.0, "gap_ms": 20.0, "least_ms": 20.0, "pad_ms": 20.0}


def parts(spark, d):
    """Frames, axis rows and manoeuvres, the shared inputs of several analyses: computed once and written."""
    f = staged(flight_frames(spark, d), "frames")
    return f, axis_frames(f), staged(M.detect_maneuvers(f, **LEVELS), "maneuvers")


def q_maneuvers(spark, d):
    return rounded(M.detect_maneuvers(flight_frames(spark, d), **LEVELS))


def q_tracking(spark, d):
    return rounded(M.tracking_stats(axis_frames(flight_frames(spark, d))))


def q_maneuver_tracking(spark, d):
    f = flight_frames(spark, d)
    return rounded(M.maneuver_tracking(f, axis_frames(f), **LEVELS))


def q_coupling(spark, d):
    f, _, w = parts(spark, d)
    return rounded(M.axis_coupling(f, w))


def q_worst_coupling(spark, d):
    f, _, w = parts(spark, d)
    out = rounded(M.worst_coupling(rounded(M.axis_coupling(f, w), 9)))
    return out


def q_feedforward(spark, d):
    _, a, w = parts(spark, d)
    return rounded(M.feedforward_windows(a, w))


def q_ff_verdict(spark, d):
    _, a, w = parts(spark, d)
    return rounded(M.feedforward(M.feedforward_windows(a, w)))


def q_gate_stats(spark, d):
    return rounded(D.gate_stats(axis_frames(flight_frames(spark, d))))


def q_gate_events(spark, d):
    return rounded(D.gate_events(axis_frames(flight_frames(spark, d)), floor=0.5, growth=0.1, peak=0.3, least=4))


def q_attenuation(spark, d):
    f = flight_frames(spark, d)
    a = D.attenuation(f, "preTpaS", post="postTpaS").withColumn("kind", F.lit("ratio"))
    b = D.attenuation(f.withColumn("factor", F.lit(1.0) - F.least(F.col("v"), F.lit(100.0)) / 200.0), "preTpaS", factor="factor").withColumn("kind", F.lit("direct"))
    return rounded(a.unionByName(b))


def q_trim(spark, d):
    f = flight_frames(spark, d)
    return rounded(D.trim_bias(f, axis_frames(f), stick=400.0, bank=300.0, settle_sec=0.05, cover_sec=0.1))


def q_saturation(spark, d):
    return rounded(D.saturation_runs(V.pwm_long(flight_frames(spark, d)), 1250.0, 1750.0))


def q_asymmetry(spark, d):
    f = flight_frames(spark, d)
    return rounded(V.servo_asymmetry(f, S.axis_correlations(f), 100.0))


def q_axis_servo(spark, d):
    f = flight_frames(spark, d)
    return rounded(V.axis_aggregate(f, S.axis_correlations(f)))


def q_probe(spark, d):
    """Activity of each signal on every 8th frame."""
    got = sample_checks(flight_frames(spark, d), ["v", "axisD_0", "servo_0", "wingSpa_1"], 8)
    return rounded(got.select("log_id", F.explode("checks").alias("field", "c")).select("log_id", "field", "c.*"))


def recommended(spark, d):
    """Share, feed-forward, coupling and servo rules over all logs, with severity order."""
    f, a, w = parts(spark, d)
    style = f.select("log_id").distinct().select("log_id", F.element_at(F.array(F.lit("cruise"), F.lit("sport"), F.lit("3d"), F.lit("other")), (F.col("log_id") % 4 + 1).cast("int")).alias("profile"))
    return R.gather(
        R.share_rules(S.term_shares(a)), R.feedforward_rule(M.feedforward(M.feedforward_windows(a, w))), R.coupling_rule(M.axis_coupling(f, w), style, least=1),
        R.asymmetry_rule(V.servo_asymmetry(f, S.axis_correlations(f), 100.0)), R.gate_rule(D.gate_stats(a), D.gate_events(a)),
    )


def q_recommend(spark, d):
    recs = recommended(spark, d)
    return recs.select("log_id", "rec_id", "domain", F.coalesce("axis", F.lit("")).alias("axis"), "severity", "confidence", F.array_join("cli", "; ").alias("cli"))


def q_regions(spark, d):
    f, _, w = parts(spark, d)
    return rounded(M.region_plan(f, w, 12, 0.02, 2))


def q_caveat(spark, d):
    return G.step_caveat(caps(spark)).select("log_id", F.col("axis").cast("long"), "term")


def q_hint(spark, d):
    """Profile hints for a style by the median stick size of each log."""
    f = flight_frames(spark, d)
    style = f.groupBy("log_id").agg(S.percentile_linear(F.abs("rcCommand_0"), 0.5).alias("m")).select("log_id", F.when(F.col("m") < 40, "cruise").when(F.col("m") < 45, "sport").otherwise("3d").alias("profile"))
    chosen = f.select("log_id").distinct().select("log_id", F.when(F.col("log_id") % 2 == 0, "cruise").alias("profile"))
    return G.profile_hint(style, chosen)


# --- literal tables: headers and capabilities -------------------------------------------------------------------

#: Header templates: number, parameter, value. Supplier s has template s % 3 + 1, with frequencies higher by s % 50.
HEADERS = [
    (1, "gyro_lpf1_type", "0"), (1, "gyro_lpf1_static_hz", "100"), (1, "dyn_notch_count", "3"), (1, "dyn_notch_min_hz", "80"), (1, "dyn_notch_max_hz", "300"), (1, "dyn_notch_q", "300"),
    (1, "smix0", "3,0,100,0,0,100,0"), (1, "smix1", "2,0,-100,0,0,100,0"), (1, "smix2", "4,1,100,0,0,100,0"), (1, "servoParam0", "100,1000,2000,1500,0"), (1, "servoParam1", "-50, 1100,1900,1500,2"),
    (2, "gyro_lpf1_type", "BIQUAD"), (2, "gyro_lpf1_dyn_hz", "75,200"), (2, "gyro_lpf2_type", "OFF"), (2, "gyro_lpf2_static_hz", "250"), (2, "dterm_lpf1_type", "2"), (2, "dterm_lpf1_static_hz", "80"),
    (2, "rpm_filter_harmonics", "2"), (2, "rpm_filter_min_hz", "100"), (2, "rpm_filter_q", "500"), (2, "smix0", "2,0,100,0,0,100,0"), (2, "smix1", "3,0,100,0,0,100,0"), (2, "smix2", "2,1,60,0,0,100,0"),
    (2, "smix3", "3,1,60,0,0,100,0"), (2, "smix4", "5,x,1,0,0,0,0"), (3, "gyro_lpf1_type", "3"), (3, "gyro_lpf1_static_hz", "0"), (3, "dyn_notch_count", "0"), (3, "craft_name", "Delta"),
    (3, "smix0", "1,1,80,0,0,100,0"), (3, "smix1", "1,2,80,0,0,100,0"), (3, "smix2", "2,1,80,0,0,100,0"), (3, "smix3", "2,2,-80,0,0,100,0"), (3, "smix4", "6,4,100,0,0,100,0"),
]
HEADERS_SQL = (
    "h0(t, k, v) AS (VALUES " + ", ".join(f"({a}, '{b}', '{c}')" for a, b, c in HEADERS) + "), h AS (SELECT CAST(s_suppkey AS BIGINT) AS log_id, k, CASE WHEN suffix(k, '_hz') AND regexp_full_match(v, '[1-9][0-9]*') "
    "THEN CAST(CAST(v AS BIGINT) + s_suppkey % 50 AS VARCHAR) ELSE v END AS v FROM supplier JOIN h0 ON t = s_suppkey % 3 + 1)"
)


def header_templates(spark):
    rows = spark.createDataFrame(HEADERS, "log_id long, k string, v string")
    return rows.groupBy("log_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("header_params"))


def logs(spark, d):
    """log_id and header_params of a log for each supplier."""
    templates = spark.createDataFrame(HEADERS, "t long, k string, v string")
    ids = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").cast("long").alias("log_id")).withColumn("t", F.col("log_id") % 3 + 1)
    higher = F.col("k").endswith("_hz") & F.col("v").rlike("^[1-9][0-9]*$")
    value = F.when(higher, (F.col("v").try_cast("long") + F.col("log_id") % 50).cast("string")).otherwise(F.col("v"))
    rows = ids.join(F.broadcast(templates), "t").select("log_id", "k", value.alias("v"))
    return rows.groupBy("log_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("header_params"))


def q_filter_config(spark, d):
    c = H.filter_config(logs(spark, d))
    out = [c.select("log_id", F.lit(p).alias("filter"), F.col(p)["filter_type"].alias("kind"), F.coalesce(F.col(p)["static_hz"], F.lit(-1)).alias("a"), F.coalesce(F.col(p)["dyn_min_hz"], F.lit(-1)).alias("b"), F.coalesce(F.col(p)["dyn_max_hz"], F.lit(-1)).alias("c")).where("kind is not null")
           for p in ("gyro_lpf1", "gyro_lpf2", "dterm_lpf1", "dterm_lpf2")]
    out.append(c.where("dyn_notch is not null").select("log_id", F.lit("dyn_notch").alias("filter"), F.lit("NOTCH").alias("kind"), F.col("dyn_notch.count").alias("a"), F.col("dyn_notch.min_hz").alias("b"), F.col("dyn_notch.max_hz").alias("c")))
    out.append(c.where("rpm_filter is not null").select("log_id", F.lit("rpm_filter").alias("filter"), F.lit("NOTCH").alias("kind"), F.col("rpm_filter.harmonics").alias("a"), F.col("rpm_filter.min_hz").alias("b"), F.col("rpm_filter.q").alias("c")))
    res = out[0]
    for o in out[1:]:
        res = res.unionByName(o)
    return res


def q_delay(spark, d):
    return rounded(H.delay_budget(H.filter_config(logs(spark, d))).select("log_id", "stage", "delay_ms"))


def q_params(spark, d):
    p = H.filter_params(logs(spark, d))
    return rounded(p.select("log_id", "lpf1_type", "lpf1_static_hz", "lpf1_dyn_min_hz", "lpf1_dyn_max_hz", "notch_q", "notch_max_hz", "rpm_harmonics", "rpm_q", F.col("rpm_weights")[0].alias("w0"), "motor_poles"))


def q_smix(spark, d):
    rules = H.smix_rules(logs(spark, d))
    servos = logs(spark, d).select("log_id", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("servo"))
    return rounded(V.roles_from_mixer(servos, rules))


def q_servo_params(spark, d):
    return rounded(H.servo_params(logs(spark, d)))


def q_search(spark, d):
    return H.search_params(logs(spark, d), "Lpf1")


#: Synthetic capabilities: log, fields, debug mode, GPS, frames, firmware, checks (field, all zero, lowest, highest).
CAPS = [
    ("a", ["axisP[0]", "axisI[0]", "axisD[0]", "axisF[0]", "axisS[0]", "wingTpaArg", "wingTpaFactor", "gps:GPS_speed"], "NONE", True, 1000, "Firmware 4.5.1",
     [("axisP[0]", False, -5.0, 5.0), ("axisI[0]", False, -5.0, 5.0), ("axisD[0]", False, -1.0, 1.0), ("axisF[0]", False, 0.0, 3.0), ("axisS[0]", True, 0.0, 0.0), ("wingTpaArg", False, 0.0, 900.0), ("wingTpaFactor", False, 100.0, 1000.0), ("gps:GPS_speed", False, 0.0, 30.0)]),
    ("b", ["debug[0]", "debug[5]", "debug[4]", "axisP[1]"], "TPA", False, 500, "4.4", [("debug[0]", False, 0.0, 5000.0), ("debug[5]", False, 0.0, 800.0), ("debug[4]", True, 0.0, 0.0), ("axisP[1]", True, 0.0, 0.0)]),
    ("c", ["debug[0]", "debug[1]", "debug[2]", "axisS[1]"], "SPA", True, 0, None, [("debug[0]", False, 0.0, 1000.0), ("debug[1]", True, 0.0, 0.0), ("debug[2]", False, 0.0, 1000.0), ("axisS[1]", False, -1.0, 1.0)]),
    ("d", [], None, False, 0, None, []),
]


def caps(spark):
    rows = [(a, f, m, g, n, fw, {k: (z, lo, hi) for k, z, lo, hi in c}) for a, f, m, g, n, fw, c in CAPS]
    return spark.createDataFrame(rows, G.SCHEMA)


def _sql(v):
    return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)


CAPS_SQL = (
    "c(log_id, mode, gps, n, fw) AS (VALUES " + ", ".join(f"('{a}', {_sql(m)}, {g}, {n}, {_sql(fw)})" for a, _, m, g, n, fw, _ in CAPS) + "), "
    "fl(log_id, field) AS (VALUES " + ", ".join(f"('{a}', '{x}')" for a, f, *_ in CAPS for x in f) + "), "
    "ck(log_id, field, zero, lo, hi) AS (VALUES " + ", ".join(f"('{a}', '{k}', {z}, {lo}, {hi})" for a, *_, c in CAPS for k, z, lo, hi in c) + "), "
    "src(signal, axis, pref, kind, field, mode, lo, hi) AS (VALUES " + ", ".join("(" + ", ".join(map(_sql, s[:8])) + ")" for s in G.SOURCES) + "), "
    "pr AS (SELECT c.log_id, s.signal, s.axis, s.pref, s.kind, s.field, CASE WHEN fl.field IS NULL OR (s.mode IS NOT NULL AND s.mode <> coalesce(c.mode, '')) THEN 'missing' WHEN coalesce(ck.zero, FALSE) THEN 'inactive' "
    "WHEN coalesce(ck.lo < s.lo, FALSE) OR coalesce(ck.hi > s.hi, FALSE) THEN 'out_of_range' ELSE 'resolved' END AS state FROM c CROSS JOIN src s LEFT JOIN fl ON fl.log_id = c.log_id AND fl.field = s.field LEFT JOIN ck ON ck.log_id = c.log_id AND ck.field = s.field), "
    "rs AS (SELECT log_id, signal, axis, state, kind, field FROM (SELECT *, row_number() OVER (PARTITION BY log_id, signal, axis ORDER BY CASE state WHEN 'resolved' THEN 0 WHEN 'out_of_range' THEN 1 WHEN 'inactive' THEN 2 ELSE 3 END, pref) AS k FROM pr) WHERE k = 1)"
)


def q_resolution(spark, d):
    return G.resolve_signals(caps(spark), G.signal_sources(spark)).select("log_id", "signal", F.col("axis").cast("long"), "state", "kind", "field")


def q_modules(spark, d):
    return G.module_report(caps(spark), G.signal_sources(spark)).select("log_id", "module", F.col("axis").cast("long"), "state")


def q_fields(spark, d):
    return G.field_table(caps(spark))


def q_confidence(spark, d):
    """Confidence of a criterion table made from the term shares of each log."""
    s = S.term_shares(axis_frames(flight_frames(spark, d)))
    c = s.selectExpr("log_id", "axis", "stack(3, 'p', p_share > 0.1, true, 'i', i_share < 0.45, false, 'd', d_share > 0.2, false) AS (name, passed, critical)")
    return rounded(G.aggregate_confidence(c, ("log_id", "axis")).select("log_id", "axis", "confidence", F.array_join("failed", ",").alias("failed")))


def q_hyperbolic(spark, d):
    x = spark.range(0, 101).select((F.col("id") / 100.0).alias("x"))
    return rounded(x.select("x", *(hyperbolic(F.col("x"), *map(F.lit, p)).alias(n) for n, p in CURVES.items())))


CURVES = {"flat": (2.0, 0.5, 0.2, -0.1), "bent": (3.0, 0.5, 0.2, 5.0), "steep": (1.5, 0.2, 0.4, 60.0)}

QUERIES = {
    "maneuver_windows": q_maneuvers, "tracking_stats": q_tracking, "maneuver_tracking": q_maneuver_tracking, "axis_coupling": q_coupling, "worst_coupling": q_worst_coupling, "ff_effect": q_feedforward,
    "ff_verdict": q_ff_verdict, "gate_stats": q_gate_stats, "gate_events": q_gate_events, "attenuation": q_attenuation, "trim_bias": q_trim, "saturation_runs": q_saturation, "servo_pairs": q_asymmetry,
    "axis_servo_sum": q_axis_servo, "probe_strided": q_probe, "recommendations": q_recommend, "header_filters": q_filter_config, "delay_budget": q_delay, "filter_params": q_params, "smix_roles": q_smix,
    "servo_params": q_servo_params, "header_search": q_search, "signal_resolution": q_resolution, "module_report": q_modules, "field_table": q_fields, "confidence": q_confidence, "hyperbolic_eval": q_hyperbolic,
    "region_plan": q_regions, "step_caveat": q_caveat, "profile_hint": q_hint,
}

WIN = "WINDOW w AS (PARTITION BY log_id ORDER BY frame_idx)"


def half_up(x: str) -> str:
    return f"CAST(floor({x} + 0.5) AS BIGINT)"


_v = lambda a: f"coalesce((lead(setpoint_{a}) OVER w - lag(setpoint_{a}) OVER w) / (2.0 * dt), (lead(setpoint_{a}) OVER w - setpoint_{a}) / dt, (setpoint_{a} - lag(setpoint_{a}) OVER w) / dt, 0.0)"
MAN_SQL = f"""{FRAMES_SQL},
m0 AS (SELECT *, count(*) OVER (PARTITION BY log_id) AS n, (max(time_sec) OVER (PARTITION BY log_id) - min(time_sec) OVER (PARTITION BY log_id)) / (count(*) OVER (PARTITION BY log_id) - 1) AS dt FROM frames),
m1 AS (SELECT *, {', '.join(f'abs({_v(a)}) AS v{a}' for a in range(3))} FROM m0 WHERE n >= 3 AND dt > 0 {WIN}),
m2 AS (SELECT *, {', '.join(f'avg(v{a}) OVER (w ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS s{a}' for a in range(3))} FROM m1 {WIN}),
m3 AS (SELECT *, greatest(s0, s1, s2) AS trig FROM m2),
m4 AS (SELECT *, coalesce(last_value(CASE WHEN trig >= 12000 THEN 1 WHEN trig < 6000 THEN 0 END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS open FROM m3 {WIN}),
m5 AS (SELECT *, CASE WHEN open = lag(open) OVER w THEN 0 ELSE 1 END AS ch FROM m4 {WIN}),
m6 AS (SELECT *, sum(ch) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM m5 {WIN}),
m7 AS (SELECT log_id, min(frame_idx) AS s, max(frame_idx) + 1 AS e, min(n) AS n, min(dt) AS dt FROM m6 WHERE open = 1 GROUP BY log_id, g),
m8 AS (SELECT *, max(e) OVER (PARTITION BY log_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM m7),
m9 AS (SELECT *, sum(CASE WHEN s - reach <= {half_up("0.02 / dt")} THEN 0 ELSE 1 END) OVER (PARTITION BY log_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM m8),
ma AS (SELECT log_id, min(s) AS s, max(e) AS e, min(n) AS n, min(dt) AS dt FROM m9 GROUP BY log_id, g HAVING max(e) - min(s) >= {half_up("0.02 / min(dt)")}),
mb AS (SELECT log_id, greatest(s - {half_up("0.02 / dt")}, 0) AS start_idx, least(e + {half_up("0.02 / dt")}, n) AS end_idx, n, dt FROM ma),
mc AS (SELECT mb.log_id, start_idx, end_idx, min(mb.n) AS n, min(mb.dt) AS dt, max(s0) AS p0, max(s1) AS p1, max(s2) AS p2 FROM mb JOIN m3 f ON f.log_id = mb.log_id AND f.frame_idx >= start_idx AND f.frame_idx < end_idx GROUP BY 1, 2, 3),
md AS (SELECT *, greatest(p0, p1, p2) AS peak, CASE WHEN p0 = greatest(p0, p1, p2) THEN 0 WHEN p1 = greatest(p0, p1, p2) THEN 1 ELSE 2 END AS dominant_axis FROM mc),
man AS (SELECT *, CASE WHEN CAST(p0 >= 0.7 * peak AS INT) + CAST(p1 >= 0.7 * peak AS INT) + CAST(p2 >= 0.7 * peak AS INT) >= 2 THEN 'mixed' ELSE ['roll', 'pitch', 'yaw'][dominant_axis + 1] END AS kind FROM md)"""

COUP_SQL = f"""{MAN_SQL},
q0 AS (SELECT log_id, start_idx, end_idx AS move_end, least(end_idx + {half_up("0.15 / dt")}, n) AS e, greatest({half_up("0.03 / dt")}, 1) AS bn, dominant_axis AS cmd_axis FROM man WHERE kind <> 'mixed'),
q1 AS ({' UNION ALL '.join(f'SELECT log_id, frame_idx, {a} AS resp_axis, gyroADC_{a} AS g FROM frames' for a in range(3))}),
q2 AS (SELECT q0.*, resp_axis, frame_idx, g, avg(CASE WHEN frame_idx < start_idx + bn THEN g END) OVER (PARTITION BY q0.log_id, start_idx, move_end, cmd_axis, resp_axis) AS base FROM q0 JOIN q1 ON q1.log_id = q0.log_id AND frame_idx >= start_idx AND frame_idx < e WHERE e - start_idx >= 3),
q3 AS (SELECT log_id, start_idx, move_end, cmd_axis, resp_axis, g - base AS dev, row_number() OVER (PARTITION BY log_id, start_idx, move_end, cmd_axis, resp_axis ORDER BY abs(g - base) DESC, frame_idx) AS k FROM q2),
q4 AS (SELECT *, max(CASE WHEN cmd_axis = resp_axis THEN dev END) OVER (PARTITION BY log_id, start_idx, move_end, cmd_axis) AS cmd FROM q3 WHERE k = 1),
coup AS (SELECT log_id, cmd_axis, resp_axis, avg(dev / abs(cmd) * CASE WHEN cmd >= 0 THEN 1 ELSE -1 END) AS ratio, count(*) AS n FROM q4 WHERE abs(cmd) >= 20 GROUP BY 1, 2, 3)"""

_v2 = "coalesce((lead(sp) OVER w2 - lag(sp) OVER w2) / (2.0 * dt), (lead(sp) OVER w2 - sp) / dt, (sp - lag(sp) OVER w2) / dt, 0.0)"
FF_SQL = f"""{MAN_SQL},
f0 AS (SELECT *, count(*) OVER (PARTITION BY log_id, axis) AS n, (max(time_sec) OVER (PARTITION BY log_id, axis) - min(time_sec) OVER (PARTITION BY log_id, axis)) / (count(*) OVER (PARTITION BY log_id, axis) - 1) AS dt FROM axes),
f1 AS (SELECT *, {_v2} AS vel FROM f0 WHERE n >= 3 AND dt > 0 WINDOW w2 AS (PARTITION BY log_id, axis ORDER BY frame_idx)),
f2 AS (SELECT f1.*, man.start_idx, man.end_idx FROM f1 JOIN man ON man.log_id = f1.log_id AND (man.kind = 'mixed' OR man.dominant_axis = f1.axis) AND frame_idx >= start_idx AND frame_idx < end_idx WHERE end_idx - start_idx >= 2),
f3 AS (SELECT *, avg(f) OVER (PARTITION BY log_id, axis, start_idx, end_idx ORDER BY frame_idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS sm, row_number() OVER (PARTITION BY log_id, axis, start_idx, end_idx ORDER BY abs(vel) DESC, frame_idx) AS k FROM f2),
f4 AS (SELECT log_id, axis, start_idx, end_idx, coalesce(sum(abs(f)) FILTER (WHERE abs(vel) >= 600), 0) AS sf, coalesce(sum(abs(p)) FILTER (WHERE abs(vel) >= 600), 0) AS sq, max(abs(sp)) AS spk, avg((f - sm) * (f - sm)) AS res, avg(sm * sm) AS env,
  min(dt) AS dt, min(n) AS n, max(CASE WHEN k = 1 THEN frame_idx END) AS top, max(CASE WHEN k = 1 THEN vel END) AS tv FROM f3 GROUP BY 1, 2, 3, 4),
f5 AS (SELECT f4.log_id, f4.axis, start_idx, end_idx, greatest(max((f1.gyro - f1.sp) * CASE WHEN tv >= 0 THEN 1 ELSE -1 END), 0) AS ov FROM f4 JOIN f1 ON f1.log_id = f4.log_id AND f1.axis = f4.axis AND f1.frame_idx >= top AND f1.frame_idx < least(f4.n, top + greatest({half_up("0.15 / f4.dt")}, 1)) GROUP BY 1, 2, 3, 4),
ff AS (SELECT log_id, axis, start_idx, end_idx, sf + sq AS effort, CASE WHEN sf + sq > 0 THEN sf / (sf + sq) ELSE 0 END AS coverage, CASE WHEN spk > 0 THEN ov / spk ELSE 0 END AS overshoot,
  CASE WHEN end_idx - start_idx >= 3 AND sqrt(env) > 1e-6 THEN sqrt(res) / sqrt(env) ELSE 0 END AS noise FROM f4 JOIN f5 USING (log_id, axis, start_idx, end_idx)),
fv AS (SELECT log_id, axis, CASE WHEN sum(effort) > 0 THEN sum(coverage * effort) / sum(effort) ELSE 0 END AS mean_coverage, count(*) AS n_windows, count(*) FILTER (WHERE overshoot > 0.15) AS n_overshoot, avg(noise) AS mean_noise FROM ff GROUP BY 1, 2),
fw AS (SELECT *, CASE WHEN n_overshoot / n_windows > 0.5 THEN 'overgained' WHEN mean_coverage < 0.5 THEN 'undergained' ELSE 'healthy' END AS verdict FROM fv)"""


def gate_sql(least, floor, growth, peak):
    return f"""
g0 AS (SELECT log_id, axis, frame_idx, time_sec, i, spa, spa < 0.95 AS gated, max(i) OVER (PARTITION BY log_id, axis) - min(i) OVER (PARTITION BY log_id, axis) AS rng FROM axes),
g1 AS (SELECT *, CASE WHEN gated = lag(gated) OVER (PARTITION BY log_id, axis ORDER BY frame_idx) THEN 0 ELSE 1 END AS ch FROM g0),
g2 AS (SELECT *, sum(ch) OVER (PARTITION BY log_id, axis ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM g1),
g3 AS (SELECT log_id, axis, min(frame_idx) AS s, max(frame_idx) + 1 AS e, min(spa) AS lo, min(time_sec) AS t0, max(time_sec) AS t1, arg_min(i, frame_idx) AS i0, arg_max(i, frame_idx) AS i1, greatest(min(rng), 1e-9) AS rng FROM g2 WHERE gated GROUP BY log_id, axis, g HAVING count(*) >= {least}),
g4 AS (SELECT g3.log_id, g3.axis, t1, max(abs(f.i)) / min(rng) AS frac FROM g3 JOIN axes f ON f.log_id = g3.log_id AND f.axis = g3.axis AND f.frame_idx >= e AND f.time_sec <= t1 + 0.2 GROUP BY g3.log_id, g3.axis, t1, rng),
gev AS (SELECT log_id, axis, 'wind_up' AS kind, t0 AS time_sec, least(abs(i1 - i0) / rng, 1) AS severity FROM g3 WHERE lo <= {floor} AND abs(i1 - i0) / rng >= {growth}
  UNION ALL SELECT log_id, axis, 'bounce_back', t1, least(frac, 1) FROM g4 WHERE frac >= {peak}),
gst AS (SELECT log_id, axis, count(*) FILTER (WHERE spa < 0.95) AS active_n, count(*) FILTER (WHERE spa < 0.95) * 100.0 / count(*) AS active_pct, min(spa) AS spa_min, avg(spa) AS spa_mean, greatest(max(i) - min(i), 1e-9) AS i_range FROM axes GROUP BY 1, 2)"""


CORR_SQL = f"""l AS ({' UNION ALL '.join(f'SELECT log_id, frame_idx, {n} AS servo, servo_{n} AS pwm, setpoint_0, setpoint_1, setpoint_2 FROM frames' for n in range(4))}),
c0 AS (SELECT log_id, servo, {', '.join(f'coalesce(CASE WHEN stddev_pop(pwm) > 0 AND stddev_pop(setpoint_{a}) > 0 THEN corr(pwm, setpoint_{a}) END, 0) AS r{a}' for a in range(3))} FROM l GROUP BY 1, 2),
c1 AS (SELECT *, CASE WHEN greatest(abs(r0), abs(r1), abs(r2)) > 0.25 THEN CASE WHEN abs(r0) = greatest(abs(r0), abs(r1), abs(r2)) THEN 0 WHEN abs(r1) = greatest(abs(r0), abs(r1), abs(r2)) THEN 1 ELSE 2 END END AS axis FROM c0),
lead_ AS (SELECT log_id, servo, axis, CASE axis WHEN 0 THEN r0 WHEN 1 THEN r1 ELSE r2 END AS rr FROM c1 WHERE axis IS NOT NULL)"""
ASYM_SQL = f"""{CORR_SQL},
a0 AS (SELECT *, first_value(servo) OVER (PARTITION BY log_id, axis ORDER BY round(abs(rr), 9) DESC, servo) AS reference FROM lead_ WHERE abs(rr) >= 0.25),
a1 AS (SELECT l.log_id, axis, l.servo, reference, frame_idx, sign(CASE WHEN rr >= 0 THEN 1 ELSE -1 END) * (pwm - 1500.0) AS x FROM l JOIN a0 ON a0.log_id = l.log_id AND a0.servo = l.servo),
a2 AS (SELECT log_id, axis, servo, reference, stddev_pop(x) AS sd, count(*) AS n FROM a1 GROUP BY 1, 2, 3, 4),
a3 AS (SELECT b.log_id, b.axis, b.servo, lag, sum(a.x * b.x) AS dot FROM a1 a CROSS JOIN (SELECT unnest(generate_series(-3, 3)) AS lag) JOIN a1 b ON b.log_id = a.log_id AND b.axis = a.axis AND b.frame_idx = a.frame_idx + lag AND b.servo <> b.reference WHERE a.servo = a.reference GROUP BY 1, 2, 3, 4),
a4 AS (SELECT a3.log_id, a3.axis, s.reference, a3.servo, lag, s.sd, f.sd AS fsd, CASE WHEN s.sd > 0 AND f.sd > 0 THEN dot / (s.n * s.sd * f.sd) ELSE 0 END AS rr FROM a3 JOIN a2 s ON s.log_id = a3.log_id AND s.axis = a3.axis AND s.servo = a3.servo JOIN a2 f ON f.log_id = a3.log_id AND f.axis = a3.axis AND f.servo = s.reference AND f.servo = f.reference),
a5 AS (SELECT *, row_number() OVER (PARTITION BY log_id, axis, servo ORDER BY abs(rr) DESC, lag) AS k FROM a4),
asym AS (SELECT log_id, axis, reference, servo, lag * 10.0 AS lag_ms, rr AS r, CASE WHEN fsd > 0 THEN sd / fsd ELSE 0 END AS ratio,
  CASE WHEN rr < 0.5 THEN 'inconclusive' WHEN abs(lag * 10.0) <= 10 AND CASE WHEN fsd > 0 THEN sd / fsd ELSE 0 END BETWEEN 0.7 AND 1.3 THEN 'ok' ELSE 'warn' END AS severity FROM a5 WHERE k = 1)"""

_sp = "['R', 'P', 'Y'][{} + 1]"
_shares = "sh0 AS (SELECT log_id, axis, avg(abs(p)) AS p, avg(abs(i)) AS i, avg(abs(d)) AS d, avg(abs(f)) AS f, avg(abs(s)) AS s FROM axes GROUP BY 1, 2), sh AS (SELECT log_id, axis, p / t AS ps, i / t AS i_s, d / t AS ds, f / t AS fs, s / t AS ss FROM (SELECT *, p + i + d + f + s AS t FROM sh0))"
_h = lambda k: f"max(CASE WHEN k = '{k}' THEN trim(v) END)"
_int = lambda k: f"max(CASE WHEN k = '{k}' AND regexp_full_match(trim(v), '[0-9]+') THEN CAST(trim(v) AS BIGINT) END)"


def _lpf(p: str) -> str:
    return f"""SELECT log_id, '{p}' AS filter, kind, coalesce(st, -1) AS a, coalesce(lo, -1) AS b, coalesce(hi, -1) AS c FROM (
      SELECT log_id, CASE upper({_h(p + '_type')}) WHEN '0' THEN 'PT1' WHEN '1' THEN 'BIQUAD' WHEN '2' THEN 'PT2' WHEN '3' THEN 'PT3' ELSE {_h(p + '_type')} END AS kind, {_int(p + '_static_hz')} AS st,
        max(CASE WHEN k = '{p}_dyn_hz' THEN CAST(split_part(v, ',', 1) AS BIGINT) END) AS lo, max(CASE WHEN k = '{p}_dyn_hz' THEN CAST(split_part(v, ',', 2) AS BIGINT) END) AS hi FROM h GROUP BY log_id)
      WHERE kind IS NOT NULL AND upper(kind) <> 'OFF' AND (coalesce(st, 0) > 0 OR lo IS NOT NULL)"""


CONFIG_SQL = f"{HEADERS_SQL}, cfg AS (" + " UNION ALL ".join(_lpf(p) for p in ("gyro_lpf1", "gyro_lpf2", "dterm_lpf1", "dterm_lpf2")) + f"""
  UNION ALL SELECT log_id, 'dyn_notch', 'NOTCH', {_int('dyn_notch_count')}, coalesce({_int('dyn_notch_min_hz')}, 0), coalesce({_int('dyn_notch_max_hz')}, 0) FROM h GROUP BY log_id HAVING coalesce({_int('dyn_notch_count')}, 0) > 0
  UNION ALL SELECT log_id, 'rpm_filter', 'NOTCH', {_int('rpm_filter_harmonics')}, coalesce({_int('rpm_filter_min_hz')}, 0), coalesce({_int('rpm_filter_q')}, 0) FROM h GROUP BY log_id HAVING coalesce({_int('rpm_filter_harmonics')}, 0) > 0)"""
DELAY_SQL = f"""{CONFIG_SQL}, nq AS (SELECT log_id, coalesce({_int('dyn_notch_q')}, 0) AS q FROM h GROUP BY log_id),
  dl AS (SELECT log_id, filter AS stage, 1000 / (2 * pi()) / CASE WHEN b > 0 THEN b ELSE a END * CASE upper(kind) WHEN 'PT2' THEN 2 WHEN 'PT3' THEN 3 WHEN 'BIQUAD' THEN 1.5 ELSE 1 END AS ms FROM cfg WHERE kind <> 'NOTCH' AND greatest(a, b) > 0
    UNION ALL SELECT cfg.log_id, filter, CASE filter WHEN 'dyn_notch' THEN q ELSE c END / 100.0 / (pi() * b) * 1000 * a FROM cfg JOIN nq USING (log_id) WHERE kind = 'NOTCH' AND b > 0)"""
_num = lambda k, dflt: f"coalesce(max(CASE WHEN k = '{k}' THEN TRY_CAST(regexp_extract(trim(v), '^[+-]?[0-9]*\\.?[0-9]+') AS DOUBLE) END), {dflt})"
_nth = lambda k, i: f"coalesce(max(CASE WHEN k = '{k}' THEN TRY_CAST(trim(split_part(v, ',', {i})) AS DOUBLE) END), 0)"

MODULES_SQL = f"""{CAPS_SQL}, ps AS (SELECT c.log_id, x.field, CASE WHEN fl.field IS NULL THEN 'missing' WHEN coalesce(ck.zero, FALSE) THEN 'zero' ELSE 'active' END AS p FROM c CROSS JOIN
  (SELECT 'axis' || t || '[' || a || ']' AS field FROM (VALUES ('P'), ('I'), ('D'), ('F'), ('S')) AS v(t), (VALUES (0), (1), (2)) AS u(a) UNION ALL SELECT 'gps:GPS_speed') x
  LEFT JOIN fl ON fl.log_id = c.log_id AND fl.field = x.field LEFT JOIN ck ON ck.log_id = c.log_id AND ck.field = x.field),
pa AS (SELECT log_id, CAST(substr(field, 7, 1) AS BIGINT) AS axis, max(CASE WHEN substr(field, 5, 1) <> 'S' AND p = 'missing' THEN 1 ELSE 0 END) AS miss, max(CASE WHEN substr(field, 5, 1) <> 'S' AND p = 'zero' THEN 1 ELSE 0 END) AS zero, max(CASE WHEN substr(field, 5, 1) = 'S' THEN p END) AS s FROM ps WHERE field LIKE 'axis%' GROUP BY 1, 2)
SELECT c.log_id, 'basic_viewing' AS module, -1 AS axis, CASE WHEN n = 0 OR NOT EXISTS (SELECT 1 FROM fl WHERE fl.log_id = c.log_id) THEN 'blocked' ELSE 'available' END AS state FROM c
UNION ALL SELECT log_id, 'pidfs', axis, CASE WHEN miss = 1 THEN 'blocked' WHEN zero = 1 THEN 'inactive' WHEN s <> 'active' THEN 'partial' ELSE 'available' END FROM pa
UNION ALL SELECT pa.log_id, 'sterm_viz', pa.axis, CASE WHEN s = 'missing' OR state = 'missing' THEN 'blocked' WHEN s = 'zero' OR state = 'inactive' THEN 'inactive' ELSE 'available' END FROM pa JOIN rs ON rs.log_id = pa.log_id AND rs.axis = pa.axis AND signal = 'pre_tpa_s'
UNION ALL SELECT log_id, CASE signal WHEN 'spa' THEN 'spa_effect' ELSE 'airspeed_crosscheck' END, axis, CASE state WHEN 'resolved' THEN 'available' WHEN 'missing' THEN 'blocked' ELSE state END FROM rs WHERE signal IN ('spa', 'tpa_speed_est')
UNION ALL SELECT log_id, 'tpa_curve', -1, CASE WHEN max(CASE WHEN state = 'out_of_range' THEN 1 ELSE 0 END) = 1 THEN 'out_of_range' WHEN max(CASE WHEN state = 'missing' THEN 1 ELSE 0 END) = 1 THEN 'blocked' WHEN max(CASE WHEN state = 'inactive' THEN 1 ELSE 0 END) = 1 THEN 'inactive' ELSE 'available' END FROM rs WHERE signal IN ('tpa_arg', 'tpa_factor') GROUP BY log_id
UNION ALL SELECT c.log_id, 'airspeed_fit', -1, CASE WHEN NOT gps THEN 'blocked' WHEN p = 'zero' THEN 'inactive' ELSE 'available' END FROM c JOIN ps ON ps.log_id = c.log_id AND field = 'gps:GPS_speed'"""

_curve = lambda thr0, thr100, st, ex: f"CASE WHEN x <= {st} THEN CAST({thr0} AS DOUBLE) ELSE {thr0} / pow(1 + (pow(CAST({thr0} AS DOUBLE) / {thr100}, 1 / (-1 / (0.999 - {ex} / 100.0))) - 1) * (x - {st}) / (1 - {st}), -1 / (0.999 - {ex} / 100.0)) END"

ORACLE_SQL = {
    "maneuver_windows": f"WITH {MAN_SQL} SELECT log_id, start_idx, end_idx, dominant_axis, kind, {r('peak', 'peak')} FROM man",
    "tracking_stats": f"""WITH {FRAMES_SQL}, k AS (SELECT *, abs(gyro - sp) AS e, row_number() OVER (PARTITION BY log_id, axis ORDER BY abs(gyro - sp) DESC, frame_idx) AS k FROM axes)
        SELECT log_id, axis, {r("sqrt(avg(e * e))", "rms")}, {r("max(e)", "peak")}, max(CASE WHEN k = 1 THEN frame_idx END) AS peak_idx, count(e) AS n FROM k GROUP BY 1, 2""",
    "maneuver_tracking": f"""WITH {MAN_SQL}, k AS (SELECT a.log_id, a.axis, start_idx, end_idx, kind, frame_idx, abs(gyro - sp) AS e, row_number() OVER (PARTITION BY a.log_id, a.axis, start_idx, end_idx ORDER BY abs(gyro - sp) DESC, frame_idx) AS k
        FROM axes a JOIN man ON man.log_id = a.log_id AND man.dominant_axis = a.axis AND frame_idx >= start_idx AND frame_idx < end_idx)
        SELECT log_id, axis, start_idx, end_idx, kind, {r("sqrt(avg(e * e))", "rms")}, {r("max(e)", "peak")}, max(CASE WHEN k = 1 THEN frame_idx END) AS peak_idx, count(e) AS n FROM k GROUP BY 1, 2, 3, 4, 5""",
    "axis_coupling": f"WITH {COUP_SQL} SELECT log_id, cmd_axis, resp_axis, {r('ratio', 'ratio')}, n FROM coup",
    "worst_coupling": f"WITH {COUP_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY abs(round(ratio, 9)) DESC, cmd_axis, resp_axis) AS k FROM coup WHERE cmd_axis <> resp_axis) SELECT log_id, cmd_axis, resp_axis, {r('ratio', 'ratio')}, n FROM k WHERE k = 1",
    "ff_effect": f"WITH {FF_SQL} SELECT log_id, axis, start_idx, end_idx, {r('effort', 'effort')}, {r('coverage', 'coverage')}, {r('overshoot', 'overshoot')}, {r('noise', 'noise')}, overshoot > 0.15 AS has_overshoot, noise > 0.35 AS noisy FROM ff",
    "ff_verdict": f"WITH {FF_SQL} SELECT log_id, axis, {r('mean_coverage', 'mean_coverage')}, n_windows, n_overshoot, {r('mean_noise', 'mean_noise')}, mean_noise > 0.35 AS noisy, verdict FROM fw",
    "gate_stats": f"WITH {FRAMES_SQL}, {gate_sql(4, 0.5, 0.1, 0.3)} SELECT log_id, axis, active_n, {r('active_pct', 'active_pct')}, {r('spa_min', 'spa_min')}, {r('spa_mean', 'spa_mean')}, {r('i_range', 'i_range')} FROM gst",
    "gate_events": f"WITH {FRAMES_SQL}, {gate_sql(4, 0.5, 0.1, 0.3)} SELECT log_id, axis, kind, {r('time_sec', 'time_sec')}, {r('severity', 'severity')} FROM gev",
    "attenuation": f"""WITH {FRAMES_SQL}, x AS (SELECT log_id, 'ratio' AS kind, CASE WHEN abs(preTpaS) >= 1 THEN greatest(least(postTpaS / preTpaS, 3), 0) END AS f FROM frames UNION ALL SELECT log_id, 'direct', CASE WHEN abs(preTpaS) >= 1 THEN 1.0 - least(v, 100.0) / 200.0 END FROM frames)
        SELECT log_id, kind, {r("coalesce(avg(f), 1)", "mean_factor")}, {r("coalesce(min(f), 1)", "min_factor")}, {r("CASE WHEN count(f) > 0 THEN greatest(least(1 - avg(f), 1), 0) ELSE 0 END", "attenuation")}, count(f) AS active_n, {r("count(f) * 100.0 / count(*)", "active_pct")} FROM x GROUP BY 1, 2""",
    "trim_bias": f"""WITH {FRAMES_SQL}, h0 AS (SELECT log_id, frame_idx, time_sec - lag(time_sec) OVER w AS dt, count(*) OVER (PARTITION BY log_id) AS n, greatest(abs(setpoint_0), abs(setpoint_1), abs(setpoint_2)) < 400 AND abs(attitude_0) < 300 AS calm FROM frames {WIN}),
        h1 AS (SELECT log_id, CASE WHEN max(CASE WHEN frame_idx = n // 2 THEN dt END) > 0 THEN 1 / max(CASE WHEN frame_idx = n // 2 THEN dt END) ELSE 0 END AS hz FROM h0 GROUP BY log_id),
        h2 AS (SELECT h0.log_id, frame_idx, hz, frame_idx - coalesce(last_value(CASE WHEN NOT calm THEN frame_idx END IGNORE NULLS) OVER (PARTITION BY h0.log_id ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), -1) >= greatest({half_up("hz * 0.05")}, 1) AND hz > 0 AS ok FROM h0 JOIN h1 USING (log_id)),
        h3 AS (SELECT a.log_id, axis, avg(i) FILTER (WHERE ok) AS m, sqrt(avg(i * i)) AS q, count(*) FILTER (WHERE ok) AS n, min(hz) AS hz FROM axes a JOIN h2 USING (log_id, frame_idx) GROUP BY 1, 2),
        h4 AS (SELECT *, CASE WHEN m IS NOT NULL AND q > 1 THEN least(abs(m) / q, 1) ELSE 0 END AS fr, CASE WHEN hz > 0 THEN n / hz ELSE 0 END AS cov FROM h3)
        SELECT log_id, axis, {r("m", "mean_i")}, {r("q", "rms_i")}, {r("fr", "fraction")}, n AS steady_n, {r("cov", "coverage_sec")}, CASE WHEN m IS NULL OR cov < 0.1 THEN 'unknown' WHEN fr >= 0.5 THEN 'trim-error' WHEN fr >= 0.25 THEN 'slight' ELSE 'balanced' END AS severity FROM h4""",
    "saturation_runs": f"""WITH {FRAMES_SQL}, s0 AS ({' UNION ALL '.join(f"SELECT log_id, frame_idx, {n} AS servo, CASE WHEN servo_{n} <= 1275 THEN 'low' WHEN servo_{n} >= 1725 THEN 'high' ELSE 'none' END AS kind FROM frames" for n in range(4))}),
        s1 AS (SELECT *, CASE WHEN kind = lag(kind) OVER (PARTITION BY log_id, servo ORDER BY frame_idx) THEN 0 ELSE 1 END AS ch FROM s0), s2 AS (SELECT *, sum(ch) OVER (PARTITION BY log_id, servo ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM s1)
        SELECT log_id, servo, kind, min(frame_idx) AS start_idx, max(frame_idx) + 1 AS end_idx, {r("count(*) * 1000.0 / 1000.0", "duration_ms")} FROM s2 WHERE kind <> 'none' GROUP BY log_id, servo, kind, g""",
    "servo_pairs": f"WITH {FRAMES_SQL}, {ASYM_SQL} SELECT log_id, axis, reference, servo, {r('lag_ms', 'lag_ms')}, {r('r', 'r')}, {r('ratio', 'ratio')}, severity FROM asym",
    "axis_servo_sum": f"WITH {FRAMES_SQL}, {CORR_SQL} SELECT l.log_id, axis, frame_idx, {r('sum(CASE WHEN rr >= 0 THEN 1 ELSE -1 END * (pwm - 1500.0))', 'servo_sum')} FROM l JOIN lead_ ON lead_.log_id = l.log_id AND lead_.servo = l.servo GROUP BY 1, 2, 3",
    "probe_strided": f"""WITH {FRAMES_SQL}, x AS ({' UNION ALL '.join(f"SELECT log_id, frame_idx, '{n}' AS field, {n} AS x FROM frames" for n in ("v", "axisD_0", "servo_0", "wingSpa_1"))})
        SELECT log_id, field, max(CASE WHEN x <> 0 THEN 1 ELSE 0 END) = 0 AS all_zero, {r("min(x)", "value_min")}, {r("max(x)", "value_max")} FROM x WHERE (frame_idx + 1) % 8 = 0 GROUP BY 1, 2""",
    "recommendations": f"""WITH {COUP_SQL}, {FF_SQL.split(MAN_SQL + ",", 1)[1]}, {gate_sql(16, 0.1, 0.2, 0.6)}, {ASYM_SQL}, {_shares},
        pf AS (SELECT DISTINCT log_id, CASE log_id % 4 WHEN 0 THEN 0.12 WHEN 2 THEN 0.22 ELSE 0.15 END AS lim FROM frames),
        ne AS (SELECT log_id, axis, count(*) AS n FROM gev GROUP BY 1, 2), gr AS (SELECT gst.log_id, gst.axis, active_pct, coalesce(n, 0) AS n FROM gst LEFT JOIN ne USING (log_id, axis))
        SELECT log_id, 'pidfs-high-p-low-d-' || lower({_sp.format('axis')}) AS rec_id, 'PID' AS domain, {_sp.format('axis')} AS axis, 'low' AS severity, 'yellow' AS confidence, '' AS cli FROM sh WHERE ps > 0.45 AND ds < 0.08
        UNION ALL SELECT log_id, 'pidfs-i-dominance-' || lower({_sp.format('axis')}), 'PID', {_sp.format('axis')}, CASE WHEN i_s > 0.7 THEN 'high' WHEN i_s > 0.55 THEN 'medium' ELSE 'low' END, 'yellow', '' FROM sh WHERE i_s > 0.4
        UNION ALL SELECT log_id, 'pidfs-f-excessive-' || lower({_sp.format('axis')}), 'PID', {_sp.format('axis')}, 'low', 'yellow', '' FROM sh WHERE fs > 0.4
        UNION ALL SELECT log_id, 'pidfs-s-barely-' || lower({_sp.format('axis')}), 'PID', {_sp.format('axis')}, 'info', 'yellow', '' FROM sh WHERE ss < 0.02
        UNION ALL SELECT log_id, 'ff-' || w || '-' || ['roll', 'pitch', 'yaw'][axis + 1], 'PID', {_sp.format('axis')}, 'low', 'yellow', '' FROM (SELECT log_id, axis, 'noisy' AS w FROM fw WHERE mean_noise > 0.35 UNION ALL SELECT log_id, axis, verdict FROM fw WHERE verdict <> 'healthy')
        UNION ALL SELECT log_id, 'coupling-' || lower({_sp.format('cmd_axis')}) || '-' || lower({_sp.format('resp_axis')}), 'Coupling', {_sp.format('cmd_axis')}, CASE WHEN abs(ratio) >= 2 * lim THEN 'medium' ELSE 'low' END, 'yellow', '' FROM coup JOIN pf USING (log_id) WHERE cmd_axis <> resp_axis AND abs(ratio) >= lim
        UNION ALL SELECT log_id, 'servo-asym-' || ['roll', 'pitch', 'yaw'][axis + 1] || '-servo' || servo, 'Servo', {_sp.format('axis')}, 'low', 'yellow', '' FROM asym WHERE severity = 'warn'
        UNION ALL SELECT log_id, 'spa-clean-' || ['roll', 'pitch', 'yaw'][axis + 1], 'SPA', {_sp.format('axis')}, 'info', 'green', '' FROM gr WHERE n = 0 AND active_pct >= 1
        UNION ALL SELECT log_id, 'spa-events-' || ['roll', 'pitch', 'yaw'][axis + 1], 'SPA', {_sp.format('axis')}, CASE WHEN n >= 5 THEN 'medium' ELSE 'low' END, 'yellow', '' FROM gr WHERE n > 0""",
    "header_filters": f"WITH {CONFIG_SQL} SELECT * FROM cfg",
    "delay_budget": f"WITH {DELAY_SQL} SELECT log_id, stage, {r('ms', 'delay_ms')} FROM dl UNION ALL SELECT log_id, 'total', {r('sum(ms)', 'delay_ms')} FROM dl GROUP BY log_id",
    "filter_params": f"""WITH {HEADERS_SQL} SELECT log_id, CASE WHEN upper({_h('gyro_lpf1_type')}) IN ('PT2', '2') THEN 'PT2' WHEN upper({_h('gyro_lpf1_type')}) IN ('PT3', '3') THEN 'PT3' WHEN upper({_h('gyro_lpf1_type')}) IN ('BIQUAD', '1') THEN 'BIQUAD' ELSE 'PT1' END AS lpf1_type,
        {r(_num('gyro_lpf1_static_hz', 0), 'lpf1_static_hz')}, {r(_nth('gyro_lpf1_dyn_hz', 1), 'lpf1_dyn_min_hz')}, {r(_nth('gyro_lpf1_dyn_hz', 2), 'lpf1_dyn_max_hz')}, {r(_num('dyn_notch_q', 300) + ' / 100', 'notch_q')}, {r(_num('dyn_notch_max_hz', 600), 'notch_max_hz')},
        {r(_num('rpm_filter_harmonics', 0), 'rpm_harmonics')}, {r(_num('rpm_filter_q', 500) + ' / 100', 'rpm_q')}, {r('CAST(1 AS DOUBLE)', 'w0')}, {r(_num('motor_poles', 14), 'motor_poles')} FROM h GROUP BY log_id""",
    "smix_roles": f"""WITH {HEADERS_SQL}, ru AS (SELECT log_id, CAST(split_part(v, ',', 1) AS INT) AS servo, TRY_CAST(split_part(v, ',', 2) AS INT) AS src, CAST(split_part(v, ',', 3) AS INT) AS rate FROM h WHERE regexp_full_match(k, 'smix[0-9]+') AND regexp_full_match(v, '(-?[0-9]+,){{6,}}-?[0-9]+')),
        sv AS (SELECT DISTINCT h.log_id, s AS servo FROM h, (SELECT unnest(generate_series(0, 7)) AS s)),
        g AS (SELECT sv.log_id, sv.servo, {', '.join(f'coalesce(max(CASE WHEN src = {a} THEN 1 END), 0) AS a{a}, coalesce(sum(CASE WHEN src = {a} THEN rate END), 0) AS r{a}' for a in range(3))}, max(CASE WHEN src > 2 THEN 1 ELSE 0 END) AS direct FROM sv LEFT JOIN ru ON ru.log_id = sv.log_id AND ru.servo = sv.servo GROUP BY 1, 2),
        k AS (SELECT *, CASE WHEN a0 = 1 THEN 'roll' WHEN a1 = 1 AND a2 = 1 THEN 'tail' END AS grp, CASE WHEN a0 = 1 THEN r0 ELSE r2 END AS key FROM g), m AS (SELECT *, count(*) OVER (PARTITION BY log_id, grp) AS n, row_number() OVER (PARTITION BY log_id, grp ORDER BY key, servo) AS i FROM k)
        SELECT log_id, servo, CASE WHEN a0 = 1 THEN CASE WHEN a1 = 1 THEN 'elevon-' ELSE 'aileron-' END || CASE WHEN n <> 2 THEN 'paired' WHEN i = 1 THEN 'l' ELSE 'r' END WHEN grp = 'tail' THEN CASE WHEN n = 2 AND i = 2 THEN 'vtail-r' ELSE 'vtail-l' END WHEN a1 = 1 THEN 'elevator' WHEN a2 = 1 THEN 'rudder' WHEN direct = 1 THEN 'other' ELSE 'unknown' END AS role FROM m""",
    "servo_params": f"""WITH {HEADERS_SQL} SELECT log_id, CAST(substr(k, 11) AS BIGINT) AS servo, {', '.join(f"CAST(trim(split_part(v, ',', {i + 1})) AS BIGINT) AS {c}" for i, c in enumerate(("rate", "lo", "hi", "middle", "forward")))} FROM h WHERE regexp_full_match(k, 'servoParam[0-9]+')""",
    "header_search": f"WITH {HEADERS_SQL} SELECT log_id, k AS key, v AS value, 'set ' || k || ' = ' || v AS cli FROM h WHERE contains(lower(k), 'lpf1') OR contains(lower(v), 'lpf1')",
    "signal_resolution": f"WITH {CAPS_SQL} SELECT * FROM rs",
    "module_report": f"WITH {MODULES_SQL}",
    "field_table": f"WITH {CAPS_SQL} SELECT fl.log_id, fl.field, CASE WHEN coalesce(zero, FALSE) THEN 'all-zero' ELSE 'ok' END AS status FROM fl LEFT JOIN ck ON ck.log_id = fl.log_id AND ck.field = fl.field",
    "confidence": f"""WITH {FRAMES_SQL}, {_shares} SELECT log_id, axis, CASE WHEN ps > 0.1 AND i_s < 0.45 AND ds > 0.2 THEN 'green' WHEN NOT ps > 0.1 OR CAST(NOT i_s < 0.45 AS INT) + CAST(NOT ds > 0.2 AS INT) > 1 THEN 'red' ELSE 'yellow' END AS confidence,
        array_to_string([x for x in [CASE WHEN NOT ds > 0.2 THEN 'd' END, CASE WHEN NOT i_s < 0.45 THEN 'i' END, CASE WHEN NOT ps > 0.1 THEN 'p' END] if x IS NOT NULL], ',') AS failed FROM sh""",
    "hyperbolic_eval": "WITH t AS (SELECT i / CAST(100 AS DOUBLE) AS x FROM (SELECT unnest(generate_series(0, 100)) AS i)) SELECT x, " + ", ".join(r(_curve(*p), n) for n, p in CURVES.items()) + " FROM t",
    "region_plan": f"""WITH {MAN_SQL}, nd AS (SELECT DISTINCT log_id, n, dt FROM m1), ax AS (SELECT log_id, n, dt, axis FROM nd, (VALUES (0), (1), (2)) AS v(axis)),
        o AS (SELECT ax.log_id, axis, greatest(start_idx - {half_up("0.02 / ax.dt")}, 0) AS s, least(end_idx + {half_up("0.02 / ax.dt")}, ax.n) AS e FROM man JOIN ax ON ax.log_id = man.log_id AND (kind = 'mixed' OR dominant_axis = axis)),
        p AS (SELECT *, max(e) OVER (PARTITION BY log_id, axis ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM o), g AS (SELECT *, sum(CASE WHEN s - m <= 0 THEN 0 ELSE 1 END) OVER (PARTITION BY log_id, axis ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM p),
        rg AS (SELECT log_id, axis, min(s) AS s, max(e) AS e FROM g GROUP BY log_id, axis, g HAVING max(e) - min(s) >= 12), c AS (SELECT *, sum(e - s) OVER (PARTITION BY log_id, axis) AS cov FROM rg)
        SELECT log_id, axis, s AS start_idx, e AS end_idx, 'manoeuvres' AS mode FROM c WHERE cov >= 24
        UNION ALL SELECT log_id, axis, 0, n, 'whole flight' FROM ax WHERE NOT EXISTS (SELECT 1 FROM c WHERE cov >= 24 AND c.log_id = ax.log_id AND c.axis = ax.axis)""",
    "step_caveat": f"WITH {CAPS_SQL} SELECT log_id, CAST(substr(field, 7, 1) AS BIGINT) AS axis, substr(field, 5, 1) AS term FROM ck WHERE regexp_full_match(field, 'axis[FS].[0-2].') AND greatest(abs(lo), abs(hi)) > 1",
    "profile_hint": f"""WITH {FRAMES_SQL}, s AS (SELECT log_id, CASE WHEN quantile_cont(abs(rcCommand_0), 0.5) < 40 THEN 'cruise' WHEN quantile_cont(abs(rcCommand_0), 0.5) < 45 THEN 'sport' ELSE '3d' END AS suggested, CASE WHEN log_id % 2 = 0 THEN 'cruise' ELSE 'sport' END AS active FROM frames GROUP BY log_id)
        SELECT log_id, suggested, active, log_id || ':' || suggested || ':' || active AS hint_key FROM s WHERE suggested <> active""",
}
