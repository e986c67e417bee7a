"""Queries on time axes, statistics and segments, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerolith.flight import FlightSession
from aerolith.operators import diagnostics as D
from aerolith.operators import stats as S
from aerolith.operators import timeaxis as T
from aerolith.operators.segments import frames_in, hysteresis, merge_gaps, runs
from aerolith.sources.virtual_logs import FRAMES_SQL, axis_frames, flight_frames


def rounded(df, digits: int = 6):
    """Doubles rounded; negative zero becomes zero, NaN null."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if f.dataType.simpleString() == "double":
            c = F.when(~F.isnan(c), F.round(c, digits) + F.lit(0.0)).alias(f.name)
        elif f.dataType.simpleString() == "int":
            c = c.cast("bigint").alias(f.name)
        out.append(c)
    return df.select(*out)


def r(expr: str, name: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0 AS {name}"


def q_sample_rates(spark, d):
    return rounded(T.sample_rates(flight_frames(spark, d), "real_sec"))


def q_boxcar(spark, d):
    f = flight_frames(spark, d)
    return rounded(f.select("log_id", "frame_idx", *(T.boxcar(F.col("v"), n, T.ordered()).alias(f"w{n}") for n in T.SMOOTH_WIDTHS)), 8)


def q_hold_last(spark, d):
    f = flight_frames(spark, d)
    return rounded(f.select("log_id", "frame_idx", *(T.hold_last(F.when(F.col("event_type") == e, F.col("v")), T.ordered()).alias(e) for e in ("click", "view", "error"))))


def q_velocity(spark, d):
    f = flight_frames(spark, d)
    return rounded(f.select("log_id", "frame_idx", T.central_velocity(F.col("setpoint_0"), F.lit(0.01), T.ordered()).alias("central"), T.backward_rate(F.col("v"), F.col("real_sec"), T.ordered()).alias("backward")))


def q_interp(spark, d):
    f = flight_frames(spark, d)
    src = f.where("event_type = 'click'").select("log_id", F.col("real_sec").alias("time_sec"), "v")
    return rounded(T.interpolate(src, f.select("log_id", "frame_idx", F.col("real_sec").alias("time_sec")), "v").drop("time_sec"))


def q_onto_ref(spark, d):
    f = flight_frames(spark, d)
    ref = f.where("log_id = 0").select(F.col("frame_idx").alias("ref_idx"), "time_sec")
    offsets = f.select("log_id").distinct().select("log_id", (F.col("log_id") * 0.004).alias("offset_sec"))
    return rounded(T.onto_reference(f, ref, "v", offsets=offsets).select("log_id", "ref_idx", "v"))


def q_nearest(spark, d):
    f = flight_frames(spark, d)
    at = f.select("log_id").distinct().select("log_id", F.explode(F.array(*(F.lit(x) for x in (-1.0, 0.123, 0.255, 9.0)))).alias("at_sec"))
    return T.nearest_index(f, at)


def q_decimate(spark, d):
    f = flight_frames(spark, d)
    a = T.block_mean(f, "v", 5).withColumnRenamed("v", "mean").withColumn("kind", F.lit("whole"))
    b = T.fractional_blocks(f, "v", 2.5).withColumnRenamed("v", "mean").withColumn("kind", F.lit("fraction"))
    return rounded(a.unionByName(b))


def q_magnitude(spark, d):
    f = flight_frames(spark, d)
    return rounded(f.select("log_id", "frame_idx", T.magnitude(*(F.col(f"gyroADC_{a}") for a in range(3))).alias("gyro")))


def q_align_times(spark, d):
    """Session times (time plus offset), and the longest log as the reference."""
    f = flight_frames(spark, d)
    s = FlightSession(f, f.select("log_id").distinct().select("log_id", (F.col("log_id") * 0.5).alias("offset_sec")))
    g = s.session_time().groupBy("log_id").agg(F.count(F.lit(1)).alias("n"), F.min("session_sec").alias("first"), F.max("session_sec").alias("last"))
    return rounded(g.join(s.reference_log().withColumn("is_ref", F.lit(True)), "log_id", "left").withColumn("is_ref", F.coalesce("is_ref", F.lit(False))))


def q_term_shares(spark, d):
    return rounded(S.term_shares(axis_frames(flight_frames(spark, d))))


def q_pearson(spark, d):
    return rounded(S.axis_correlations(flight_frames(spark, d)).withColumn("dominant_axis", F.coalesce("dominant_axis", F.lit(-1))))


def q_percentiles(spark, d):
    f = flight_frames(spark, d)
    a = f.groupBy("log_id").agg(S.percentile_linear(F.col("v"), 0.5).alias("median"), S.percentile_linear(F.col("v"), 0.9).alias("p90"))
    near = S.percentile_nearest(f, "v", 95.0).withColumnRenamed("value", "near95")
    return rounded(a.join(near, "log_id"))


def q_coverage(spark, d):
    f = flight_frames(spark, d).select("log_id", "frame_idx", "time_sec", F.col("gps_speed").alias("speed"), ((F.col("rcCommand_3") - 1000.0) / 1000.0).alias("throttle"), F.radians(-F.col("attitude_1") / 10.0).alias("pitch"), F.col("vbatLatest").alias("vbat"))
    out = S.speed_coverage(f)
    return rounded(out.select(*(c for c in out.columns if c != "histogram"), *(F.col("histogram")[i].alias(f"bin{i}") for i in range(8))))


def q_fidelity(spark, d):
    rows = axis_frames(flight_frames(spark, d)).select("log_id", "axis", "frame_idx", F.col("sp").alias("ref"), F.col("gyro").alias("sim"))
    return rounded(S.model_fidelity(rows, ("log_id", "axis"), warmup=10))


def q_channels(spark, d):
    from aerolith.operators.servo import active_channels, pwm_long

    return rounded(active_channels(pwm_long(flight_frames(spark, d)), 450.0))


def q_runs(spark, d):
    f = flight_frames(spark, d).withColumn("open", hysteresis(F.col("v"), 80.0, 30.0, T.ordered()))
    return rounded(runs(f, "open", mean=F.avg("v")))


def q_interval_merge(spark, d):
    f = flight_frames(spark, d)
    w = f.where("v > 120").select("log_id", (F.col("frame_idx") - 2).alias("start_idx"), (F.col("frame_idx") + 3).alias("end_idx"))
    return merge_gaps(w, F.lit(1))


def q_first_crossing(spark, d):
    return rounded(D.first_crossing(flight_frames(spark, d), level=1400.0))


QUERIES = {
    "sample_rates": q_sample_rates, "boxcar_smooth": q_boxcar, "hold_last": q_hold_last, "velocity_rates": q_velocity, "interp_resample": q_interp, "nearest_resample": q_onto_ref,
    "nearest_time_index": q_nearest, "block_decimate": q_decimate, "gyro_magnitude": q_magnitude, "session_times": q_align_times, "term_shares": q_term_shares, "pearson_matrix": q_pearson,
    "percentiles": q_percentiles, "speed_coverage": q_coverage, "model_fidelity": q_fidelity, "active_channels": q_channels, "state_runs": q_runs, "interval_merge": q_interval_merge,
    "first_crossing": q_first_crossing,
}

WIN = "WINDOW w AS (PARTITION BY log_id ORDER BY frame_idx)"
_terms = "p i d f s".split()

ORACLE_SQL = {
    "sample_rates": f"""WITH {FRAMES_SQL},
        x AS (SELECT log_id, frame_idx, real_sec AS t, lag(real_sec) OVER w AS b, count(*) OVER (PARTITION BY log_id) AS n FROM frames {WIN}),
        g AS (SELECT log_id, max(CASE WHEN frame_idx = n // 2 THEN t - b END) AS mid, count(*) AS n, min(t) AS t0, max(t) AS t1 FROM x GROUP BY log_id)
        SELECT log_id, n, {r("CASE WHEN n >= 2 AND mid > 0 THEN 1 / mid ELSE 0.0 END", "midpoint_hz")}, {r("CASE WHEN n >= 2 AND t1 > t0 THEN (n - 1) / (t1 - t0) ELSE 1000.0 END", "mean_hz")},
               {r("CASE WHEN n >= 2 AND t1 > t0 THEN (t1 - t0) / (n - 1) END", "mean_dt")} FROM g""",
    "boxcar_smooth": f"WITH {FRAMES_SQL} SELECT log_id, frame_idx, " + ", ".join(r(f"avg(v) OVER (w ROWS BETWEEN {n // 2} PRECEDING AND {n // 2} FOLLOWING)", f"w{n}", 8) for n in T.SMOOTH_WIDTHS) + f" FROM frames {WIN}",
    "hold_last": f"WITH {FRAMES_SQL} SELECT log_id, frame_idx, " + ", ".join(r(f"last_value(CASE WHEN event_type = '{e}' THEN v END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", e) for e in ("click", "view", "error")) + f" FROM frames {WIN}",
    "velocity_rates": f"""WITH {FRAMES_SQL}, x AS (SELECT log_id, frame_idx, setpoint_0 AS s, lag(setpoint_0) OVER w AS b, lead(setpoint_0) OVER w AS a, v, lag(v) OVER w AS bv, real_sec AS t, lag(real_sec) OVER w AS bt FROM frames {WIN})
        SELECT log_id, frame_idx, {r("coalesce((a - b) / 0.02, (a - s) / 0.01, (s - b) / 0.01, 0.0)", "central")}, {r("CASE WHEN t - bt > 0 THEN (v - bv) / (t - bt) ELSE 0.0 END", "backward")} FROM x""",
    "interp_resample": f"""WITH {FRAMES_SQL}, s AS (SELECT log_id, real_sec AS t, v FROM frames WHERE event_type = 'click'),
        x AS (SELECT f.log_id, f.frame_idx, f.real_sec AS t, (SELECT max(s.t) FROM s WHERE s.log_id = f.log_id AND s.t <= f.real_sec) AS tb, (SELECT min(s.t) FROM s WHERE s.log_id = f.log_id AND s.t >= f.real_sec) AS ta FROM frames f)
        SELECT x.log_id, frame_idx, {r("CASE WHEN tb IS NULL AND ta IS NULL THEN 0.0 WHEN tb IS NULL THEN a.v WHEN ta IS NULL OR ta <= tb THEN b.v ELSE b.v + (a.v - b.v) * (x.t - tb) / (ta - tb) END", "v")}
        FROM x LEFT JOIN s a ON a.log_id = x.log_id AND a.t = ta LEFT JOIN s b ON b.log_id = x.log_id AND b.t = tb""",
    "nearest_resample": f"""WITH {FRAMES_SQL}, g AS (SELECT log_id, min(time_sec) AS t0, (max(time_sec) - min(time_sec)) / (count(*) - 1) AS dt, count(*) AS n FROM frames GROUP BY log_id),
        x AS (SELECT g.log_id, f.frame_idx AS ref_idx, n, CAST(floor((f.time_sec - g.log_id * CAST(0.004 AS DOUBLE) - t0) / dt + 0.5) AS BIGINT) AS i FROM g, (SELECT * FROM frames WHERE log_id = 0) f)
        SELECT x.log_id, ref_idx, {r("v", "v")} FROM x LEFT JOIN frames f ON f.log_id = x.log_id AND f.frame_idx = CASE WHEN i BETWEEN 0 AND n - 1 THEN i END""",
    "nearest_time_index": f"""WITH {FRAMES_SQL}, a AS (SELECT DISTINCT log_id, x AS at_sec FROM frames, (VALUES (CAST(-1 AS DOUBLE)), (CAST(0.123 AS DOUBLE)), (CAST(0.255 AS DOUBLE)), (CAST(9 AS DOUBLE))) AS t(x)),
        k AS (SELECT a.log_id, at_sec, frame_idx, row_number() OVER (PARTITION BY a.log_id, at_sec ORDER BY abs(time_sec - at_sec), frame_idx) AS n FROM a JOIN frames USING (log_id)) SELECT log_id, at_sec, frame_idx FROM k WHERE n = 1""",
    "block_decimate": f"""WITH {FRAMES_SQL}, n AS (SELECT log_id, count(*) AS n FROM frames GROUP BY log_id),
        k AS (SELECT log_id, n, unnest(generate_series(0, n)) AS block FROM n)
        SELECT log_id, frame_idx // 5 AS block, {r("avg(v)", "mean")}, 'whole' AS kind FROM frames GROUP BY 1, 2 HAVING count(*) = 5
        UNION ALL SELECT f.log_id, block, {r("avg(v)", "mean")}, 'fraction' FROM k JOIN frames f ON f.log_id = k.log_id AND f.frame_idx >= floor(block * 2.5) AND f.frame_idx < floor((block + 1) * 2.5)
        WHERE floor((block + 1) * 2.5) <= n GROUP BY 1, 2""",
    "gyro_magnitude": f"WITH {FRAMES_SQL} SELECT log_id, frame_idx, {r('sqrt(gyroADC_0 * gyroADC_0 + gyroADC_1 * gyroADC_1 + gyroADC_2 * gyroADC_2)', 'gyro')} FROM frames",
    "session_times": f"""WITH {FRAMES_SQL}, g AS (SELECT log_id, count(*) AS n, min(time_sec) + log_id * 0.5 AS first, max(time_sec) + log_id * 0.5 AS last FROM frames GROUP BY log_id)
        SELECT log_id, n, {r("first", "first")}, {r("last", "last")}, row_number() OVER (ORDER BY n DESC, log_id) = 1 AS is_ref FROM g""",
    "term_shares": f"""WITH {FRAMES_SQL}, g AS (SELECT log_id, axis, {', '.join(f'avg(abs({t})) AS {t}' for t in _terms)} FROM axes GROUP BY 1, 2), k AS (SELECT *, p + i + d + f + s AS total, greatest(p, i, d, f, s) AS top FROM g)
        SELECT log_id, axis, {', '.join(r(f"CASE WHEN total > 0 THEN {t} / total ELSE 0.0 END", f"{t}_share") for t in _terms)},
               CASE WHEN total > 0 THEN CASE WHEN p = top THEN 'P' WHEN i = top THEN 'I' WHEN d = top THEN 'D' WHEN f = top THEN 'F' ELSE 'S' END END AS dominant FROM k""",
    "pearson_matrix": f"""WITH {FRAMES_SQL}, l AS ({' UNION ALL '.join(f'SELECT log_id, {n} AS servo, servo_{n} AS pwm, setpoint_0, setpoint_1, setpoint_2 FROM frames' for n in range(4))}),
        g AS (SELECT log_id, servo, {', '.join(f'coalesce(CASE WHEN stddev_pop(pwm) > 0 AND stddev_pop(setpoint_{a}) > 0 THEN corr(pwm, setpoint_{a}) END, 0) AS r{a}' for a in range(3))} FROM l GROUP BY 1, 2),
        k AS (SELECT *, CASE WHEN greatest(abs(r0), abs(r1), abs(r2)) > 0.25 THEN CASE WHEN abs(r0) = greatest(abs(r0), abs(r1), abs(r2)) THEN 0 WHEN abs(r1) = greatest(abs(r0), abs(r1), abs(r2)) THEN 1 ELSE 2 END END AS dominant_axis FROM g)
        SELECT log_id, servo, {r("r0", "r0")}, {r("r1", "r1")}, {r("r2", "r2")}, coalesce(dominant_axis, -1) AS dominant_axis, {r("CASE dominant_axis WHEN 0 THEN r0 WHEN 1 THEN r1 WHEN 2 THEN r2 END", "dominant_r")} FROM k""",
    "percentiles": f"""WITH {FRAMES_SQL}, k AS (SELECT log_id, v, row_number() OVER (PARTITION BY log_id ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY log_id) AS n FROM frames)
        SELECT log_id, {r("quantile_cont(v, 0.5)", "median")}, {r("quantile_cont(v, 0.9)", "p90")}, {r("max(CASE WHEN i = floor(0.95 * (n - 1) + 0.5) THEN v END)", "near95")} FROM k GROUP BY log_id""",
    "speed_coverage": f"""WITH {FRAMES_SQL}, x AS (SELECT log_id, time_sec, gps_speed AS s, vbatLatest AS b, radians(-attitude_1 / 10.0) AS pitch, CASE WHEN abs((rcCommand_3 - 1000.0) / 1000.0 - lag((rcCommand_3 - 1000.0) / 1000.0) OVER w) > 0.15 THEN 1 ELSE 0 END AS jump FROM frames {WIN}),
        y AS (SELECT *, least(floor(s / greatest(max(s) OVER (PARTITION BY log_id), 1.0) * 8), 7) AS bin FROM x)
        SELECT log_id, {r("min(s)", "speed_min")}, {r("max(s)", "speed_max")}, {r("CASE WHEN max(time_sec) > min(time_sec) THEN sum(jump) / ((max(time_sec) - min(time_sec)) / 60.0) ELSE 0.0 END", "jumps_per_min")},
               {r("count(*) FILTER (WHERE pitch < -0.17453292519943295) / count(*)", "dive_share")}, {r("count(*) FILTER (WHERE pitch > 0.17453292519943295) / count(*)", "climb_share")}, {r("(max(b) - min(b)) / max(b)", "sag")},
               {', '.join(f'count(*) FILTER (WHERE bin = {i}) AS bin{i}' for i in range(8))} FROM y GROUP BY log_id""",
    "model_fidelity": f"""WITH {FRAMES_SQL} SELECT log_id, axis, count(*) AS n, {r("CASE WHEN sum(sp * sp) > 0 THEN sqrt(sum((gyro - sp) * (gyro - sp)) / sum(sp * sp)) END", "nrmse")}, {r("greatest(1 - CASE WHEN sum(sp * sp) > 0 THEN sqrt(sum((gyro - sp) * (gyro - sp)) / sum(sp * sp)) END, 0.0)", "fidelity")}
        FROM axes WHERE frame_idx >= 10 GROUP BY 1, 2""",
    "active_channels": f"""WITH {FRAMES_SQL}, l AS ({' UNION ALL '.join(f'SELECT log_id, {n} AS servo, servo_{n} AS pwm FROM frames' for n in range(4))}) SELECT log_id, servo, {r("max(pwm) - min(pwm)", "travel")} FROM l GROUP BY 1, 2 HAVING max(pwm) - min(pwm) > 450""",
    "state_runs": f"""WITH {FRAMES_SQL}, x AS (SELECT *, coalesce(last_value(CASE WHEN v >= 80 THEN 1 WHEN v < 30 THEN 0 END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS open FROM frames {WIN}),
        y AS (SELECT *, CASE WHEN open = lag(open) OVER w THEN 0 ELSE 1 END AS ch FROM x {WIN}), z AS (SELECT *, sum(ch) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM y {WIN})
        SELECT log_id, open, min(frame_idx) AS start_idx, max(frame_idx) + 1 AS end_idx, {r("avg(v)", "mean")} FROM z GROUP BY log_id, g, open""",
    "interval_merge": f"""WITH {FRAMES_SQL}, x AS (SELECT log_id, frame_idx - 2 AS s, frame_idx + 3 AS e FROM frames WHERE v > 120), y AS (SELECT *, max(e) OVER (PARTITION BY log_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM x),
        z AS (SELECT *, sum(CASE WHEN s - m <= 1 THEN 0 ELSE 1 END) OVER (PARTITION BY log_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM y) SELECT log_id, min(s) AS start_idx, max(e) AS end_idx FROM z GROUP BY log_id, g""",
    "first_crossing": f"""WITH {FRAMES_SQL}, x AS (SELECT log_id, frame_idx, time_sec, rcCommand_3 AS c, lag(rcCommand_3) OVER w AS b FROM frames {WIN}),
        g AS (SELECT log_id, min(CASE WHEN b < 1400 AND c >= 1400 THEN time_sec END) AS t, max(CASE WHEN frame_idx = 0 AND c >= 1400 THEN 1 ELSE 0 END) AS up FROM x GROUP BY log_id)
        SELECT log_id, {r("CASE WHEN up = 0 THEN t END", "first_sec")}, up = 0 AND t IS NOT NULL AS detected FROM g""",
}
