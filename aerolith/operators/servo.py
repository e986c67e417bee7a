"""Servo roles, input-chain latency, left/right asymmetry and hunting."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aerolith.functions import kernels as K
from aerolith.operators.headers import mixer_axis
from aerolith.operators.spectral import per_series
from aerolith.operators.stats import pearson

CENTRE = 1500.0


def pwm_long(frames: DataFrame, servos=(0, 1, 2, 3)) -> DataFrame:
    args = ", ".join(f"{n}, servo_{n}" for n in servos)
    return frames.selectExpr("log_id", "frame_idx", "time_sec", f"stack({len(servos)}, {args}) AS (servo, pwm)")


def active_channels(pwm: DataFrame, least: float = 10.0) -> DataFrame:
    """log_id, servo, travel of channels that move more than ``least``."""
    g = pwm.groupBy("log_id", "servo").agg((F.max("pwm") - F.min("pwm")).alias("travel"))
    return g.where(F.col("travel") > least)


def roles_from_mixer(servos: DataFrame, rules: DataFrame) -> DataFrame:
    """log_id, servo, role from mixer rules; logs without a rule for any of their servos have no rows.

    ``servos``: log_id, servo. Left and right go by ascending rate where exactly two servos share the axis.
    """
    r = rules.select("log_id", F.col("target").alias("servo"), "rate", mixer_axis(F.col("input")).alias("axis"))
    g = servos.join(r, ["log_id", "servo"], "left").groupBy("log_id", "servo").agg(
        *(F.coalesce(F.max(F.when(F.col("axis") == a, 1)), F.lit(0)).alias(f"a{a}") for a in range(3)),
        *(F.coalesce(F.sum(F.when(F.col("axis") == a, F.col("rate"))), F.lit(0)).alias(f"r{a}") for a in (0, 2)),
        F.max(F.when(F.col("rate").isNotNull() & F.col("axis").isNull(), 1).otherwise(0)).alias("direct"),
    )
    g = g.withColumn("any", F.max(F.col("a0") + F.col("a1") + F.col("a2") + F.col("direct")).over(Window.partitionBy("log_id"))).where(F.col("any") > 0)
    g = g.withColumn("tail", (F.col("a0") == 0) & (F.col("a1") == 1) & (F.col("a2") == 1))
    group = F.when(F.col("a0") == 1, "roll").when(F.col("tail"), "tail")
    g = g.withColumns({"grp": group, "key": F.when(F.col("a0") == 1, F.col("r0")).otherwise(F.col("r2"))})
    w = Window.partitionBy("log_id", "grp")
    g = g.withColumns({"n": F.count(F.lit(1)).over(w), "k": F.row_number().over(w.orderBy("key", "servo"))})
    side = F.when(F.col("n") != 2, "paired").when(F.col("k") == 1, "l").otherwise("r")
    name = F.when(F.col("a1") == 1, "elevon").otherwise("aileron")
    tail = F.when((F.col("n") == 2) & (F.col("k") == 2), "vtail-r").otherwise("vtail-l")
    role = (
        F.when(F.col("a0") == 1, F.concat_ws("-", name, side)).when(F.col("tail"), tail).when(F.col("a1") == 1, "elevator").when(F.col("a2") == 1, "rudder")
        .when(F.col("direct") == 1, "other").otherwise("unknown")
    )
    return g.select("log_id", "servo", role.alias("role"))


def roles_from_correlation(corrs: DataFrame, frames: DataFrame, servos=(0, 1, 2, 3), pair: float = 0.5) -> DataFrame:
    """log_id, servo, role from each servo's dominant axis (``stats.axis_correlations``)."""
    n_pitch = F.count(F.when(F.col("dominant_axis") == 1, 1)).over(Window.partitionBy("log_id"))
    roll = corrs.withColumn("n_pitch", n_pitch).where("dominant_axis = 0")
    w = Window.partitionBy("log_id")
    roll = roll.withColumns({"n": F.count(F.lit(1)).over(w), "k": F.row_number().over(w.orderBy("dominant_r", "servo")), "s0": F.min("servo").over(w), "s1": F.max("servo").over(w)})
    value = lambda c: F.element_at(F.array(*(F.col(f"servo_{s}") for s in servos)), F.array_position(F.array(*map(F.lit, servos)), F.col(c)).cast("int"))
    two = roll.where("n = 2").select("log_id", "s0", "s1").distinct()
    both = frames.join(two, "log_id").groupBy("log_id").agg(pearson(value("s0"), value("s1")).alias("pair_r"))
    kind = F.when(F.col("n_pitch") > 0, "aileron").otherwise("elevon")
    side = F.when(F.col("pair_r") >= pair, "paired").when(F.col("k") == 1, "l").otherwise("r")
    named = roll.join(both, "log_id", "left").select("log_id", "servo", F.when(F.col("n") == 2, F.concat_ws("-", kind, side)).otherwise("other").alias("role"))
    rest = corrs.where("dominant_axis is null or dominant_axis <> 0").select("log_id", "servo", F.when(F.col("dominant_axis") == 1, "elevator").when(F.col("dominant_axis") == 2, "rudder").otherwise("unknown").alias("role"))
    return named.unionByName(rest)


def classify_servos(by_mixer: DataFrame, by_correlation: DataFrame) -> DataFrame:
    """Mixer roles where a log has them, else correlation roles."""
    a = by_mixer.withColumn("via", F.lit("mixer"))
    logs = by_mixer.select("log_id").distinct()
    return a.unionByName(by_correlation.join(logs, "log_id", "left_anti").withColumn("via", F.lit("correlation")))


def axis_aggregate(frames: DataFrame, corrs: DataFrame, servos=(0, 1, 2, 3)) -> DataFrame:
    """log_id, axis, frame_idx, servo_sum: signed travel of the servos that are dominant on the axis."""
    lead = corrs.where("dominant_axis is not null").select("log_id", "servo", F.col("dominant_axis").alias("axis"), F.when(F.col("dominant_r") >= 0, 1.0).otherwise(-1.0).alias("sign"))
    rows = pwm_long(frames, servos).join(lead, ["log_id", "servo"])
    return rows.groupBy("log_id", "axis", "frame_idx").agg(F.sum(F.col("sign") * (F.col("pwm") - CENTRE)).alias("servo_sum"))


def input_chain(rows: DataFrame, fs: float, keys=("log_id", "axis"), **how) -> DataFrame:
    """keys, a_ms, b_ms, c_ms, total_ms and r of stages command to setpoint, setpoint to servo, servo to gyro.

    ``rows``: rc, sp, servo_sum, gyro. A stage's lag is the median over accepted windows (null if none).
    """

    def stage(x, y):
        found = K.window_lags(x, y, fs, **how)
        if not found:
            return None, None, 0
        lag, r = np.median([f[0] for f in found]), np.median([f[1] for f in found])
        return float(lag) / fs * 1000, float(r), len(found)

    def kernel(s):
        s = {k: np.nan_to_num(v.astype(float)) for k, v in s.items()}
        got = [stage(s["rc"], s["sp"]), stage(s["sp"], s["servo_sum"]), stage(s["servo_sum"], s["gyro"])]
        total = sum(g[0] for g in got) if all(g[0] is not None for g in got) else None
        return {f"{n}_{c}": [g[i]] for n, g in zip("abc", got) for i, c in enumerate(("ms", "r", "n"))} | {"total_ms": [total]}

    schema = ", ".join(f"{n}_ms double, {n}_r double, {n}_n long" for n in "abc") + ", total_ms double"
    return per_series(rows, keys, ["rc", "sp", "servo_sum", "gyro"], kernel, schema)


#: Latency limits in ms, good and bad, of each stage and in all (fixed values).
CHAIN_LIMITS = {"a_ms": (5, 15), "b_ms": (20, 50), "c_ms": (20, 50), "total_ms": (40, 100)}


def chain_tones(chain: DataFrame) -> DataFrame:
    tone = lambda c, lo, hi: F.when(F.col(c).isNull(), "unknown").when(F.col(c) < lo, "good").when(F.col(c) < hi, "warn").otherwise("bad")
    return chain.withColumns({c.replace("_ms", "_tone"): tone(c, lo, hi) for c, (lo, hi) in CHAIN_LIMITS.items()})


def servo_asymmetry(frames: DataFrame, corrs: DataFrame, fs: float, window_ms: float = 30.0, least: float = 0.25, servos=(0, 1, 2, 3)) -> DataFrame:
    """log_id, axis, reference, servo, lag_ms, r, ratio, severity of each servo against its axis' strongest one.

    Both series are centred on 1500 and turned by the sign of their correlation; a lag's product is divided by the frames
    and both deviations. The least lag among the best (to nine places) counts.
    """
    lead = corrs.where(F.abs("dominant_r") >= least).select("log_id", "servo", F.col("dominant_axis").alias("axis"), "dominant_r")
    w = Window.partitionBy("log_id", "axis").orderBy(F.desc(F.round(F.abs("dominant_r"), 9)), "servo")  # mirrored servos tie
    lead = lead.withColumns({"reference": F.first("servo").over(w), "sign": F.when(F.col("dominant_r") >= 0, 1.0).otherwise(-1.0)})
    lead = lead.withColumn("n_servos", F.count(F.lit(1)).over(Window.partitionBy("log_id", "axis"))).where("n_servos > 1")
    rows = pwm_long(frames, servos).join(lead, ["log_id", "servo"]).withColumn("x", F.col("sign") * (F.col("pwm") - CENTRE))
    most = int(round(window_ms / 1000 * fs))

    def kernel(s):
        reference, out = int(s["reference"][0]), {c: [] for c in ("reference", "servo", "lag_ms", "r", "ratio")}
        parts = {int(k): s["x"][s["servo"] == k].astype(float) for k in np.unique(s["servo"])}
        a = parts.pop(reference)
        spread = a.std()
        for servo, b in parts.items():
            n, sd = min(len(a), len(b)), b.std()
            lags = np.arange(-min(most, n - 1), min(most, n - 1) + 1)
            dots = np.array([a[max(0, -k) : n - max(0, k)] @ b[max(0, k) : n - max(0, -k)] for k in lags])
            r = dots / (n * sd * spread) if sd > 0 and spread > 0 else np.zeros(len(lags))
            k = int(np.round(np.abs(r), 9).argmax())
            for c, v in zip(out, (reference, servo, lags[k] * 1000.0 / fs, r[k], sd / spread if spread > 0 else 0.0)):
                out[c].append(v)
        return out

    out = per_series(rows, ("log_id", "axis"), ["servo", "reference", "x"], kernel, "reference int, servo int, lag_ms double, r double, ratio double")
    severity = F.when(F.col("r") < 0.5, "inconclusive").when((F.abs("lag_ms") <= 10) & F.col("ratio").between(0.7, 1.3), "ok").otherwise("warn")
    return out.withColumn("severity", severity)


def servo_hunt(rows: DataFrame, fs: float, keys=("log_id", "servo"), cutoff: float = 20.0, window_ms: float = 30.0, watch: float = 3.0, hunt: float = 8.0) -> DataFrame:
    """keys, rms, coupling, score, severity: fast servo motion that the setpoint does not explain. ``rows``: pwm, sp."""

    def kernel(s):
        x, y = (np.nan_to_num(s[c].astype(float)) for c in ("pwm", "sp"))
        if len(x) < 256 or not np.any(y):
            return {"rms": [None], "coupling": [None], "score": [None], "severity": ["unknown"]}
        a, b = K.high_pass(x, fs, cutoff), K.high_pass(y, fs, cutoff)
        rms = float(np.sqrt((a * a).mean()))
        r = float(np.abs(K.cross_correlation(a, b, int(round(window_ms / 1000 * fs)))).max())
        score = rms * (1 - min(1.0, r))
        return {"rms": [rms], "coupling": [r], "score": [score], "severity": ["hunt" if score >= hunt else "watch" if score >= watch else "ok"]}

    return per_series(rows, keys, ["pwm", "sp"], kernel, "rms double, coupling double, score double, severity string")


def pilot_style(frames: DataFrame, deadband: float = 25.0, least_sec: float = 3.0, least_rms: float = 5.0) -> DataFrame:
    """log_id, per-axis RMS, reversals and stroke percentiles; suggested profile and correction character of the log.

    The verdict looks at roll and pitch; an axis without strokes lends its RMS as amplitude.
    """

    def kernel(s):
        t = s["time_sec"].astype(float)
        sec = max(0.0, t[-1] - t[0]) if len(t) > 1 else 0.0
        out: dict = {"duration_sec": [sec]}
        rms, rate, amp = [], [], []
        for a in range(3):
            x = np.nan_to_num(s[f"rcCommand_{a}"].astype(float))
            found = K.strokes(x, deadband) if sec > 0 else []
            r = float(np.sqrt((x * x).mean())) if sec > 0 else 0.0
            p50, p90 = (float(v) for v in np.percentile(found, (50, 90))) if found else (math.nan, math.nan)
            out |= {f"rms_{a}": [r], f"reversals_{a}": [len(found)], f"stroke_median_{a}": [p50], f"stroke_p90_{a}": [p90]}
            if a < 2:
                rms.append(r)
                rate.append(len(found) / sec if sec > 0 else 0.0)
                amp.append(p90 if math.isfinite(p90) else r)
        judged = sec >= least_sec and max(rms) >= least_rms
        profile = ("cruise" if max(amp) < 80 else "sport" if max(amp) < 220 else "3d") if judged else None
        character = ("calm" if max(rate) < 0.5 else "active" if max(rate) < 2 else "busy") if judged else None
        return out | {"profile": [profile], "character": [character]}

    per_axis = ", ".join(f"rms_{a} double, reversals_{a} long, stroke_median_{a} double, stroke_p90_{a} double" for a in range(3))
    return per_series(frames, ("log_id",), ["time_sec", "rcCommand_0", "rcCommand_1", "rcCommand_2"], kernel, f"duration_sec double, {per_axis}, profile string, character string")
