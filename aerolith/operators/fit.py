"""Model fits and filter simulation, one group for each log."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolith.functions import kernels as K
from aerolith.functions.columns import clamp, finite, half_up
from aerolith.operators.spectral import per_series
from aerolith.operators.timeaxis import interpolate

PARAMS = ("lpf1_type", "lpf1_static_hz", "lpf1_dyn_min_hz", "lpf1_dyn_max_hz", "lpf1_dyn_expo", "notch_count", "notch_q", "notch_min_hz", "notch_max_hz",
          "rpm_harmonics", "rpm_q", "rpm_min_hz", "rpm_fade_hz", "rpm_lpf_hz", "rpm_weights", "motor_poles")


def max_voltage_x100(header: Column, peak: Column) -> Column:
    """Full battery voltage times 100: the header's value if it is plausible, else the peak."""
    v = F.trim(header).try_cast("int")
    return F.when(v.between(420, 8400), v).otherwise(half_up(clamp(peak * 100.0, 420.0, 8400.0)).cast("int"))


def airspeed_inputs(frames: DataFrame, gps: DataFrame, header: DataFrame | None = None, least: int = 10) -> DataFrame:
    """log_id, frame_idx, time_sec, throttle, vbat, pitch, gps_speed, full_volts on the frames within the GPS times.

    ``frames``: rcCommand_3, vbatLatest, attitude_1 (tenths of a degree, null: level); ``gps``: log_id, time_sec,
    gps_speed; ``header``: log_id, tpa_speed_max_voltage.
    """
    ends = gps.groupBy("log_id").agg(F.min("time_sec").alias("g0"), F.max("time_sec").alias("g1"))
    inside = frames.join(ends, "log_id").where("time_sec between g0 and g1")
    speed = interpolate(gps, inside.select("log_id", "frame_idx", "time_sec"), "gps_speed").drop("time_sec")
    info = inside.groupBy("log_id").agg(F.max(finite(F.col("vbatLatest"))).alias("peak"), F.count(F.lit(1)).alias("n"), F.count("attitude_1").alias("n_pitch")).where(F.col("n") >= least)
    info = info.join(header, "log_id", "left") if header is not None else info.withColumn("tpa_speed_max_voltage", F.lit(None).cast("string"))
    volts = max_voltage_x100(F.col("tpa_speed_max_voltage"), F.col("peak")) / 100.0
    info = info.select("log_id", volts.alias("full_volts"), (F.col("n_pitch") == 0).alias("pitch_missing"))
    out = inside.join(speed, ["log_id", "frame_idx"]).join(info, "log_id")
    return out.select(
        "log_id", "frame_idx", "time_sec", clamp((F.col("rcCommand_3") - 1000.0) / 1000.0, 0.0, 1.0).alias("throttle"), F.col("vbatLatest").alias("vbat"),
        F.coalesce(F.radians(-F.col("attitude_1") / 10.0), F.lit(0.0)).alias("pitch"), "gps_speed", "full_volts", "pitch_missing",
    )


SIGNALS = ["time_sec", "throttle", "vbat", "pitch", "gps_speed", "full_volts"]


def fit_airspeed(inputs: DataFrame, most: int = 250) -> DataFrame:
    """log_id, delay_ms, gravity_pct, r2, rms, iterations, converged."""

    def kernel(s):
        return {k: [v] for k, v in K.fit_airspeed(*(s[c].astype(float) for c in SIGNALS[:5]), float(s["full_volts"][0]), most).items()}

    return per_series(inputs, ("log_id",), SIGNALS, kernel, "delay_ms double, gravity_pct double, r2 double, rms double, iterations long, converged boolean")


def whole_log_airspeed(frames: DataFrame, fitted: DataFrame) -> DataFrame:
    """log_id, frame_idx, airspeed from fitted parameters over all frames. ``frames``: as from airspeed_inputs."""
    rows = frames.join(fitted.select("log_id", "delay_ms", "gravity_pct"), "log_id")

    def kernel(s):
        one = lambda c: float(s[c][0])
        v = K.airspeed(one("delay_ms"), one("gravity_pct"), *(s[c].astype(float) for c in SIGNALS[:4]), one("full_volts"))
        return {"frame_idx": s["frame_idx"], "airspeed": v}

    signals = ["frame_idx", *SIGNALS[:4], "full_volts", "delay_ms", "gravity_pct"]
    return per_series(rows, ("log_id",), signals, kernel, "frame_idx long, airspeed double")


def tpa_inputs(frames: DataFrame, arg: str, factor: str, least: float = 0.05) -> DataFrame:
    """log_id, frame_idx, x, y in units of 1, points with x of ``least`` or more."""
    return frames.select("log_id", "frame_idx", (F.col(arg) / 1000.0).alias("x"), (F.col(factor) / 1000.0).alias("y")).where(F.col("x") >= least)


def tpa_coverage(points: DataFrame, dt: float) -> DataFrame:
    """Range of x and seconds in its lower, middle and upper third."""
    from pyspark.sql import Window

    w = Window.partitionBy("log_id")
    lo, hi = F.min("x").over(w), F.max("x").over(w)
    p = points.withColumns({"a": lo + (hi - lo) / 3.0, "b": lo + (hi - lo) * 2.0 / 3.0})
    return p.groupBy("log_id").agg(
        F.min("x").alias("x_min"), F.max("x").alias("x_max"), (F.count(F.when(F.col("x") <= F.col("a"), 1)) * dt).alias("low_sec"),
        (F.count(F.when((F.col("x") > F.col("a")) & (F.col("x") < F.col("b")), 1)) * dt).alias("mid_sec"), (F.count(F.when(F.col("x") >= F.col("b"), 1)) * dt).alias("high_sec"),
        F.count(F.lit(1)).alias("n"),
    )


def fit_hyperbolic(points: DataFrame, most: int = 800) -> DataFrame:
    """log_id, thr0, thr100, stall, expo, rms, iterations, converged."""

    def kernel(s):
        return {k: [v] for k, v in K.fit_hyperbolic(s["x"].astype(float), s["y"].astype(float), most).items()}

    return per_series(points, ("log_id",), ["x", "y"], kernel, "thr0 double, thr100 double, stall double, expo double, rms double, iterations long, converged boolean")


def curve_cli(fitted: DataFrame) -> DataFrame:
    """Fitted parameters as whole command-line values: percent, and exponent in tenths of its legal range."""
    whole = lambda c, lo, hi: half_up(clamp(F.col(c) * 100.0, lo, hi))
    return fitted.select(
        "log_id", whole("stall", 0.0, 100.0).alias("stall_throttle"), whole("thr0", 0.0, 1000.0).alias("thr0_pct"), whole("thr100", 0.0, 1000.0).alias("thr100_pct"),
        half_up(clamp(F.col("expo"), -100.0, 100.0)).alias("expo"),
    )


def trusted_fit(fitted: DataFrame, points: DataFrame, least: int = 50) -> DataFrame:
    """Whether a fit may be shown: enough points, parameters within their bounds, exponent not at its limit."""
    n = points.groupBy("log_id").agg(F.count(F.lit(1)).alias("n"))
    ok = (F.col("n") >= least) & F.col("stall").between(0, 1) & F.col("thr0").between(0, 10) & F.col("thr100").between(0, 10) & (F.abs("expo") < 99)
    return fitted.join(n, "log_id").select("log_id", "n", ok.alias("trusted"))


def simulate_chain(rows: DataFrame, params: DataFrame, fs: float, keys=("log_id", "axis"), stages=("rpm", "lpf1", "notch")) -> DataFrame:
    """keys, frame_idx, sim, ref: raw gyro through the filter chain beside the logged filtered gyro.

    ``rows``: raw, ref, throttle and erpm_0..n; ``params``: as from headers.filter_params.
    """
    motors = sorted(c for c in rows.columns if c.startswith("erpm_"))

    def kernel(s):
        p = {c: s[c][0] for c in PARAMS}
        sim = K.filter_chain(s["raw"].astype(float), p, fs, [s[m].astype(float) for m in motors], s["throttle"].astype(float), stages)
        return {"frame_idx": s["frame_idx"], "sim": sim, "ref": s["ref"].astype(float)}

    both = rows.join(params, "log_id")
    return per_series(both, keys, ["frame_idx", "raw", "ref", "throttle", *motors, *PARAMS], kernel, "frame_idx long, sim double, ref double")


def low_pass(rows: DataFrame, value: str, cutoff: float, fs: float, order: int = 1, keys=("log_id",)) -> DataFrame:
    """keys, frame_idx, filtered: one to three poles from rest."""

    def kernel(s):
        return {"frame_idx": s["frame_idx"], "filtered": K.poles(np.nan_to_num(s[value].astype(float)), cutoff, 1 / fs, order)}

    return per_series(rows, keys, ["frame_idx", value], kernel, "frame_idx long, filtered double")
