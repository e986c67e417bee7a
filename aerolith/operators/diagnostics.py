"""Gate, attenuation, trim and saturation diagnostics, and the first throttle-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerolith.functions.columns import finite, half_up
from aerolith.operators.segments import frames_in, runs
from aerolith.operators.timeaxis import ordered, sample_rates

AXIS = ("log_id", "axis")


def gate_stats(rows: DataFrame, active: float = 0.95) -> DataFrame:
    """Samples and percentage with an active gate, least and mean gate, range of the I term (at least 1e-9)."""
    n = F.count(F.lit(1))
    on = F.count(F.when(F.col("spa") < active, 1))
    return rows.groupBy(*AXIS).agg(on.alias("active_n"), (on * 100.0 / n).alias("active_pct"), F.min("spa").alias("spa_min"), F.avg("spa").alias("spa_mean"), F.greatest(F.max("i") - F.min("i"), F.lit(1e-9)).alias("i_range"))


def gate_events(rows: DataFrame, active: float = 0.95, floor: float = 0.10, least: int = 16, growth: float = 0.20, peak: float = 0.60, after_sec: float = 0.2) -> DataFrame:
    """log_id, axis, kind (wind_up, bounce_back), time_sec, severity of each active run of ``least`` samples or more."""
    f = rows.withColumn("gated", F.col("spa") < active)
    first, last = F.min(F.struct("frame_idx", "time_sec", "i")), F.max(F.struct("frame_idx", "time_sec", "i"))
    found = runs(f, "gated", AXIS, first=first, last=last, spa_min=F.min("spa")).where("gated").where(F.col("end_idx") - F.col("start_idx") >= least)
    found = found.join(gate_stats(rows, active).select(*AXIS, "i_range"), list(AXIS))
    g = F.abs(F.col("last.i") - F.col("first.i")) / F.col("i_range")
    wind = found.where((F.col("spa_min") <= floor) & (g >= growth)).select(*AXIS, F.lit("wind_up").alias("kind"), F.col("first.time_sec").alias("time_sec"), F.least(g, F.lit(1.0)).alias("severity"))
    span = found.select(*AXIS, F.col("end_idx").alias("from_idx"), F.col("last.time_sec").alias("released"), "i_range")
    # time is cut into buckets of the length looked ahead; a release looks into its own and the next
    bucket = lambda t: F.floor(t / after_sec).cast("long")
    span = span.withColumn("__bucket", F.explode(F.array(bucket(F.col("released")), bucket(F.col("released")) + 1, bucket(F.col("released")) + 2)))
    met = rows.select(*AXIS, "frame_idx", "time_sec", "i").withColumn("__bucket", bucket(F.col("time_sec"))).join(span, [*AXIS, "__bucket"])
    met = met.where((F.col("frame_idx") >= F.col("from_idx")) & (F.col("time_sec") <= F.col("released") + after_sec))
    top = met.groupBy(*AXIS, "released", "i_range").agg((F.max(F.abs("i")) / F.first("i_range")).alias("frac"))
    bounce = top.where(F.col("frac") >= peak).select(*AXIS, F.lit("bounce_back").alias("kind"), F.col("released").alias("time_sec"), F.least("frac", F.lit(1.0)).alias("severity"))
    return wind.unionByName(bounce)


def attenuation(rows: DataFrame, pre: str, post: str | None = None, factor: str | None = None, active: float = 1.0, most: float = 3.0, keys=("log_id",)) -> DataFrame:
    """Mean and least factor, attenuation and active share of an S term: post / pre clamped to [0, most], or a logged factor."""
    on = F.abs(F.col(pre)) >= active
    value = F.greatest(F.least(F.col(post) / F.col(pre), F.lit(most)), F.lit(0.0)) if post else finite(F.col(factor))
    g = rows.withColumn("__f", F.when(on, value)).groupBy(*keys).agg(F.avg("__f").alias("m"), F.min("__f").alias("least"), F.count("__f").alias("active_n"), F.count(F.lit(1)).alias("n"))
    mean = F.coalesce("m", F.lit(1.0))
    cut = F.when(F.col("active_n") > 0, F.greatest(F.least(F.lit(1.0) - mean, F.lit(1.0)), F.lit(0.0))).otherwise(0.0)
    return g.select(*keys, mean.alias("mean_factor"), F.coalesce("least", F.lit(1.0)).alias("min_factor"), cut.alias("attenuation"), "active_n", (F.col("active_n") * 100.0 / F.col("n")).alias("active_pct"))


def trim_bias(frames: DataFrame, axis_rows: DataFrame, stick: float = 20.0, bank: float | None = 150.0, settle_sec: float = 1.5, cover_sec: float = 5.0, rms_floor: float = 1.0) -> DataFrame:
    """Mean I term in settled straight flight against its RMS: trim-error, slight, balanced or unknown.

    A sample is settled after ``settle_sec`` without stick (all axes) or bank; the rate is the midpoint rate.
    """
    w = ordered()
    calm = F.greatest(*(F.abs(f"setpoint_{a}") for a in range(3))) < stick
    if bank is not None:
        calm = calm & (F.abs("attitude_0") < bank)
    rate = sample_rates(frames).select("log_id", F.col("midpoint_hz").alias("hz"))
    f = frames.select("log_id", "frame_idx", calm.alias("calm")).join(rate, "log_id")
    broke = F.last(F.when(~F.col("calm"), F.col("frame_idx")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    settle = F.greatest(half_up(F.col("hz") * settle_sec), F.lit(1))
    f = f.withColumn("steady", (F.col("frame_idx") - F.coalesce(broke, F.lit(-1)) >= settle) & (F.col("hz") > 0))
    g = axis_rows.select("log_id", "axis", "frame_idx", "i").join(f.select("log_id", "frame_idx", "steady", "hz"), ["log_id", "frame_idx"]).groupBy(*AXIS).agg(
        F.avg(F.when(F.col("steady"), F.col("i"))).alias("mean_i"), F.sqrt(F.avg(F.col("i") * F.col("i"))).alias("rms_i"), F.count(F.when(F.col("steady"), 1)).alias("steady_n"), F.first("hz").alias("hz")
    )
    frac = F.when(F.col("mean_i").isNotNull() & (F.col("rms_i") > rms_floor), F.least(F.abs("mean_i") / F.col("rms_i"), F.lit(1.0))).otherwise(0.0)
    cover = F.when(F.col("hz") > 0, F.col("steady_n") / F.col("hz")).otherwise(0.0)
    g = g.withColumns({"fraction": frac, "coverage_sec": cover})
    severity = F.when(F.col("mean_i").isNull() | (F.col("coverage_sec") < cover_sec), "unknown").when(F.col("fraction") >= 0.5, "trim-error").when(F.col("fraction") >= 0.25, "slight").otherwise("balanced")
    return g.select(*AXIS, "mean_i", "rms_i", "fraction", "steady_n", "coverage_sec", severity.alias("severity"))


def saturation_runs(pwm_rows: DataFrame, low: float = 1000.0, high: float = 2000.0, margin: float = 25.0, fs: float = 1000.0, keys=("log_id", "servo")) -> DataFrame:
    """Episodes at a servo's limit: keys, kind (low, high), start_idx, end_idx, duration_ms. The rate is ``fs``, as given."""
    state = F.when(F.col("pwm") <= low + margin, "low").when(F.col("pwm") >= high - margin, "high").otherwise("none")
    found = runs(pwm_rows.withColumn("kind", state), "kind", keys).where("kind <> 'none'")
    return found.select(*keys, "kind", "start_idx", "end_idx", ((F.col("end_idx") - F.col("start_idx")) * 1000.0 / fs).alias("duration_ms"))


def first_crossing(frames: DataFrame, value: str = "rcCommand_3", level: float = 1100.0, time: str = "time_sec") -> DataFrame:
    """log_id, first_sec, detected: first rise through ``level``; a log that begins above it has none."""
    w = ordered()
    up = (F.lag(value).over(w) < level) & (F.col(value) >= level)
    rows = frames.select("log_id", "frame_idx", F.col(value).alias("v"), F.when(up, F.col(time)).alias("t"))
    g = rows.groupBy("log_id").agg(F.min("t").alias("t"), F.max(F.when((F.col("frame_idx") == 0) & (F.col("v") >= level), 1).otherwise(0)).alias("above"))
    t = F.when(F.col("above") == 0, F.col("t"))
    return g.select("log_id", t.alias("first_sec"), t.isNotNull().alias("detected"))
