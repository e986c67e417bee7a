"""Per-log aggregates: term shares, correlations, percentiles, coverage, model fidelity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerolith.functions.columns import finite

TERMS = ("p", "i", "d", "f", "s")


def mean_abs(x: Column) -> Column:
    return F.coalesce(F.avg(F.abs(x)), F.lit(0.0))


def term_shares(rows: DataFrame, keys=("log_id", "axis")) -> DataFrame:
    """Share of each controller term's mean magnitude; the dominant term is the first greatest, null if all are 0."""
    g = rows.groupBy(*keys).agg(*(mean_abs(F.col(t)).alias(t) for t in TERMS))
    total = reduce(lambda a, b: a + b, (F.col(t) for t in TERMS))
    top = F.greatest(*(F.col(t) for t in TERMS))
    dominant = reduce(lambda e, t: F.when(F.col(t) == top, F.lit(t.upper())).otherwise(e), reversed(TERMS), F.lit(None).cast("string"))
    shares = [F.when(total > 0, F.col(t) / total).otherwise(0.0).alias(f"{t}_share") for t in TERMS]
    return g.select(*keys, *shares, F.when(total > 0, dominant).alias("dominant"))


def pearson(x: Column, y: Column) -> Column:
    """Population Pearson; 0 where a side does not vary or there are no samples."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.coalesce(F.when(spread > 0, F.covar_pop(x, y) / spread), F.lit(0.0))


def axis_correlations(frames: DataFrame, servos=(0, 1, 2, 3), least: float = 0.25) -> DataFrame:
    """Per log and servo: correlation with each setpoint axis; the dominant axis has the largest |r| above ``least``."""
    args = ", ".join(f"{n}, servo_{n}" for n in servos)
    long = frames.selectExpr("log_id", "setpoint_0", "setpoint_1", "setpoint_2", f"stack({len(servos)}, {args}) AS (servo, pwm)")
    g = long.groupBy("log_id", "servo").agg(*(pearson(F.col("pwm"), F.col(f"setpoint_{a}")).alias(f"r{a}") for a in range(3)))
    top = F.greatest(*(F.abs(f"r{a}") for a in range(3)))
    axis = F.when(top > least, F.when(F.abs("r0") == top, 0).when(F.abs("r1") == top, 1).otherwise(2))
    g = g.withColumn("dominant_axis", axis)
    return g.withColumn("dominant_r", F.when(F.col("dominant_axis") == 0, F.col("r0")).when(F.col("dominant_axis") == 1, F.col("r1")).when(F.col("dominant_axis") == 2, F.col("r2")))


def percentile_linear(x: Column, q: float) -> Column:
    return F.percentile(finite(x), F.lit(q))


def percentile_nearest(rows: DataFrame, value: str, p: float, keys=("log_id",)) -> DataFrame:
    """Nearest-rank percentile: the value at rank floor(p / 100 * (n - 1) + 0.5) of the sorted values."""
    rows = rows.where(F.col(value).isNotNull() & ~F.isnan(value))
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(value)) - 1
    got = rows.select(*keys, F.col(value).alias("value"), rank.alias("k"), n.alias("n"))
    return got.where(F.col("k") == F.floor(F.lit(p / 100.0) * (F.col("n") - 1) + 0.5)).select(*keys, "value")


def speed_coverage(frames: DataFrame, bins: int = 8, jump: float = 0.15, steep_rad: float = 0.17453292519943295) -> DataFrame:
    """How much of the envelope a log covers: speed range, throttle changes a minute, dives and climbs, battery sag, histogram.

    ``frames``: log_id, frame_idx, time_sec, speed, throttle (0 to 1), pitch (rad), vbat.
    """
    w = Window.partitionBy("log_id").orderBy("frame_idx")
    f = frames.withColumn("jump", (F.abs(F.col("throttle") - F.lag("throttle").over(w)) > jump).cast("int"))
    f = f.withColumn("top", F.greatest(F.max(finite(F.col("speed"))).over(Window.partitionBy("log_id")), F.lit(1.0)))
    bin_ = F.least(F.floor(F.col("speed") / F.col("top") * bins), F.lit(bins - 1))
    f = f.withColumn("bin", F.when(F.col("speed") >= 0, bin_))
    hist = F.array(*(F.count(F.when(F.col("bin") == b, 1)) for b in range(bins)))
    minutes = (F.max("time_sec") - F.min("time_sec")) / 60.0
    return f.groupBy("log_id").agg(
        F.min(finite(F.col("speed"))).alias("speed_min"), F.max(finite(F.col("speed"))).alias("speed_max"),
        F.when(minutes > 0, F.coalesce(F.sum("jump"), F.lit(0)) / minutes).otherwise(0.0).alias("jumps_per_min"),
        (F.count(F.when(F.col("pitch") < -steep_rad, 1)) / F.count(F.lit(1))).alias("dive_share"), (F.count(F.when(F.col("pitch") > steep_rad, 1)) / F.count(F.lit(1))).alias("climb_share"),
        F.when(F.max("vbat") > 0, (F.max("vbat") - F.min("vbat")) / F.max("vbat")).otherwise(0.0).alias("sag"), hist.alias("histogram"),
    )


def model_fidelity(rows: DataFrame, keys=("log_id",), warmup: int = 2000) -> DataFrame:
    """nrmse of ``sim`` against ``ref`` after the warm-up samples, and fidelity = max(0, 1 - nrmse)."""
    g = rows.where(F.col("frame_idx") >= warmup).groupBy(*keys).agg(F.sum(F.pow(F.col("sim") - F.col("ref"), 2)).alias("e"), F.sum(F.col("ref") * F.col("ref")).alias("r"), F.count(F.lit(1)).alias("n"))
    return g.withColumn("nrmse", F.when(F.col("r") > 0, F.sqrt(F.col("e") / F.col("r")))).select(*keys, "n", "nrmse", F.greatest(F.lit(1.0) - F.col("nrmse"), F.lit(0.0)).alias("fidelity"))
