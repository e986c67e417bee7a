"""Time-axis operators: sample rates, derivatives, smoothing, resampling, alignment.

All take long tables with ``log_id`` and a dense ``frame_idx``; everything is windows, joins and aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from aerolith.functions.columns import finite, half_up

KEYS = ("log_id",)
#: Boxcar widths of the display smoothing strengths 0 to 4 (fixed values).
SMOOTH_WIDTHS = (1, 7, 15, 31, 61)


def ordered(keys=KEYS, order: str = "frame_idx") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def sample_rates(frames: DataFrame, time: str = "time_sec", keys=KEYS) -> DataFrame:
    """Three rates: ``midpoint_hz`` from the middle pair of samples (0 if undefined), ``mean_hz`` over the log (1000 if
    undefined), ``mean_dt`` (null unless positive)."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    pairs = frames.select(*keys, "frame_idx", F.col(time).alias("t"), F.lag(time).over(ordered(keys)).alias("before"), n.alias("n"))
    mid = F.max(F.when(F.col("frame_idx") == F.floor(F.col("n") / 2), F.col("t") - F.col("before")))
    got = pairs.groupBy(*keys).agg(mid.alias("mid"), F.count(F.lit(1)).alias("n"), F.min("t").alias("t0"), F.max("t").alias("t1"))
    span = F.col("t1") - F.col("t0")
    dt = F.when((F.col("n") >= 2) & (span > 0), span / (F.col("n") - 1))
    return got.select(
        *keys, "n", F.when((F.col("n") >= 2) & (F.col("mid") > 0), F.lit(1.0) / F.col("mid")).otherwise(0.0).alias("midpoint_hz"),
        F.coalesce(F.lit(1.0) / dt, F.lit(1000.0)).alias("mean_hz"), dt.alias("mean_dt"),
    )


def central_velocity(x: Column, dt, w: WindowSpec) -> Column:
    """Central difference, one-sided at both ends."""
    before, after = F.lag(x).over(w), F.lead(x).over(w)
    return F.coalesce((after - before) / (F.lit(2.0) * dt), (after - x) / dt, (x - before) / dt, F.lit(0.0))


def backward_rate(x: Column, t: Column, w: WindowSpec) -> Column:
    """Difference to the sample before over the true time step; 0 for the first and where time does not advance."""
    step = t - F.lag(t).over(w)
    return F.when(step > 0, (x - F.lag(x).over(w)) / step).otherwise(0.0)


def boxcar(x: Column, width: int, w: WindowSpec) -> Column:
    """Centred mean of an odd width; edges shrink, NaN and null are skipped."""
    half = (width | 1) // 2
    return F.avg(finite(x)).over(w.rowsBetween(-half, half))


def strict_boxcar(x: Column, width: int, w: WindowSpec) -> Column:
    """As :func:`boxcar`, but a NaN or null sample makes every mean it takes part in null."""
    half = (width | 1) // 2
    near = w.rowsBetween(-half, half)
    return F.when(F.count(finite(x)).over(near) == F.count(F.lit(1)).over(near), F.avg(x).over(near))


def hold_last(x: Column, w: WindowSpec) -> Column:
    """Forward fill of NaN and null; leading gaps stay null."""
    return F.last(finite(x), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def block_mean(frames: DataFrame, value: str, factor: int, keys=KEYS) -> DataFrame:
    """Mean of each full block of ``factor`` samples: keys, block, value."""
    rows = frames.groupBy(*keys, F.floor(F.col("frame_idx") / factor).alias("block"))
    return rows.agg(F.avg(value).alias(value), F.count(F.lit(1)).alias("n")).where(F.col("n") == factor).drop("n")


def fractional_blocks(frames: DataFrame, value: str, ratio: float, keys=KEYS) -> DataFrame:
    """Block i is samples floor(i * ratio) to floor((i + 1) * ratio) - 1; a ratio of 1 or less changes nothing; the
    incomplete block at the end is dropped."""
    if ratio <= 1:
        return frames.select(*keys, F.col("frame_idx").alias("block"), value)
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    guess = F.floor(F.col("frame_idx") / F.lit(ratio))
    block = F.when(F.floor((guess + 1) * F.lit(ratio)) <= F.col("frame_idx"), guess + 1).otherwise(guess)
    rows = frames.select(*keys, "frame_idx", value, n.alias("n")).withColumn("block", block)
    return rows.where(F.floor((F.col("block") + 1) * F.lit(ratio)) <= F.col("n")).groupBy(*keys, "block").agg(F.avg(value).alias(value))


def interpolate(src: DataFrame, dst: DataFrame, value: str, time: str = "time_sec", keys=KEYS) -> DataFrame:
    """Linear interpolation of ``src`` at the times of ``dst``, clamped to the end values; logs without source give 0.

    The two series are merged in time order and each target takes the source samples before and after it: running values
    over the rows sorted forwards and backwards.
    """
    both = src.select(*keys, F.col(time).alias("t"), F.struct(F.col(time).alias("t"), F.col(value).alias("v")).alias("s"), F.lit(0).alias("target"), F.lit(None).cast("long").alias("frame_idx"))
    both = both.unionByName(dst.select(*keys, F.col(time).alias("t"), F.lit(None).cast(both.schema["s"].dataType).alias("s"), F.lit(1).alias("target"), F.col("frame_idx").cast("long")))
    w = Window.partitionBy(*keys)
    before = F.last("s", ignorenulls=True).over(w.orderBy("t", "target").rowsBetween(Window.unboundedPreceding, 0))
    after = F.last("s", ignorenulls=True).over(w.orderBy(F.desc("t"), "target").rowsBetween(Window.unboundedPreceding, 0))
    got = both.withColumns({"b": before, "a": after}).where("target = 1")
    b, a = F.col("b"), F.col("a")
    mix = b["v"] + (a["v"] - b["v"]) * (F.col("t") - b["t"]) / (a["t"] - b["t"])
    out = F.when(b.isNull() & a.isNull(), 0.0).when(b.isNull(), a["v"]).when(a.isNull() | (a["t"] <= b["t"]), b["v"]).otherwise(mix)
    return got.select(*keys, "frame_idx", F.col("t").alias(time), out.alias(value))


def onto_reference(log: DataFrame, ref: DataFrame, value: str, time: str = "time_sec", offsets: DataFrame | None = None) -> DataFrame:
    """Nearest sample of each log at the times of one reference axis (ref_idx, time), by uniform index.

    ``offsets``: log_id, offset_sec. Times outside the log give null, as do logs without a positive time step.
    """
    span = log.groupBy("log_id").agg(F.min(time).alias("t0"), F.max(time).alias("t1"), F.count(F.lit(1)).alias("n"))
    span = span.join(offsets, "log_id", "left") if offsets is not None else span.withColumn("offset_sec", F.lit(0.0))
    span = span.select("log_id", "t0", "n", F.coalesce("offset_sec", F.lit(0.0)).alias("offset_sec"), ((F.col("t1") - F.col("t0")) / (F.col("n") - 1)).alias("dt"))
    grid = ref.select("ref_idx", F.col(time).alias("ref_time"))
    idx = half_up((F.col("ref_time") - F.col("offset_sec") - F.col("t0")) / F.col("dt"))
    want = grid.join(span, F.lit(True)).withColumn("frame_idx", F.when(F.col("dt") > 0, idx))
    want = want.withColumn("frame_idx", F.when(F.col("frame_idx").between(0, F.col("n") - 1), F.col("frame_idx")))
    return want.join(log.select("log_id", "frame_idx", value), ["log_id", "frame_idx"], "left").select("log_id", "ref_idx", "ref_time", value)


def nearest_index(frames: DataFrame, at: DataFrame, time: str = "time_sec", keys=KEYS) -> DataFrame:
    """frame_idx nearest to each (keys, at_sec); ties go to the lower index.

    Frames and cursors are merged in time order, as in :func:`interpolate`; each cursor looks at one frame to each side.
    """
    cursors, none = at.select(*keys, "at_sec").distinct(), F.lit(None)
    seen = frames.groupBy(*keys, F.col(time).alias("t")).agg(F.min("frame_idx").alias("i"))
    both = seen.select(*keys, "t", F.struct("t", "i").alias("s"), F.lit(0).alias("target"))
    both = both.unionByName(cursors.select(*keys, F.col("at_sec").alias("t"), none.cast(both.schema["s"].dataType).alias("s"), F.lit(1).alias("target")))
    w = Window.partitionBy(*keys)
    sides = {
        "b": F.last("s", ignorenulls=True).over(w.orderBy("t", "target").rowsBetween(Window.unboundedPreceding, 0)),
        "a": F.last("s", ignorenulls=True).over(w.orderBy(F.desc("t"), "target").rowsBetween(Window.unboundedPreceding, 0)),
    }
    gap = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(c)["t"] - F.col("t")).alias("gap"), F.col(c)["i"].alias("frame_idx")))
    best = F.least(gap("b"), gap("a"))
    return both.withColumns(sides).where("target = 1").withColumn("m", best).where("m is not null").select(*keys, F.col("t").alias("at_sec"), F.col("m.frame_idx").alias("frame_idx"))


def magnitude(*axes: Column) -> Column:
    """Root of the sum of squares over the axes that are there; null if none is."""
    total = sum((F.coalesce(a * a, F.lit(0.0)) for a in axes), F.lit(0.0))
    return F.when(F.coalesce(*axes).isNotNull(), F.sqrt(total))
