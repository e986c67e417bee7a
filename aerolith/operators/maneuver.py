"""Manoeuvre detection, tracking error, cross-axis coupling and feed-forward effect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerolith.functions.columns import half_up
from aerolith.operators.segments import frames_in, hysteresis, merge_gaps, runs
from aerolith.operators.timeaxis import boxcar, central_velocity, ordered

AXES = (0, 1, 2)


def with_dt(frames: DataFrame) -> DataFrame:
    """Adds ``dt``, the log's mean time step, and ``n``; logs without a positive step or under 3 frames are dropped."""
    log = Window.partitionBy("log_id")
    n = F.count(F.lit(1)).over(log)
    dt = (F.max("time_sec").over(log) - F.min("time_sec").over(log)) / (n - 1)
    return frames.withColumns({"n": n, "dt": dt}).where("n >= 3 and dt > 0")


def stick_speed(frames: DataFrame) -> DataFrame:
    """Adds speed_a, the smoothed absolute setpoint velocity of each axis, and ``trigger``, the greatest of them."""
    w = ordered()
    f = with_dt(frames)
    f = f.withColumns({f"__v{a}": F.abs(central_velocity(F.col(f"setpoint_{a}"), F.col("dt"), w)) for a in AXES})
    f = f.withColumns({f"speed_{a}": boxcar(F.col(f"__v{a}"), 5, w) for a in AXES}).drop(*(f"__v{a}" for a in AXES))
    return f.withColumn("trigger", F.greatest(*(F.col(f"speed_{a}") for a in AXES)))


def detect_maneuvers(
    frames: DataFrame, enter: float = 1500.0, leave: float = 600.0, gap_ms: float = 120.0, least_ms: float = 40.0, pad_ms: float = 80.0, mixed: float = 0.7
) -> DataFrame:
    """log_id, start_idx, end_idx (exclusive), dominant_axis, kind (axis name or 'mixed'), peak.

    Hysteresis on the trigger, merge of close windows, minimum length, padding clamped to the log; then the axis with the
    highest smoothed speed in the padded window, mixed if another reaches ``mixed`` of it. Padded windows may overlap.
    """
    f = stick_speed(frames)
    f = f.withColumn("open", hysteresis(F.col("trigger"), enter, leave, ordered()))
    dt = F.first("dt")
    found = runs(f, "open", n=F.first("n"), dt=dt).where("open = 1")
    info = found.groupBy("log_id").agg(F.first("n").alias("n"), F.first("dt").alias("dt"))
    ms = lambda x: half_up(F.lit(x / 1000.0) / F.col("dt"))
    merged = merge_gaps(found.withColumn("gap", ms(gap_ms)), F.col("gap")).join(info, "log_id")
    kept = merged.where(F.col("end_idx") - F.col("start_idx") >= ms(least_ms))
    padded = kept.select(
        "log_id", F.greatest(F.col("start_idx") - ms(pad_ms), F.lit(0)).alias("start_idx"), F.least(F.col("end_idx") + ms(pad_ms), F.col("n")).alias("end_idx")
    )
    inside = frames_in(f.select("log_id", "frame_idx", *(f"speed_{a}" for a in AXES)), padded)
    peaks = inside.groupBy("log_id", "start_idx", "end_idx").agg(*(F.max(f"speed_{a}").alias(f"p{a}") for a in AXES))
    top = F.greatest("p0", "p1", "p2")
    axis = F.when(F.col("p0") == top, 0).when(F.col("p1") == top, 1).otherwise(2)
    others = sum((F.when(F.col(f"p{a}") >= F.lit(mixed) * F.col("peak"), 1).otherwise(0) for a in AXES), F.lit(0))
    return peaks.withColumns({"peak": top, "dominant_axis": axis}).select(
        "log_id", "start_idx", "end_idx", "dominant_axis",
        F.when(others >= 2, "mixed").otherwise(F.element_at(F.array(F.lit("roll"), F.lit("pitch"), F.lit("yaw")), F.col("dominant_axis") + 1)).alias("kind"), "peak",
    )


def tracking_stats(axis_rows: DataFrame, keys=("log_id", "axis")) -> DataFrame:
    """rms and peak of gyro - setpoint, index of the first peak, count."""
    e = F.abs(F.col("gyro") - F.col("sp"))
    rows = axis_rows.withColumn("e", e)
    best = F.max(F.struct(F.col("e"), (-F.col("frame_idx")).alias("i")))
    return rows.groupBy(*keys).agg(F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rms"), best.alias("m"), F.count("e").alias("n")).select(
        *keys, "rms", F.col("m.e").alias("peak"), (-F.col("m.i")).alias("peak_idx"), "n"
    )


def maneuver_tracking(frames: DataFrame, axis_rows: DataFrame, **how) -> DataFrame:
    """Tracking error of the dominant axis inside each manoeuvre, worst first."""
    windows = detect_maneuvers(frames, **how).withColumnRenamed("dominant_axis", "axis")
    inside = frames_in(axis_rows.select("log_id", "axis", "frame_idx", "sp", "gyro"), windows, ("log_id", "axis"))
    return tracking_stats(inside, ("log_id", "axis", "start_idx", "end_idx", "kind")).orderBy(F.desc("rms"), "log_id", "start_idx")


def coupling_windows(frames: DataFrame, windows: DataFrame, tail_ms: float = 150.0, baseline_ms: float = 30.0, least: float = 20.0) -> DataFrame:
    """log_id, start_idx, cmd_axis, resp_axis, ratio: signed peak gyro response per commanded response, single-axis windows.

    Each axis' deviation is taken from the mean of the window's first samples; windows whose commanded axis moves less
    than ``least`` are left out; the diagonal is 1 by construction.
    """
    f = with_dt(frames)
    info = f.groupBy("log_id").agg(F.first("n").alias("n"), F.first("dt").alias("dt"))
    ms = lambda x: half_up(F.lit(x / 1000.0) / F.col("dt"))
    single = windows.where("kind <> 'mixed'").join(info, "log_id").select(
        "log_id", "start_idx", F.col("end_idx").alias("move_end"), F.least(F.col("end_idx") + ms(tail_ms), F.col("n")).alias("end_idx"),
        F.greatest(ms(baseline_ms), F.lit(1)).alias("base_n"), F.col("dominant_axis").alias("cmd_axis"),
    ).where("end_idx - start_idx >= 3")
    long = f.selectExpr("log_id", "frame_idx", "stack(3, 0, gyroADC_0, 1, gyroADC_1, 2, gyroADC_2) AS (resp_axis, g)")
    rows = frames_in(long, single)
    keys = ["log_id", "start_idx", "move_end", "cmd_axis", "resp_axis"]
    base = F.avg(F.when(F.col("frame_idx") < F.col("start_idx") + F.col("base_n"), F.col("g"))).over(Window.partitionBy(*keys))
    rows = rows.withColumn("dev", F.col("g") - base)
    peak = F.max(F.struct(F.abs("dev").alias("size"), (-F.col("frame_idx")).alias("i"), F.col("dev"))).alias("m")
    devs = rows.groupBy(*keys).agg(peak).select(*keys, F.col("m.dev").alias("dev"))
    cmd = F.max(F.when(F.col("resp_axis") == F.col("cmd_axis"), F.col("dev"))).over(Window.partitionBy("log_id", "start_idx", "move_end", "cmd_axis"))
    devs = devs.withColumn("cmd", cmd).where(F.abs("cmd") >= least)
    return devs.select(*keys, (F.col("dev") / F.abs("cmd") * F.when(F.col("cmd") >= 0, 1.0).otherwise(-1.0)).alias("ratio"))


def axis_coupling(frames: DataFrame, windows: DataFrame, **how) -> DataFrame:
    """cmd_axis, resp_axis, ratio (mean), n windows: the 3 x 3 matrix of each log in long form."""
    return coupling_windows(frames, windows, **how).groupBy("log_id", "cmd_axis", "resp_axis").agg(F.avg("ratio").alias("ratio"), F.count(F.lit(1)).alias("n"))


def worst_coupling(matrix: DataFrame) -> DataFrame:
    """Largest off-diagonal cell of each log; the first in row order wins ties."""
    best = F.max_by(F.struct("cmd_axis", "resp_axis", "ratio", "n"), F.struct(F.abs("ratio"), -F.col("cmd_axis"), -F.col("resp_axis")))
    return matrix.where("cmd_axis <> resp_axis").groupBy("log_id").agg(best.alias("m")).select("log_id", "m.*")


def feedforward_windows(
    axis_rows: DataFrame, windows: DataFrame, moving: float = 600.0, over_ms: float = 150.0, smooth_sec: float = 0.02, over_flag: float = 0.15, noise_flag: float = 0.35
) -> DataFrame:
    """Per log, axis and manoeuvre (of the axis, or mixed): coverage, effort, overshoot and noise of the F term."""
    w = Window.partitionBy("log_id", "axis").orderBy("frame_idx")
    log = Window.partitionBy("log_id", "axis")
    n = F.count(F.lit(1)).over(log)
    dt = (F.max("time_sec").over(log) - F.min("time_sec").over(log)) / (n - 1)
    f = axis_rows.withColumns({"n": n, "dt": dt}).where("n >= 3 and dt > 0").withColumn("vel", central_velocity(F.col("sp"), F.col("dt"), w))
    mine = windows.select("log_id", "start_idx", "end_idx", "kind", "dominant_axis").where("end_idx - start_idx >= 2")
    mine = mine.join(F.broadcast(axis_rows.sparkSession.createDataFrame([(a,) for a in AXES], "axis int")), F.lit(True))
    mine = mine.where("kind = 'mixed' or dominant_axis = axis").select("log_id", "axis", "start_idx", "end_idx")
    rows = frames_in(f.drop("p0"), mine, ("log_id", "axis"))
    keys = ["log_id", "axis", "start_idx", "end_idx"]
    inside = Window.partitionBy(*keys)
    half = F.floor(F.greatest(half_up(F.lit(smooth_sec) / F.col("dt")), F.lit(3)) / 2)
    # the boxcar is clipped to the window, and its width is a column: differences of running sums, window by window
    rows = rows.withColumn("acc", F.sum("f").over(inside.orderBy("frame_idx").rowsBetween(Window.unboundedPreceding, 0)))
    move = F.abs("vel") >= moving
    stats = rows.withColumn("half", half).groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(move, F.abs("f"))), F.lit(0.0)).alias("sum_f"), F.coalesce(F.sum(F.when(move, F.abs("p"))), F.lit(0.0)).alias("sum_p"),
        F.max_by(F.struct("frame_idx", "vel"), F.struct(F.abs("vel"), -F.col("frame_idx"))).alias("top"), F.max(F.abs("sp")).alias("sp_peak"),
        F.sort_array(F.collect_list(F.struct("frame_idx", "f", "acc"))).alias("trace"), F.first("half").cast("int").alias("half"), F.first("dt").alias("dt"), F.first("n").alias("n"),
    )
    last, width = F.size("trace") - 1, F.col("half")

    def add(sums: Column, i: Column) -> Column:
        hi, lo = F.least(i + width, last), F.greatest(i - width, F.lit(0))
        before = F.when(lo > 0, F.get("trace", lo - 1)["acc"]).otherwise(0.0)
        smooth = (F.get("trace", hi)["acc"] - before) / (hi - lo + 1)
        rest = F.get("trace", i)["f"] - smooth
        return F.struct((sums["res"] + rest * rest).alias("res"), (sums["env"] + smooth * smooth).alias("env"))

    zero = F.struct(F.lit(0.0).alias("res"), F.lit(0.0).alias("env"))
    stats = stats.withColumn("sums", F.aggregate(F.sequence(F.lit(0), last), zero, add))
    stats = stats.withColumns({"res": F.col("sums.res") / F.size("trace"), "env": F.col("sums.env") / F.size("trace")}).drop("sums", "trace")
    after = stats.select(
        "log_id", "axis", F.col("start_idx").alias("s"), F.col("end_idx").alias("e"), F.col("top.frame_idx").alias("start_idx"),
        F.least(F.col("n"), F.col("top.frame_idx") + F.greatest(half_up(F.lit(over_ms / 1000.0) / F.col("dt")), F.lit(1))).alias("end_idx"),
        F.when(F.col("top.vel") >= 0, 1.0).otherwise(-1.0).alias("dir"),
    )
    past = frames_in(f.select("log_id", "axis", "frame_idx", "sp", "gyro"), after, ("log_id", "axis"))
    over = past.groupBy("log_id", "axis", F.col("s").alias("start_idx"), F.col("e").alias("end_idx")).agg(F.greatest(F.max((F.col("gyro") - F.col("sp")) * F.col("dir")), F.lit(0.0)).alias("over"))
    noise = F.when((F.col("end_idx") - F.col("start_idx") >= 3) & (F.sqrt("env") > 1e-6), F.sqrt("res") / F.sqrt("env")).otherwise(0.0)
    out = stats.join(over, keys).select(
        *keys, (F.col("sum_f") + F.col("sum_p")).alias("effort"), F.when(F.col("sum_f") + F.col("sum_p") > 0, F.col("sum_f") / (F.col("sum_f") + F.col("sum_p"))).otherwise(0.0).alias("coverage"),
        F.when(F.col("sp_peak") > 0, F.col("over") / F.col("sp_peak")).otherwise(0.0).alias("overshoot"), noise.alias("noise"),
    )
    return out.withColumns({"has_overshoot": F.col("overshoot") > over_flag, "noisy": F.col("noise") > noise_flag})


def feedforward(axis_windows: DataFrame, under: float = 0.5, noise_flag: float = 0.35) -> DataFrame:
    """Verdict per log and axis: overgained if most windows overshoot, undergained below ``under`` coverage, else healthy."""
    g = axis_windows.groupBy("log_id", "axis").agg(
        F.sum(F.col("coverage") * F.col("effort")).alias("c"), F.sum("effort").alias("e"), F.count(F.lit(1)).alias("n_windows"),
        F.sum(F.col("has_overshoot").cast("int")).alias("n_overshoot"), F.avg("noise").alias("mean_noise"),
    )
    g = g.withColumn("mean_coverage", F.when(F.col("e") > 0, F.col("c") / F.col("e")).otherwise(0.0))
    verdict = F.when(F.col("n_overshoot") / F.col("n_windows") > 0.5, "overgained").when(F.col("mean_coverage") < under, "undergained").otherwise("healthy")
    return g.select("log_id", "axis", "mean_coverage", "n_windows", "n_overshoot", "mean_noise", (F.col("mean_noise") > noise_flag).alias("noisy"), verdict.alias("verdict"))


def region_plan(frames: DataFrame, windows: DataFrame, size: int = 1024, pad_sec: float = 1.0, segments: int = 4) -> DataFrame:
    """log_id, axis, start_idx, end_idx, mode: where a spectrum of each axis should look.

    Windows of the axis or mixed, padded by ``pad_sec``, merged where they overlap, of ``size`` samples or more; an axis
    whose regions hold fewer than ``segments`` segments in all gets the whole flight.
    """
    info = with_dt(frames).groupBy("log_id").agg(F.first("n").alias("n"), F.first("dt").alias("dt"))
    axes = frames.sparkSession.createDataFrame([(a,) for a in AXES], "axis int")
    every = info.join(F.broadcast(axes), F.lit(True))
    pad = half_up(F.lit(pad_sec) / F.col("dt"))
    own = windows.join(every, "log_id").where("kind = 'mixed' or dominant_axis = axis")
    own = own.select("log_id", "axis", F.greatest(F.col("start_idx") - pad, F.lit(0)).alias("start_idx"), F.least(F.col("end_idx") + pad, F.col("n")).alias("end_idx"))
    regions = merge_gaps(own, F.lit(0), ("log_id", "axis")).where(F.col("end_idx") - F.col("start_idx") >= size)
    covered = F.sum(F.col("end_idx") - F.col("start_idx")).over(Window.partitionBy("log_id", "axis"))
    enough = regions.withColumn("covered", covered).where(F.col("covered") >= segments * size).select("log_id", "axis", "start_idx", "end_idx", F.lit("manoeuvres").alias("mode"))
    rest = every.join(enough.select("log_id", "axis").distinct(), ["log_id", "axis"], "left_anti")
    return enough.unionByName(rest.select("log_id", "axis", F.lit(0).cast("long").alias("start_idx"), F.col("n").alias("end_idx"), F.lit("whole flight").alias("mode")))
