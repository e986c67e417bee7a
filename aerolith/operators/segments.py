"""Gaps-and-islands primitives on ordered frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerolith.operators.timeaxis import KEYS, ordered


def hysteresis(level: Column, enter: float, leave: float, w) -> Column:
    """1 from the first sample at or above ``enter`` until one below ``leave``, else 0."""
    mark = F.when(level >= enter, 1).when(level < leave, 0)
    return F.coalesce(F.last(mark, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))


def runs(frames: DataFrame, state: str, keys=KEYS, **aggs: Column) -> DataFrame:
    """Maximal runs of equal ``state``: keys, state, start_idx, end_idx (exclusive), and ``aggs`` over each run."""
    w = ordered(keys)
    change = F.when(F.col(state).eqNullSafe(F.lag(state).over(w)) & (F.col("frame_idx") == F.lag("frame_idx").over(w) + 1), 0).otherwise(1)
    rows = frames.withColumn("__change", change).withColumn("__run", F.sum("__change").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    extra = [e.alias(n) for n, e in aggs.items()]
    return rows.groupBy(*keys, "__run", state).agg(F.min("frame_idx").alias("start_idx"), (F.max("frame_idx") + 1).alias("end_idx"), *extra).drop("__run")


def merge_gaps(windows: DataFrame, gap: Column, keys=KEYS) -> DataFrame:
    """Joins windows [start_idx, end_idx) of a key whose distance is at most ``gap`` (overlaps included)."""
    w = Window.partitionBy(*keys).orderBy("start_idx", "end_idx")
    reach = F.max("end_idx").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = windows.withColumn("__new", F.when(F.col("start_idx") - reach <= gap, 0).otherwise(1))
    rows = rows.withColumn("__group", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "__group").agg(F.min("start_idx").alias("start_idx"), F.max("end_idx").alias("end_idx")).drop("__group")


def in_bin_regions(frames: DataFrame, value: str, lo: float, hi: float, least: int, keys=KEYS) -> DataFrame:
    """Maximal runs with lo <= value < hi of ``least`` samples or more."""
    inside = F.coalesce((F.col(value) >= lo) & (F.col(value) < hi), F.lit(False))
    return runs(frames.withColumn("__in", inside), "__in", keys).where("__in").where(F.col("end_idx") - F.col("start_idx") >= least).drop("__in")


#: Frames of a bucket in which frames and windows meet.
BUCKET = 512


def frames_in(frames: DataFrame, windows: DataFrame, keys=KEYS) -> DataFrame:
    """Frames inside each window [start_idx, end_idx) (windows may overlap): frame columns plus the window's.

    A window is dealt to the buckets of frames it reaches into, so that a frame meets the windows of its bucket, not all
    of its log.
    """
    at = lambda c: F.floor(c / BUCKET).cast("long")
    w = windows.where("end_idx > start_idx").withColumn("__bucket", F.explode(F.sequence(at(F.col("start_idx")), at(F.col("end_idx") - 1))))
    met = frames.withColumn("__bucket", at(F.col("frame_idx"))).join(w, [*keys, "__bucket"])
    return met.where((F.col("frame_idx") >= F.col("start_idx")) & (F.col("frame_idx") < F.col("end_idx"))).drop("__bucket")
