"""Facade over a set of logs: add and remove logs, offsets, visibility, and the analyses by name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolith.operators import maneuver, stats
from aerolith.operators.timeaxis import onto_reference


class FlightSession:
    """Logs of one analysis. Nothing is collected; every method gives a DataFrame or changes the session's selection."""

    def __init__(self, frames: DataFrame, offsets: DataFrame | None = None):
        """``offsets``: log_id, offset_sec of logs that have one; :meth:`offset` sets single ones over it."""
        self._frames, self._offsets = frames, offsets
        self.hidden: set = set()
        self.offsets: dict = {}
        self.removed: set = set()

    def remove(self, log_id) -> None:
        """Takes a log out; removing it twice is no error."""
        self.removed.add(log_id)

    def hide(self, log_id, hidden: bool = True) -> None:
        (self.hidden.add if hidden else self.hidden.discard)(log_id)

    def offset(self, log_id, seconds: float) -> None:
        self.offsets[log_id] = seconds

    @property
    def frames(self) -> DataFrame:
        gone = list(self.removed | self.hidden)
        return self._frames.where(~F.col("log_id").isin(gone)) if gone else self._frames

    def fields(self, *names: str) -> DataFrame:
        """Keys and the named columns only, so that the scan reads no others."""
        return self.frames.select("log_id", "frame_idx", "time_sec", *names)

    def log_offsets(self) -> DataFrame:
        """log_id, offset_sec of each visible log."""
        logs = self.frames.select("log_id").distinct()
        known = logs.join(self._offsets, "log_id", "left") if self._offsets is not None else logs.withColumn("offset_sec", F.lit(None).cast("double"))
        set_here = (F.when(F.col("log_id") == k, F.lit(float(v))) for k, v in self.offsets.items())
        return known.select("log_id", F.coalesce(*set_here, F.col("offset_sec"), F.lit(0.0)).alias("offset_sec"))

    def session_time(self) -> DataFrame:
        """Frames with ``session_sec``, time plus the log's offset."""
        return self.frames.join(self.log_offsets(), "log_id").withColumn("session_sec", F.col("time_sec") + F.col("offset_sec")).drop("offset_sec")

    def reference_log(self) -> DataFrame:
        """log_id of the visible log with the most frames (least log_id among equals)."""
        n = self.frames.groupBy("log_id").agg(F.count(F.lit(1)).alias("n"))
        return n.agg(F.max_by("log_id", F.struct("n", -F.col("log_id"))).alias("log_id")).where("log_id is not null")

    def reference(self) -> DataFrame:
        """ref_idx, time_sec: the aligned axis of the reference log."""
        return self.session_time().join(self.reference_log(), "log_id").select(F.col("frame_idx").alias("ref_idx"), F.col("session_sec").alias("time_sec"))

    def on_reference(self, value: str) -> DataFrame:
        return onto_reference(self.frames, self.reference(), value, offsets=self.log_offsets())

    def maneuvers(self, **how) -> DataFrame:
        return maneuver.detect_maneuvers(self.frames, **how)

    def servo_axes(self) -> DataFrame:
        return stats.axis_correlations(self.frames)
