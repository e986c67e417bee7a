"""Streaming forms as queries: replays of the virtual logs in three micro-batches, with the batch forms' SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerolith.plans.basics import r, rounded
from aerolith.plans.dynamics import WIN
from aerolith.plans.spectra import ORACLE_SQL as SPECTRA_SQL
from aerolith.sources.virtual_logs import FRAMES_SQL, flight_frames
from aerolith.streaming import stateful as T
from aerolith.streaming.run import replay


def frames(spark, d):
    return flight_frames(spark, d).select("log_id", "frame_idx", "v", "event_type")


def q_low_pass(spark, d):
    return rounded(replay(frames(spark, d), lambda s: T.low_pass(s, "v", 8.0, 100.0)))


def q_hold_last(spark, d):
    f = frames(spark, d).withColumn("click", F.when(F.col("event_type") == "click", F.col("v")))
    return rounded(replay(f, lambda s: T.hold_last(s, "click")))


def q_runs(spark, d):
    f = frames(spark, d).withColumn("on", F.col("v") > 60)
    return replay(f, lambda s: T.closed_runs(s, "on", 2))


def q_windows(spark, d):
    return replay(frames(spark, d), lambda s: T.hysteresis_windows(s, "v", 120.0, 40.0, 2, 2))


QUERIES = {"stream_low_pass": q_low_pass, "stream_hold_last": q_hold_last, "stream_runs": q_runs, "stream_windows": q_windows}

ORACLE_SQL = {
    "stream_low_pass": SPECTRA_SQL["pt1_filter"],
    "stream_hold_last": f"WITH {FRAMES_SQL} SELECT log_id, frame_idx, {r('''last_value(CASE WHEN event_type = 'click' THEN v END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)''', 'held')} FROM frames {WIN}",
    "stream_runs": f"""WITH {FRAMES_SQL}, x AS (SELECT log_id, frame_idx, v > 60 AS on_, count(*) OVER (PARTITION BY log_id) AS n FROM frames), y AS (SELECT *, CASE WHEN on_ = lag(on_) OVER w THEN 0 ELSE 1 END AS ch FROM x {WIN}),
        z AS (SELECT *, sum(ch) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM y {WIN})
        SELECT log_id, min(frame_idx) AS start_idx, max(frame_idx) + 1 AS end_idx FROM z WHERE on_ GROUP BY log_id, g HAVING count(*) >= 2 AND max(frame_idx) + 1 < min(n)""",
    "stream_windows": f"""WITH {FRAMES_SQL}, x AS (SELECT log_id, frame_idx, count(*) OVER (PARTITION BY log_id) AS n, coalesce(last_value(CASE WHEN v >= 120 THEN 1 WHEN v < 40 THEN 0 END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS open FROM frames {WIN}),
        y AS (SELECT *, CASE WHEN open = lag(open) OVER w THEN 0 ELSE 1 END AS ch FROM x {WIN}), z AS (SELECT *, sum(ch) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM y {WIN}),
        i AS (SELECT log_id, min(frame_idx) AS s, max(frame_idx) + 1 AS e, min(n) AS n FROM z WHERE open = 1 GROUP BY log_id, g), j AS (SELECT *, max(e) OVER (PARTITION BY log_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM i),
        k AS (SELECT *, sum(CASE WHEN s - m <= 2 THEN 0 ELSE 1 END) OVER (PARTITION BY log_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM j)
        SELECT log_id, min(s) AS start_idx, max(e) AS end_idx FROM k GROUP BY log_id, g HAVING max(e) - min(s) >= 2 AND min(n) - 1 - max(e) > 2""",
}
