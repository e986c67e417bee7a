"""Virtual flight logs made from the driver's ``events`` table, in Spark and in SQL.

A user is a log, the user's events in time order are its frames at a nominal 100 Hz, and the event's value drives all
signals through fixed formulas, so that setpoint and gyro are a known lagging plant. ``real_sec`` keeps the true, uneven
times.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FS = 100.0
AXES = (0, 1, 2)


def events_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def flight_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """main_frames: log_id, frame_idx (dense from 0), time_sec, real_sec and signals."""
    log = Window.partitionBy("log_id")
    by_time = log.orderBy("ts", "event_id")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    e = events_table(spark, sf_dir).select(F.col("user_id").alias("log_id"), "ts", "event_id", "event_type", F.col("value").alias("v"))
    e = e.withColumns({"frame_idx": F.row_number().over(by_time) - 1, "us": micros})
    e = e.withColumn("real_sec", (F.col("us") - F.min("us").over(log)) / 1e6)
    w = log.orderBy("frame_idx")
    e = e.select("log_id", F.col("frame_idx").cast("long"), (F.col("frame_idx") * 0.01).alias("time_sec"), "real_sec", "event_type", "v").withColumns(
        {
            "setpoint_0": F.col("v") * 4.0,
            "setpoint_1": F.coalesce(F.lag("v", 1).over(w), F.lit(0.0)) * 3.0,
            "setpoint_2": F.coalesce(F.lag("v", 2).over(w), F.lit(0.0)) * -2.0,
        }
    )
    e = e.withColumns({f"gyroADC_{a}": F.avg(f"setpoint_{a}").over(w.rowsBetween(-2, 0)) for a in AXES})
    more = {}
    for a in AXES:
        sp, g = F.col(f"setpoint_{a}"), F.col(f"gyroADC_{a}")
        more |= {
            f"axisP_{a}": (sp - g) * 0.5,
            f"axisI_{a}": F.avg(sp - g).over(w.rowsBetween(-7, 0)) + 5.0,
            f"axisD_{a}": g - F.coalesce(F.lag(g).over(w), F.lit(0.0)),
            f"axisF_{a}": (sp - F.coalesce(F.lag(sp).over(w), F.lit(0.0))) * 0.3,
            f"axisS_{a}": F.col("v") * 0.1,
            f"wingSpa_{a}": F.lit(1.0) - F.least(F.col("v") * (a + 1), F.lit(200.0)) / 200.0,
        }
    v = F.col("v")
    more |= {
        "servo_0": 1500.0 + F.least(v * 5.0, F.lit(500.0)),
        "servo_1": 1500.0 - F.least(v * 5.0, F.lit(500.0)),
        "servo_2": 1500.0 + F.least(F.coalesce(F.lag("v", 1).over(w), F.lit(0.0)) * 4.0, F.lit(400.0)),
        "servo_3": 1500.0 + F.when(F.col("frame_idx") % 2 == 0, 300.0).otherwise(-300.0),
        "rcCommand_0": v - 50.0,
        "rcCommand_1": F.coalesce(F.lag("v", 1).over(w), F.lit(0.0)) - 50.0,
        "rcCommand_2": F.coalesce(F.lag("v", 2).over(w), F.lit(0.0)) - 50.0,
        "rcCommand_3": 1000.0 + F.least(v * 6.0, F.lit(1000.0)),
        "attitude_0": (v - 50.0) * 4.0,
        "attitude_1": (v - 50.0) * 2.0,
        "vbatLatest": 16.8 - F.col("frame_idx") * 0.01,
        "gps_speed": 8.0 + F.least(v, F.lit(100.0)) * 0.2,
        "preTpaS": v - 40.0,
        "postTpaS": (v - 40.0) * (F.lit(1.0) - F.least(v, F.lit(100.0)) / 200.0),
    }
    return e.withColumns(more)


def axis_frames(frames: DataFrame) -> DataFrame:
    """Long form: one row per frame and axis with sp, gyro, p, i, d, f, s, spa."""
    cols = {"sp": "setpoint", "gyro": "gyroADC", "p": "axisP", "i": "axisI", "d": "axisD", "f": "axisF", "s": "axisS", "spa": "wingSpa"}
    args = ", ".join(f"{a}, " + ", ".join(f"{c}_{a}" for c in cols.values()) for a in AXES)
    return frames.selectExpr("log_id", "frame_idx", "time_sec", "preTpaS", "postTpaS", f"stack(3, {args}) AS (axis, {', '.join(cols)})")


def _axis_sql(a: int) -> str:
    return (
        f"(setpoint_{a} - gyroADC_{a}) * 0.5 AS axisP_{a}, "
        f"avg(setpoint_{a} - gyroADC_{a}) OVER (w ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) + 5.0 AS axisI_{a}, "
        f"gyroADC_{a} - coalesce(lag(gyroADC_{a}) OVER w, 0.0) AS axisD_{a}, "
        f"(setpoint_{a} - coalesce(lag(setpoint_{a}) OVER w, 0.0)) * CAST(0.3 AS DOUBLE) AS axisF_{a}, "
        f"v * CAST(0.1 AS DOUBLE) AS axisS_{a}, 1.0 - least(v * {a + 1}, 200.0) / 200.0 AS wingSpa_{a}"
    )


FRAMES_SQL = f"""
e0 AS (
  SELECT user_id AS log_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_idx,
         (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6 AS real_sec, event_type, value AS v FROM events),
e1 AS (
  SELECT *, frame_idx * CAST(0.01 AS DOUBLE) AS time_sec, v * 4.0 AS setpoint_0, coalesce(lag(v, 1) OVER w, 0.0) * 3.0 AS setpoint_1,
         coalesce(lag(v, 2) OVER w, 0.0) * -2.0 AS setpoint_2
  FROM e0 WINDOW w AS (PARTITION BY log_id ORDER BY frame_idx)),
e2 AS (
  SELECT *, {', '.join(f'avg(setpoint_{a}) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS gyroADC_{a}' for a in AXES)}
  FROM e1 WINDOW w AS (PARTITION BY log_id ORDER BY frame_idx)),
frames AS (
  SELECT *, {', '.join(map(_axis_sql, AXES))},
    1500.0 + least(v * 5.0, 500.0) AS servo_0, 1500.0 - least(v * 5.0, 500.0) AS servo_1,
    1500.0 + least(coalesce(lag(v, 1) OVER w, 0.0) * 4.0, 400.0) AS servo_2,
    1500.0 + CASE WHEN frame_idx % 2 = 0 THEN 300.0 ELSE -300.0 END AS servo_3,
    v - 50.0 AS rcCommand_0, coalesce(lag(v, 1) OVER w, 0.0) - 50.0 AS rcCommand_1, coalesce(lag(v, 2) OVER w, 0.0) - 50.0 AS rcCommand_2,
    1000.0 + least(v * 6.0, 1000.0) AS rcCommand_3, (v - 50.0) * 4.0 AS attitude_0, (v - 50.0) * 2.0 AS attitude_1,
    CAST(16.8 AS DOUBLE) - frame_idx * CAST(0.01 AS DOUBLE) AS vbatLatest, 8.0 + least(v, 100.0) * CAST(0.2 AS DOUBLE) AS gps_speed,
    v - 40.0 AS preTpaS, (v - 40.0) * (1.0 - least(v, 100.0) / 200.0) AS postTpaS
  FROM e2 WINDOW w AS (PARTITION BY log_id ORDER BY frame_idx)),
axes AS (
  {' UNION ALL '.join(f'SELECT log_id, frame_idx, time_sec, preTpaS, postTpaS, {a} AS axis, setpoint_{a} AS sp, gyroADC_{a} AS gyro, axisP_{a} AS p, axisI_{a} AS i, axisD_{a} AS d, axisF_{a} AS f, axisS_{a} AS s, wingSpa_{a} AS spa FROM frames' for a in AXES)})
"""
