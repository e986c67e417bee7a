"""Synthetic logs for the operator tests."""

import numpy as np
import pandas as pd

FIELDS = [f"{n}_{a}" for n in ("setpoint", "gyroADC", "rcCommand", "axisI") for a in range(3)] + [f"servo_{s}" for s in range(4)] + ["attitude_0"]


def log(spark, fs=1000.0, n=4000, log_id=1, **signals):
    pdf = pd.DataFrame({f: np.zeros(n) for f in FIELDS} | {k: np.asarray(v, float) for k, v in signals.items()})
    pdf.insert(0, "log_id", log_id)
    pdf.insert(1, "frame_idx", np.arange(n))
    pdf.insert(2, "time_sec", np.arange(n) / fs)
    return spark.createDataFrame(pdf)


def axis_log(spark, fs=1000.0, axis=0, log_id=1, **signals):
    n = len(next(iter(signals.values())))
    cols = {c: np.zeros(n) for c in ("sp", "gyro", "p", "i", "d", "f", "s", "spa")} | {k: np.asarray(v, float) for k, v in signals.items()}
    pdf = pd.DataFrame({"log_id": log_id, "axis": axis, "frame_idx": np.arange(n), "time_sec": np.arange(n) / fs} | cols)
    return spark.createDataFrame(pdf).withColumn("axis", __import__("pyspark").sql.functions.col("axis").cast("int"))


def ramp(n=4000, at=1000, rise=50, top=300.0):
    x = np.zeros(n)
    x[at : at + rise] = np.linspace(0, top, rise)
    x[at + rise :] = top
    return x
