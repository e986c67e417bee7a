"""Spectral operators. Kernels run per (log, axis) group; peaks, bins and averages are windows and aggregates.

``rows``: key columns, frame_idx and the named signals.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aerolith.functions import kernels as K
from aerolith.functions.columns import finite, half_up, psd_to_db
from aerolith.operators.segments import frames_in, in_bin_regions
from aerolith.operators.stats import percentile_nearest

KEYS = ("log_id", "axis")


def per_series(rows: DataFrame, keys, signals, kernel, schema: str) -> DataFrame:
    """``kernel(dict of arrays in frame order) -> dict of columns`` for each group; keys are put in front.

    ``schema`` names the kernel's columns. ``frame_idx`` can be one of the signals.
    """
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    full = ", ".join(f"{k} {types[k]}" for k in keys) + ", " + schema
    wanted = list(dict.fromkeys(["frame_idx", *signals]))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame_idx")
        out = pd.DataFrame(kernel({s: pdf[s].to_numpy() for s in signals}))
        for i, (k, v) in enumerate(zip(keys, key)):
            out.insert(i, k, v)
        return out

    run.__annotations__ = {"key": tuple, "pdf": pd.DataFrame, "return": pd.DataFrame}  # Spark reads types, not their names
    return rows.select(*keys, *wanted).groupBy(*keys).applyInPandas(run, full)


def welch_psd(rows: DataFrame, value: str, fs: float, size: int = 1024, overlap: float = 0.5, keys=KEYS) -> DataFrame:
    """keys, bin, freq, psd, n_segments; one-sided, no detrending."""

    def kernel(s):
        freq, psd, n = K.welch(np.nan_to_num(s[value].astype(float)), fs, size, overlap)
        return {"bin": np.arange(len(freq)), "freq": freq, "psd": psd, "n_segments": np.full(len(freq), n)}

    return per_series(rows, keys, [value], kernel, "bin long, freq double, psd double, n_segments long")


def spectrum_peaks(psd: DataFrame, lo: float = 30.0, hi: float = 400.0, around: int = 10, least_db: float = 6.0, keys=KEYS) -> DataFrame:
    """Strict local maxima between lo and hi Hz that stand ``least_db`` over the mean of their positive neighbours."""
    w = Window.partitionBy(*keys).orderBy("bin")
    good = F.when((F.col("psd") > 0) & ~F.isnan("psd") & (F.col("psd") < F.lit(math.inf)), F.col("psd"))
    near = w.rowsBetween(-around, around)
    total, n = F.sum(good).over(near) - F.coalesce(good, F.lit(0.0)), F.count(good).over(near) - F.when(good.isNotNull(), 1).otherwise(0)
    f = psd.withColumns({"__l": F.lag("psd").over(w), "__r": F.lead("psd").over(w), "__m": total / n})
    last = F.max("bin").over(Window.partitionBy(*keys))
    f = f.withColumn("__last", last).where((F.col("bin") >= around) & (F.col("bin") <= F.col("__last") - around))  # whole neighbourhoods only
    f = f.where((F.col("psd") > F.col("__l")) & (F.col("psd") > F.col("__r")) & F.col("freq").between(lo, hi) & (F.col("__m") > 0))
    return f.withColumn("ratio_db", F.log10(F.col("psd") / F.col("__m")) * 10.0).where(F.col("ratio_db") >= least_db).select(*keys, "bin", "freq", "psd", "ratio_db")


def stft_columns(rows: DataFrame, value: str, fs: float, size: int = 256, hop: int | None = None, keys=KEYS) -> DataFrame:
    """keys, col, centre_sec, bin, freq, power."""

    def kernel(s):
        centre, power = K.stft(np.nan_to_num(s[value].astype(float)), fs, size, hop)
        c, b = power.shape
        return {"col": np.repeat(np.arange(c), b), "centre_sec": np.repeat(centre, b), "bin": np.tile(np.arange(b), c), "freq": np.tile(np.arange(b) * fs / size, c), "power": power.ravel()}

    return per_series(rows, keys, [value], kernel, "col long, centre_sec double, bin long, freq double, power double")


def stft_by_speed(columns: DataFrame, speed: DataFrame, fs: float, size: int = 256, hop: int | None = None, bins: int = 20, keys=KEYS) -> DataFrame:
    """keys, speed_bin, bin, power (mean linear), n columns; the last speed bin is closed, columns without speed are left out.

    ``speed``: log_id, frame_idx, speed. Empty cells have no row.
    """
    hop = hop or size // 2
    n = speed.groupBy("log_id").agg((F.max("frame_idx") + 1).alias("n"))
    at = columns.select(*keys, "col").distinct().join(n, "log_id").withColumn("frame_idx", F.least(half_up(F.col("col") * hop + (size - 1) / 2), F.col("n") - 1))
    at = at.join(speed.select("log_id", "frame_idx", finite(F.col("speed")).alias("speed")), ["log_id", "frame_idx"]).where("speed is not null")
    w = Window.partitionBy(*keys)
    lo, hi = F.min("speed").over(w), F.max("speed").over(w)
    at = at.withColumns({"lo": lo, "hi": F.when(hi > lo, hi).otherwise(lo + 1.0)})
    at = at.withColumn("speed_bin", F.least(F.floor((F.col("speed") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)))
    return columns.join(at.select(*keys, "col", "speed_bin"), [*keys, "col"]).groupBy(*keys, "speed_bin", "bin").agg(F.avg("power").alias("power"), F.count(F.lit(1)).alias("n"))


def transfer_function(rows: DataFrame, x: str, y: str, fs: float, size: int = 2048, overlap: float = 0.5, keys=KEYS) -> DataFrame:
    """keys, bin, freq, db, phase_deg, coherence, n_segments of y over x."""

    def kernel(s):
        freq, db, phase, coh, n = K.transfer(np.nan_to_num(s[x].astype(float)), np.nan_to_num(s[y].astype(float)), fs, size, overlap)
        return {"bin": np.arange(len(freq)), "freq": freq, "db": db, "phase_deg": phase, "coherence": coh, "n_segments": np.full(len(freq), n)}

    return per_series(rows, keys, [x, y], kernel, "bin long, freq double, db double, phase_deg double, coherence double, n_segments long")


def bandwidth(tf: DataFrame, keys=KEYS, **how) -> DataFrame:
    """keys, hz (null if not crossed), plateau, coherence, trusted."""
    rows = tf.withColumn("frame_idx", F.col("bin"))

    def kernel(s):
        hz, level, coh, ok = K.bandwidth(s["freq"], s["db"], s["coherence"], int(s["n_segments"][0]), **how)
        none = lambda v: None if math.isnan(v) else v
        return {"hz": [none(hz)], "plateau": [none(level)], "coherence": [coh], "trusted": [ok]}

    return per_series(rows, keys, ["freq", "db", "coherence", "n_segments"], kernel, "hz double, plateau double, coherence double, trusted boolean")


def step_response(rows: DataFrame, fs: float, size: int = 2048, keys=KEYS, **how) -> DataFrame:
    """keys, n_segments, peak, peak_ms, latency_ms (null if never above a half), final, response (array)."""

    def kernel(s):
        r, n, peak, at, late, final = K.step_response(np.nan_to_num(s["sp"].astype(float)), np.nan_to_num(s["gyro"].astype(float)), fs, size, **how)
        return {"n_segments": [n], "peak": [peak], "peak_ms": [at], "latency_ms": [None if math.isnan(late) else late], "final": [final], "response": [r.tolist()]}

    return per_series(rows, keys, ["sp", "gyro"], kernel, "n_segments long, peak double, peak_ms double, latency_ms double, final double, response array<double>")


def speed_step_response(rows: DataFrame, speed: DataFrame, fs: float, size: int = 2048, bins: int = 3, spread: float = 2.0, keys=KEYS) -> DataFrame:
    """Step response in each of ``bins`` speed bins between the 5th and 95th percentile; only regions wholly in the bin count."""
    lo = percentile_nearest(speed, "speed", 5.0).withColumnRenamed("value", "p_lo")
    hi = percentile_nearest(speed, "speed", 95.0).withColumnRenamed("value", "p_hi")
    ends = lo.join(hi, "log_id").where(F.col("p_hi") - F.col("p_lo") >= spread)
    f = speed.join(ends, "log_id")
    width = (F.col("p_hi") - F.col("p_lo")) / bins
    regions = None
    for b in range(bins):
        scaled = f.select("log_id", "frame_idx", ((F.col("speed") - F.col("p_lo")) / width).alias("u"))
        part = in_bin_regions(scaled, "u", float(b), b + 1 + (1e-6 if b + 1 == bins else 0.0), size).withColumn("speed_bin", F.lit(b))
        regions = part if regions is None else regions.unionByName(part)
    inside = frames_in(rows.select(*keys, "frame_idx", "sp", "gyro"), regions)

    def kernel(s):
        at = s["frame_idx"]
        cut = np.flatnonzero(np.diff(at) != 1) + 1
        edges = [0, *cut.tolist(), len(at)]
        res = K.step_response(s["sp"].astype(float), s["gyro"].astype(float), fs, size, regions=list(zip(edges, edges[1:])))
        return {"n_segments": [res[1]], "peak": [res[2]], "final": [res[5]]}

    return per_series(inside, (*keys, "speed_bin"), ["frame_idx", "sp", "gyro"], kernel, "n_segments long, peak double, final double")


def cross_correlation(pairs: DataFrame, most: int, keys=("log_id",), a: str = "a", b: str = "b") -> DataFrame:
    """keys, lag, r for lags -most..most: means removed, divided by the norms over the whole series."""

    def kernel(s):
        return {"lag": np.arange(-most, most + 1), "r": K.cross_correlation(s[a].astype(float), s[b].astype(float), most)}

    return per_series(pairs, keys, [a, b], kernel, "lag long, r double")


def align_logs(xcorr: DataFrame, hz: float = 50.0, exclude_sec: float = 1.0, keys=("log_id",)) -> DataFrame:
    """Offset -lag / hz of the best lag (first of equals), its correlation, and its ratio to the best lag further than
    ``exclude_sec`` away (null: none is positive)."""
    best = F.max_by(F.struct("lag", "r"), F.struct(F.col("r"), -F.col("lag"))).alias("m")
    top = xcorr.groupBy(*keys).agg(best).select(*keys, F.col("m.lag").alias("best"), F.col("m.r").alias("ncc"))
    far = xcorr.join(top, list(keys)).where(F.abs(F.col("lag") - F.col("best")) > exclude_sec * hz).groupBy(*keys).agg(F.max("r").alias("rival"))
    out = top.join(far, list(keys), "left")
    return out.select(*keys, (-F.col("best") / hz).alias("offset_sec"), "ncc", F.when(F.col("rival") > 0, F.col("ncc") / F.col("rival")).alias("peak_ratio"))


def align_policy(aligned: DataFrame, throttle: DataFrame, ref_first: float, least_ncc: float = 0.4, least_ratio: float = 1.5) -> DataFrame:
    """Chosen offset: a clear correlation, else the first throttle-up, else the correlation marked low."""
    j = aligned.join(throttle.select("log_id", "first_sec"), "log_id", "left")
    clear = (F.col("ncc") >= least_ncc) & (F.coalesce("peak_ratio", F.lit(math.inf)) >= least_ratio)
    by_throttle = F.lit(ref_first) - F.col("first_sec")
    return j.select(
        "log_id", F.when(clear, F.col("offset_sec")).when(by_throttle.isNotNull(), by_throttle).otherwise(F.col("offset_sec")).alias("offset_sec"),
        F.when(clear, "correlation").when(by_throttle.isNotNull(), "first-throttle").otherwise("low-confidence").alias("method"),
    )


#: Airframe modes by axis (fixed values): name, axes, low and high edge in Hz.
MODES = [("phugoid", (1,), 0.02, 0.12), ("dutch-roll", (0, 2), 0.15, 1.2), ("short-period", (1,), 0.4, 3.0)]


def low_frequency_modes(rows: DataFrame, value: str, fs: float, least_db: float = 6.0, keys=KEYS) -> DataFrame:
    """keys, freq, prominence_db, mode: slow airframe oscillations below 3 Hz from one long zero-padded spectrum."""

    def kernel(s):
        axis = int(s["__axis"][0])
        x = np.nan_to_num(s[value].astype(float))
        factor = max(1, int(math.floor(fs / 20 + 0.5)))
        x = x[: len(x) // factor * factor].reshape(-1, factor).mean(1)
        none = {"freq": [], "prominence_db": [], "mode_id": []}
        if len(x) < 64:
            return none
        used = x[:65536]
        size = 1 << (len(used) - 1).bit_length()
        power = np.abs(np.fft.rfft((used - used.mean()) * K.hann(len(used)), size)) ** 2
        hz = np.arange(len(power)) * fs / factor / size
        keep = (hz >= 0.015) & (hz <= 3)
        hz, db = hz[keep], 10 * np.log10(np.maximum(power[keep], 1e-12))
        if len(hz) < 3:
            return none
        step = hz[1] - hz[0]
        smooth = np.empty_like(db)
        for i in range(len(db)):  # triangle that widens with frequency
            half = int(hz[i] * 0.1 / step)
            a, b = max(0, i - half), min(len(db), i + half + 1)
            weight = half + 1 - np.abs(np.arange(a, b) - i)
            smooth[i] = (db[a:b] * weight).sum() / weight.sum()
        reach = int(min(200, max(3, math.floor(0.4 / step + 0.5))))
        found = []
        for i in range(1, len(smooth) - 1):
            if smooth[i] > smooth[i - 1] and smooth[i] >= smooth[i + 1]:
                left, right = smooth[max(0, i - reach) : i].min(), smooth[i + 1 : i + 1 + reach].min()
                rise = smooth[i] - max(left, right)
                if rise >= least_db:
                    name = next((k for k, (_, axes, lo, hi) in enumerate(MODES) if axis in axes and lo <= hz[i] <= hi), -1)
                    found.append((rise, hz[i], name))
        found.sort(key=lambda p: (-p[0], p[1]))
        seen, out = set(), []
        for rise, f, name in found:
            if name in seen or (name < 0 and (rise < 12 or any(abs(f - o[1]) < 0.05 for o in out))):
                continue
            seen.add(name)
            out.append((rise, f, name))
        return {"freq": [o[1] for o in out[:8]], "prominence_db": [o[0] for o in out[:8]], "mode_id": [o[2] for o in out[:8]]}

    found = per_series(rows.withColumn("__axis", F.col("axis")), keys, [value, "__axis"], kernel, "freq double, prominence_db double, mode_id long")
    mode = F.when(F.col("mode_id") < 0, "unclassified").otherwise(F.element_at(F.array(*(F.lit(m[0]) for m in MODES)), (F.col("mode_id") + 1).cast("int")))
    return found.select(*keys, "freq", "prominence_db", mode.alias("mode"))


def db(psd: DataFrame) -> DataFrame:
    return psd.withColumn("db", psd_to_db(F.col("psd")))
