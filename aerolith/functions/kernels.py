"""NumPy kernels for what windows and aggregates cannot express: FFT families, recursive filters, simplex fits."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

G = 9.81


def hann(size: int) -> np.ndarray:
    """Symmetric Hann window."""
    return np.ones(1) if size == 1 else 0.5 * (1 - np.cos(2 * np.pi * np.arange(size) / (size - 1)))


def segments(x: np.ndarray, size: int, step: int, regions=None) -> np.ndarray:
    """Rows are the segments of ``size`` samples every ``step`` samples, within each region if given."""
    parts = []
    for lo, hi in regions if regions is not None and len(regions) else [(0, len(x))]:
        part = x[max(0, int(lo)) : min(len(x), int(hi))]
        if len(part) >= size:
            parts.append(np.lib.stride_tricks.sliding_window_view(part, size)[::step])
    return np.concatenate(parts) if parts else np.empty((0, size))


def require_power_of_two(size: int) -> None:
    if size < 2 or size & (size - 1):
        raise ValueError(f"segment length must be a power of 2, got {size}")


def one_sided(power: np.ndarray) -> np.ndarray:
    out = power.copy()
    out[..., 1:-1] *= 2
    return out


def welch(x: np.ndarray, fs: float, size: int = 1024, overlap: float = 0.5):
    """(freq, psd, number of segments); no detrending; zeros if the series is shorter than a segment."""
    require_power_of_two(size)
    freq = np.arange(size // 2 + 1) * fs / size
    rows = segments(np.asarray(x, float), size, max(1, int(size * (1 - overlap))))
    if not len(rows):
        return freq, np.zeros(size // 2 + 1), 0
    w = hann(size)
    power = np.abs(np.fft.rfft(rows * w, axis=1)) ** 2
    return freq, one_sided(power.mean(0)) / (fs * (w * w).sum()), len(rows)


def stft(x: np.ndarray, fs: float, size: int = 256, hop: int | None = None):
    """(column centres in seconds, power by column and bin)."""
    require_power_of_two(size)
    hop = hop or size // 2
    rows = segments(np.asarray(x, float), size, hop)
    w = hann(size)
    power = one_sided(np.abs(np.fft.rfft(rows * w, axis=1)) ** 2) / (fs * (w * w).sum())
    return (np.arange(len(rows)) * hop + (size - 1) / 2) / fs, power


def edge_sums(rows: np.ndarray) -> np.ndarray:
    """Spectra of ``rows``, the first and last bin as plain cosine and sine sums: the sines of the last bin are not quite
    zero, and their sign decides between a phase of 180 and -180 degrees."""
    size = rows.shape[1]
    out, turn = np.fft.rfft(rows, axis=1), 2 * np.pi * np.arange(size)
    for k in (0, size // 2):
        out[:, k] = rows @ np.cos(turn * k / size) - 1j * (rows @ np.sin(turn * k / size))
    return out


def cross_spectra(x: np.ndarray, y: np.ndarray, size: int = 2048, overlap: float = 0.5, regions=None):
    """Sums over segments of Sxx, Syy and Sxy (conjugate of x times y), segment means removed, and their number."""
    require_power_of_two(size)
    step = max(1, int(size * (1 - overlap)))
    a, b = (segments(np.asarray(v, float), size, step, regions) for v in (x, y))
    w = hann(size)
    fa, fb = (edge_sums((s - s.mean(1, keepdims=True)) * w) if len(s) else np.zeros((0, size // 2 + 1)) for s in (a, b))
    return (np.abs(fa) ** 2).sum(0), (np.abs(fb) ** 2).sum(0), (np.conj(fa) * fb).sum(0) + 0, len(a)


def transfer(x, y, fs: float, size: int = 2048, overlap: float = 0.5, regions=None):
    """(freq, dB, phase in degrees, coherence, segments) of the H1 estimate y / x."""
    sxx, syy, sxy, n = cross_spectra(x, y, size, overlap, regions)
    freq = np.arange(size // 2 + 1) * fs / size
    with np.errstate(divide="ignore", invalid="ignore"):
        h = np.where(sxx > 0, sxy / np.where(sxx > 0, sxx, 1), 0)
        coherence = np.where((sxx > 0) & (syy > 0), np.minimum(np.abs(sxy) ** 2 / np.where((sxx > 0) & (syy > 0), sxx * syy, 1), 1), 0)
        size_h = np.abs(h)
        db = np.where(size_h > 1e-6, 20 * np.log10(np.maximum(size_h, 1e-300)), -120.0)
    return freq, db, np.degrees(np.angle(h)), coherence, n


def bandwidth(freq, db, coherence, n: int, plateau=(0.5, 4.0), trust: float = 0.5, top: float = 50.0):
    """First crossing of plateau / sqrt 2, walking up while coherence holds: (hz or nan, plateau, mean coherence, trusted)."""
    mag = 10 ** (np.asarray(db) / 20)
    low = (freq >= plateau[0]) & (freq <= plateau[1]) & (coherence >= trust)
    if n < 2 or low.sum() < 2:
        return math.nan, math.nan, 0.0, False
    level = float(np.median(mag[low]))
    goal, last, used = level / math.sqrt(2), None, []
    start = int(np.flatnonzero(low)[0])
    for i in range(start, len(freq)):
        if freq[i] > top or coherence[i] < trust:
            break
        used.append(coherence[i])
        if mag[i] < goal and last is not None:
            hz = freq[last] + (mag[last] - goal) / (mag[last] - mag[i]) * (freq[i] - freq[last])
            mean = float(np.mean(used))
            return float(hz), level, mean, bool(np.isfinite(hz) and mean >= trust)
        last = i
    return math.nan, level, float(np.mean(used)) if used else 0.0, False


def step_response(sp, gyro, fs: float, size: int = 2048, overlap: float = 0.5, seconds: float = 0.5, least: float = 50.0, peak_ms: float = 400.0, regions=None):
    """Mean step response by Wiener deconvolution of segments whose setpoint reaches ``least``.

    Returns (response, segments used, peak, peak ms, latency ms, final value). A segment counts if its last tenth
    averages between 0.5 and 3; the regularisation is absolute (1e-4), so results depend on signal units.
    """
    require_power_of_two(size)
    keep = min(size, max(2, int(math.floor(seconds * fs + 0.5))))
    nothing = np.zeros(keep), 0, 0.0, 0.0, math.nan, 0.0
    if fs <= 0 or len(sp) < size:
        return nothing
    step = max(1, int(size * (1 - overlap)))
    s, g = (segments(np.asarray(v, float), size, step, regions) for v in (sp, gyro))
    use = np.abs(s).max(1) >= least if len(s) else np.zeros(0, bool)
    s, g, w = s[use], g[use], hann(size)
    fs_, fg = np.fft.fft(s * w, axis=1), np.fft.fft(g * w, axis=1)
    power = np.abs(fs_) ** 2
    ok = power.max(1) > 0 if len(s) else np.zeros(0, bool)
    impulse = np.fft.ifft(fg * np.conj(fs_) / (power + 1e-4), axis=1).real[ok]
    steps = np.cumsum(impulse, axis=1)[:, :keep]
    tail = max(1, int(keep * 0.1))
    final = steps[:, keep - tail :].mean(1)
    steps = steps[(final >= 0.5) & (final <= 3.0)]
    if not len(steps):
        return nothing
    r = steps.mean(0)
    early = r[: min(keep, max(1, int(math.floor(peak_ms / 1000 * fs + 0.5))))]
    at = int(early.argmax())
    above = np.flatnonzero(early >= 0.5)
    latency = above[0] / fs * 1000 if early[at] >= 0.5 and len(above) else math.nan
    return r, len(steps), float(early[at]), at / fs * 1000, float(latency), float(r[keep - tail :].mean())


def cross_correlation(a, b, most: int) -> np.ndarray:
    """Correlation at lags -most..most of a[i] with b[i + lag], means removed, divided by the global norms."""
    n = min(len(a), len(b))
    a, b = np.asarray(a[:n], float), np.asarray(b[:n], float)
    a, b = a - a.mean() if n else a, b - b.mean() if n else b
    norm = math.sqrt((a * a).sum() * (b * b).sum())
    out = np.zeros(2 * most + 1)
    if norm > 0:
        lags = np.arange(-most, most + 1)
        size = 1 << (n + most).bit_length()  # room for all lags: none wraps around
        products = np.fft.irfft(np.conj(np.fft.rfft(a, size)) * np.fft.rfft(b, size), size)
        out = np.where(np.abs(lags) < n, products[lags % size] / norm, 0.0)
    return out


def window_lags(x, y, fs: float, win_sec: float = 2.0, step_sec: float = 1.0, most_ms: float = 150.0, least_std: float = 5.0, least_r: float = 0.35):
    """Per 2 s window the lag at which y follows x best: arrays of (lag in samples, r) of accepted windows."""
    n, win, most = min(len(x), len(y)), int(round(win_sec * fs)), int(round(most_ms / 1000 * fs))
    out = []
    for at in range(0, n - win + 1, max(1, int(round(step_sec * fs)))):
        a = np.asarray(x[at : at + win], float)
        sd = a.std()
        if sd < least_std:
            continue
        tail = np.asarray(y[at : min(n, at + win + most - 1)], float)
        if len(tail) < win:
            continue
        rows = np.lib.stride_tricks.sliding_window_view(tail, win)
        spread = rows.std(1)
        with np.errstate(divide="ignore", invalid="ignore"):
            r = np.where(spread > 0, ((rows - rows.mean(1, keepdims=True)) @ (a - a.mean())) / (win * sd * np.where(spread > 0, spread, 1)), -1)
        k = int(np.round(r, 9).argmax())  # periodic series tie
        if r[k] >= least_r:
            out.append((k, float(r[k])))
    return out


# --- recursive filters -------------------------------------------------------------------------------------------


def biquad(freq, dt: float, q: float, kind: str):
    """(b0, b1, b2, a1, a2), normalised; ``freq`` may be an array."""
    omega = 2 * np.pi * np.asarray(freq, float) * dt
    c, alpha = np.cos(omega), np.sin(omega) / (2 * q)
    if kind == "lowpass":
        b = ((1 - c) / 2, 1 - c, (1 - c) / 2)
    else:
        b = (np.ones_like(c), -2 * c, np.ones_like(c))
    return tuple(v / (1 + alpha) for v in (*b, -2 * c, 1 - alpha))


def run_biquad(x, coefficients, weight=None) -> np.ndarray:
    """Direct form 1 from rest; coefficients are scalars or one value for each sample; output fades with ``weight``."""
    x = np.asarray(x, float)
    b0, b1, b2, a1, a2 = (np.broadcast_to(c, x.shape).tolist() for c in coefficients)
    out, x1, x2, y1, y2 = [], 0.0, 0.0, 0.0, 0.0
    for i, v in enumerate(x.tolist()):
        y = b0[i] * v + b1[i] * x1 + b2[i] * x2 - a1[i] * y1 - a2[i] * y2
        x1, x2, y1, y2 = v, x1, y, y1
        out.append(y)
    out = np.array(out)
    return out if weight is None else weight * out + (1 - weight) * x


def pole_gain(cutoff, dt: float, order: int):
    """Gain of each pole of a 1- to 3-pole low-pass."""
    w = 2 * np.pi * {1: 1.0, 2: 1.553773974, 3: 1.961459177}[order] * np.asarray(cutoff, float) * dt
    return w / (w + 1)


def poles(x, cutoff, dt: float, order: int = 1) -> np.ndarray:
    """Cascade of one-pole low-passes from rest; the cutoff is a scalar or one value for each sample."""
    y = np.asarray(x, float).tolist()
    k = np.broadcast_to(pole_gain(cutoff, dt, order), (len(y),)).tolist()
    for _ in range(order):
        s, out = 0.0, []
        for g, v in zip(k, y):
            s += g * (v - s)
            out.append(s)
        y = out
    return np.array(y)


def high_pass(x, fs: float, cutoff: float = 20.0) -> np.ndarray:
    """Two one-pole high-passes; each low-pass state starts at its first input."""
    alpha, y = 1 - math.exp(-2 * math.pi * cutoff / fs), np.asarray(x, float).tolist()
    for _ in range(2):
        low, out = (y[0] if y else 0.0), []
        for v in y:
            low += alpha * (v - low)
            out.append(v - low)
        y = out
    return np.array(y)


def notch_cascade(x, centres: np.ndarray, q: float, fs: float, weights: np.ndarray | None = None) -> np.ndarray:
    """Notches in series; ``centres`` and ``weights`` have a row for each notch and a value for each sample."""
    for k, hz in enumerate(centres):
        x = run_biquad(x, biquad(hz, 1 / fs, q, "notch"), None if weights is None else weights[k])
    return x


def harmonics(erpm: np.ndarray, p: dict, fs: float) -> tuple[np.ndarray, np.ndarray]:
    """Centre and weight of the notch at each harmonic of each motor: arrays of (motor and harmonic, sample).

    A motor's frequency is its electrical speed (in hundreds a minute) by pole pairs, smoothed. Centres stay between the
    lower limit and 0.48 of the sampling rate; weights fade in over ``rpm_fade_hz`` above the lower limit.
    """
    order = np.arange(1, int(p["rpm_harmonics"]) + 1)
    share = np.zeros(len(order))
    given = np.asarray(p["rpm_weights"], float)[: len(order)]
    share[: len(given)] = given
    low, high = p["rpm_min_hz"], 0.48 * fs
    base = np.stack([poles(e * (100 / 60 * 2 / p["motor_poles"]), p["rpm_lpf_hz"], 1 / fs) for e in erpm])
    centre = np.minimum(np.maximum(order[None, :, None] * base[:, None, :], low), high)
    fade = np.minimum((centre - low) / p["rpm_fade_hz"], 1) if p["rpm_fade_hz"] > 0 else np.ones_like(centre)
    weight = np.clip(share[None, :, None] * fade, 0, 1)
    used = np.broadcast_to(share > 0, centre.shape[:2]).ravel()
    flat = lambda a: a.reshape(-1, a.shape[-1])[used]
    return flat(centre), flat(weight)


def rpm_notches(x, erpm: list, p: dict, fs: float) -> np.ndarray:
    """Notches at each motor's harmonics; near the lower limit they fade out. Motors with too short a record are left out."""
    x = np.asarray(x, float)
    motors = [np.asarray(e[: len(x)], float) for e in erpm if e is not None and len(e) >= len(x)]
    if not motors or p["rpm_harmonics"] < 1 or p["motor_poles"] < 2:
        return x
    centres, weights = harmonics(np.stack(motors), p, fs)
    return notch_cascade(x, centres, p["rpm_q"], fs, weights)


def lowpass_cutoff(p: dict, throttle):
    """Cutoff of the first gyro low-pass in Hz: one number, one for each sample where it follows throttle, or 0 (off).

    With an exponent e the throttle curve is t + t (1 - t) e / 10 between the two limits; without, 1.5 t (1 - t^2 / 3) of
    the upper limit, but never under the lower one.
    """
    low, high = p["lpf1_dyn_min_hz"], p["lpf1_dyn_max_hz"]
    if low <= 0 or throttle is None:
        return max(0.0, p["lpf1_static_hz"])
    t, e = np.clip(np.asarray(throttle, float), 0, 1), p["lpf1_dyn_expo"]
    return low + (high - low) * (t + t * (1 - t) * e / 10) if e > 0 else np.maximum(1.5 * t * (1 - t * t / 3) * high, low)


def gyro_lowpass(x, p: dict, throttle, fs: float) -> np.ndarray:
    """First gyro low-pass: poles in series, or a second-order section."""
    hz, order = lowpass_cutoff(p, throttle), {"PT1": 1, "PT2": 2, "PT3": 3}.get(p["lpf1_type"])
    if np.ndim(hz) == 0 and hz == 0:
        return np.asarray(x, float)
    return poles(x, hz, 1 / fs, order) if order else run_biquad(x, biquad(hz, 1 / fs, math.sqrt(0.5), "lowpass"))


def notch_tracks(x, p: dict, fs: float, size: int = 256) -> np.ndarray:
    """Centre frequencies of the dynamic notches, one row for each slot; unused slots stay at the upper limit.

    Each column of a short-time spectrum lends its highest local maxima between the limits, in order of frequency, to the
    samples nearest to its centre.
    """
    count, hop, rest = int(np.clip(p["notch_count"], 0, 7)), size // 4, float(p["notch_max_hz"])
    limits = np.floor(np.array([p["notch_min_hz"], p["notch_max_hz"]]) * size / fs + 0.5).astype(int)
    lo, hi = np.clip(limits, 1, size // 2 - 1)
    if not count or len(x) < size or hi <= lo or limits[1] <= limits[0]:
        return np.full((count, len(x)), rest)
    power = stft(x, fs, size, hop)[1][:, lo - 1 : hi + 2]
    here, before, after = power[:, 1:-1], power[:, :-2], power[:, 2:]
    height = np.where((here > before) & (here >= after), here, -np.inf)
    best = np.argsort(-height, axis=1, kind="stable")[:, :count]
    hz = np.where(np.isfinite(np.take_along_axis(height, best, 1)), (lo + best) * fs / size, np.inf)
    hz = np.sort(hz, axis=1)
    slots = np.full((len(power), count), rest)
    slots[:, : hz.shape[1]] = np.where(np.isfinite(hz), hz, rest)
    column = np.clip(np.floor((np.arange(len(x)) - (size - 1) / 2) / hop + 0.5).astype(int), 0, len(power) - 1)
    return slots[column].T


def filter_chain(x, p: dict, fs: float, erpm=(), throttle=None, stages=("rpm", "lpf1", "notch")) -> np.ndarray:
    """Gyro filter chain: motor-speed notches, low-pass, dynamic notches; each stage can be left out."""
    y = np.asarray(x, float)
    if "rpm" in stages and len(erpm):
        y = rpm_notches(y, erpm, p, fs)
    if "lpf1" in stages:
        y = gyro_lowpass(y, p, throttle, fs)
    if "notch" in stages:
        y = notch_cascade(y, notch_tracks(y, p, fs), p["notch_q"], fs)
    return y


# --- state machines and fits ------------------------------------------------------------------------------------


def strokes(x, deadband: float = 25.0) -> list[float]:
    """Sizes |extremum| of stick strokes: an extremum counts once the stick has come back by more than the deadband.

    Until the first move that is larger than the deadband, the running high and low are both candidates; the older one
    of the two is the first stroke.
    """
    values = np.asarray(x, float).tolist()
    if not values:
        return []
    out: list[float] = []
    hi, lo, hi_at, lo_at, sign, top = values[0], values[0], 0, 0, 0, 0.0
    for i, v in enumerate(values[1:], 1):
        if sign == 0:
            if v > hi:
                hi, hi_at = v, i
            if v < lo:
                lo, lo_at = v, i
            if hi - lo > deadband:
                rising = hi_at > lo_at
                out.append(abs(lo if rising else hi))
                sign, top = (1, hi) if rising else (-1, lo)
        elif (v - top) * sign > 0:
            top = v
        elif (top - v) * sign > deadband:
            out.append(abs(top))
            sign, top = -sign, v
    return out


def simplex(seed, cost: Callable, most: int = 800, tolerance: float = 1e-7, step=0.1):
    """Nelder-Mead minimum: (x, loss, converged, iterations).

    Reflection 1, expansion 2, inside contraction and shrink 0.5; vertices sort stably by loss; ends when the losses lie
    within ``tolerance``. ``step``: one value for each coordinate, or a share of it (0.05 at zero).
    """
    seed = np.asarray(seed, float)
    size = np.asarray(step, float) if np.ndim(step) else np.where(np.abs(seed) > 1e-6, step * np.abs(seed), 0.05)
    points = np.vstack([seed, seed + np.diag(size)])
    losses = np.array([cost(p) for p in points])
    for done in range(most + 1):
        order = np.argsort(losses, kind="stable")
        points, losses = points[order], losses[order]
        if losses[-1] - losses[0] < tolerance or done == most:
            return points[0], float(losses[0]), bool(losses[-1] - losses[0] < tolerance), done
        middle, worst = points[:-1].mean(0), points[-1]
        trial = 2 * middle - worst
        loss = cost(trial)
        if loss < losses[0]:
            far = 3 * middle - 2 * worst
            far_loss = cost(far)
            trial, loss = (far, far_loss) if far_loss < loss else (trial, loss)
        elif loss >= losses[-2]:
            trial = (middle + worst) / 2
            loss = cost(trial)
            if loss >= losses[-1]:
                points[1:] = (points[1:] + points[0]) / 2
                losses[1:] = [cost(p) for p in points[1:]]
                continue
        points[-1], losses[-1] = trial, loss
    raise AssertionError


def airspeed(delay_ms: float, gravity_pct: float, time, throttle, vbat, pitch, full_volts: float) -> np.ndarray:
    """Airspeed from thrust, drag and gravity by Euler steps; never negative; steps outside (0, 1] s hold the speed."""
    thrust = (100 / max(1.0, gravity_pct)) ** 2
    tau = max(0.001, delay_ms / 1000) / math.atanh(0.5)
    drag = 1 / (tau * tau * thrust * G)
    dt = np.diff(np.asarray(time, float), prepend=np.nan)
    ok = np.isfinite(dt) & (dt > 0) & (dt <= 1)
    push = np.clip(np.asarray(throttle, float) * np.asarray(vbat, float) / max(0.01, full_volts), 0, 1) * thrust * G - G * np.sin(np.asarray(pitch, float))
    v, out = 0.0, []
    for move, a, h in zip(ok.tolist(), push.tolist(), dt.tolist()):
        if move:
            v = max(0.0, v + (a - drag * v * v) * h)
        out.append(v)
    return np.array(out)


def fit_airspeed(time, throttle, vbat, pitch, gps, full_volts: float, most: int = 250):
    """Two-parameter fit to GPS speed: dict of delay_ms, gravity_pct, r2, rms, iterations, converged."""
    gps = np.asarray(gps, float)
    seen = np.isfinite(gps)

    def legal(p):
        return min(5000.0, max(50.0, p[0])), min(100.0, max(5.0, p[1]))

    def cost(p):
        e = airspeed(*legal(p), time, throttle, vbat, pitch, full_volts)[seen] - gps[seen]
        return float((e * e).mean()) if len(e) else math.inf

    best, _, converged, n = simplex([1000.0, 50.0], cost, most, step=[250.0, 12.0])
    delay, gravity = legal(best)
    e = airspeed(delay, gravity, time, throttle, vbat, pitch, full_volts) - gps
    total = ((gps - gps[seen].mean()) ** 2).sum() if seen.any() else math.nan
    r2 = 1 - (e * e).sum() / total if total > 0 else 0.0
    return {"delay_ms": delay, "gravity_pct": gravity, "r2": float(r2), "rms": float(np.sqrt((e * e).mean())) if len(e) else 0.0, "iterations": n, "converged": converged}


def hyperbolic(x, thr0, thr100, stall, expo):
    """NumPy form of the gain curve in ``functions.columns``."""
    stall, expo, thr0, thr100 = min(0.999, max(0.0, stall)), min(100.0, max(-100.0, expo)), max(1e-6, thr0), max(1e-6, thr100)
    e = -1 / (0.999 - expo / 100)
    y = (np.asarray(x, float) - stall) / (1 - stall)
    base = 1 + (max(1e-9, thr0 / thr100) ** (1 / e) - 1) * y
    return np.where(np.asarray(x) <= stall, thr0, thr0 / np.maximum(1e-9, np.maximum(1e-9, base) ** e))


def fit_hyperbolic(x, y, most: int = 800):
    """Four-parameter fit of the gain curve: dict of thr0, thr100, stall, expo, rms, iterations, converged."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    best, loss, converged, n = simplex([3.0, 0.5, 0.2, 5.0], lambda p: float(((hyperbolic(x, *p) - y) ** 2).sum()), most)
    return dict(zip(("thr0", "thr100", "stall", "expo"), map(float, best))) | {"rms": math.sqrt(loss / max(len(x), 1)), "iterations": n, "converged": converged}
