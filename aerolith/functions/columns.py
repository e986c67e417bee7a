"""Column expressions shared by the operators."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column) -> Column:
    """Nearest integer, halves upwards also below zero; for indices and sample counts."""
    return F.floor(x + 0.5).cast("long")


def finite(x: Column) -> Column:
    """NaN as null, so that aggregates skip it."""
    return F.when(~F.isnan(x), x)


def clamp(x: Column, lo, hi) -> Column:
    return F.greatest(F.least(x, F.lit(hi)), F.lit(lo))


def psd_to_db(power: Column) -> Column:
    return F.when(power <= 1e-12, F.lit(-120.0)).otherwise(F.log10(power) * 10.0)


def hann(j: Column, size: int) -> Column:
    """Symmetric Hann window."""
    return F.lit(1.0) if size == 1 else (F.lit(1.0) - F.cos(F.lit(2 * math.pi) * j / F.lit(size - 1))) * 0.5


def one_pole_gain(cutoff_hz: Column, dt: Column, order: int) -> Column:
    """Smoothing gain of a one-pole low-pass; cascades of 2 and 3 raise the cutoff (fixed corrections)."""
    correction = {1: 1.0, 2: 1.553773974, 3: 1.961459177}[order]
    omega = F.lit(2 * math.pi * correction) * cutoff_hz * dt
    return omega / (omega + 1.0)


def biquad_columns(hz: Column, dt: Column, q: Column, kind: str) -> tuple[Column, ...]:
    """b0, b1, b2, a1, a2 of a second-order low-pass or notch, normalised by 1 + alpha."""
    w = F.lit(2 * math.pi) * hz * dt
    c, alpha = F.cos(w), F.sin(w) / (q * 2.0)
    b = ((F.lit(1.0) - c) / 2.0, F.lit(1.0) - c, (F.lit(1.0) - c) / 2.0) if kind == "lowpass" else (F.lit(1.0), c * -2.0, F.lit(1.0))
    return tuple(v / (alpha + 1.0) for v in (*b, c * -2.0, F.lit(1.0) - alpha))


def hyperbolic(x: Column, thr0: Column, thr100: Column, stall: Column, expo: Column) -> Column:
    """Gain curve over throttle: ``thr0`` up to the stall throttle, from there a hyperbola that reaches ``thr100`` at 1.

    With exponent e = -1 / (0.999 - expo / 100) and y the throttle beyond stall scaled to 0..1, the curve is
    thr0 / (1 + ((thr0 / thr100) ** (1 / e) - 1) * y) ** e. Parameters are kept in their legal ranges.
    """
    stall, expo = clamp(stall, 0.0, 0.999), clamp(expo, -100.0, 100.0)
    thr0, thr100 = F.greatest(thr0, F.lit(1e-6)), F.greatest(thr100, F.lit(1e-6))
    e = F.lit(-1.0) / (F.lit(0.999) - expo / 100.0)
    y = (x - stall) / (F.lit(1.0) - stall)
    base = (F.pow(F.greatest(thr0 / thr100, F.lit(1e-9)), F.lit(1.0) / e) - 1.0) * y + 1.0
    return F.when(x <= stall, thr0).otherwise(thr0 / F.greatest(F.pow(F.greatest(base, F.lit(1e-9)), e), F.lit(1e-9)))
