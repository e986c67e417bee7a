import math

import numpy as np
import pytest

from aerolith.functions import kernels as K

RNG = np.random.default_rng(1)


def test_tone_and_parseval():
    x = np.cos(2 * np.pi * 8 * np.arange(256) / 256)
    freq, psd, n = K.welch(x, 256.0, 256)
    assert psd.argmax() == 8 and n == 1 and freq[8] == 8.0
    noise = RNG.normal(size=65536)
    freq, psd, _ = K.welch(noise, 100.0, 512)
    assert abs(psd.sum() * freq[1] - noise.var()) < 0.03
    assert K.welch(x[:10], 1.0, 256)[2] == 0 and not K.welch(x[:10], 1.0, 256)[1].any()
    with pytest.raises(ValueError):
        K.welch(x, 1.0, 100)


def test_first_order_plant():
    x = RNG.normal(size=100_000)
    y = K.poles(x, 10.0, 1 / 1000)
    freq, db, _, coherence, _ = K.transfer(x, y, 1000.0, 2048)
    at = np.abs(freq - 10).argmin()
    assert 0.6 < 10 ** (db[at] / 20) < 0.82 and coherence[at] > 0.95
    hz, _, _, trusted = K.bandwidth(freq, db, coherence, 10)
    assert trusted and 7 < hz < 13


def test_phase_of_the_outer_bins_has_the_sign_of_plain_sums():
    rng, turn, n = np.random.default_rng(8), 2 * math.pi * np.arange(32), 32
    for _ in range(200):
        x, y = rng.normal(size=(2, n))
        phase = K.transfer(x, y, 100.0, n)[2]
        for k in (0, n // 2):
            (ar, ai), (br, bi) = (((h := (v - v.mean()) * K.hann(n)) @ np.cos(turn * k / n), -(h @ np.sin(turn * k / n))) for v in (x, y))
            assert round(phase[k], 5) == round(math.degrees(math.atan2(0 + ar * bi - ai * br, ar * br + ai * bi)), 5)


def test_step_response_of_a_lag():
    sp = np.where(np.arange(8192) // 200 % 2 == 0, 100.0, -100.0)
    r, n, peak, _, latency, final = K.step_response(sp, K.poles(sp, 1 / (2 * math.pi * 0.08), 1 / 1000), 1000.0, 1024)
    assert n > 0 and 0.7 < final < 1.4 and 30 < latency < 100 and peak >= 0.5 and len(r) == 500
    assert K.step_response(sp * 0.1, sp, 1000.0, 1024)[1] == 0


def test_correlation_finds_the_shift():
    a = RNG.normal(size=500)
    r = K.cross_correlation(a, np.roll(a, 7), 20)
    assert r.argmax() - 20 == 7 and r.max() > 0.9
    assert not K.cross_correlation(np.zeros(9), np.ones(9), 3).any()


def test_window_lags():
    t = np.arange(6000) / 1000
    x = 100 * np.sin(2 * np.pi * 0.8 * t) + RNG.normal(size=6000)
    found = K.window_lags(x, np.roll(x, 20), 1000.0)
    assert found and abs(np.median([f[0] for f in found]) - 20) <= 2
    assert K.window_lags(np.zeros(6000), x, 1000.0) == []


@pytest.mark.parametrize("hz,kind,lo,hi", [(100.0, "lowpass", 0.66, 0.75), (100.0, "notch", 0.0, 0.1)])
def test_biquads(hz, kind, lo, hi):
    tone = np.sin(2 * np.pi * hz * np.arange(8000) / 1000)
    out = K.run_biquad(tone, K.biquad(hz, 1 / 1000, 1 / math.sqrt(2) if kind == "lowpass" else 3.0, kind))[4000:]
    assert lo <= np.sqrt((out**2).mean()) / np.sqrt((tone**2).mean()) <= hi
    steady = K.run_biquad(np.ones(3000), K.biquad(hz, 1 / 1000, 1.0, kind))[-1]
    assert abs(steady - 1) < 1e-6


def params(**own):
    return {"lpf1_type": "PT1", "lpf1_static_hz": 0.0, "lpf1_dyn_min_hz": 0.0, "lpf1_dyn_max_hz": 0.0, "lpf1_dyn_expo": 5.0, "notch_count": 0, "notch_q": 3.0, "notch_min_hz": 80.0, "notch_max_hz": 400.0,
            "rpm_harmonics": 0, "rpm_q": 5.0, "rpm_min_hz": 100.0, "rpm_fade_hz": 50.0, "rpm_lpf_hz": 150.0, "rpm_weights": [1.0, 1.0, 1.0], "motor_poles": 14.0} | own


def test_filter_chain():
    t = np.arange(6000) / 1000
    tone = np.sin(2 * np.pi * 200 * t)
    rms = lambda x: np.sqrt((x[3000:] ** 2).mean())
    assert np.array_equal(K.filter_chain(tone, params(), 1000.0), tone)
    assert rms(K.filter_chain(tone, params(notch_count=1), 1000.0)) < 0.3 * rms(tone)
    speed = np.full(6000, 200 * 60 / 100 * 7.0)
    assert rms(K.filter_chain(tone, params(rpm_harmonics=1), 1000.0, [speed])) < 0.2 * rms(tone)
    assert rms(K.filter_chain(tone, params(lpf1_static_hz=50.0), 1000.0)) < 0.35 * rms(tone)
    slow = K.filter_chain(tone, params(lpf1_dyn_min_hz=30.0, lpf1_dyn_max_hz=400.0), 1000.0, throttle=np.zeros(6000))
    fast = K.filter_chain(tone, params(lpf1_dyn_min_hz=30.0, lpf1_dyn_max_hz=400.0), 1000.0, throttle=np.ones(6000))
    assert rms(slow) < rms(fast)


def test_high_pass_removes_the_mean():
    assert np.abs(K.high_pass(np.full(500, 9.0), 1000.0)).max() == 0


def test_strokes():
    assert K.strokes(np.where(np.arange(400) // 50 % 2 == 0, 80.0, -80.0))[1:] == [80.0] * 6
    assert K.strokes(8.0 * np.sin(np.arange(300))) == [] and K.strokes([]) == []


def test_simplex_finds_a_minimum():
    x, loss, converged, n = K.simplex([3.0, -2.0], lambda p: float((p[0] - 1) ** 2 + 10 * (p[1] - 2) ** 2))
    assert converged and np.allclose(x, [1, 2], atol=1e-2) and loss < 1e-4 and n < 300


def test_airspeed_parameters_are_recovered():
    t = np.arange(0, 40, 0.01)
    throttle = np.where((t // 4) % 2 == 0, 1.0, 0.35)
    args = (t, throttle, np.full(len(t), 25.2), 0.15 * np.sin(t / 6))
    speed = K.airspeed(1200.0, 45.0, *args, 25.2)
    assert speed.min() >= 0
    got = K.fit_airspeed(*args, speed, 25.2)
    assert abs(got["delay_ms"] - 1200) < 60 and abs(got["gravity_pct"] - 45) < 2 and got["r2"] > 0.99


def test_gain_curve():
    assert np.allclose(K.hyperbolic([0.1, 0.4, 0.6, 0.8], 2.0, 0.5, 0.2, -0.1), [2.0, 1.625, 1.25, 0.875], atol=1e-6)
    assert np.allclose(K.hyperbolic([0.35, 0.9], 3.0, 0.5, 0.2, 5.0), [2.5176111201, 0.7985967495])
    x = np.linspace(0.05, 1, 300)
    got = K.fit_hyperbolic(x, K.hyperbolic(x, 3.0, 0.5, 0.2, 5.0))
    assert got["rms"] < 0.02
