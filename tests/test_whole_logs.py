import collections
import math

import pytest

from aerolith.plans import spectra
from aerolith.sources.virtual_logs import flight_frames

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def logs(spark):
    out = collections.defaultdict(list)
    for r in flight_frames(spark, SF).select("log_id", "frame_idx", "v", "event_type").collect():
        out[r.log_id].append(r)
    assert len(out) > 40 and max(map(len, out.values())) > 60
    return {k: sorted(rows, key=lambda r: r.frame_idx) for k, rows in out.items()}


def low_pass(logs):
    want, w = {}, 2 * math.pi * 8.0 * 0.01
    for k, rows in logs.items():
        y = 0.0
        for r in rows:
            y += w / (w + 1) * (r.v - y)
            want[k, r.frame_idx] = pytest.approx(y, abs=1e-5)
    return want


def test_pt1_filter_over_all_frames(spark, logs):
    assert {(r.log_id, r.frame_idx): r.filtered for r in spectra.q_pt1(spark, SF).collect()} == low_pass(logs)


def test_airspeed_euler_over_all_frames(spark):
    by_log, want = collections.defaultdict(list), {}
    for r in spectra.airspeed_inputs(spark, SF).collect():
        by_log[r.log_id].append(r)
    drag = math.atanh(0.5) ** 2 / (4 * 9.81)
    for k, rows in by_log.items():
        v, last = 0.0, None
        for r in sorted(rows, key=lambda r: r.frame_idx):
            if last is not None:
                thrust = max(min(r.throttle * r.vbat / r.full_volts, 1), 0)
                v = max(v + (4 * 9.81 * thrust - 9.81 * math.sin(r.pitch) - drag * v * v) * (r.time_sec - last), 0)
            last = r.time_sec
            want[k, r.frame_idx] = pytest.approx(v, abs=1e-4)
    assert max(i for _, i in want) > 60
    assert {(r.log_id, r.frame_idx): r.airspeed for r in spectra.q_airspeed_euler(spark, SF).collect()} == want
