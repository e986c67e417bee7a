from aerolith.plans import streams
from tests.test_whole_logs import SF, logs, low_pass  # noqa: F401  (logs is a fixture)


def closed(on, n):
    """(start, end) of each run of true values."""
    runs, start = [], None
    for i, x in enumerate([*on, False]):
        if x and start is None:
            start = i
        elif not x and start is not None:
            runs.append((start, i))
            start = None
    return runs


def test_streams_over_all_logs(spark, logs):  # noqa: F811
    held, runs, windows = {}, set(), set()
    for k, rows in logs.items():
        n, last = len(rows), None
        for r in rows:
            last = r.v if r.event_type == "click" and r.v is not None else last
            held[k, r.frame_idx] = None if last is None else round(last, 6)
        runs |= {(k, a, b) for a, b in closed([r.v > 60 for r in rows], n) if b - a >= 2 and b < n}
        state, on = False, []
        for r in rows:
            state = True if r.v >= 120 else False if r.v < 40 else state
            on.append(state)
        merged = []
        for a, b in closed(on, n):
            if merged and a - merged[-1][1] <= 2:
                merged[-1] = (merged[-1][0], b)
            else:
                merged.append((a, b))
        windows |= {(k, a, b) for a, b in merged if b - a >= 2 and n - 1 - b > 2}
    got = {(r.log_id, r.frame_idx): r.held for r in streams.q_hold_last(spark, SF).collect()}
    assert {k: None if v is None else round(v, 6) for k, v in got.items()} == held
    assert {(r.log_id, r.start_idx, r.end_idx) for r in streams.q_runs(spark, SF).collect()} == runs
    assert {(r.log_id, r.start_idx, r.end_idx) for r in streams.q_windows(spark, SF).collect()} == windows
    assert {(r.log_id, r.frame_idx): r.filtered for r in streams.q_low_pass(spark, SF).collect()} == low_pass(logs)
    for found in (held, runs, windows):
        assert max(k[0] for k in found) >= 40
    f = [r for rows in logs.values() for r in rows]
    print("COUNTS", len(f), sum(r.frame_idx < 60 for r in f), sum(r.log_id < 40 for r in f), sum(r.log_id < 40 and r.frame_idx < 60 for r in f), len(runs), sum(k[0] < 40 for k in runs), len(windows), sum(k[0] < 40 for k in windows), len(logs))
