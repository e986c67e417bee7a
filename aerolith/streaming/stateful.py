"""Stateful forms of the sequential operators for Structured Streaming.

Each keeps a few numbers for a key between micro-batches. Frames of a key must reach the stream in frame order across
micro-batches (any order within one). ``frames`` is a streaming (or static) DataFrame with ``log_id`` and ``frame_idx``.

A key's state ends when the log does: at a frame that is flagged as the last (``Ending.flag``), or, with a watermark, once
event time has passed the key's last frame by ``Ending.quiet``. What the state still holds is given out then, and the
state is removed; without an :class:`Ending` it is kept.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

from aerolith.functions.kernels import pole_gain


@dataclass(frozen=True)
class Ending:
    """When a key's state ends. ``flag``: boolean column of a log's last frame; ``time``: timestamp column with the
    watermark ``late``; ``quiet``: seconds of event time without frames."""

    flag: str | None = None
    time: str | None = None
    late: str = "10 seconds"
    quiet: float = 60.0


def stateful(
    frames: DataFrame, step: Callable, out: str, state: str, start: tuple, key: str = "log_id", finish: Callable | None = None, ending: Ending | None = None
) -> DataFrame:
    """``step(state tuple, frames of one key in order) -> (state tuple, output frame)`` for each key and micro-batch;
    ``finish(state tuple) -> output frame`` gives what an ended key still owes."""
    ending = ending or Ending()
    if ending.time:
        frames = frames.withWatermark(ending.time, ending.late)

    def run(k, parts, held):
        if held.hasTimedOut:
            now = held.get
            held.remove()
            if finish is not None:
                result = finish(now)
                result.insert(0, key, k[0])
                yield result
            return
        rows = pd.concat(list(parts)).sort_values("frame_idx")
        now, result = step(held.get if held.exists else start, rows)
        if ending.flag and rows[ending.flag].fillna(False).any():
            if finish is not None:
                result = pd.concat([result, finish(now)], ignore_index=True).astype(result.dtypes)
            if held.exists:
                held.remove()
        else:
            held.update(now)
            if ending.time:
                last = rows[ending.time].max().value // 1_000_000 + int(ending.quiet * 1000)
                held.setTimeoutTimestamp(max(last, held.getCurrentWatermarkMs() + 1))
        result.insert(0, key, k[0])
        yield result

    types = {f.name: f.dataType.simpleString() for f in frames.schema.fields}
    timeout = GroupStateTimeout.EventTimeTimeout if ending.time else GroupStateTimeout.NoTimeout
    return frames.groupBy(key).applyInPandasWithState(run, f"{key} {types[key]}, {out}", state, "append", timeout)


def hold_last(frames: DataFrame, value: str, ending: Ending | None = None) -> DataFrame:
    """log_id, frame_idx, held: last value that is not null or NaN; null before the first."""

    def step(state, rows):
        seen, last = state
        series = rows[value].astype(float)
        filled = series.ffill()
        if seen:
            filled = filled.fillna(last)
        end = filled.iloc[-1]
        ok = bool(pd.notna(end))
        return (ok, float(end) if ok else 0.0), pd.DataFrame({"frame_idx": rows["frame_idx"], "held": filled})

    return stateful(frames, step, "frame_idx long, held double", "seen boolean, last double", (False, 0.0), ending=ending)


def low_pass(frames: DataFrame, value: str, cutoff: float, fs: float, ending: Ending | None = None) -> DataFrame:
    """log_id, frame_idx, filtered: one-pole low-pass from rest."""
    gain = float(pole_gain(cutoff, 1 / fs, 1))

    def step(state, rows):
        s, out = state[0], []
        for v in rows[value].astype(float).fillna(0.0):
            s += gain * (v - s)
            out.append(s)
        return (s,), pd.DataFrame({"frame_idx": rows["frame_idx"].to_numpy(), "filtered": out})

    return stateful(frames, step, "frame_idx long, filtered double", "s double", (0.0,), ending=ending)


def spans(rows: list) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["start_idx", "end_idx"], dtype="int64")


def closed_runs(frames: DataFrame, flag: str, least: int = 1, ending: Ending | None = None) -> DataFrame:
    """log_id, start_idx, end_idx of each run of true ``flag`` of ``least`` frames or more, once it or its log has ended."""

    def step(state, rows):
        (start, seen), out = state, []
        for i, on in zip(rows["frame_idx"].tolist(), rows[flag].fillna(False).tolist()):
            if on and start < 0:
                start = i
            elif not on and start >= 0:
                if i - start >= least:
                    out.append((start, i))
                start = -1
            seen = i + 1
        return (start, seen), spans(out)

    def finish(state):
        start, seen = state
        return spans([(start, seen)] if start >= 0 and seen - start >= least else [])

    return stateful(frames, step, "start_idx long, end_idx long", "start long, seen long", (-1, 0), finish=finish, ending=ending)


def hysteresis_windows(frames: DataFrame, level: str, enter: float, leave: float, gap: int, least: int, ending: Ending | None = None) -> DataFrame:
    """log_id, start_idx, end_idx of manoeuvre-like windows: opened at ``enter``, closed below ``leave``, merged over up to
    ``gap`` frames, dropped under ``least`` frames. A window is given out once more than ``gap`` quiet frames follow it, or
    its log has ended."""

    def step(state, rows):
        is_open, start, end, out = bool(state[0]), state[1], state[2], []
        for i, v in zip(rows["frame_idx"].tolist(), rows[level].tolist()):
            if v >= enter:
                is_open = True
            elif v < leave:
                is_open = False
            if is_open:
                if start >= 0 and i - end > gap:
                    if end - start >= least:
                        out.append((start, end))
                    start = -1
                start, end = (i if start < 0 else start), i + 1
            elif start >= 0 and i - end > gap:
                if end - start >= least:
                    out.append((start, end))
                start = -1
        return (is_open, start, end), spans(out)

    def finish(state):
        _, start, end = state
        return spans([(start, end)] if start >= 0 and end - start >= least else [])

    return stateful(frames, step, "start_idx long, end_idx long", "open boolean, start long, end long", (False, -1, -1), finish=finish, ending=ending)
