"""SQL twins of the queries on whole series: step responses, bandwidth, latency, hunting, strokes, slow modes, filter chain.

Transforms are cosine and sine sums, recursive filters and state machines are recursive tables.
"""

from __future__ import annotations

from aerolith.plans.basics import r
from aerolith.plans.dynamics import CORR_SQL
from aerolith.plans.spectra import FS, SEG_SQL, TF_SQL, L
from aerolith.sources.virtual_logs import FRAMES_SQL


def step_sql(size: int, keep: int, keys: str) -> str:
    """CTEs from ``sx`` (keys, seg, j, sp, gyro) to ``resp`` (keys, t, r, n): the mean step response of the segments that count."""
    win = f"0.5 * (1 - cos(2 * pi() * j / {size - 1}))"
    turn = f"2 * pi() * j * k / {size}"
    return f"""kk AS (SELECT unnest(generate_series(0, {size - 1})) AS k), tt AS (SELECT unnest(generate_series(0, {keep - 1})) AS t),
    loud AS (SELECT {keys}, seg FROM sx GROUP BY ALL HAVING max(abs(sp)) >= 50),
    dft AS (SELECT {keys}, seg, k, sum(sp * {win} * cos({turn})) AS sr, -sum(sp * {win} * sin({turn})) AS si, sum(gyro * {win} * cos({turn})) AS gr, -sum(gyro * {win} * sin({turn})) AS gi
      FROM sx JOIN loud USING ({keys}, seg) CROSS JOIN kk GROUP BY ALL),
    hh AS (SELECT {keys}, seg, k, (gr * sr + gi * si) / (sr * sr + si * si + 1e-4) AS re, (gi * sr - gr * si) / (sr * sr + si * si + 1e-4) AS im FROM dft),
    imp AS (SELECT {keys}, seg, t, sum(re * cos(2 * pi() * k * t / {size}) - im * sin(2 * pi() * k * t / {size})) / {size} AS v FROM hh CROSS JOIN tt GROUP BY ALL),
    cum AS (SELECT *, sum(v) OVER (PARTITION BY {keys}, seg ORDER BY t) AS s FROM imp),
    good AS (SELECT {keys}, seg FROM cum WHERE t >= {keep - max(1, int(keep * 0.1))} GROUP BY ALL HAVING avg(s) BETWEEN 0.5 AND 3),
    resp AS (SELECT {keys}, t, avg(s) AS r, count(*) AS n FROM cum JOIN good USING ({keys}, seg) GROUP BY ALL)"""


AXES_SQL = "(VALUES (0), (1), (2)) AS v(axis)"
SPEED_SQL = """sp0 AS (SELECT log_id, frame_idx, 8.0 + frame_idx * CAST(0.2 AS DOUBLE) AS speed FROM frames),
    sp1 AS (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY speed) - 1 AS k, count(*) OVER (PARTITION BY log_id) AS n FROM sp0),
    sp2 AS (SELECT log_id, max(CASE WHEN k = floor(CAST(0.05 AS DOUBLE) * (n - 1) + 0.5) THEN speed END) AS lo, max(CASE WHEN k = floor(CAST(0.95 AS DOUBLE) * (n - 1) + 0.5) THEN speed END) AS hi FROM sp1 GROUP BY log_id),
    sp3 AS (SELECT sp0.log_id, frame_idx, (speed - lo) / ((hi - lo) / 3) AS u FROM sp0 JOIN sp2 USING (log_id) WHERE hi - lo >= 2),
    sp4 AS (SELECT log_id, CAST(b AS INT) AS speed_bin, frame_idx, frame_idx - row_number() OVER (PARTITION BY log_id, b ORDER BY frame_idx) AS g FROM sp3, (VALUES (0), (1), (2)) AS w(b) WHERE u >= b AND u < b + 1 + CASE WHEN b = 2 THEN 1e-6 ELSE 0 END),
    rg AS (SELECT log_id, speed_bin, min(frame_idx) AS s, max(frame_idx) + 1 AS e FROM sp4 GROUP BY log_id, speed_bin, g HAVING count(*) >= 16),
    sg AS (SELECT log_id, speed_bin, s, unnest(generate_series(s, e - 16, 8)) AS seg FROM rg), jj AS (SELECT unnest(generate_series(0, 15)) AS j),
    sx AS (SELECT a.log_id, a.axis, speed_bin, seg, j, sp, gyro FROM sg CROSS JOIN jj JOIN axes a ON a.log_id = sg.log_id AND a.frame_idx = seg + j)"""

LI_SQL = """li AS (SELECT l_suppkey AS log_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_partkey, l_linenumber) - 1 AS i, CAST(l_quantity AS DOUBLE) AS q, CAST(l_discount AS DOUBLE) AS d FROM lineitem)"""


def tone(c: str, lo: int, hi: int) -> str:
    return f"CASE WHEN {c} IS NULL THEN 'unknown' WHEN {c} < {lo} THEN 'good' WHEN {c} < {hi} THEN 'warn' ELSE 'bad' END"


#: A stick's state machine as one step: what changes when value v at place i meets the state of y.
_turned = "y.hi2 - y.lo2 > 25"
STROKES_SQL = f"""rc AS (SELECT log_id, frame_idx AS i, 0 AS axis, rcCommand_0 AS v FROM frames UNION ALL SELECT log_id, frame_idx, 1, rcCommand_1 FROM frames UNION ALL SELECT log_id, frame_idx, 2, rcCommand_2 FROM frames),
    st(log_id, axis, i, hi, lo, hi_at, lo_at, sgn, top, stroke) AS (
      SELECT log_id, axis, i, v, v, i, i, 0, CAST(0 AS DOUBLE), CAST(NULL AS DOUBLE) FROM rc WHERE i = 0
      UNION ALL
      SELECT log_id, axis, i, hi2, lo2, ha2, la2,
             CASE WHEN sgn = 0 THEN CASE WHEN {_turned} THEN CASE WHEN ha2 > la2 THEN 1 ELSE -1 END ELSE 0 END WHEN (v - top) * sgn <= 0 AND (top - v) * sgn > 25 THEN -sgn ELSE sgn END,
             CASE WHEN sgn = 0 THEN CASE WHEN {_turned} THEN CASE WHEN ha2 > la2 THEN hi2 ELSE lo2 END ELSE top END WHEN (v - top) * sgn > 0 OR (top - v) * sgn > 25 THEN v ELSE top END,
             CASE WHEN sgn = 0 THEN CASE WHEN {_turned} THEN abs(CASE WHEN ha2 > la2 THEN lo2 ELSE hi2 END) END WHEN (v - top) * sgn <= 0 AND (top - v) * sgn > 25 THEN abs(top) END
      FROM (SELECT st.log_id, st.axis, rc.i, rc.v, sgn, top, CASE WHEN sgn = 0 THEN greatest(hi, rc.v) ELSE hi END AS hi2, CASE WHEN sgn = 0 THEN least(lo, rc.v) ELSE lo END AS lo2,
              CASE WHEN sgn = 0 AND rc.v > hi THEN rc.i ELSE hi_at END AS ha2, CASE WHEN sgn = 0 AND rc.v < lo THEN rc.i ELSE lo_at END AS la2
            FROM st JOIN rc ON rc.log_id = st.log_id AND rc.axis = st.axis AND rc.i = st.i + 1) y),
    s1 AS (SELECT log_id, axis, count(stroke) AS n, quantile_cont(stroke, 0.5) AS p50, quantile_cont(stroke, 0.9) AS p90 FROM st GROUP BY 1, 2),
    s2 AS (SELECT rc.log_id, rc.axis, sqrt(avg(v * v)) AS rms FROM rc GROUP BY 1, 2),
    s3 AS (SELECT log_id, max(time_sec) - min(time_sec) AS sec FROM frames GROUP BY 1),
    s4 AS (SELECT log_id, axis, sec, rms, n, p50, p90, coalesce(p90, rms) AS amp, CASE WHEN sec > 0 THEN n / sec ELSE 0 END AS rate FROM s1 JOIN s2 USING (log_id, axis) JOIN s3 USING (log_id)),
    s5 AS (SELECT log_id, min(sec) AS sec, max(amp) FILTER (WHERE axis < 2) AS amp, max(rate) FILTER (WHERE axis < 2) AS rate, max(rms) FILTER (WHERE axis < 2) AS rms,
             {', '.join(f'max(rms) FILTER (WHERE axis = {a}) AS rms_{a}, max(n) FILTER (WHERE axis = {a}) AS n_{a}, max(p50) FILTER (WHERE axis = {a}) AS p50_{a}, max(p90) FILTER (WHERE axis = {a}) AS p90_{a}' for a in range(3))} FROM s4 GROUP BY log_id)"""

#: The notch of the simulated chain: 300 Hz at 1 kHz with q 3.
_w = "(2 * pi() * 300.0 * CAST(0.001 AS DOUBLE))"
_a0 = f"(1 + sin({_w}) / 6)"
CHAIN_SQL = f"""kc AS (SELECT 2 * pi() * 100.0 * CAST(0.001 AS DOUBLE) / (2 * pi() * 100.0 * CAST(0.001 AS DOUBLE) + 1) AS g, 1 / {_a0} AS b0, -2 * cos({_w}) / {_a0} AS b1, (1 - sin({_w}) / 6) / {_a0} AS a2),
    f(log_id, axis, fi, s0, s1, u0, u1, v0, v1, w0, w1) AS (
      SELECT log_id, axis, CAST(-1 AS BIGINT), {', '.join(['CAST(0 AS DOUBLE)'] * 8)} FROM axes WHERE frame_idx = 0
      UNION ALL
      SELECT log_id, axis, fi, sn, s0, un, u0, vn, v0, b0 * vn + b1 * v0 + b0 * v1 - b1 * w0 - a2 * w1, w0 FROM (
        SELECT *, b0 * un + b1 * u0 + b0 * u1 - b1 * v0 - a2 * v1 AS vn FROM (
          SELECT *, b0 * sn + b1 * s0 + b0 * s1 - b1 * u0 - a2 * u1 AS un FROM (
            SELECT f.log_id, f.axis, a.frame_idx AS fi, s0 + g * (a.sp - s0) AS sn, s0, s1, u0, u1, v0, v1, w0, w1, b0, b1, a2
            FROM f JOIN axes a ON a.log_id = f.log_id AND a.axis = f.axis AND a.frame_idx = f.fi + 1, kc))))"""

_stage = lambda n, x, y: f"SELECT log_id, axis, '{n}' AS stage, frame_idx, {x} AS x, {y} AS y FROM cr"
LAGS_SQL = f"""rcl AS ({' UNION ALL '.join(f'SELECT log_id, frame_idx, {a} AS axis, rcCommand_{a} AS rc FROM frames' for a in range(3))}),
    sv AS (SELECT l.log_id, axis, frame_idx, sum(CASE WHEN rr >= 0 THEN 1 ELSE -1 END * (pwm - 1500.0)) AS servo_sum FROM l JOIN lead_ ON lead_.log_id = l.log_id AND lead_.servo = l.servo GROUP BY 1, 2, 3),
    cr AS (SELECT a.log_id, a.axis, a.frame_idx, rc, sp, servo_sum, gyro FROM axes a JOIN sv USING (log_id, axis, frame_idx) JOIN rcl USING (log_id, axis, frame_idx)),
    pr AS ({_stage('a', 'rc', 'sp')} UNION ALL {_stage('b', 'sp', 'servo_sum')} UNION ALL {_stage('c', 'servo_sum', 'gyro')}),
    nn AS (SELECT log_id, axis, count(*) AS n FROM cr GROUP BY 1, 2), at0 AS (SELECT log_id, axis, n, unnest(generate_series(0, n - 30, 15)) AS pos FROM nn WHERE n >= 30),
    lg AS (SELECT log_id, axis, pos, unnest(generate_series(0, least(n, pos + 37) - pos - 30)) AS lag FROM at0),
    co AS (SELECT lg.log_id, lg.axis, p.stage, pos, lag, stddev_pop(p.x) AS sx, stddev_pop(q.y) AS sy, covar_pop(p.x, q.y) AS c FROM lg JOIN pr p ON p.log_id = lg.log_id AND p.axis = lg.axis AND p.frame_idx >= pos AND p.frame_idx < pos + 30
      JOIN pr q ON q.log_id = p.log_id AND q.axis = p.axis AND q.stage = p.stage AND q.frame_idx = p.frame_idx + lag GROUP BY ALL),
    bs AS (SELECT *, row_number() OVER (PARTITION BY log_id, axis, stage, pos ORDER BY round(r, 9) DESC, lag) AS k FROM (SELECT *, CASE WHEN sy > 0 THEN c / (sx * sy) ELSE -1 END AS r FROM co WHERE sx >= 5)),
    md AS (SELECT log_id, axis, stage, median(lag) / {FS} * 1000 AS ms, median(r) AS r, count(*) AS n FROM bs WHERE k = 1 AND r >= 0.35 GROUP BY 1, 2, 3),
    ch AS (SELECT nn.log_id, nn.axis, {', '.join(f"max(ms) FILTER (WHERE stage = '{s}') AS {s}_ms, max(r) FILTER (WHERE stage = '{s}') AS {s}_r, coalesce(max(md.n) FILTER (WHERE stage = '{s}'), 0) AS {s}_n" for s in 'abc')}
      FROM nn LEFT JOIN md ON md.log_id = nn.log_id AND md.axis = nn.axis GROUP BY 1, 2), ct AS (SELECT *, a_ms + b_ms + c_ms AS total_ms FROM ch)"""

HUNT_SQL = f"""{LI_SQL}, xy AS (SELECT log_id, i, q * 4 + 1400 AS x, d * 100 AS y FROM li), nn AS (SELECT log_id, count(*) AS n, max(abs(y)) AS most FROM xy GROUP BY 1), al AS (SELECT 1 - exp(-2 * pi() * 20.0 / 200.0) AS a),
    hp(log_id, i, l1, o1, l2, o2, m1, p1, m2, p2) AS (
      SELECT log_id, i, x, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), y, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM xy WHERE i = 0
      UNION ALL
      SELECT log_id, i, l1n, o1n, l2 + a * (o1n - l2), o1n - (l2 + a * (o1n - l2)), m1n, p1n, m2 + a * (p1n - m2), p1n - (m2 + a * (p1n - m2)) FROM (
        SELECT hp.log_id, xy.i, l1 + a * (x - l1) AS l1n, x - (l1 + a * (x - l1)) AS o1n, l2, m1 + a * (y - m1) AS m1n, y - (m1 + a * (y - m1)) AS p1n, m2, a
        FROM hp JOIN xy ON xy.log_id = hp.log_id AND xy.i = hp.i + 1, al)),
    z AS (SELECT log_id, i, o2 - avg(o2) OVER (PARTITION BY log_id) AS a, p2 - avg(p2) OVER (PARTITION BY log_id) AS b, o2 FROM hp),
    zn AS (SELECT log_id, sqrt(avg(o2 * o2)) AS rms, sqrt(sum(a * a) * sum(b * b)) AS norm FROM z GROUP BY 1),
    zc AS (SELECT s.log_id, lag, sum(s.a * t.b) AS dot FROM z s CROSS JOIN (SELECT unnest(generate_series(-6, 6)) AS lag) JOIN z t ON t.log_id = s.log_id AND t.i = s.i + lag GROUP BY 1, 2),
    hs AS (SELECT zn.log_id, rms, max(CASE WHEN norm > 0 THEN abs(dot) / norm ELSE 0 END) AS c FROM zn JOIN zc USING (log_id) GROUP BY 1, 2),
    hr AS (SELECT nn.log_id, CASE WHEN n >= 256 AND most > 0 THEN rms END AS rms, CASE WHEN n >= 256 AND most > 0 THEN c END AS c FROM nn LEFT JOIN hs USING (log_id))"""

_mode = "CASE WHEN axis = 1 AND hz BETWEEN 0.02 AND 0.12 THEN 0 WHEN axis <> 1 AND hz BETWEEN 0.15 AND 1.2 THEN 1 WHEN axis = 1 AND hz BETWEEN 0.4 AND 3.0 THEN 2 ELSE -1 END"
MODES_SQL = f"""{LI_SQL}, n_ AS (SELECT log_id, count(*) AS n, avg(q) AS m, CAST(pow(2, ceil(log2(count(*)))) AS BIGINT) AS size FROM li GROUP BY 1 HAVING count(*) >= 64),
    xs AS (SELECT li.log_id, i, size, (q - m) * 0.5 * (1 - cos(2 * pi() * i / (n - 1))) AS x FROM li JOIN n_ USING (log_id)),
    bb AS (SELECT log_id, size, unnest(generate_series(CAST(ceil(CAST(0.015 AS DOUBLE) * size / 20) AS BIGINT), CAST(floor(3.0 * size / 20) AS BIGINT))) AS k FROM n_),
    pw AS (SELECT xs.log_id, k, k * 20.0 / xs.size AS hz, 20.0 / xs.size AS step, 10 * log10(greatest(pow(sum(x * cos(2 * pi() * i * k / xs.size)), 2) + pow(sum(x * sin(2 * pi() * i * k / xs.size)), 2), 1e-12)) AS db FROM xs JOIN bb ON bb.log_id = xs.log_id GROUP BY ALL),
    hf AS (SELECT *, CAST(floor(hz * CAST(0.1 AS DOUBLE) / step) AS BIGINT) AS half FROM pw),
    sm AS (SELECT h.log_id, h.k, h.hz, h.step, sum(p.db * (h.half + 1 - abs(p.k - h.k))) / sum(h.half + 1 - abs(p.k - h.k)) AS s FROM hf h JOIN pw p ON p.log_id = h.log_id AND p.k BETWEEN h.k - h.half AND h.k + h.half GROUP BY ALL),
    pk AS (SELECT *, least(200, greatest(3, CAST(floor(CAST(0.4 AS DOUBLE) / step + 0.5) AS BIGINT))) AS reach, lag(s) OVER w AS l, lead(s) OVER w AS g FROM sm WINDOW w AS (PARTITION BY log_id ORDER BY k)),
    rs AS (SELECT a.log_id, a.hz, a.s - greatest(min(b.s) FILTER (WHERE b.k < a.k), min(b.s) FILTER (WHERE b.k > a.k)) AS rise FROM pk a JOIN sm b ON b.log_id = a.log_id AND b.k BETWEEN a.k - a.reach AND a.k + a.reach WHERE a.s > a.l AND a.s >= a.g GROUP BY a.log_id, a.k, a.hz, a.s),
    nm AS (SELECT *, {_mode} AS mode FROM (SELECT *, log_id % 3 AS axis FROM rs) WHERE rise >= 6),
    kn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY log_id, mode ORDER BY rise DESC, hz) AS o FROM nm WHERE mode >= 0) WHERE o = 1),
    un AS (SELECT * FROM (SELECT nm.*, row_number() OVER (PARTITION BY log_id ORDER BY rise DESC, hz) AS o FROM nm WHERE mode < 0 AND rise >= 12 AND NOT EXISTS (
      SELECT 1 FROM kn WHERE kn.log_id = nm.log_id AND (kn.rise > nm.rise OR (kn.rise = nm.rise AND kn.hz < nm.hz)) AND abs(kn.hz - nm.hz) < 0.05)) WHERE o = 1)"""

ORACLE_SQL = {
    "bandwidth": f"""WITH {FRAMES_SQL}, {TF_SQL}, t AS (SELECT log_id, axis, bin, bin * {FS} / {L} AS f, n, CASE WHEN sxx > 0 AND sqrt(re * re + im * im) / sxx > 1e-6 THEN sqrt(re * re + im * im) / sxx ELSE 1e-6 END AS mag, CASE WHEN sxx > 0 AND syy > 0 THEN least((re * re + im * im) / (sxx * syy), 1) ELSE 0 END AS coh FROM cs),
        g AS (SELECT log_id, axis, max(n) AS n, count(*) FILTER (WHERE f BETWEEN 0.5 AND 12 AND coh >= 0.5) AS c, median(mag) FILTER (WHERE f BETWEEN 0.5 AND 12 AND coh >= 0.5) AS level, min(bin) FILTER (WHERE f BETWEEN 0.5 AND 12 AND coh >= 0.5) AS st FROM t GROUP BY 1, 2),
        h AS (SELECT g.*, min(bin) FILTER (WHERE bin >= st AND (f > 50 OR coh < 0.5)) AS stop FROM g JOIN t USING (log_id, axis) GROUP BY ALL),
        w AS (SELECT t.log_id, t.axis, t.bin, t.f, t.mag, t.coh, st, level, lag(mag) OVER (PARTITION BY log_id, axis ORDER BY bin) AS m0, lag(f) OVER (PARTITION BY log_id, axis ORDER BY bin) AS f0 FROM t JOIN (SELECT log_id, axis, st, stop, level FROM h WHERE n >= 2 AND c >= 2) h USING (log_id, axis) WHERE bin >= st AND (stop IS NULL OR bin < stop)),
        x AS (SELECT log_id, axis, min(bin) FILTER (WHERE bin > st AND mag < level / sqrt(2)) AS pos FROM w GROUP BY 1, 2),
        y AS (SELECT w.log_id, w.axis, min(level) AS level, avg(coh) AS coh, max(CASE WHEN bin = pos THEN f0 + (m0 - level / sqrt(2)) / (m0 - mag) * (f - f0) END) AS hz FROM w JOIN x USING (log_id, axis) WHERE pos IS NULL OR bin <= pos GROUP BY 1, 2),
        k AS (SELECT DISTINCT log_id, axis FROM axes)
        SELECT k.log_id, k.axis, {r('hz', 'hz')}, {r('level', 'plateau')}, {r('coalesce(coh, 0)', 'coherence')}, coalesce(hz IS NOT NULL AND coh >= 0.5, FALSE) AS trusted FROM k LEFT JOIN y USING (log_id, axis)""",
    "step_response": f"""WITH {FRAMES_SQL}, {SEG_SQL}, {step_sql(L, 16, 'log_id, axis')},
        top AS (SELECT log_id, axis, max(n) AS n, max(r) AS peak, min(t) FILTER (WHERE r >= 0.5) AS late, max(r) FILTER (WHERE t = 15) AS fin FROM resp GROUP BY 1, 2),
        pk AS (SELECT resp.log_id, resp.axis, min(t) AS pos FROM resp JOIN top USING (log_id, axis) WHERE r = peak GROUP BY 1, 2), k AS (SELECT DISTINCT log_id, axis FROM axes)
        SELECT k.log_id, k.axis, coalesce(n, 0) AS n_segments, {r('coalesce(peak, 0)', 'peak')}, {r(f'coalesce(pos / {FS} * 1000, 0)', 'peak_ms')}, {r(f'CASE WHEN peak >= 0.5 THEN late / {FS} * 1000 END', 'latency_ms')}, {r('coalesce(fin, 0)', 'final')}
        FROM k LEFT JOIN top USING (log_id, axis) LEFT JOIN pk USING (log_id, axis)""",
    "speed_step_response": f"""WITH {FRAMES_SQL}, {SPEED_SQL}, {step_sql(16, 16, 'log_id, axis, speed_bin')}, k AS (SELECT DISTINCT log_id, axis, speed_bin FROM rg, {AXES_SQL}),
        top AS (SELECT log_id, axis, speed_bin, max(n) AS n, max(r) AS peak, max(r) FILTER (WHERE t = 15) AS fin FROM resp GROUP BY 1, 2, 3)
        SELECT k.log_id, k.axis, k.speed_bin, coalesce(n, 0) AS n_segments, {r('coalesce(peak, 0)', 'peak')}, {r('coalesce(fin, 0)', 'final')} FROM k LEFT JOIN top USING (log_id, axis, speed_bin)""",
    "low_freq_modes": f"""WITH {MODES_SQL} SELECT log_id, axis, {r('hz', 'freq')}, {r('rise', 'prominence_db')}, CASE mode WHEN 0 THEN 'phugoid' WHEN 1 THEN 'dutch-roll' WHEN 2 THEN 'short-period' ELSE 'unclassified' END AS mode
        FROM (SELECT log_id, axis, hz, rise, mode FROM kn UNION ALL SELECT log_id, axis, hz, rise, mode FROM un)""",
    "chain_fidelity": f"""WITH RECURSIVE {FRAMES_SQL}, {CHAIN_SQL}, e AS (SELECT a.log_id, a.axis, count(*) AS n, sqrt(sum((w0 - gyro) * (w0 - gyro)) / sum(gyro * gyro)) AS nrmse FROM f JOIN axes a ON a.log_id = f.log_id AND a.axis = f.axis AND a.frame_idx = f.fi WHERE fi >= 5 GROUP BY 1, 2 HAVING sum(gyro * gyro) > 0)
        SELECT log_id, axis, n, {r('nrmse', 'nrmse')}, {r('greatest(1 - nrmse, 0)', 'fidelity')} FROM e""",
    "input_chain": f"""WITH {FRAMES_SQL}, {CORR_SQL}, {LAGS_SQL} SELECT log_id, axis, {', '.join(f"{r(f'{s}_ms', f'{s}_ms')}, {r(f'{s}_r', f'{s}_r')}, {s}_n" for s in 'abc')}, {r('total_ms', 'total_ms')},
        {tone('a_ms', 5, 15)} AS a_tone, {tone('b_ms', 20, 50)} AS b_tone, {tone('c_ms', 20, 50)} AS c_tone, {tone('total_ms', 40, 100)} AS total_tone FROM ct""",
    "hunt_score": f"""WITH RECURSIVE {HUNT_SQL} SELECT log_id, 0 AS servo, {r('rms', 'rms')}, {r('c', 'coupling')}, {r('rms * (1 - least(1, c))', 'score')},
        CASE WHEN rms IS NULL THEN 'unknown' WHEN rms * (1 - least(1, c)) >= 8 THEN 'hunt' WHEN rms * (1 - least(1, c)) >= 3 THEN 'watch' ELSE 'ok' END AS severity FROM hr""",
    "zigzag_strokes": f"""WITH RECURSIVE {FRAMES_SQL}, {STROKES_SQL} SELECT log_id, {r('sec', 'duration_sec')}, {', '.join(f"{r(f'rms_{a}', f'rms_{a}')}, n_{a} AS reversals_{a}, {r(f'p50_{a}', f'stroke_median_{a}')}, {r(f'p90_{a}', f'stroke_p90_{a}')}" for a in range(3))},
        CASE WHEN sec >= 0.3 AND rms >= 5 THEN CASE WHEN amp < 80 THEN 'cruise' WHEN amp < 220 THEN 'sport' ELSE '3d' END END AS profile,
        CASE WHEN sec >= 0.3 AND rms >= 5 THEN CASE WHEN rate < 0.5 THEN 'calm' WHEN rate < 2 THEN 'active' ELSE 'busy' END END AS character FROM s5""",
}
