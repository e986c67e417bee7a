"""The binary decoder against logs written here, and what becomes of raw frames and events."""

import random

import pytest
from pyspark.sql import functions as F

from aerolith.sources import blackbox as B
from aerolith.sources import logs as L


def vb(n):
    out = bytearray()
    n &= 0xFFFFFFFF
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def zigzag(n):
    return vb((n << 1) ^ (n >> 31))


MAIN = [  # name, signed, predictor and encoding of I frames, predictor and encoding of P frames
    ("loopIteration", 0, 0, 1, 6, 9), ("time", 0, 0, 1, 2, 0), ("axisP[0]", 1, 0, 0, 1, 0), ("vbatLatest", 0, 9, 3, 1, 6), ("rcCommand[3]", 0, 4, 1, 1, 6), ("motor[0]", 0, 11, 1, 3, 0), ("motor[1]", 0, 5, 0, 3, 0),
]


def header():
    lines = ["Product:Blackbox flight data recorder by Nicholas Sherlock", "Firmware revision:Somewhere 4.5.1", "I interval:4", "P interval:1/1", "minthrottle:1000", "vbatref:1600", "motorOutput:158,2047"]
    for key, at in (("I name", 0), ("I signed", 1), ("I predictor", 2), ("I encoding", 3), ("P predictor", 4), ("P encoding", 5)):
        lines.append(f"Field {key}:" + ",".join(str(m[at]) for m in MAIN))
    lines += ["Field G name:time,GPS_speed,GPS_coord[0]", "Field G signed:0,0,1", "Field G predictor:10,0,7", "Field G encoding:1,1,0", "Field H name:GPS_home[0],GPS_home[1]", "Field H signed:1,1", "Field H predictor:0,0", "Field H encoding:0,0"]
    return "".join(f"H {x}\n" for x in lines).encode()


def written(n, seed, end=True):
    """A log's bytes, its main frames, position frames and events."""
    rng, out, main, gps, events = random.Random(seed), bytearray(header()), [], [], []
    out += b"H" + zigzag(500) + zigzag(-7)
    t = 1_000_000
    for i in range(n):
        t += rng.randint(900, 1100)
        row = [i, t, rng.randint(-400, 400), rng.randint(1500, 1680), rng.randint(1000, 2000), rng.randint(158, 2047), rng.randint(158, 2047)]
        if i % 4 == 0:
            out += b"I" + vb(row[0]) + vb(row[1]) + zigzag(row[2]) + vb(-(row[3] - 1600) & 0x3FFF) + vb(row[4] - 1000) + vb(row[5] - 158) + zigzag(row[6] - row[5])
            one, two = row, row
        else:
            half = [int((a + b) / 2) for a, b in zip(one, two)]
            pair = [row[3] - one[3], row[4] - one[4]]
            out += b"P" + zigzag(row[1] - 2 * one[1] + two[1]) + zigzag(row[2] - one[2])
            out += bytes([sum((p != 0) << k for k, p in enumerate(pair))]) + b"".join(zigzag(p) for p in pair if p) + zigzag(row[5] - half[5]) + zigzag(row[6] - half[6])
            one, two = row, one
        main.append(row)
        if i % 5 == 2:
            g = [t + 40, rng.randint(0, 3000), rng.randint(-900, 900)]
            out += b"G" + vb(40) + vb(g[1]) + zigzag(g[2] - 500)
            gps.append(g)
        if i == 3:
            out += b"E" + bytes([30]) + vb(5) + vb(1)
            events.append((3, "flight_mode", None, 5))
    if end:
        out += b"E" + bytes([15]) + vb(4) + b"E" + bytes([255]) + b"End of log (disarm reason:4)\0"
        events += [(n - 1, "disarm", "4", None), (n - 1, "end", "4", None)]
    return bytes(out), main, gps, events


def test_decoder_reads_what_was_written(spark, tmp_path):
    a, b = written(40, 1), written(23, 2, end=False)
    (tmp_path / "two.bbl").write_bytes(b"noise before " + a[0] + b[0])
    (tmp_path / "none.bbl").write_bytes(b"no log at all")
    logs = sorted(B.read_logs(spark, str(tmp_path)).collect(), key=lambda r: r.log_id)
    assert [r.log_id[-9:] for r in logs] == ["two.bbl#0", "two.bbl#1"] and logs[0].firmware == "Somewhere 4.5.1" and logs[0].fields[-1] == "gps:GPS_coord[0]" and logs[0].header_params["vbatref"] == "1600"
    names = [m[0] for m in MAIN]
    rows = B.read_main(spark, str(tmp_path), [*names, "absent"]).orderBy("log_id", "frame_idx").collect()
    assert [[int(r[f"{n}"]) for n in names] for r in rows] == a[1] + b[1] and all(r.absent is None and r.time_us == r["time"] for r in rows)
    gps = B.read_gps(spark, str(tmp_path), ["GPS_speed", "GPS_coord[0]"]).orderBy("log_id", "frame_idx").collect()
    assert [[r.time_us, int(r[3]), int(r[4])] for r in gps] == a[2] + b[2]
    events = B.read_events(spark, str(tmp_path)).orderBy("log_id", "seq").collect()
    assert [(r.after_frame, r.name, r.code, r.flags) for r in events] == a[3] + b[3]


def test_decoder_passes_over_damage(spark, tmp_path):
    data, main, _, _ = written(40, 3)
    at = data.index(b"P", len(header()) + 60)
    (tmp_path / "cut.bbl").write_bytes(data[:at] + b"\xff\xff" + data[at + 1 :])
    got = [[int(x) for x in r[3:]] for r in B.read_main(spark, str(tmp_path), [m[0] for m in MAIN]).orderBy("frame_idx").collect()]
    assert len(got) >= 30 and got[-20:] == main[-20:]


@pytest.mark.parametrize(
    "kind, data, want",
    [
        (7, [0b00_01_10_11], [1, -2, -1]), (7, [0b01_00_0111, 0x8F], [7, -8, -1]), (7, [0b10_100000, 0x1F, 0x3F], [-32, 31, -1]), (7, [0b11_00_01_00, 0xFE, 0x34, 0x12, 5], [-2, 0x1234, 5]),
        (10, [0b01_011110, 0x18], [15, 1, -8]), (10, [0b10_111111, 0xC0, 0x81], [-1, 1, 1]), (8, [0b11_10_01_00, 0x7F, 0xE1, 0x23, 0x40], [0, 7, -2, 0x1234]), (8, [0b00_00_01_01, 0x9C], [-7, -4, 0, 0]),
    ],
)
def test_group_encodings(kind, data, want):
    assert B.Bytes(bytes(data), 0, len(data)).values([kind] * len(want)) == want


def test_events_and_positions_of_a_decoded_log(spark, tmp_path):
    data, main, gps, _ = written(40, 4)
    (tmp_path / "one.bbl").write_bytes(data)
    frames = L.with_time(B.read_main(spark, str(tmp_path), ["vbatLatest"]))
    got = L.map_events(B.read_events(spark, str(tmp_path)), frames.where("frame_idx <> 3")).orderBy("seq").collect()
    assert [(r.kind, r.reason, r.flags, r.name) for r in got] == [("flight_mode_change", None, 5, None), ("disarming", "code:4", None, None), ("disarming", "end:4", None, None)]
    assert got[0].time_sec == pytest.approx((main[2][1] - main[0][1]) / 1e6)
    track = L.hydrate_gps(B.read_gps(spark, str(tmp_path), ["GPS_speed"]), frames, ["gps:GPS_speed", "gps:lost"]).orderBy("frame_idx").collect()
    assert [r["gps:GPS_speed"] for r in track] == pytest.approx([g[1] / 100 for g in gps]) and track[0]["gps:lost"] is None
    assert [r.time_sec for r in track] == pytest.approx([(g[0] - main[0][1]) / 1e6 for g in gps])
    assert L.map_events(B.read_events(spark, str(tmp_path)), frames.where("false")).first().time_sec == 0.0
    checks = L.gps_checks(B.read_gps(spark, str(tmp_path), ["GPS_speed"]), ["GPS_speed"]).first().checks["GPS_speed"]
    assert checks.value_max == max(g[1] for g in gps)


def test_frames_are_kept_by_bucket(spark, tmp_path):
    f = spark.range(3000).select((F.col("id") % 30).alias("log_id"), F.floor(F.col("id") / 30).alias("frame_idx"), F.rand(1).alias("x"))
    L.write_frames(f, f"{tmp_path}/f", buckets=4)
    L.write_frames(f.withColumn("log_id", F.col("log_id") + 100), f"{tmp_path}/f", buckets=4)
    one = L.read_log(spark, f"{tmp_path}/f", 7, buckets=4)
    assert one.count() == 100 and L.read_frames(spark, f"{tmp_path}/f").count() == 6000
    assert "PartitionFilters: [isnotnull(bucket" in one._jdf.queryExecution().toString()


def test_capabilities_are_scanned_once(spark, tmp_path):
    path, n = f"{tmp_path}/caps", F.col("id") % 4
    frames = spark.range(400).select(n.alias("log_id"), F.floor(F.col("id") / 4).alias("frame_idx"), (n * 1.0).alias("axisP[0]"))
    logs = spark.range(4).select(F.col("id").alias("log_id"), F.array(F.lit("axisP[0]")).alias("fields"), F.lit(None).cast("string").alias("debug_mode"), F.lit(False).alias("gps_present"), F.lit("x").alias("firmware"))
    first = L.with_capabilities(logs.where("log_id < 3"), frames, ["axisP[0]"], path).collect()
    assert {r.log_id: r.checks["axisP[0]"].all_zero for r in first} == {0: True, 1: False, 2: False} and first[0].total_frames == 100
    again = L.with_capabilities(logs, frames.where("log_id = 3"), ["axisP[0]"], path).collect()  # frames of the others are not needed
    assert {r.log_id: r.total_frames for r in again} == dict.fromkeys(range(4), 100)
    assert spark.read.parquet(path).count() == 4
