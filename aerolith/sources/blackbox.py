"""Binary flight logs: decoding inside Spark, from any store Spark can read.

Files come as rows of Spark's ``binaryFile`` source and are decoded by ``mapInArrow``, a file in one task (delta frames
build on each other). A file may hold several logs; a log's id is its path, '#' and its number. The format is the public
one of open flight controllers: text headers that define the fields, then frames of one letter each: I (whole values), P
(differences), S (slow), G and H (position and home), E (events).

Damaged places: an unknown frame letter or a field that runs over the end drops the frame; P frames are skipped until the
next I frame. A file without a log gives no rows, as does a log without a main field list.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

START = b"H Product:Blackbox flight data recorder"
#: Event numbers (fixed values).
SYNC, ADJUSTMENT, RESUME, DISARM, FLIGHT_MODE, END = 0, 13, 14, 15, 30, 255


class Damaged(Exception):
    """Bytes that are no frame."""


def signed(value: int, bits: int) -> int:
    value &= (1 << bits) - 1
    return value - (1 << bits) if value >> (bits - 1) else value


class Bytes:
    """Reader of the format's number encodings."""

    def __init__(self, data: bytes, at: int, end: int):
        self.data, self.at, self.end = data, at, end

    def byte(self) -> int:
        if self.at >= self.end:
            raise Damaged
        self.at += 1
        return self.data[self.at - 1]

    def unsigned_vb(self) -> int:
        """Seven bits a byte, lowest first; the top bit says that more follow."""
        value = 0
        for shift in range(0, 35, 7):
            b = self.byte()
            value |= (b & 0x7F) << shift
            if b < 0x80:
                return value & 0xFFFFFFFF
        raise Damaged

    def signed_vb(self) -> int:
        v = self.unsigned_vb()
        return (v >> 1) ^ -(v & 1)

    def little(self, size: int) -> int:
        return signed(sum(self.byte() << (8 * k) for k in range(size)), 8 * size)

    def selected(self, tags: int) -> list[int]:
        """Three values of 1 to 4 bytes, sizes from three pairs of bits."""
        return [self.little((tags >> (2 * k) & 3) + 1) for k in range(3)]

    def tag2_3s32(self) -> list[int]:
        head = self.byte()
        kind = head >> 6
        if kind == 0:
            return [signed(head >> s, 2) for s in (4, 2, 0)]
        if kind == 1:
            b = self.byte()
            return [signed(head, 4), signed(b >> 4, 4), signed(b, 4)]
        if kind == 2:
            return [signed(head, 6), signed(self.byte(), 6), signed(self.byte(), 6)]
        return self.selected(head)

    def tag2_3svariable(self) -> list[int]:
        head = self.byte()
        kind = head >> 6
        if kind == 0:
            return [signed(head >> s, 2) for s in (4, 2, 0)]
        if kind == 1:  # 5, 5 and 4 bits
            all_bits = (head & 0x3F) << 8 | self.byte()
            return [signed(all_bits >> 9, 5), signed(all_bits >> 4, 5), signed(all_bits, 4)]
        if kind == 2:  # 8, 7 and 7 bits
            all_bits = (head & 0x3F) << 16 | self.byte() << 8 | self.byte()
            return [signed(all_bits >> 14, 8), signed(all_bits >> 7, 7), signed(all_bits, 7)]
        return self.selected(head)

    def tag8_4s16(self) -> list[int]:
        """Four values of 0, 4, 8 or 16 bits, packed by half bytes, high half first."""
        tags, held, halves = self.byte(), 0, 0
        out = []
        for k in range(4):
            need = (0, 1, 2, 4)[tags >> (2 * k) & 3]
            while halves < need:
                held, halves = held << 8 | self.byte(), halves + 2
            halves -= need
            out.append(signed(held >> (4 * halves), 4 * need) if need else 0)
            held &= (1 << (4 * halves)) - 1
        return out

    def tag8_8svb(self, count: int) -> list[int]:
        if count == 1:
            return [self.signed_vb()]
        tags = self.byte()
        return [self.signed_vb() if tags >> k & 1 else 0 for k in range(count)]

    def values(self, encodings: list[int]) -> list[int]:
        """One raw value for each encoding number; group encodings take several fields at once."""
        out: list[int] = []
        while len(out) < len(encodings):
            at, kind = len(out), encodings[len(out)]
            if kind == 0:
                out.append(self.signed_vb())
            elif kind == 1:
                out.append(self.unsigned_vb())
            elif kind == 3:
                out.append(-signed(self.unsigned_vb(), 14))
            elif kind == 6:
                count = 1
                while count < 8 and encodings[at + count : at + count + 1] == [6]:
                    count += 1
                out += self.tag8_8svb(count)
            elif kind in (7, 10):
                out += self.tag2_3s32() if kind == 7 else self.tag2_3svariable()
            elif kind == 8:
                out += self.tag8_4s16()
            elif kind == 9:
                out.append(0)
            else:
                raise Damaged
        if len(out) != len(encodings):
            raise Damaged
        return out


class Log:
    """One log of a file: headers, then :meth:`frames`."""

    def __init__(self, data: bytes, at: int, end: int):
        self.params: dict[str, str] = {}
        while data[at : at + 2] == b"H ":
            stop = data.find(b"\n", at, end)
            stop = end if stop < 0 else stop
            key, _, value = data[at + 2 : stop].decode("utf-8", "replace").partition(":")
            self.params[key.strip()] = value.strip()
            at = stop + 1
        self.data, self.at, self.end = data, at, end
        self.names = {k: self.listed(k, "name") for k in "ISGH"}
        self.names["P"] = self.names["I"]

    def listed(self, kind: str, what: str) -> list[str]:
        text = self.params.get(f"Field {kind} {what}", "")
        return text.split(",") if text else []

    def numbers(self, kind: str, what: str) -> list[int]:
        return [int(x) for x in self.listed(kind, what)]

    def number(self, key: str, default: int, at: int = 0) -> int:
        try:
            return int(self.params[key].replace("/", ",").split(",")[at], 0)
        except (KeyError, ValueError, IndexError):
            return default

    def fields(self, kind: str) -> list[str]:
        return self.names[kind]

    def due(self, iteration: int) -> bool:
        """Whether the controller writes a main frame for this loop iteration."""
        every = max(1, self.number("I interval", 32))
        num = self.number("P interval", 1)
        den = self.number("P interval", 1, 1) if "/" in self.params.get("P interval", "") else 1
        return (iteration % every + num - 1) % max(1, den) < num

    def skipped(self, iteration: int) -> int:
        n = 0
        while not self.due(iteration + 1 + n) and n < 1000:
            n += 1
        return n

    def frames(self) -> Iterator[tuple]:
        """('I' main, 'G' position, 'S' slow: values) and ('E', name, code, flags), in file order."""
        raw = Bytes(self.data, self.at, self.end)
        signs = {k: self.numbers(k, "signed") for k in "IGSH"}
        signs["P"] = signs["I"]
        rules = {k: (self.numbers(k, "predictor"), self.numbers(k, "encoding")) for k in "IPSGH"}
        low = self.number("minthrottle", 1150)
        fixed = {4: low, 8: 1500, 9: self.number("vbatref", 0), 11: self.number("motorOutput", low)}
        names = self.names["I"]
        motor = names.index("motor[0]") if "motor[0]" in names else None
        clock = names.index("time") if "time" in names else None
        one = two = None  # the last main frame, and the one before
        home = [0, 0]

        def predicted(kind: str, delta: list[int], new: list[int], i: int) -> int:
            rule = rules[kind][0][i]
            if rule in fixed:
                return fixed[rule]
            if rule == 1:
                return one[i]
            if rule == 2:
                return 2 * one[i] - two[i]
            if rule == 3:
                return int((one[i] + two[i]) / 2)
            if rule == 5:
                return new[motor] if motor is not None and motor < len(new) else 0
            if rule == 6:
                return one[i] + 1 + self.skipped(one[i])
            if rule == 7:
                return home[1 if self.names[kind][i].endswith("[1]") else 0]
            if rule == 10:
                return one[clock] if one and clock is not None else 0
            return 0

        while raw.at < raw.end:
            start, kind = raw.at, chr(raw.data[raw.at])
            raw.at += 1
            try:
                if kind == "E":
                    event = self.event(raw)
                    if event[1] == "resume":
                        one = two = None
                    yield event
                    if event[1] == "end":
                        return
                    continue
                if kind not in rules or not rules[kind][1]:
                    raise Damaged
                delta = raw.values(rules[kind][1])
                if kind == "P" and one is None:
                    continue
                new: list[int] = []
                for i, d in enumerate(delta):
                    v = d + predicted(kind, delta, new, i)
                    sign = signs[kind][i] if i < len(signs[kind]) else 1
                    new.append(signed(v, 32) if sign else v & 0xFFFFFFFF)
            except Damaged:
                one = two = None
                raw.at = start + 1
                continue
            if kind in "IP":
                one, two = new, one if kind == "P" else new
                yield "I", new
            elif kind == "H":
                home = [*new, 0, 0][:2]
            else:
                yield kind, new

    @staticmethod
    def event(raw: Bytes) -> tuple:
        kind = raw.byte()
        if kind == SYNC:
            return "E", "sync", None, raw.unsigned_vb()
        if kind == DISARM:
            return "E", "disarm", str(raw.unsigned_vb()), None
        if kind == FLIGHT_MODE:
            flags, _ = raw.unsigned_vb(), raw.unsigned_vb()
            return "E", "flight_mode", None, flags
        if kind == RESUME:
            raw.unsigned_vb()
            return "E", "resume", None, raw.unsigned_vb()
        if kind == ADJUSTMENT:
            what = raw.byte()
            if what < 128:
                return "E", "adjustment", str(raw.signed_vb()), what
            value = struct.unpack("<f", bytes(raw.byte() for _ in range(4)))[0]
            return "E", "adjustment", repr(value), what - 128
        if kind == END:
            text = raw.data[raw.at : raw.at + 64].split(b"\0")[0].decode("ascii", "replace")
            if not text.startswith("End of log"):
                raise Damaged
            reason = text.partition("reason:")[2].strip(" )")
            raw.at += len(text) + 1
            return "E", "end", reason or None, None
        raise Damaged


def logs_of(data: bytes) -> Iterator[Log]:
    at = data.find(START)
    while at >= 0:
        after = data.find(START, at + len(START))
        log = Log(data, at, after if after >= 0 else len(data))
        if log.names["I"]:
            yield log
        at = after


def _decode(spark: SparkSession, path: str, rows, schema: pa.Schema, ddl: str, batch: int = 4096) -> DataFrame:
    """``rows(log)`` gives tuples after the log's id."""

    def run(batches):
        from aerolith.sources.blackbox import logs_of

        for part in batches:
            for name, data in zip(part.column(0).to_pylist(), part.column(1)):
                for n, log in enumerate(logs_of(data.as_buffer().to_pybytes())):
                    held: list[tuple] = []
                    for row in rows(log):
                        held.append((f"{name}#{n}", *row))
                        if len(held) == batch:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
                            held = []
                    if held:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, ddl)


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """log_id, header_params, fields (position fields as ``gps:`` and their name), firmware."""
    schema = pa.schema([("log_id", pa.string()), ("header_params", pa.map_(pa.string(), pa.string())), ("fields", pa.list_(pa.string())), ("firmware", pa.string())])

    def rows(log):
        yield list(log.params.items()), [*log.fields("I"), *(f"gps:{g}" for g in log.fields("G"))], log.params.get("Firmware revision")

    return _decode(spark, path, rows, schema, "log_id string, header_params map<string,string>, fields array<string>, firmware string")


def _frames(spark: SparkSession, path: str, kind: str, fields: list[str]) -> DataFrame:
    names = ["log_id", "frame_idx", "time_us", *fields]
    types = [pa.string(), pa.int64(), pa.int64(), *[pa.float64()] * len(fields)]

    def rows(log):
        own = log.fields(kind)
        at = [own.index(f) if f in own else None for f in fields]
        clock, last, n = own.index("time") if "time" in own else None, 0, 0
        main_clock = log.fields("I").index("time") if "time" in log.fields("I") else None
        for what, *got in log.frames():
            if what == "I" and main_clock is not None:
                last = got[0][main_clock]
            if what == kind:
                yield n, got[0][clock] if clock is not None else last, *(None if i is None else float(got[0][i]) for i in at)
                n += 1

    ddl = "log_id string, frame_idx long, time_us long" + "".join(f", `{f}` double" for f in fields)
    return _decode(spark, path, rows, pa.schema(list(zip(names, types))), ddl)


def read_main(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """log_id, frame_idx, time_us and the raw values of the named fields of each main frame; null where a log lacks a field."""
    return _frames(spark, path, "I", fields)


def read_gps(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """log_id, frame_idx, time_us and the raw values of the named fields of each position frame."""
    return _frames(spark, path, "G", fields)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """log_id, seq, after_frame (main frame before the event, -1 if none), name, code, flags; as ``logs.map_events`` takes them."""
    schema = pa.schema([("log_id", pa.string()), ("seq", pa.int64()), ("after_frame", pa.int64()), ("name", pa.string()), ("code", pa.string()), ("flags", pa.int64())])

    def rows(log):
        main, seq = -1, 0
        for what, *got in log.frames():
            main += what == "I"
            if what == "E":
                yield seq, main, *got
                seq += 1

    return _decode(spark, path, rows, schema, "log_id string, seq long, after_frame long, name string, code string, flags long")


def with_log_numbers(df: DataFrame) -> DataFrame:
    """``log_id`` as a number, for operators that want one: a hash of path and place in the file."""
    return df.withColumnRenamed("log_id", "log_name").withColumn("log_id", F.xxhash64("log_name"))
