"""Reading, describing and writing log tables.

``main_frames``: log_id, frame_idx, time_us, signals. ``capabilities`` are computed once and kept beside the frames, so
that readiness questions never touch the frames again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What raw events become (fixed values): kind, and what comes before the code in their reason.
EVENT_KINDS = {"disarm": ("disarming", "code:"), "end": ("disarming", "end:"), "flight_mode": ("flight_mode_change", None)}
#: Scales of raw integers to SI (fixed values): hundredths of volt and ampere, degrees in tens of millions, m/s from cm/s,
#: degrees from tenths.
SCALES = {"cv": 1e-2, "mv": 1e-3, "ca": 1e-2, "coordinate": 1e-7, "cms": 1e-2, "decideg": 0.1, "decimetre": 0.1, "us": 1e-6}
#: Units of fields by the beginning of their name (fixed values); other fields stay as they are.
FIELD_UNITS = {
    "vbatLatest": "cv", "amperageLatest": "ca", "gps:GPS_coord": "coordinate", "gps:GPS_altitude": "decimetre", "gps:GPS_speed": "cms", "gps:GPS_ground_course": "decideg",
}
G = 9.80665


def read_frames(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None) -> DataFrame:
    """Frames from Parquet, CSV or JSON; CSV and JSON want a schema. Given a schema, no footer is read to find one; without,
    the schemas of several Parquet logs are merged."""
    if kind == "parquet":
        return spark.read.schema(schema).parquet(path) if schema else spark.read.option("mergeSchema", "true").parquet(path)
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.csv(path, header=True) if kind == "csv" else reader.json(path)


def write_frames(frames: DataFrame, path: str, buckets: int = 64, mode: str = "append") -> None:
    """Frames in ``buckets`` folders by a hash of the log, sorted by log and frame, so that files and row groups of other logs
    are skipped; what is there already stays unless ``mode`` says otherwise."""
    keyed = frames.withColumn("bucket", F.pmod(F.xxhash64("log_id"), F.lit(buckets)).cast("int"))
    keyed.repartition("bucket", "log_id").sortWithinPartitions("bucket", "log_id", "frame_idx").write.mode(mode).partitionBy("bucket").parquet(path)


def read_log(spark: SparkSession, path: str, log_id: int, buckets: int = 64) -> DataFrame:
    """Frames of one log from :func:`write_frames`; only its bucket is listed and read."""
    bucket = F.pmod(F.xxhash64(F.lit(log_id).cast("long")), F.lit(buckets)).cast("int")
    return spark.read.parquet(path).where((F.col("bucket") == bucket) & (F.col("log_id") == log_id)).drop("bucket")


def with_time(frames: DataFrame) -> DataFrame:
    """Adds time_sec, seconds since the log's first frame, from time_us."""
    return frames.withColumn("time_sec", (F.col("time_us") - F.min("time_us").over(Window.partitionBy("log_id"))) / 1e6)


def gps_time(gps: DataFrame, frames: DataFrame) -> DataFrame:
    """Adds time_sec to position frames: seconds since the log's first main frame (its first position frame if it has no
    other), never negative."""
    first = frames.groupBy("log_id").agg(F.min("time_us").alias("__t0"))
    t0 = F.coalesce("__t0", F.min("time_us").over(Window.partitionBy("log_id")))
    return gps.join(first, "log_id", "left").withColumn("time_sec", F.greatest(F.col("time_us") - t0, F.lit(0)) / 1e6).drop("__t0")


def to_si(value: Column, unit: str | None) -> Column:
    """Raw value in SI as a 32-bit float; values without a known unit only change type."""
    return (value.cast("double") * F.lit(SCALES.get(unit, 1.0))).cast("float")


def in_si(frames: DataFrame, fields: list[str]) -> DataFrame:
    """``frames`` with the named fields in SI, by the units of their names."""
    unit = lambda f: next((u for k, u in FIELD_UNITS.items() if f.startswith(k)), None)
    return frames.withColumns({f: to_si(F.col(f"`{f}`"), unit(f)) for f in fields})


def rotation(raw: Column, scale: Column) -> Column:
    """Degrees a second from a raw rate; ``scale``: the header's radians a microsecond for one step."""
    return F.degrees(raw.cast("double") * scale * 1e6).cast("float")


def acceleration(raw: Column, one_g: Column) -> Column:
    """m/s^2 from a raw acceleration; ``one_g``: the header's steps for 1 g."""
    return (raw.cast("double") / one_g * G).cast("float")


def hydrate(frames: DataFrame, fields: list[str]) -> DataFrame:
    """Keys and the named main fields in the given order; a field that no log has is null. Position fields (``gps:``) are
    read by :func:`hydrate_gps`, as they have times of their own."""
    have = set(frames.columns)
    main = [f for f in fields if not f.startswith("gps:")]
    return frames.select("log_id", "frame_idx", "time_sec", *(F.col(f"`{f}`") if f in have else F.lit(None).cast("float").alias(f) for f in main))


def hydrate_gps(gps: DataFrame, frames: DataFrame, fields: list[str]) -> DataFrame:
    """log_id, frame_idx, time_sec and the ``gps:`` fields of ``fields`` in SI, from position frames with raw fields."""
    have, wanted = set(gps.columns), [f for f in fields if f.startswith("gps:")]
    timed = gps_time(gps, frames)
    named = timed.select("log_id", "frame_idx", "time_sec", *(F.col(f"`{f[4:]}`").alias(f) if f[4:] in have else F.lit(None).cast("float").alias(f) for f in wanted))
    return in_si(named, wanted)


def sample_checks(frames: DataFrame, fields: list[str], stride: int = 32) -> DataFrame:
    """log_id, checks (map of field to all_zero, value_min, value_max) over every ``stride``-th frame.

    A log without a sampled frame has all fields zero and no range.
    """
    on = (F.col("frame_idx") + 1) % stride == 0
    aggs = []
    for f in fields:
        value = F.col(f"`{f}`")
        x = F.when(on, value.cast("double"))
        aggs.append(F.struct(F.coalesce(F.max(F.when(on, (value != 0).cast("int"))) == 0, F.lit(True)).alias("all_zero"), F.min(x).alias("value_min"), F.max(x).alias("value_max")).alias(f"__{len(aggs)}"))
    g = frames.groupBy("log_id").agg(*aggs, F.count(F.lit(1)).alias("total_frames"))
    pairs = [c for i, f in enumerate(fields) for c in (F.lit(f), F.col(f"__{i}"))]
    return g.select("log_id", "total_frames", F.create_map(*pairs).alias("checks"))


def capabilities(frames: DataFrame, logs: DataFrame, fields: list[str], stride: int = 32) -> DataFrame:
    """Capability rows (see ``operators.registry``). ``logs``: log_id, fields, debug_mode, gps_present, firmware."""
    return logs.join(sample_checks(frames, fields, stride), "log_id", "left").select(
        "log_id", "fields", "debug_mode", "gps_present", F.coalesce("total_frames", F.lit(0)).cast("long").alias("total_frames"), "firmware", "checks"
    )


def keep_capabilities(caps: DataFrame, path: str) -> None:
    """Adds capability rows to the store at ``path``."""
    caps.write.mode("append").parquet(path)


def with_capabilities(logs: DataFrame, frames: DataFrame, fields: list[str], path: str, stride: int = 32) -> DataFrame:
    """Capability rows of all ``logs``: those in the store at ``path`` are read, the others are made and added to it, so
    that a log's frames are scanned once however often it is asked about."""
    spark = logs.sparkSession
    store = spark._jvm.org.apache.hadoop.fs.Path(path)
    if store.getFileSystem(spark._jsc.hadoopConfiguration()).exists(store):
        new = logs.join(spark.read.parquet(path).select("log_id"), "log_id", "left_anti")
        keep_capabilities(capabilities(frames.join(new.select("log_id"), "log_id", "left_semi"), new, fields, stride), path)
    else:
        keep_capabilities(capabilities(frames, logs, fields, stride), path)
    return spark.read.parquet(path).join(logs.select("log_id"), "log_id", "left_semi")


def map_events(raw: DataFrame, frames: DataFrame) -> DataFrame:
    """log_id, seq, kind, time_sec, reason, flags, name of raw events (log_id, seq, after_frame, name, code, flags).

    An event's time is that of the last frame there is up to ``after_frame``, 0 before any. Disarming and the log's end are
    both a disarming, with the reason ``code:`` or ``end:`` and the code (null without); only other events keep their name.
    """
    none = F.lit(None)
    marks = frames.select("log_id", F.col("frame_idx").alias("at"), F.col("time_sec").alias("t"), none.cast("long").alias("seq"))
    both = marks.unionByName(raw.select("log_id", F.col("after_frame").alias("at"), none.cast("double").alias("t"), F.col("seq").cast("long")))
    upto = Window.partitionBy("log_id").orderBy("at", F.col("seq").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    timed = both.withColumn("time_sec", F.coalesce(F.last("t", ignorenulls=True).over(upto), F.lit(0.0))).where("seq is not null").select("log_id", "seq", "time_sec")
    pick = lambda i: F.coalesce(*(F.when(F.col("name") == k, F.lit(v[i]).cast("string")) for k, v in EVENT_KINDS.items()))
    kind = F.coalesce(pick(0), F.lit("other"))
    reason = F.concat(pick(1), F.col("code").cast("string"))
    return raw.join(timed, ["log_id", "seq"]).select(
        "log_id", "seq", kind.alias("kind"), "time_sec", reason.alias("reason"), F.when(kind == "flight_mode_change", F.col("flags").cast("long")).alias("flags"), F.when(kind == "other", F.col("name")).alias("name")
    )


def gps_checks(gps: DataFrame, fields: list[str]) -> DataFrame:
    """log_id, checks of position fields over every frame: these are few."""
    return sample_checks(gps, fields, 1)


def check_manifest(manifest: DataFrame, caps: DataFrame) -> DataFrame:
    """Problems of a log corpus. ``manifest``: log_id, class, gps_present, bundled, location_class, fields, firmware."""
    j = manifest.alias("m").join(caps.alias("c"), "log_id", "left")
    missing = F.array_except(F.col("m.fields"), F.coalesce(F.col("c.fields"), F.array().cast("array<string>")))
    problems = F.array(
        F.when(F.col("c.total_frames").isNull(), F.lit("not decoded")),
        F.when(~F.col("m.class").isin("wing", "quad", "synthetic"), F.lit("unknown class")),
        F.when(F.col("m.gps_present") & F.col("m.location_class").isNull(), F.lit("GPS without location class")),
        F.when(F.col("m.bundled") & (F.col("m.location_class") == "private"), F.lit("private log bundled")),
        F.when(F.size(missing) > 0, F.concat(F.lit("missing fields: "), F.array_join(missing, ","))),
        F.when(~F.coalesce(F.col("c.firmware").contains(F.col("m.firmware")), F.lit(False)) & F.col("m.firmware").isNotNull(), F.lit("other firmware")),
    )
    return j.select("log_id", F.filter(problems, lambda p: p.isNotNull()).alias("problems"))
