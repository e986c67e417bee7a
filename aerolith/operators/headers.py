"""Header dictionaries: filter configuration, delay budget, servo mixer rules. ``logs``: log_id, header_params (map)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Delay of a low-pass type against a single pole, and the enum numbers of the types (fixed values).
DELAY = {"PT1": 1.0, "PT2": 2.0, "PT3": 3.0, "BIQUAD": 1.5}
TYPES = {"0": "PT1", "1": "BIQUAD", "2": "PT2", "3": "PT3"}


def param(key: str) -> Column:
    return F.trim(F.try_element_at(F.col("header_params"), F.lit(key)))


def whole(key: str) -> Column:
    """Non-negative integer parameter, else null."""
    v = param(key)
    return F.when(v.rlike("^[0-9]+$"), v.try_cast("bigint"))


def pair(key: str, at: int) -> Column:
    """One of two comma-separated integers; null unless there are two and one is not 0."""
    parts = F.filter(F.split(param(key), ","), lambda p: F.trim(p).rlike("^[0-9]+$"))
    parts = F.transform(parts, lambda p: F.trim(p).cast("bigint"))
    return F.when((F.size(parts) == 2) & ~((parts[0] == 0) & (parts[1] == 0)), parts[at])


def low_pass(prefix: str) -> Column:
    """struct filter_type, static_hz, dyn_min_hz, dyn_max_hz; null if off or without any cutoff."""
    raw = param(f"{prefix}_type")
    kind = F.upper(raw)
    name = F.coalesce(*(F.when(kind == k, F.lit(v)) for k, v in TYPES.items()), raw)
    static, lo, hi = whole(f"{prefix}_static_hz"), pair(f"{prefix}_dyn_hz", 0), pair(f"{prefix}_dyn_hz", 1)
    off = raw.isNull() | (kind == "OFF") | ((F.coalesce(static, F.lit(0)) == 0) & lo.isNull())
    return F.when(~off, F.struct(name.alias("filter_type"), static.alias("static_hz"), lo.alias("dyn_min_hz"), hi.alias("dyn_max_hz")))


def counted(prefix: str, count: str, names: tuple[str, ...]) -> Column:
    n = F.coalesce(whole(f"{prefix}_{count}"), F.lit(0))
    return F.when(n > 0, F.struct(n.alias(count), *(F.coalesce(whole(f"{prefix}_{k}"), F.lit(0)).alias(k) for k in names)))


def filter_config(logs: DataFrame) -> DataFrame:
    """log_id and one struct for each configured filter; null where it is off."""
    return logs.select(
        "log_id", counted("dyn_notch", "count", ("min_hz", "max_hz", "q")).alias("dyn_notch"),
        *(low_pass(p).alias(p) for p in ("gyro_lpf1", "gyro_lpf2", "dterm_lpf1", "dterm_lpf2")),
        counted("rpm_filter", "harmonics", ("lpf_hz", "min_hz", "q")).alias("rpm_filter"),
    )


def delay_budget(config: DataFrame) -> DataFrame:
    """log_id, stage, cutoff_hz, delay_ms of each filter, and the stage 'total'."""
    out = None
    for p in ("gyro_lpf1", "gyro_lpf2", "dterm_lpf1", "dterm_lpf2"):
        c = F.col(p)
        hz = F.when(F.coalesce(c["dyn_min_hz"], F.lit(0)) > 0, c["dyn_min_hz"]).otherwise(F.coalesce(c["static_hz"], F.lit(0)))
        times = F.coalesce(*(F.when(F.upper(c["filter_type"]) == k, F.lit(v)) for k, v in DELAY.items()), F.lit(1.0))
        part = config.where(c.isNotNull()).select("log_id", F.lit(p).alias("stage"), hz.alias("cutoff_hz"), (F.lit(1000 / (2 * math.pi)) / hz * times).alias("delay_ms"))
        out = part if out is None else out.unionByName(part)
    for p, n in (("dyn_notch", "count"), ("rpm_filter", "harmonics")):
        c = F.col(p)
        ms = c["q"] / 100.0 / (F.lit(math.pi) * c["min_hz"]) * 1000.0 * c[n]
        out = out.unionByName(config.where(c.isNotNull()).select("log_id", F.lit(p).alias("stage"), c["min_hz"].alias("cutoff_hz"), ms.alias("delay_ms")))
    out = out.where("cutoff_hz > 0")
    total = out.groupBy("log_id").agg(F.sum("delay_ms").alias("delay_ms")).select("log_id", F.lit("total").alias("stage"), F.lit(None).cast("bigint").alias("cutoff_hz"), "delay_ms")
    return out.unionByName(total)


def number(key: str, default: float, at: int | None = None) -> Column:
    v = param(key) if at is None else F.trim(F.get(F.split(param(key), ","), F.lit(at)))
    return F.coalesce(F.regexp_extract(v, r"^[+-]?[0-9]*\.?[0-9]+", 0).try_cast("double"), F.lit(default))


def filter_params(logs: DataFrame) -> DataFrame:
    """Parameters of the simulated filter chain with the firmware's defaults (fixed values)."""
    kind = F.upper(F.coalesce(param("gyro_lpf1_type"), F.lit("")))
    name = F.when(kind.isin("PT2", "2"), "PT2").when(kind.isin("PT3", "3"), "PT3").when(kind.isin("BIQUAD", "1"), "BIQUAD").otherwise("PT1")
    return logs.select(
        "log_id", name.alias("lpf1_type"), number("gyro_lpf1_static_hz", 0).alias("lpf1_static_hz"), number("gyro_lpf1_dyn_hz", 0, 0).alias("lpf1_dyn_min_hz"),
        number("gyro_lpf1_dyn_hz", 0, 1).alias("lpf1_dyn_max_hz"), number("gyro_lpf1_dyn_expo", 5).alias("lpf1_dyn_expo"), number("dyn_notch_count", 0).alias("notch_count"),
        (number("dyn_notch_q", 300) / 100).alias("notch_q"), number("dyn_notch_min_hz", 100).alias("notch_min_hz"), number("dyn_notch_max_hz", 600).alias("notch_max_hz"),
        number("rpm_filter_harmonics", 0).alias("rpm_harmonics"), (number("rpm_filter_q", 500) / 100).alias("rpm_q"), number("rpm_filter_min_hz", 100).alias("rpm_min_hz"),
        number("rpm_filter_fade_range_hz", 50).alias("rpm_fade_hz"), number("rpm_filter_lpf_hz", 150).alias("rpm_lpf_hz"),
        F.array(*(number("rpm_filter_weights", 100, i) / 100 for i in range(3))).alias("rpm_weights"), number("motor_poles", 14).alias("motor_poles"),
    )


def search_params(logs: DataFrame, text: str) -> DataFrame:
    """Parameters whose name or value holds ``text``, case aside, with the command that sets each."""
    rows = logs.select("log_id", F.explode("header_params").alias("key", "value"))
    q = F.lit(text.lower())
    return rows.where(F.lower("key").contains(q) | F.lower("value").contains(q)).withColumn("cli", F.format_string("set %s = %s", "key", "value"))


def indexed(logs: DataFrame, prefix: str, least: int) -> DataFrame:
    """log_id, n, parts (array of int) of numbered list parameters with ``least`` integers or more."""
    rows = logs.select("log_id", F.explode("header_params").alias("key", "value"))
    rows = rows.select("log_id", F.regexp_extract("key", f"^{prefix}([0-9]+)$", 1).try_cast("int").alias("n"), F.transform(F.split("value", ","), lambda p: F.trim(p).try_cast("int")).alias("parts"))
    return rows.where(F.col("n").isNotNull() & (F.size("parts") >= least) & ~F.exists("parts", lambda p: p.isNull()))


def smix_rules(logs: DataFrame) -> DataFrame:
    """log_id, n, target, input, rate, speed, lo, hi, box of each mixer rule."""
    names = ("target", "input", "rate", "speed", "lo", "hi", "box")
    return indexed(logs, "smix", 7).select("log_id", "n", *(F.col("parts")[i].alias(c) for i, c in enumerate(names)))


def servo_params(logs: DataFrame) -> DataFrame:
    """log_id, servo, rate, lo, hi, middle, forward of each servo."""
    names = ("rate", "lo", "hi", "middle", "forward")
    return indexed(logs, "servoParam", 5).select("log_id", F.col("n").alias("servo"), *(F.col("parts")[i].alias(c) for i, c in enumerate(names)))


def mixer_axis(source: Column) -> Column:
    """Axis that a mixer input drives: 0 roll, 1 pitch, 2 yaw; throttle (3) and direct channels (4 on) drive none."""
    return F.when(source.between(0, 2), source)
