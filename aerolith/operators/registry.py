"""Signal registry and readiness rules, as joins of small rule tables with the capabilities of each log.

capabilities: log_id, fields (array), debug_mode, gps_present, total_frames, firmware, checks (map of field name to
struct all_zero, value_min, value_max).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

CHECKS = "map<string,struct<all_zero:boolean,value_min:double,value_max:double>>"
SCHEMA = f"log_id string, fields array<string>, debug_mode string, gps_present boolean, total_frames long, firmware string, checks {CHECKS}"

#: Rule table (fixed values): signal, axis (-1: none), preference, kind, field, debug mode, lowest and highest value.
SOURCES: list[tuple] = [
    ("tpa_speed_est", -1, 0, "main_frame", "wingTpaAirspeed", None, None, None, None),
    ("tpa_speed_est", -1, 1, "debug", "debug[4]", "TPA", 0.0, 1500.0, None),
    ("tpa_arg", -1, 0, "main_frame", "wingTpaArg", None, None, None, None),
    ("tpa_arg", -1, 1, "debug", "debug[5]", "TPA", 0.0, 1000.0, None),
    ("tpa_factor", -1, 0, "main_frame", "wingTpaFactor", None, None, None, None),
    ("tpa_factor", -1, 1, "debug", "debug[0]", "TPA", 0.0, 3000.0, None),
    ("attitude_roll", -1, 0, "main_frame", "wingTpaRoll", None, None, None, None),
    ("attitude_roll", -1, 1, "debug", "debug[1]", "TPA", -1800.0, 1800.0, None),
    ("attitude_pitch", -1, 0, "main_frame", "wingTpaPitch", None, None, None, None),
    ("attitude_pitch", -1, 1, "main_frame", "attitude[1]", None, None, None, None),
    ("attitude_pitch", -1, 2, "debug", "debug[2]", "TPA", -900.0, 900.0, None),
    ("throttle_calc", -1, 0, "main_frame", "wingTpaThrottle", None, None, None, None),
    ("throttle_calc", -1, 1, "debug", "debug[3]", "TPA", 0.0, 1000.0, None),
    *[(s, a, 0, "main_frame", f"{f}[{a}]", None, None, None, None) for s, f in (
        ("gyro_raw", "gyroUnfilt"), ("spa", "wingSpa"), ("pre_tpa_setpoint", "wingSetpointRaw"), ("adjusted_setpoint", "wingSetpointAdj"),
        ("pre_tpa_s", "wingSTermRaw"), ("post_tpa_s", "wingSTermPost")) for a in range(3)],
    *[("post_tpa_s", a, 1, "main_frame", f"axisS[{a}]", None, None, None, None) for a in range(3)],
    *[("gyro_raw", a, 1, "debug", f"debug[{a}]", "GYRO_RAW", None, None, None) for a in range(3)],
    *[("spa", a, 1, "debug", f"debug[{a}]", "SPA", None, None, None) for a in range(3)],
    *[(s, a, 1, "debug", f"debug[{2 * a + k}]", "WING_SETPOINT", None, None, None) for k, s in enumerate(("pre_tpa_setpoint", "adjusted_setpoint")) for a in range(3)],
    *[("pre_tpa_s", a, 1, "debug", f"debug[{2 * a}]", "S_TERM", None, None, None) for a in range(3)],
    *[("post_tpa_s", a, 2, "debug", f"debug[{2 * a + 1}]", "S_TERM", None, None, None) for a in range(3)],
]
SOURCE_SCHEMA = "signal string, axis int, pref int, kind string, field string, mode string, lo double, hi double, min_fw string"


def signal_sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SOURCES, SOURCE_SCHEMA)


def version(text: Column) -> Column:
    """(major, minor, patch) from the first dotted version in the text; null if there is none."""
    part = lambda g: F.regexp_extract(text, r"(\d+)\.(\d+)(?:\.(\d+))?", g)
    number = lambda g: F.coalesce(part(g).try_cast("int"), F.lit(0))
    return F.when(text.isNotNull() & (part(1) != ""), F.struct(number(1).alias("major"), number(2).alias("minor"), number(3).alias("patch")))


def presence(caps: DataFrame, field: str) -> Column:
    """missing, zero or active."""
    check = F.try_element_at(F.col("checks"), F.lit(field))
    return F.when(~F.array_contains("fields", field), "missing").when(F.coalesce(check["all_zero"], F.lit(False)), "zero").otherwise("active")


def probe_sources(caps: DataFrame, sources: DataFrame) -> DataFrame:
    """State of each candidate source of each log: resolved, out_of_range, inactive or missing; too old firmware drops it."""
    r = caps.join(F.broadcast(sources), F.lit(True))
    fw, need = version(F.col("firmware")), version(F.col("min_fw"))
    r = r.where(F.col("min_fw").isNull() | fw.isNull() | need.isNull() | (fw >= need))
    check = F.try_element_at(F.col("checks"), F.col("field"))
    here = F.array_contains("fields", F.col("field")) & (F.col("mode").isNull() | (F.col("mode") == F.coalesce("debug_mode", F.lit(""))))
    off = (F.col("lo").isNotNull() & (check["value_min"] < F.col("lo"))) | (F.col("hi").isNotNull() & (check["value_max"] > F.col("hi")))
    state = F.when(~here, "missing").when(F.coalesce(check["all_zero"], F.lit(False)), "inactive").when(F.coalesce(off, F.lit(False)), "out_of_range").otherwise("resolved")
    return r.select("log_id", "signal", "axis", "pref", "kind", "field", "mode", state.alias("state"))


def resolve_signals(caps: DataFrame, sources: DataFrame) -> DataFrame:
    """Best source of each signal: the first resolved one by preference, else out_of_range, inactive, missing in this order."""
    rank = F.when(F.col("state") == "resolved", 0).when(F.col("state") == "out_of_range", 1).when(F.col("state") == "inactive", 2).otherwise(3)
    best = F.min(F.struct(rank.alias("rank"), "pref", "state", "kind", "field", "mode"))
    return probe_sources(caps, sources).groupBy("log_id", "signal", "axis").agg(best.alias("m")).select("log_id", "signal", "axis", "m.state", "m.kind", "m.field", "m.mode")


def module_report(caps: DataFrame, sources: DataFrame) -> DataFrame:
    """Readiness of each analysis: log_id, module, axis (-1: none), state (available, partial, inactive, out_of_range, blocked), via."""
    got = resolve_signals(caps, sources).select("log_id", "signal", "axis", "state", "kind")
    out = []
    empty = (F.size("fields") == 0) | (F.col("total_frames") == 0)
    out.append(caps.select("log_id", F.lit("basic_viewing").alias("module"), F.lit(-1).alias("axis"), F.when(empty, "blocked").otherwise("available").alias("state"), F.lit(None).cast("string").alias("via")))
    for a in range(3):
        p = {t: presence(caps, f"axis{t}[{a}]") for t in "PIDFS"}
        core = [p[t] for t in "PIDF"]
        missing = core[0] == "missing"
        zero = core[0] == "zero"
        for c in core[1:]:
            missing, zero = missing | (c == "missing"), zero | (c == "zero")
        state = F.when(missing, "blocked").when(zero, "inactive").when(p["S"] != "active", "partial").otherwise("available")
        out.append(caps.select("log_id", F.lit("pidfs").alias("module"), F.lit(a).alias("axis"), state.alias("state"), F.lit(None).cast("string").alias("via")))
        s = presence(caps, f"axisS[{a}]")
        out.append(
            caps.select("log_id", s.alias("s")).join(got.where((F.col("signal") == "pre_tpa_s") & (F.col("axis") == a)), "log_id").select(
                "log_id", F.lit("sterm_viz").alias("module"), F.lit(a).alias("axis"),
                F.when((F.col("s") == "missing") | (F.col("state") == "missing"), "blocked").when((F.col("s") == "zero") | (F.col("state") == "inactive"), "inactive").otherwise("available").alias("state"),
                F.when((F.col("s") == "active") & (F.col("state") == "resolved"), F.col("kind")).alias("via"),
            )
        )
    single = F.when(F.col("state") == "resolved", "available").when(F.col("state") == "missing", "blocked").otherwise(F.col("state"))
    via = F.when(F.col("state") == "resolved", F.col("kind"))
    out.append(got.where("signal = 'spa'").select("log_id", F.lit("spa_effect").alias("module"), "axis", single.alias("state"), via.alias("via")))
    out.append(got.where("signal = 'tpa_speed_est'").select("log_id", F.lit("airspeed_crosscheck").alias("module"), "axis", single.alias("state"), via.alias("via")))
    pair = got.where("signal in ('tpa_arg', 'tpa_factor')").groupBy("log_id").agg(F.collect_set("state").alias("states"), F.array_sort(F.collect_set("kind")).alias("kinds"))
    has = lambda s: F.array_contains("states", s)
    state = F.when(has("out_of_range"), "out_of_range").when(has("missing"), "blocked").when(has("inactive"), "inactive").otherwise("available")
    mix = F.when(state == "available", F.when(F.size("kinds") > 1, "mixed").otherwise(F.element_at("kinds", 1)))
    out.append(pair.select("log_id", F.lit("tpa_curve").alias("module"), F.lit(-1).alias("axis"), state.alias("state"), mix.alias("via")))
    speed = presence(caps, "gps:GPS_speed")
    gps = F.when(~F.col("gps_present"), "blocked").when(speed == "zero", "inactive").otherwise("available")
    out.append(caps.select("log_id", F.lit("airspeed_fit").alias("module"), F.lit(-1).alias("axis"), gps.alias("state"), F.lit(None).cast("string").alias("via")))
    result = out[0]
    for o in out[1:]:
        result = result.unionByName(o)
    return result


def aggregate_confidence(criteria: DataFrame, keys=("rec_id",)) -> DataFrame:
    """green if nothing failed; red if a critical criterion or over half of the supporting ones failed; else yellow.

    ``criteria``: keys, name, passed, critical.
    """
    failed, support = ~F.col("passed"), ~F.col("critical")
    g = criteria.groupBy(*keys).agg(
        F.count(F.when(failed, 1)).alias("n_failed"), F.count(F.when(failed & F.col("critical"), 1)).alias("hard"), F.count(F.when(failed & support, 1)).alias("soft"), F.count(F.when(support, 1)).alias("n_support"),
        F.array_sort(F.collect_list(F.when(failed, F.col("name")))).alias("failed"),
    )
    level = F.when(F.col("n_failed") == 0, "green").when((F.col("hard") > 0) | (F.col("soft") > F.col("n_support") / 2), "red").otherwise("yellow")
    return g.select(*keys, level.alias("confidence"), "failed")


def field_table(caps: DataFrame) -> DataFrame:
    """log_id, field, status (ok, all-zero) of each field that a log has."""
    f = caps.select("log_id", F.explode("fields").alias("field"), "checks")
    zero = F.coalesce(F.try_element_at(F.col("checks"), F.col("field"))["all_zero"], F.lit(False))
    return f.select("log_id", "field", F.when(zero, "all-zero").otherwise("ok").alias("status"))


def step_caveat(caps: DataFrame, limit: float = 1.0) -> DataFrame:
    """log_id, axis, term of feed-forward and S terms that were at work, from the sampled ranges alone: a step response
    of the axis then shows more than the feedback loop."""
    rows = None
    for a in range(3):
        for t in "FS":
            c = F.try_element_at(F.col("checks"), F.lit(f"axis{t}[{a}]"))
            part = caps.where(F.greatest(F.abs(c["value_min"]), F.abs(c["value_max"])) > limit).select("log_id", F.lit(a).alias("axis"), F.lit(t).alias("term"))
            rows = part if rows is None else rows.unionByName(part)
    return rows


def profile_hint(styles: DataFrame, chosen: DataFrame) -> DataFrame:
    """log_id, suggested, active, hint_key where the flown style suggests another profile than the active one.

    ``styles``: log_id, profile; ``chosen``: log_id, profile (null: sport).
    """
    j = styles.select("log_id", F.col("profile").alias("suggested")).join(chosen.select("log_id", F.coalesce("profile", F.lit("sport")).alias("active")), "log_id")
    return j.where("suggested is not null and suggested <> active").withColumn("hint_key", F.concat_ws(":", "log_id", "suggested", "active"))
