"""Tuning rules. Each takes results of other operators and gives recommendations in one schema:

log_id, rec_id, domain, axis, severity, title, cli (array), confidence, failed (array), emit_order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.functions.columns import half_up

COLUMNS = ("log_id", "rec_id", "domain", "axis", "severity", "title", "cli", "confidence", "failed", "emit_order")
SHORT = ("R", "P", "Y")

#: Limits by flying style (fixed values): significance of coupling, highest filter delay in ms.
PROFILES = [("cruise", 0.12, 11.0), ("sport", 0.15, 8.0), ("3d", 0.22, 6.0)]


def profiles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PROFILES, "profile string, coupling_limit double, delay_limit double")


def with_profile(rows: DataFrame, profile: Column) -> DataFrame:
    """Adds the limits of each row's profile; an unknown one counts as sport."""
    known = F.when(profile.isin(*(p[0] for p in PROFILES)), profile).otherwise("sport")
    return rows.withColumn("profile", known).join(F.broadcast(profiles(rows.sparkSession)), "profile")


def short(axis: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, SHORT)), axis + 1)


def rec(rows: DataFrame, order: int, rec_id, domain: str, severity, title, axis=None, cli=None, confidence="yellow", failed=None) -> DataFrame:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    none = F.array().cast("array<string>")
    return rows.select(
        "log_id", lit(rec_id).alias("rec_id"), F.lit(domain).alias("domain"), (axis if axis is not None else F.lit(None).cast("string")).alias("axis"), lit(severity).alias("severity"),
        lit(title).alias("title"), (cli if cli is not None else none).alias("cli"), lit(confidence).alias("confidence"), (failed if failed is not None else none).alias("failed"), F.lit(order).alias("emit_order"),
    )


def rec_each(rows: DataFrame, order: int, domain: str, axis: Column, cases: list[tuple]) -> DataFrame:
    """Recommendations of several rules over the same rows in one pass; ``cases``: condition, rec_id, severity, title, confidence."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    structs = [F.when(c, F.struct(lit(i).alias("rec_id"), lit(s).alias("severity"), lit(t).alias("title"), lit(k).alias("confidence"))) for c, i, s, t, k in cases]
    found = rows.select("*", F.explode(F.filter(F.array(*structs), lambda x: x.isNotNull())).alias("__r"))
    return rec(found, order, F.col("__r.rec_id"), domain, F.col("__r.severity"), F.col("__r.title"), axis, confidence=F.col("__r.confidence"))


def debug_mode(modules: DataFrame, caps: DataFrame) -> DataFrame:
    """Suggests a debug mode whose analyses are blocked, unless the log has it already."""
    blocked = lambda m, n: F.count(F.when((F.col("module") == m) & (F.col("state") == "blocked"), 1)) >= n
    g = modules.groupBy("log_id").agg(
        (blocked("airspeed_crosscheck", 1) | blocked("tpa_curve", 1)).alias("TPA"), blocked("spa_effect", 3).alias("SPA"), blocked("sterm_viz", 3).alias("S_TERM")
    )
    rows = g.selectExpr("log_id", "stack(3, 'TPA', TPA, 'SPA', SPA, 'S_TERM', S_TERM) AS (mode, blocked)").join(caps.select("log_id", "debug_mode"), "log_id")
    rows = rows.where("blocked").where(F.coalesce("debug_mode", F.lit("NONE")) != F.col("mode"))
    cli = F.array(F.format_string("set debug_mode = %s", "mode"), F.lit("save"))
    return rec(rows, 1, F.concat(F.lit("debug-mode-"), F.lower("mode")), "Setup", "low", F.format_string("Log with debug mode %s", "mode"), cli=cli, confidence="green")


def share_rules(shares: DataFrame, logged: DataFrame | None = None) -> DataFrame:
    """Rules on controller-term shares. ``logged``: log_id, axis and booleans d, f, s (term logged and active; default all)."""
    if logged is None:
        rows = shares.withColumns({"has_d": F.lit(True), "has_f": F.lit(True), "has_s": F.lit(True)})
    else:
        rows = shares.join(logged.select("log_id", "axis", F.col("d").alias("has_d"), F.col("f").alias("has_f"), F.col("s").alias("has_s")), ["log_id", "axis"])
    a = short(F.col("axis"))
    tag = lambda s: F.concat(F.lit(s), F.lower(a))
    level = F.when(F.col("i_share") > 0.70, "high").when(F.col("i_share") > 0.55, "medium").otherwise("low")
    return rec_each(rows, 2, "PID", a, [
        (F.expr("has_d and p_share > 0.45 and d_share < 0.08"), tag("pidfs-high-p-low-d-"), "low", "Strong P with little D", "yellow"),
        (F.expr("i_share > 0.40"), tag("pidfs-i-dominance-"), level, "I carries much of the output", "yellow"),
        (F.expr("has_f and f_share > 0.40"), tag("pidfs-f-excessive-"), "low", "Large feed-forward share", "yellow"),
        (F.expr("has_s and s_share < 0.02"), tag("pidfs-s-barely-"), "info", "S hardly takes part", "yellow"),
    ])


def graded(rows: DataFrame, criteria: dict[str, Column], soft: Column) -> DataFrame:
    """Adds failed (names of criteria not met) and confidence: green none, yellow at most two and ``soft``, else red."""
    failed = F.filter(F.array(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in criteria.items())), lambda x: x.isNotNull())
    rows = rows.withColumn("failed", failed)
    return rows.withColumn("confidence", F.when(F.size("failed") == 0, "green").when((F.size("failed") <= 2) & soft, "yellow").otherwise("red"))


def airspeed_rule(fitted: DataFrame, coverage: DataFrame, window: DataFrame) -> DataFrame:
    """Airspeed model fit with seven criteria. ``window``: log_id, window_sec, pitch_missing."""
    rows = fitted.join(coverage, "log_id").join(window, "log_id")
    rows = graded(rows, {
        "r2": F.col("r2") >= 0.85, "speed range": F.col("speed_max") - F.col("speed_min") >= 8, "throttle changes": F.col("jumps_per_min") >= 3, "voltage sag": F.col("sag") <= 0.15,
        "converged": F.col("converged"), "window": F.col("window_sec") >= 15, "pitch": ~F.col("pitch_missing"),
    }, F.col("r2") >= 0.6)
    cli = F.array(F.lit("set tpa_speed_type = BASIC"), F.format_string("set tpa_speed_basic_delay = %d", half_up(F.col("delay_ms"))), F.format_string("set tpa_speed_basic_gravity = %d", half_up(F.col("gravity_pct"))))
    cli = F.when(F.col("confidence") != "red", cli).otherwise(F.array().cast("array<string>"))
    return rec(rows, 3, "airspeed-basic-model-fit", "TPA", F.when(F.col("confidence") == "red", "low").otherwise("medium"), "Airspeed model fitted to GPS speed", cli=cli, confidence=F.col("confidence"), failed=F.col("failed"))


def notch_rule(peaks: DataFrame, config: DataFrame) -> DataFrame:
    """Widens the dynamic notch to the strongest gyro peak outside its range."""
    rows = peaks.join(config.where("dyn_notch is not null and dyn_notch.max_hz > dyn_notch.min_hz").select("log_id", "dyn_notch.*"), "log_id")
    rows = rows.where((F.col("freq") < F.col("min_hz")) | (F.col("freq") > F.col("max_hz")))
    top = F.max_by(F.struct("freq", "min_hz", "max_hz"), F.struct(F.col("psd"), -F.col("axis"), -F.col("freq"))).alias("m")
    rows = rows.groupBy("log_id").agg(top).select("log_id", "m.*")
    hi = F.when(F.col("freq") > F.col("max_hz"), F.ceil((F.col("freq") + 25) / 50) * 50).otherwise(F.col("max_hz"))
    lo = F.when(F.col("freq") < F.col("min_hz"), F.greatest(F.floor((F.col("freq") - 10) / 10) * 10, F.lit(20))).otherwise(F.col("min_hz"))
    cli = F.array(F.format_string("set dyn_notch_min_hz = %d", lo.cast("bigint")), F.format_string("set dyn_notch_max_hz = %d", hi.cast("bigint")))
    return rec(rows, 4, "spectrum-notch-coverage", "Filters", "medium", F.format_string("Gyro peak near %.0f Hz lies outside the notch range", "freq"), cli=cli)


def delay_rule(budget: DataFrame, profile: DataFrame) -> DataFrame:
    """Filter delay above the profile's limit. ``profile``: log_id, profile."""
    rows = with_profile(budget.where("stage = 'total'").join(profile, "log_id", "left"), F.col("profile")).where("delay_ms > delay_limit")
    return rec(rows, 4, "spectrum-filter-delay", "Filters", F.when(F.col("delay_ms") > 15, "high").otherwise("medium"), F.format_string("Filters delay the gyro by %.1f ms", "delay_ms"))


def gate_rule(stats: DataFrame, events: DataFrame) -> DataFrame:
    """Gate effect of debug-sourced axes: clean, or with wind-up and bounce-back events."""
    n = events.groupBy("log_id", "axis").agg(F.count(F.lit(1)).alias("n"))
    rows = stats.join(n, ["log_id", "axis"], "left").withColumn("n", F.coalesce("n", F.lit(0))).where("active_pct >= 1 or n > 0")
    name = F.element_at(F.array(F.lit("roll"), F.lit("pitch"), F.lit("yaw")), F.col("axis") + 1)
    a = short(F.col("axis"))
    return rec_each(rows, 5, "SPA", a, [
        (F.col("n") == 0, F.concat(F.lit("spa-clean-"), name), "info", "Gate holds the I term cleanly", "green"),
        (F.col("n") > 0, F.concat(F.lit("spa-events-"), name), F.when(F.col("n") >= 5, "medium").otherwise("low"), "Wind-up or bounce-back around the gate", "yellow"),
    ])


def curve_rule(fitted: DataFrame, coverage: DataFrame) -> DataFrame:
    """Gain-curve fit with six criteria; the exponent is suggested only if it matters."""
    rows = graded(fitted.join(coverage, "log_id"), {
        "rms": F.col("rms") <= 0.08, "low dwell": F.col("low_sec") >= 5, "high dwell": F.col("high_sec") >= 5, "range": F.col("x_max") - F.col("x_min") >= 0.6, "points": F.col("n") >= 200, "converged": F.col("converged"),
    }, F.col("rms") <= 0.20)
    pct = lambda key, c: F.format_string(f"set {key} = %d", half_up(F.col(c) * 100.0))
    cli = F.array(F.lit("set tpa_curve_type = HYPERBOLIC"), pct("tpa_curve_stall_throttle", "stall"), pct("tpa_curve_pid_thr0", "thr0"), pct("tpa_curve_pid_thr100", "thr100"))
    cli = F.when(F.col("converged") & (F.abs(half_up(F.col("expo"))) > 5), F.array_append(cli, F.format_string("set tpa_curve_expo = %d", half_up(F.col("expo"))))).otherwise(cli)
    cli = F.when(F.col("confidence") != "red", cli).otherwise(F.array().cast("array<string>"))
    return rec(rows, 6, "tpa-curve-hyperbolic-fit", "TPA", F.when(F.col("confidence") == "red", "low").otherwise("medium"), "Gain curve fitted to the logged factor", cli=cli, confidence=F.col("confidence"), failed=F.col("failed"))


def chain_rule(chain: DataFrame, least_ms: float = 40.0, high_ms: float = 100.0, share: float = 0.5, least_r: float = 0.4) -> DataFrame:
    """Input latency of ``least_ms`` or more of which one stage has ``share`` or more, all stages correlated well enough."""
    worst = F.greatest("a_ms", "b_ms", "c_ms")
    rows = chain.where((F.col("total_ms") >= least_ms) & (worst >= F.col("total_ms") * share) & (F.least("a_r", "b_r", "c_r") >= least_r))
    stage = F.when(F.col("a_ms") == worst, "a").when(F.col("b_ms") == worst, "b").otherwise("c")
    rec_id = F.concat(F.lit("input-chain."), F.lower(short(F.col("axis"))), F.lit(".stage-"), stage)
    title = F.format_string("%.0f ms from stick to gyro, most of it in stage %s", "total_ms", stage)
    return rec(rows, 7, rec_id, "Servo", F.when(F.col("total_ms") >= high_ms, "high").otherwise("medium"), title, short(F.col("axis")))


def axis_name(axis: Column) -> Column:
    return F.element_at(F.array(F.lit("roll"), F.lit("pitch"), F.lit("yaw")), axis + 1)


def asymmetry_rule(pairs: DataFrame) -> DataFrame:
    rows = pairs.where("severity = 'warn'")
    rec_id = F.format_string("servo-asym-%s-servo%d", axis_name(F.col("axis")), "servo")
    return rec(rows, 8, rec_id, "Servo", "low", F.format_string("Servo %d differs from servo %d (lag %.1f ms, travel ratio %.2f)", "servo", "reference", "lag_ms", "ratio"), short(F.col("axis")))


def feedforward_rule(ff: DataFrame) -> DataFrame:
    a = short(F.col("axis"))
    tag = lambda s: F.concat(F.lit(s), axis_name(F.col("axis")))
    return rec_each(ff, 9, "PID", a, [
        (F.expr("noisy and n_windows > 0"), tag("ff-noisy-"), "low", "Feed-forward is noisy", "yellow"),
        (F.expr("verdict = 'undergained'"), tag("ff-undergained-"), "low", "Feed-forward does less than half of the work", "yellow"),
        (F.expr("verdict = 'overgained'"), tag("ff-overgained-"), "low", "Feed-forward overshoots in most manoeuvres", "yellow"),
    ])


def coupling_rule(matrix: DataFrame, profile: DataFrame, least: int = 3) -> DataFrame:
    """Off-axis response above the profile's limit in ``least`` windows or more; twice the limit is medium."""
    rows = with_profile(matrix.where("cmd_axis <> resp_axis").where(F.col("n") >= least).join(profile, "log_id", "left"), F.col("profile")).where("abs(ratio) >= coupling_limit")
    rec_id = F.concat(F.lit("coupling-"), F.lower(short(F.col("cmd_axis"))), F.lit("-"), F.lower(short(F.col("resp_axis"))))
    return rec(rows, 10, rec_id, "Coupling", F.when(F.abs("ratio") >= 2 * F.col("coupling_limit"), "medium").otherwise("low"), F.format_string("Response of %.0f %% on another axis", F.col("ratio") * 100.0), short(F.col("cmd_axis")))


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "high", 0).when(severity == "medium", 1).when(severity == "low", 2).otherwise(3)


def gather(*rules: DataFrame) -> DataFrame:
    """All recommendations, by severity, then in rule order."""
    return reduce(DataFrame.unionByName, rules).orderBy("log_id", severity_rank(F.col("severity")), "emit_order", "rec_id")


def severity_counts(recs: DataFrame) -> DataFrame:
    return recs.groupBy("log_id", "severity").agg(F.count(F.lit(1)).alias("n"))
