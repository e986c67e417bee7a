"""Rules whose inputs the virtual logs do not reach."""

from aerolith.operators import headers as H
from aerolith.operators import recommend as R
from aerolith.operators import registry as G


def only(df):
    return {r.rec_id: r for r in df.collect()}


def test_debug_mode_hints(spark):
    caps = spark.createDataFrame([("a", [], "SPA", False, 10, None, {}), ("b", [], None, False, 10, None, {})], G.SCHEMA)
    got = {(r.log_id, r.rec_id) for r in R.debug_mode(G.module_report(caps, G.signal_sources(spark)), caps).collect()}
    assert got == {("a", "debug-mode-tpa"), ("a", "debug-mode-s_term"), ("b", "debug-mode-tpa"), ("b", "debug-mode-spa"), ("b", "debug-mode-s_term")}


def test_notch_and_delay(spark):
    h = {"dyn_notch_count": "3", "dyn_notch_min_hz": "100", "dyn_notch_max_hz": "300", "dyn_notch_q": "300", "gyro_lpf1_type": "PT1", "gyro_lpf1_static_hz": "100"}
    config = H.filter_config(spark.createDataFrame([(1, h)], "log_id long, header_params map<string,string>"))
    peaks = spark.createDataFrame([(1, 0, 350.0, 2.0), (1, 1, 60.0, 1.0), (1, 2, 200.0, 9.0)], "log_id long, axis int, freq double, psd double")
    assert only(R.notch_rule(peaks, config))["spectrum-notch-coverage"].cli == ["set dyn_notch_min_hz = 100", "set dyn_notch_max_hz = 400"]
    assert R.notch_rule(peaks.where("freq = 200.0"), config).count() == 0
    low = R.notch_rule(peaks.where("freq = 60.0"), config).first()
    assert low.cli == ["set dyn_notch_min_hz = 50", "set dyn_notch_max_hz = 300"]
    profile = spark.createDataFrame([(1, "sport")], "log_id long, profile string")
    assert only(R.delay_rule(H.delay_budget(config), profile))["spectrum-filter-delay"].severity == "high"


def test_curve_and_chain(spark):
    fit = spark.createDataFrame([(1, 3.0, 0.5, 0.2, 5.6, 0.01, 50, True), (2, 3.0, 0.5, 0.2, 0.0, 0.5, 50, True)], "log_id long, thr0 double, thr100 double, stall double, expo double, rms double, iterations long, converged boolean")
    cover = spark.createDataFrame([(i, 0.1, 0.9, 6.0, 6.0, 6.0, 500) for i in (1, 2)], "log_id long, x_min double, x_max double, low_sec double, mid_sec double, high_sec double, n long")
    got = {r.log_id: r for r in R.curve_rule(fit, cover).collect()}
    assert got[1].confidence == "green" and got[1].cli[-1] == "set tpa_curve_expo = 6" and got[1].cli[2] == "set tpa_curve_pid_thr0 = 300"
    assert got[2].confidence == "red" and got[2].cli == [] and got[2].failed == ["rms"]
    rows = [(1, 0, 5.0, 5.0, 50.0, 60.0, 0.9, 0.9, 0.9), (1, 1, 5.0, 50.0, 50.0, 105.0, 0.9, 0.9, 0.9), (1, 2, 1.0, 1.0, 99.0, 101.0, 0.9, 0.9, 0.3), (2, 0, 5.0, 5.0, 9.0, 19.0, 0.9, 0.9, 0.9), (3, 2, 10.0, 10.0, 90.0, 110.0, 0.9, 0.9, 0.5)]
    chain = spark.createDataFrame(rows, "log_id long, axis int, a_ms double, b_ms double, c_ms double, total_ms double, a_r double, b_r double, c_r double")
    assert {(r.log_id, r.rec_id, r.severity) for r in R.chain_rule(chain).collect()} == {(1, "input-chain.r.stage-c", "medium"), (3, "input-chain.y.stage-c", "high")}
