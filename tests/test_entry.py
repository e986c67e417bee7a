import shutil
import subprocess
import sys

import __spark_entry__ as entry


def test_flagship_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_twin_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 60


def test_a_broken_training_data_package_is_not_hidden(tmp_path):
    code = "import sys; sys.path.insert(0, %r); import __spark_entry__"
    package = tmp_path / "aerolith"
    (package / "llm").mkdir(parents=True)
    for name, text in (("__init__.py", ""), ("llm/__init__.py", ""), ("llm/queries.py", "import no_such_module_at_all")):
        (package / name).write_text(text)
    (package / "plans").mkdir()
    (package / "plans/__init__.py").write_text("")
    (package / "plans/catalogue.py").write_text("QUERIES, ORACLE_SQL = {}, {}")
    shutil.copy(entry.__file__, tmp_path)
    done = subprocess.run([sys.executable, "-c", code % str(tmp_path)], cwd=tmp_path, capture_output=True, text=True)
    assert "no_such_module_at_all" in done.stderr and done.returncode


def test_entry_imports_without_the_training_data_package():
    code = "import sys; sys.modules['aerolith.llm'] = None; import __spark_entry__ as e; assert 'welch_psd' in e.queries() and not any(q.startswith('op') for q in e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True)


def test_streams_equal_batches(spark):
    from aerolith.operators.timeaxis import hold_last, ordered
    from aerolith.streaming import stateful
    from aerolith.streaming.run import replay
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(k, i, float(i) if i % 3 == 0 else None) for k in (1, 2) for i in range(20)], "log_id long, frame_idx long, v double")
    a = {tuple(r) for r in replay(rows, lambda s: stateful.hold_last(s, "v")).collect()}
    b = {tuple(r) for r in rows.select("log_id", "frame_idx", hold_last(F.col("v"), ordered())).collect()}
    assert a == b


def test_a_log_that_ends_gives_out_what_it_holds(spark):
    from aerolith.streaming import stateful
    from aerolith.streaming.run import replay
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(k, i, i >= 15, i == 19) for k in (1, 2) for i in range(20)], "log_id long, frame_idx long, on boolean, last boolean")
    flagged = replay(rows, lambda s: stateful.closed_runs(s, "on", 1, stateful.Ending(flag="last")))
    assert sorted(map(tuple, flagged.collect())) == [(1, 15, 20), (2, 15, 20)]
    assert replay(rows, lambda s: stateful.closed_runs(s, "on", 1)).count() == 0
    timed = spark.createDataFrame([(1, i, True) for i in range(5)] + [(2, i, False) for i in range(5, 60)], "log_id long, frame_idx long, on boolean")
    timed = timed.withColumn("at", F.timestamp_seconds(F.col("frame_idx") * 10 + 1000))
    got = replay(timed, lambda s: stateful.closed_runs(s, "on", 1, stateful.Ending(time="at", late="1 second", quiet=20.0)), batches=12)
    assert sorted(map(tuple, got.collect())) == [(1, 0, 5)]
