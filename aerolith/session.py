"""Session helper: one place for the settings every job of this package expects."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_spark(app: str = "aerolith", cpus: str | None = None, **conf: str) -> SparkSession:
    """Local session for tests and benches; a cluster passes its own session to every operator."""
    builder = (
        SparkSession.builder.master(f"local[{cpus or os.environ.get('BENCH_CPUS', '8')}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
