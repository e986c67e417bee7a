"""Intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str = "stage") -> str:
    """A new folder below ``spark.checkpoint.dir``, or below a temporary one where that is unset; deleted when the application ends."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if top is None:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        top = known.get() if known.isDefined() else tempfile.mkdtemp(prefix="aerolith-")
    path = f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the JVM may be gone by now
        pass


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """``df`` written once and read back, for inputs that several analyses share: it survives lost executors and takes no
    cache memory."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
