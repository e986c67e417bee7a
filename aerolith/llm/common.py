"""Shared pieces: checkpoints, canonical inputs and Arrow batch plumbing."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows whose kernel outputs are gathered before a batch is handed back to the JVM.
EMIT_ROWS = 512


class Memo(dict):
    """``memo[key]`` is ``compute(key)``, kept in two generations of at most ``limit`` short keys each.

    When the young generation is full it becomes the old one, so that keys in use survive and memory stays bounded.
    """

    def __init__(self, compute: Callable, limit: int = 300_000, longest: int = 64):
        super().__init__()
        self.compute, self.limit, self.longest, self.old = compute, limit, longest, {}

    def __missing__(self, key):
        return self.keep(key, self.old.pop(key) if key in self.old else self.compute(key))

    def keep(self, key, value):
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value

    def forget(self) -> None:
        self.clear()
        self.old = {}


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Folder for checkpoints: the cluster's own setting, else (tests, one machine) a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    folder = folder or tempfile.mkdtemp(prefix="aerolith-ckpt-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as a Parquet table in the shared checkpoint folder and read it back.

    Used instead of ``checkpoint()`` where the plan is costly: it computes the rows once, keeps them compressed, and
    the copy survives lost executors. The folder is removed when the application ends.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/aerolith-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    table = spark.read.schema(df.schema).parquet(path)
    table._aerolith_path = path
    for held in _HELD:
        held.append(table)
    return table


_HELD: list[list[DataFrame]] = []


@contextmanager
def passing() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes the tables that are materialised inside when it ends, but for those handed to what it gives."""
    held: list[DataFrame] = []
    kept: list[DataFrame] = []
    _HELD.append(held)
    try:
        yield lambda table: (kept.append(table), table)[1]
    finally:
        _HELD.pop()
        release(*(t for t in held if all(t is not k for k in kept)))


def release(*tables: DataFrame) -> None:
    """Deletes tables made by :func:`materialise` that nothing reads any more."""
    for t in tables:
        _remove(t.sparkSession, t._aerolith_path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the JVM may be gone by now
        pass


#: A side is broadcast only after its rows were counted and found to take no more than this.
BROADCAST_BYTES = 16 << 20


def small_side(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df`` (cheap to count: a table just written), marked for broadcast if it is small enough, else as it is."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def join_by_size(rows: DataFrame, keyed: DataFrame, on: str, size: str, width: Column | int = 64, share: int = 1000, floor: int = 250) -> DataFrame:
    """``rows`` joined with ``keyed``, both tables just written, where a key may hold a large part of the rows.

    ``keyed`` has one row for each key ``on``; its column ``size`` says how many of the rows have the key. A key with more
    than 1 / ``share`` of all rows would gather them in one task; fewer than ``share`` keys can be so large, and these
    are met by broadcast (``width``: bytes of such a row; 16 MB in all at most), the others by a shuffled join.
    """
    total, most = keyed.agg(F.sum(size), F.max(size)).first()
    if not total or most <= max(floor, total // share):
        return rows.join(keyed, on)
    often = F.col(size) > max(floor, total // share)
    if keyed.where(often).agg(F.sum(F.lit(width) if isinstance(width, int) else width)).first()[0] > BROADCAST_BYTES:
        return rows.join(keyed, on)  # Spark splits the large partitions of a join that nothing else depends on
    met = rows.join(F.broadcast(keyed.where(often)), on)
    rest = rows.join(F.broadcast(keyed.where(often).select(on)), on, "left_anti")
    return met.unionByName(rest.join(keyed.where(~often), on))


def without(docs: DataFrame, lost: DataFrame, again: DataFrame, digest: Column) -> DataFrame:
    """``docs`` without the rows that ``lost`` names, and with one of each row that ``again`` names; all columns kept.

    Rows are known by doc_id (null or not) and the ``digest`` of their text: columns __id and __digest of the two tables.
    """
    own = docs.withColumns({"__own_id": F.col("doc_id").cast("long"), "__own_digest": digest})

    def met(side):
        return own["__own_id"].eqNullSafe(side["__id"]) & (own["__own_digest"] == side["__digest"])

    lost, again = small_side(lost, 128), small_side(again, 128)
    kept = own.join(lost, met(lost), "left_anti").join(again, met(again), "left_anti")
    # only the texts of rows repeated with doc_id and text are shuffled
    one = own.join(again, met(again), "left_semi").dropDuplicates(["__own_id", "__own_digest"])
    return kept.unionByName(one).drop("__own_id", "__own_digest")


BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Set up a session for kernels over texts: Arrow batches of 1,000 rows unless the session's own settings name a number
    (Spark's default is meant for narrow rows), and send this package's source to the executors once per application, so
    that kernels import it there.

    Imported modules outlive a task, and with them the kernels' bounded memos.
    """
    if not spark.conf._jconf.contains(BATCH_SETTING):
        spark.conf.set(BATCH_SETTING, "1000")
    sc = spark.sparkContext
    if getattr(sc, "_aerolith_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="aerolith-src-"), "aerolith_src.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.join("aerolith", os.path.relpath(path, top)))
    sc.addPyFile(archive)
    sc._aerolith_shipped = True


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def relax() -> None:
    """Give memory that a finished task has freed back to the system: idle workers stay beside the next stage's JVM."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` that leaves its workers small."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from aerolith.llm.common import relax

        try:
            yield from run(batches)
        finally:
            relax()

    ship(df.sparkSession)
    return df.mapInArrow(tidy, schema)


def map_rows(
    df: DataFrame, kernel: Callable[[], Callable[[dict[str, list]], dict[str, Iterable]]], schema: str, arrow: pa.Schema
) -> DataFrame:
    """``mapInArrow`` with column lists: ``kernel()`` is built once per task and maps one batch to one batch.

    A kernel's attribute ``release``, if it has one, is called when the task ends.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = kernel()
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, EMIT_ROWS):
                    part = batch.slice(at, EMIT_ROWS)
                    out = step({n: part.column(i) for i, n in enumerate(part.schema.names)})
                    values = ((out[f.name], f.type) for f in arrow)
                    arrays = [v if isinstance(v, pa.Array) else pa.array(v, type=t) for v, t in values]
                    if len(arrays[0]):
                        yield pa.RecordBatch.from_arrays(arrays, schema=arrow)
        finally:
            getattr(step, "release", lambda: None)()

    return map_batches(df, run, schema)
