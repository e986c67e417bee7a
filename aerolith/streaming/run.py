"""Running a stream over a finished table, for replays and for holding streaming forms against batch results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from aerolith.staging import scratch

#: Rows of one replayed file.
FILE_ROWS = 1_000_000


class Progress(StreamingQueryListener):
    """Calls ``tell(rows so far, rows a second)`` after each micro-batch of the queries it listens to."""

    def __init__(self, tell):
        self.tell, self.rows = tell, 0

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        self.rows += event.progress.numInputRows
        self.tell(self.rows, event.progress.processedRowsPerSecond)

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass


def replay(frames: DataFrame, transform, batches: int = 3, order: str = "frame_idx", key: str = "log_id") -> DataFrame:
    """``transform`` of ``frames`` as a stream of micro-batches, split by frame so that each key's frames come in order; the
    result is what the stream wrote.

    A part of large tables is several files, each with all of its keys' frames; a micro-batch is one file.
    """
    spark = frames.sparkSession
    top = scratch(spark, "replay")
    last, total = frames.agg(F.max(order), F.count(F.lit(1))).first()
    step, files = (last or 0) // batches + 1, 1 + total // batches // FILE_ROWS
    for b in range(batches):
        frames.where(F.floor(F.col(order) / step) == b).repartition(files, key).write.mode("append").parquet(f"{top}/in")
    source = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 1).parquet(f"{top}/in")
    out = transform(source)
    query = out.writeStream.format("parquet").option("path", f"{top}/out").option("checkpointLocation", f"{top}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{top}/out")
