"""File events: classification, coalescing by quiet gaps, overflow, polling, streams.

Coalescing waits for a gap without events and keeps the last event of each path. A batch holding
a reindex event asks for a full index and its paths don't matter. Windows are by event time here;
the watermark is this library's addition, as sessions in a stream need one to end.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENT = T.StructType([T.StructField("path", T.StringType()), T.StructField("op", T.StringType()), T.StructField("ts", T.TimestampType())])


def classify(df: DataFrame, bits: str = "bits") -> DataFrame:
    """``op`` of a set of kernel bits (array of create, write, remove, rename, chmod), by
    precedence remove, rename, create, write; others are left out."""
    has = lambda b: F.array_contains(bits, b)
    op = F.when(has("remove"), "remove").when(has("rename"), "rename").when(has("create"), "create").when(has("write"), "write")
    return df.withColumn("op", op).where(F.col("op").isNotNull())


def coalesced(events: DataFrame, gap: str = "500 milliseconds", by: list[str] | None = None, watermark: str | None = None) -> DataFrame:
    """Sessions of events with less than ``gap`` between: by, start, end, events, last_op, reindex.

    ``by`` defaults to the path. For streams ``watermark`` is how late events may come in. Events
    without a time take no part; of equal times the greater op counts as last.
    """
    by = ["path"] if by is None else by
    rows = events.where(F.col("ts").isNotNull())
    rows = rows.withWatermark("ts", watermark) if watermark else rows
    grouped = rows.groupBy(F.session_window("ts", gap).alias("w"), *by).agg(
        F.count("*").alias("events"), F.max(F.struct("ts", "op")).alias("l"), F.max(F.col("op") == "reindex").alias("reindex")
    )
    return grouped.select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events", F.col("l.op").alias("last_op"), "reindex")


def next_interval(base: float, idle: int) -> float:
    """Polling interval after so many idle rounds: twice the base after one, four times after two."""
    return base * (1, 2, 4)[min(max(idle, 0), 2)]


def stream_files(spark: SparkSession, folder: str) -> DataFrame:
    """New files of a folder as a stream: path, op (create), ts."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(folder)
    return raw.select("path", F.lit("create").alias("op"), F.col("modificationTime").alias("ts"))


def run_batches(events: DataFrame, index: Callable[[DataFrame, bool], None], checkpoint: str, available_now: bool = True):
    """Start a query that hands each micro-batch to ``index(paths, full)``: the last event of each
    path, or ``full`` if a reindex event is among them. Batches run one after another."""

    def each(batch: DataFrame, _: int) -> None:
        full = not batch.where(F.col("op") == "reindex").isEmpty()
        last = batch.groupBy("path").agg(F.max(F.struct("ts", "op")).alias("l")).select("path", "l.op")
        index(last, full)

    writer = events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
