"""Streaming counts."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from cinderlog.functions.times import literal_like
from cinderlog.operators.measures import bucket
from cinderlog.operators.rollup import build_rollup, compacted
from cinderlog.schemas import ROLLUP
from cinderlog.sources.tables import LogStore

WATERMARKS = T.StructType([T.StructField("watermark", T.TimestampType(), True)])


def rollup_delta_stream(logs: DataFrame, store: LogStore, checkpoint: str) -> StreamingQuery:
    """Append one set of roll-up deltas per micro-batch. Rows of any age count; no state is kept."""
    stream = store.stream_of(checkpoint)

    def flush(rows: DataFrame, epoch: int) -> None:
        store.append_rollup(build_rollup(rows), epoch, stream)

    writer = logs.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def window_counts(logs: DataFrame, bucket: str, delay: str) -> DataFrame:
    """Bucket counts per service and level with bounded state: a bucket comes out once, when the
    watermark has passed it, and rows later than the delay are left out."""
    counted = logs.withWatermark("timestamp", delay).groupBy(F.window("timestamp", bucket).alias("w"), "service", "level")
    return counted.agg(F.count("*").alias("count")).select(F.col("w.start").alias("bucket_start"), "service", "level", "count")


def window_count_stream(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    writer = counts.writeStream.outputMode("append").format("parquet").option("path", path)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


@dataclass(frozen=True)
class WindowJob:
    """Count one micro-batch of a stream into windows; those that the watermark has passed take no more rows.

    The watermark of a micro-batch is the newest time of all before it, less the delay. It is kept per epoch, so a
    replay splits its rows the same way. Rows of windows that end at or before it are counted as amendments.
    """

    store: LogStore
    stream: int
    minutes: int
    delay: timedelta

    def __call__(self, rows: DataFrame, epoch: int) -> None:
        before = watermark(self.store, self.stream, epoch)
        start = bucket("timestamp", self.minutes, T.TimestampType()).alias("bucket_start")
        counted = rows.groupBy(start, "service", "level").agg(F.count("*").alias("count"), F.max("timestamp").cast("timestamp").alias("newest")).persist()
        try:
            late = _ended(self.minutes, before)
            for table, part in (("windows", counted.where(~late)), ("amendments", counted.where(late))):
                self.store.write_epoch(part.select(*ROLLUP.names).hint("rebalance"), table, epoch, self.stream)
            newest = counted.agg((F.max("newest") - F.lit(self.delay)).alias("watermark"))
            mark = F.greatest("watermark", literal_like(before, T.TimestampType())) if before else F.col("watermark")
            self.store.write_epoch(newest.select(mark.alias("watermark")), "watermarks", epoch, self.stream)
        finally:
            counted.unpersist()


def _ended(minutes: int, mark: datetime | None) -> Column:
    """Whether a window's end is not behind the watermark."""
    return F.lit(False) if mark is None else F.col("bucket_start") + F.lit(timedelta(minutes=minutes)) <= literal_like(mark, T.TimestampType())


def watermark(store: LogStore, stream: int, before: int | None = None) -> datetime | None:
    """How far a stream has come, or had come before an epoch; a single time."""
    marks = store.read_epochs("watermarks", WATERMARKS).where(F.col("stream") == stream)
    marks = marks if before is None else marks.where(F.col("epoch") < before)
    return marks.agg(F.max(F.col("watermark").cast("timestamp_ntz"))).first()[0]


def window_job_stream(logs: DataFrame, store: LogStore, checkpoint: str, minutes: int, delay: timedelta) -> StreamingQuery:
    """Count a stream into windows and amendments; nothing is left out, however late it comes."""
    job = WindowJob(store, store.stream_of(checkpoint), minutes, delay)
    return logs.writeStream.foreachBatch(job).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def final_windows(store: LogStore, stream: int, minutes: int) -> DataFrame:
    """Counts of the windows that the watermark has passed: these never change again."""
    rows = store.read_epochs("windows", ROLLUP).where(F.col("stream") == stream)
    return compacted(rows.where(_ended(minutes, watermark(store, stream) or datetime(1, 1, 1))))


def open_windows(store: LogStore, stream: int, minutes: int) -> DataFrame:
    """Counts so far of the windows that are still open."""
    rows = store.read_epochs("windows", ROLLUP).where(F.col("stream") == stream)
    return compacted(rows.where(~_ended(minutes, watermark(store, stream) or datetime(1, 1, 1))))


def amendments(store: LogStore, stream: int) -> DataFrame:
    """Counts of the rows that came after their window had been final."""
    return compacted(store.read_epochs("amendments", ROLLUP).where(F.col("stream") == stream))
