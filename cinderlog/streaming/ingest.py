"""Continuous ingest: landed JSON files to logs, roll-up deltas, rejects and quarantine."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from cinderlog.functions.times import literal_like
from cinderlog.operators.measures import DIGEST, digest_rollup
from cinderlog.operators.rollup import build_rollup
from cinderlog.operators.validation import accepted, rejected, validate
from cinderlog.sources.batches import bad_batches, numbered_lines, open_batches, stream_bodies
from cinderlog.sources.tables import LogStore

# Batch numbers and row ids of a micro-batch begin with a prefix of its own; what follows counts inside it.
INSIDE_BITS, PREFIX_BITS = 32, 31
#: Bytes of files in a micro-batch, where no number of files is given.
MICRO_BATCH_BYTES = 256 << 20


def _inside(number: Column, position: Column) -> Column:
    too_many = F.raise_error(F.lit("a micro-batch has more than 2^32 entries")).cast("long")
    return F.when(position >= 1 << INSIDE_BITS, too_many).otherwise(number + position)


def _numbered(checked: DataFrame, prefix: int) -> DataFrame:
    """Number the batches and entries of a micro-batch by file name and index, the same way on every replay.

    One task ranks the files of the micro-batch, a row each.
    """
    files = checked.groupBy("source_file").agg((F.coalesce(F.max("index"), F.lit(-1)) + 1).alias("entries"))
    order = Window.orderBy("source_file")
    before = F.coalesce(F.sum("entries").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    number = F.lit(prefix << INSIDE_BITS).cast("long")
    rank = F.row_number().over(order).cast("long") - 1
    numbers = files.select("source_file", _inside(number, rank).alias("batch_id"), before.alias("entries_before"))
    joined = checked.join(numbers, "source_file")
    return joined.withColumn("id", _inside(number, F.col("entries_before") + F.col("index"))).drop("entries_before")


@dataclass(frozen=True)
class IngestJob:
    """Process one micro-batch of a stream into the store; `foreachBatch` calls it, and so do replays."""

    store: LogStore
    stream: int = 0

    def __call__(self, opened: DataFrame, epoch: int) -> None:
        prefix = self.store.id_prefix("log_ids", self.stream, epoch, PREFIX_BITS)
        checked = validate(opened, F.col("as_of")).persist()
        try:
            numbered = _numbered(checked, prefix)
            good = accepted(numbered, "id")
            self.store.append_logs(good.select("id", "timestamp", "level", "service", "message", "attributes"), epoch, self.stream)
            self.store.append_rollup(build_rollup(good), epoch, self.stream)
            self.store.append_rollup(digest_rollup(good), epoch, self.stream, DIGEST)
            # Rebalanced like the roll-up: there is a task for every few files read, which would each write a file of its own.
            bad_rows = rejected(numbered, "batch_id", "source_file").hint("rebalance")
            self.store.write_epoch(bad_rows, "rejected", epoch, self.stream)
            bad = bad_batches(checked).select("source_file", F.col("batch_error").alias("reason")).hint("rebalance")
            self.store.write_epoch(bad, "quarantine", epoch, self.stream)
        finally:
            checked.unpersist()


def ingest_stream(
    store: LogStore, landing: str, checkpoint: str, as_of: datetime | None = None,
    max_files: int | None = None, interval: str | None = None, lines: bool = False,
) -> StreamingQuery:
    """Start ingesting the landing folder; without an interval, stop when it is worked off.

    A file is a batch, or with `lines` each of its lines is one. A micro-batch takes MICRO_BATCH_BYTES of files, or
    max_files of them: what it costs by itself is paid per bytes, also when files are small.

    The time that entries are checked against is the micro-batch's own (or a fixed one). Spark
    keeps it in the checkpoint, so a replayed batch accepts the same entries.
    """
    if max_files is not None and max_files < 1:
        raise ValueError("max_files must be at least 1")
    now: Column = literal_like(as_of, T.TimestampType()) if as_of else F.current_timestamp()
    bodies = stream_bodies(store.spark, landing, max_files, lines, MICRO_BATCH_BYTES).withColumn("as_of", now)
    job = IngestJob(store, store.stream_of(checkpoint))

    def lines_job(rows: DataFrame, epoch: int) -> None:
        job(open_batches(numbered_lines(rows)), epoch)

    started = bodies.writeStream.foreachBatch(lines_job) if lines else open_batches(bodies).writeStream.foreachBatch(job)
    writer = started.option("checkpointLocation", checkpoint)
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return writer.trigger(**trigger).start()
