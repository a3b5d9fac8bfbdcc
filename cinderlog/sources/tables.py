"""The engine's tables as Parquet folders under one root.

logs       log_date=/stream=/epoch=   rows sorted by (service, timestamp, id) inside each file
deltas     stream=/epoch=             roll-up deltas, one folder per micro-batch
compact    generation=/log_date=      roll-up with deltas merged in; a day's newest generation counts
compact_60, compact_1440   generation=/log_month=   the same by hour and by day; a month's newest generation counts
latency_deltas, latency..., distinct_deltas, distinct...   mergeable sketches, kept and compacted like the counts
digest_deltas, digest...           digests of what was ingested, likewise; repairs marks corrections of the roll-up
rejected, quarantine, alerts, triggers, notifications, retention, windows, amendments, watermarks   stream=/epoch=
rules      added=                     rule definitions; trigger times are kept apart, in triggers
receipts   added=                     which notifications have been read
streams    one marker per stream number that is taken
signatures log_date=/signed=          which trigrams occur in which file of the logs; runs that are done are marked in signings
log_ids, notification_ids   which blocks of id prefixes are taken, and by which stream and run of epochs

Whatever a micro-batch writes goes to folders named by its stream and epoch, which a replay overwrites, so a retried
batch never counts twice. A stream's number is taken once per checkpoint and remembered inside it: a second stream, or
the same one on a new checkpoint, gets another number and never overwrites what is there. Number 0 is for direct calls.
Folders count once this module's own marker is in them, whatever markers the committer writes.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import date, datetime, timedelta
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinderlog.functions.text import BITMAP_BITS, chunks, gram_numbers, has_number, literal_runs, substring_pattern
from cinderlog.functions.times import ts_literal
from cinderlog.operators.aggregate import aggregate, aggregate_exact
from cinderlog.operators.alerts import with_rule_check
from cinderlog.operators.measures import COUNTS, DIGEST, LATENCY, MEASURES, Measure, ceil_to, digest_of_counts, floor_to, latency_quantile
from cinderlog.operators.metrics import service_summary_rollup
from cinderlog.operators.notifications import with_read_state
from cinderlog.operators.pages import numbered_page
from cinderlog.operators.rollup import minute_differences, rollup_kept, unequal
from cinderlog.operators.search import in_range, newest, search
from cinderlog.plans.spec import AggSpec, LogQuery
from cinderlog.schemas import NOTIFICATIONS, RULES, STORED_LOGS
from cinderlog.sources.workspace import written

EPOCH = (T.StructField("stream", T.LongType(), False), T.StructField("epoch", T.LongType(), False))
TRIGGERS = T.StructType([T.StructField("rule_id", T.LongType()), T.StructField("triggered_at", T.TimestampType())])
RECEIPTS = T.StructType([T.StructField("id", T.LongType()), T.StructField("all_until", T.TimestampType())])
EXPIRED = T.StructType([T.StructField("deleted", T.LongType())])
SIGNATURES = T.StructType([
    T.StructField("file", T.StringType(), False),
    T.StructField("bucket", T.LongType(), False),  # 0 stands for the file itself
    T.StructField("bits", T.BinaryType(), True),
    T.StructField("log_date", T.DateType(), False),
    T.StructField("signed", T.LongType(), False),
])
MAX_RECORDS_PER_FILE = 20_000_000
#: Trigrams of a search that are looked up; any part of them is a sound test.
LOOKED_UP = 64
MAX_RULE = 1 << 31
#: Epochs of a stream that take their id prefixes together.
BLOCK_EPOCHS = 1 << 10
COMPLETE, LEVELLED = "_COMPLETE", "_LEVELS"


def checked_number(stream: int, epoch: int) -> None:
    """These numbers name folders."""
    if stream < 0 or epoch < 0:
        raise ValueError(f"stream {stream} and epoch {epoch} must not be negative")


@dataclass(frozen=True)
class Compaction:
    """A finished compaction: what it has merged in per stream, the first day that is kept, and whether it has all levels."""

    generation: int
    upto: dict[int, int]
    first_day: date | None
    levelled: bool = True


def _with(schema: T.StructType, *fields: T.StructField) -> T.StructType:
    return T.StructType(schema.fields + list(fields))


def _folder_key(measure: Measure, minutes: int | None) -> str:
    return "log_date" if minutes in (None, measure.levels[0]) else "log_month"


def _between(rows: DataFrame, low: datetime | None, high: datetime | None) -> Column:
    inside = F.lit(True) if low is None else F.col("bucket_start") >= ts_literal(low, rows, "bucket_start")
    return inside if high is None else inside & (F.col("bucket_start") < ts_literal(high, rows, "bucket_start"))


def _touches(day: date, low: datetime | None, high: datetime | None, month: bool) -> bool:
    """Whether the folder of a day (or of the month that begins on it) may hold a part of the range."""
    last = (day.replace(day=28) + timedelta(days=4)).replace(day=1) - timedelta(days=1) if month else day
    return (low is None or last >= low.date()) and (high is None or day <= high.date())


@dataclass(frozen=True)
class LogStore:
    spark: SparkSession
    root: str

    def path(self, table: str) -> str:
        return f"{self.root.rstrip('/')}/{table}"

    # Folders

    def _fs(self, path: str):
        jvm = self.spark._jvm
        hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
        return hadoop_path.getFileSystem(self.spark._jsc.hadoopConfiguration()), hadoop_path

    def folders(self, table: str, key: str) -> dict[str, str]:
        """Value and path of the key=value folders of a table."""
        fs, path = self._fs(self.path(table))
        if not fs.exists(path):
            return {}
        found = {}
        for status in fs.listStatus(path):
            match = re.fullmatch(rf"{key}=(.+)", status.getPath().getName())
            if match and status.isDirectory():
                found[match.group(1)] = status.getPath().toString()
        return found

    def has(self, table: str) -> bool:
        fs, path = self._fs(self.path(table))
        return fs.exists(path)

    def _drop(self, path: str) -> None:
        fs, hadoop_path = self._fs(path)
        fs.delete(hadoop_path, True)

    def _marked(self, path: str) -> bool:
        return self._is_file(f"{path}/{COMPLETE}")

    def _is_file(self, path: str) -> bool:
        fs, hadoop_path = self._fs(path)
        return fs.exists(hadoop_path)

    def _mark(self, path: str) -> bool:
        """Create an empty file; false if it was there. Only one caller ever gets true."""
        fs, hadoop_path = self._fs(path)
        return fs.createNewFile(hadoop_path)

    def _names(self, path: str) -> list[str]:
        fs, hadoop_path = self._fs(path)
        return [status.getPath().getName() for status in fs.listStatus(hadoop_path)] if fs.exists(hadoop_path) else []

    def _next(self, table: str, key: str) -> int:
        """A number that nobody else has: the marker file decides."""
        taken = [int(name.removeprefix(f"{key}.")) for name in self._names(self.path(table)) if name.startswith(f"{key}.")]
        number = max(taken, default=0) + 1
        while not self._mark(f"{self.path(table)}/{key}.{number}"):
            number += 1
        return number

    # Streams

    def stream_of(self, checkpoint: str) -> int:
        """The number of the stream that runs on this checkpoint; a new checkpoint takes a new number."""
        for name in self._names(checkpoint):
            if match := re.fullmatch(r"stream\.(\d+)", name):
                return int(match.group(1))
        number = self._next("streams", "taken")
        self._mark(f"{checkpoint.rstrip('/')}/stream.{number}")
        return number

    def id_prefix(self, table: str, stream: int, epoch: int, bits: int) -> int:
        """A number of at most `bits` bits that only this epoch of this stream has, the same one whenever it is repeated.

        Prefixes are handed out in blocks of BLOCK_EPOCHS, when a stream first needs one: neither streams nor epochs are
        bounded by themselves, only all of them together. If two callers take a block for the same epochs at once, both
        blocks are theirs alone, and the first counts from then on.
        """
        checked_number(stream, epoch)
        run, place = divmod(epoch, BLOCK_EPOCHS)
        holder = f"{self.path(table)}/stream={stream}/run={run}"
        held = [int(name.removeprefix("block.")) for name in self._names(holder) if name.startswith("block.")]
        block = min(held, default=None)
        if block is None:
            block = self._next(table, "taken")
            self._mark(f"{holder}/block.{block}")
        prefix = (block - 1) * BLOCK_EPOCHS + place
        if prefix >= 1 << bits:
            raise ValueError(f"all {bits}-bit prefixes of {table} are taken")
        return prefix

    # Logs

    def append_logs(self, rows: DataFrame, epoch: int, stream: int = 0) -> None:
        """Write one epoch of accepted rows.

        Rebalancing by date keeps small dates in one file and splits a date that holds most of the
        rows over many tasks; sorting makes row-group statistics selective for service and time.
        """
        checked_number(stream, epoch)
        numbers = {"stream": F.lit(stream).cast("long"), "epoch": F.lit(epoch).cast("long")}
        dated = rows.withColumn("log_date", F.to_date("timestamp")).withColumns(numbers)
        spread = dated.hint("rebalance", F.col("log_date"))
        ordered = spread.sortWithinPartitions("log_date", "stream", "epoch", "service", "timestamp", "id")
        (
            ordered.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .option("maxRecordsPerFile", MAX_RECORDS_PER_FILE)
            .partitionBy("log_date", "stream", "epoch")
            .parquet(self.path("logs"))
        )

    def log_days(self) -> list[date]:
        """The days that hold logs, from the names of their folders."""
        return sorted(date.fromisoformat(text) for text in self.folders("logs", "log_date"))

    def logs(self, since: datetime | None = None, until: datetime | None = None, text: str | None = None) -> DataFrame:
        """The stored rows; with bounds, only folders of the days they touch are listed and read.

        With a text, files are left out whose signature shows that no message of theirs contains it; the rows that
        are read still have to be filtered.
        """
        reader = self.spark.read.schema(STORED_LOGS)
        numbers = self._grams_of(text) if text and self.has("signings") else []
        if since is None and until is None and not numbers:
            return reader.parquet(self.path("logs"))
        days = [day for day in self.log_days() if (since is None or day >= since.date()) and (until is None or day <= until.date())]
        paths = [f"{self.path('logs')}/log_date={day.isoformat()}" for day in days]
        without = self._files_without(numbers, days) if numbers else set()
        if without:
            paths = [path for name, path in self._log_files(days).items() if name not in without]
        if not paths:
            return self.spark.createDataFrame([], STORED_LOGS)
        return reader.option("basePath", self.path("logs")).parquet(*paths)

    def search(self, query: LogQuery) -> DataFrame:
        """A page of the matching rows, from the days of the range and the files that may hold the text."""
        return search(self.logs(query.since, query.until, query.q), query)

    # Signatures of log files

    def _log_files(self, days: list[date]) -> dict[str, str]:
        """Name below the table and path of the data files of these days, as Spark's own index of the same scan holds them."""
        found = {}
        for day in days:
            fs, path = self._fs(f"{self.path('logs')}/log_date={day.isoformat()}")
            listed = fs.listFiles(path, True)
            while listed.hasNext():
                text = listed.next().getPath().toString()
                if match := re.search(r"log_date=[^/]+/stream=\d+/epoch=\d+/[^/_.][^/]*$", text):
                    found[match.group()] = text
        return found

    def _signatures(self, days: list[date]) -> DataFrame | None:
        """The signatures of these days; those of signing runs that did not finish do not count."""
        names = self._names(self.path("signings"))
        open_runs = {int(n.removeprefix("taken.")) for n in names if n.startswith("taken.")} - {int(n.removeprefix("done.")) for n in names if n.startswith("done.")}
        signed = self.folders("signatures", "log_date")
        paths = [signed[day.isoformat()] for day in days if day.isoformat() in signed]
        if not paths:
            return None
        rows = self.spark.read.schema(SIGNATURES).option("basePath", self.path("signatures")).parquet(*paths)
        return rows.where(~F.col("signed").isin(sorted(open_runs))) if open_runs else rows

    def sign_logs(self) -> int:
        """Write the signatures of the log files that have none, and return how many files those are.

        A signature says which trigrams of characters occur in the lower-cased messages of a file: one bit per number of a
        trigram, in bitmaps of a fixed size. Files are never changed; one that a replay has replaced has another name.
        Until it is signed, a file is read by every search. Distinct trigrams per file are what is shuffled.
        """
        files = self._log_files(self.log_days())
        rows = self._signatures(self.log_days())
        known = {row["file"] for row in rows.where("bucket = 0").select("file").distinct().collect()} if rows is not None else set()
        fresh = [path for name, path in files.items() if name not in known]
        if not fresh:
            return 0
        run = self._next("signings", "taken")
        name = F.regexp_extract(F.col("_metadata.file_path"), "(log_date=[^/]+/stream=[0-9]+/epoch=[0-9]+/[^/]+)$", 1)
        logs = self.spark.read.schema(STORED_LOGS).option("basePath", self.path("logs")).parquet(*fresh)
        pieces = logs.select(name.alias("file"), "log_date", F.explode(chunks(F.lower("message"))).alias("piece"))
        numbers = pieces.select("file", "log_date", F.explode(gram_numbers(F.col("piece"))).alias("number")).distinct()
        bitmaps = numbers.groupBy("file", "log_date", F.bitmap_bucket_number("number").alias("bucket"))
        bitmaps = bitmaps.agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits"))
        there = logs.select(name.alias("file"), "log_date").distinct().select("file", "log_date", F.lit(0).cast("long").alias("bucket"), F.lit(None).cast("binary").alias("bits"))
        signed = bitmaps.unionByName(there).withColumn("signed", F.lit(run).cast("long")).hint("rebalance", F.col("log_date"))
        ordered = signed.sortWithinPartitions("log_date", "signed", "bucket", "file")
        ordered.write.mode("append").partitionBy("log_date", "signed").parquet(self.path("signatures"))
        self._mark(f"{self.path('signings')}/done.{run}")
        return len(fresh)

    def _grams_of(self, text: str) -> list[int]:
        """The numbers of trigrams that a message containing the text must have; lower-cased as ILIKE does, as a whole."""
        low = self.spark.range(1).select(F.lower(F.lit(substring_pattern(text)))).first()[0]
        runs = literal_runs(low)
        if not runs:
            return []
        numbers = F.array_distinct(F.flatten(F.array(*[gram_numbers(F.lit(run)) for run in runs])))
        return sorted(self.spark.range(1).select(numbers).first()[0])[:LOOKED_UP]

    def _files_without(self, numbers: list[int], days: list[date]) -> set[str]:
        """The signed files of these days that lack one of the trigrams."""
        rows = self._signatures(days)
        if rows is None:
            return set()
        buckets = sorted({1 + (number - 1) // BITMAP_BITS for number in numbers})
        hits = [F.when(F.col("bucket") == 1 + (n - 1) // BITMAP_BITS, has_number(F.col("bits"), n)).otherwise(0) for n in numbers]
        counted = rows.where(F.col("bucket").isin([0, *buckets])).groupBy("file").agg(F.sum(reduce(add, hits)).alias("hits"))
        return {row["file"] for row in counted.where(F.col("hits") < len(numbers)).select("file").collect()}

    def newest(self, query: LogQuery) -> DataFrame:
        """The newest matching rows; see `newest`."""
        return newest(self.logs(query.since, query.until), query, self.log_days())

    # Tables written once per epoch

    def _epoch_path(self, table: str, epoch: int, stream: int) -> str:
        return f"{self.path(table)}/stream={stream}/epoch={epoch}"

    def write_epoch(self, rows: DataFrame, table: str, epoch: int, stream: int = 0) -> None:
        """A replay replaces the folder, also when it has become empty."""
        checked_number(stream, epoch)
        path = self._epoch_path(table, epoch, stream)
        rows.write.mode("overwrite").parquet(path)
        self._mark(f"{path}/{COMPLETE}")

    def drop_epoch(self, table: str, epoch: int, stream: int = 0) -> None:
        """Take back what an earlier try has written, if anything."""
        path = self._epoch_path(table, epoch, stream)
        if self._is_file(path):
            self._drop(path)

    def read_epochs(self, table: str, schema: T.StructType) -> DataFrame:
        if not self.has(table):
            return self.spark.createDataFrame([], _with(schema, *EPOCH))
        return self.spark.read.schema(_with(schema, *EPOCH)).parquet(self.path(table))

    def epochs(self, table: str) -> dict[tuple[int, int], str]:
        """(stream, epoch) and path of the finished folders of a table."""
        found = {}
        for stream in self.folders(table, "stream"):
            for epoch, path in self.folders(f"{table}/stream={stream}", "epoch").items():
                if self._marked(path):
                    found[int(stream), int(epoch)] = path
        return found

    # Roll-ups: counts and other measures

    def append_rollup(self, deltas: DataFrame, epoch: int, stream: int = 0, measure: Measure = COUNTS) -> None:
        """Rebalancing sizes the files by their bytes: one for a small batch, many for a big one."""
        self.write_epoch(deltas.select(*measure.schema.names).hint("rebalance"), measure.deltas, epoch, stream)

    def _compactions(self, measure: Measure = COUNTS) -> list[Compaction]:
        found = []
        for text, path in self.folders(measure.compact, "generation").items():
            names = self._names(path)
            if COMPLETE in names:
                upto = dict(map(int, name.split(".")[1:]) for name in names if name.startswith("_upto."))
                first = [date.fromisoformat(name.split(".")[1]) for name in names if name.startswith("_from.")]
                found.append(Compaction(int(text), upto, max(first, default=None), LEVELLED in names))
        return sorted(found, key=lambda c: c.generation)

    def _compact_days(self, upto_generation: int, measure: Measure = COUNTS, minutes: int | None = None) -> dict[date, list[tuple[int, str]]]:
        """The generations (ascending) that hold a day, or a month of a coarser level, and their paths."""
        table, key = measure.table(minutes or measure.levels[0]), _folder_key(measure, minutes)
        days: dict[date, list[tuple[int, str]]] = {}
        for text in sorted(self.folders(table, "generation"), key=int):
            if int(text) <= upto_generation:
                for day, path in self.folders(f"{table}/generation={text}", key).items():
                    days.setdefault(date.fromisoformat(day), []).append((int(text), path))
        return days

    def _pending(self, base: Compaction | None) -> Column:
        """Whether a delta's epoch is beyond what the compaction has of its stream."""
        pending = F.lit(True)
        for stream, epoch in (base.upto if base else {}).items():
            pending = pending & ((F.col("stream") != stream) | (F.col("epoch") > epoch))
        return pending

    def _deltas(self, where: Column, measure: Measure = COUNTS) -> DataFrame:
        deltas = self.read_epochs(measure.deltas, measure.schema).where(where)
        return deltas.select(*measure.schema.names, F.to_date("bucket_start").alias("log_date"))

    def _compacted(self, base: Compaction | None, days: set[date] | None = None, measure: Measure = COUNTS, minutes: int | None = None, listed: dict[date, list[tuple[int, str]]] | None = None) -> DataFrame:
        """The compacted rows of a level (the finest, if none is named) in the folders of the given days or months."""
        key = _folder_key(measure, minutes)
        schema = _with(measure.schema, T.StructField(key, T.DateType()))
        first = base.first_day if base else None
        lowest = first.replace(day=1) if first and key == "log_month" else first
        paths = []
        listed = self._compact_days(base.generation, measure, minutes) if base and listed is None else listed or {}
        for day, found in listed.items():
            if (days is None or day in days) and (lowest is None or day >= lowest):
                paths.append(found[-1][1])
        dated = F.to_date("bucket_start").alias("log_date")
        if not paths:
            return self.spark.createDataFrame([], schema).select(*measure.schema.names, dated)
        # Read with the generation as well, which the folders carry.
        rows = self.spark.read.schema(_with(schema, T.StructField("generation", T.LongType())))
        rows = rows.option("basePath", self.path(measure.table(minutes or measure.levels[0]))).parquet(*paths)
        if key == "log_date":
            return rows.select(*measure.schema.names, "log_date")
        rows = rows.select(*measure.schema.names, dated)
        return rows.where(F.col("log_date") >= F.lit(first)) if first else rows

    def rollup(self, measure: Measure = COUNTS) -> DataFrame:
        """Compacted part and later deltas together; always merge the rows. Dated, so that ranges
        open only the days they need of the compacted part."""
        base = max(self._compactions(measure), key=lambda c: c.generation, default=None)
        deltas = self._deltas(self._pending(base), measure)
        return self._compacted(base, measure=measure).unionByName(deltas) if base else deltas

    def rollup_cover(self, since: datetime | None, until: datetime | None, coarsest: int = 1440, measure: Measure = COUNTS) -> DataFrame:
        """Roll-up rows of a range, of the coarsest buckets (up to `coarsest` minutes) that fit into it.

        Whole days come from the level of days, whole hours at the edges from that of hours, and only the rest from
        minutes; rows that are not compacted yet come as they are. Folders outside of the range are not opened.
        """
        base = max(self._compactions(measure), key=lambda c: c.generation, default=None)
        stretches = measure.cover(since, until, coarsest if base and base.levelled else measure.levels[0])
        whole = [edge for _, low, high in stretches for edge in (low, high) if edge]
        low, high = min(whole, default=None) if since else None, max(whole, default=None) if until else None
        rows = in_range(self._deltas(self._pending(base), measure), low, high, "bucket_start")
        for minutes in measure.levels if base else []:
            ranges = [(low, high) for level, low, high in stretches if level == minutes]
            found = self._compact_days(base.generation, measure, minutes) if ranges else {}
            inside = {day for day in found if any(_touches(day, low, high, minutes > measure.levels[0]) for low, high in ranges)}
            if inside:
                level = self._compacted(base, inside, measure, minutes, found)
                rows = rows.unionByName(level.where(reduce(or_, [_between(level, low, high) for low, high in ranges])))
        return rows

    def aggregate(self, spec: AggSpec, exact: bool = False) -> DataFrame:
        """Bucket counts from the cheapest stored tables: the levels of the roll-up, or raw rows of the days in range.

        With `exact`, minutes that the range cuts are counted from raw rows.
        """
        if spec.source != "rollup":
            logs = self.logs(spec.since, spec.until, spec.q)
            return aggregate(logs, logs, spec)
        cover = self.rollup_cover(spec.since, spec.until, spec.minutes)
        return aggregate_exact(self.logs(spec.since, spec.until), cover, spec) if exact else aggregate(cover, cover, spec)

    def page(self, query: LogQuery, number: int) -> DataFrame:
        """Page number addressing at any depth; only the days that hold the page are opened for its rows."""
        return numbered_page(lambda since, until: self.logs(since, until, query.q), self.rollup_cover, query, number)

    def latency(self, since: datetime | None, until: datetime | None, quantile: float = 0.99) -> DataFrame:
        """(service, n, latency): a quantile of the range from stored sketches, without a scan of raw rows."""
        return latency_quantile(self.rollup_cover(since, until, measure=LATENCY), quantile)

    def service_summary(self, since: datetime | None, until: datetime | None) -> DataFrame:
        """The service summary of a range, from counts and sketches."""
        return service_summary_rollup(self.rollup_cover(since, until), self.rollup_cover(since, until, measure=LATENCY))

    def reconcile(self, since: datetime | None = None, until: datetime | None = None) -> DataFrame:
        """Minutes of the range (whole ones) whose roll-up differs from the stored rows: bucket_start, service, level,
        raw_count, rollup_count, missing.

        Digests kept at ingest are compared with those the roll-up amounts to, by day and service; of unequal days by
        minute; raw rows are read and counted for unequal minutes only. Days whose digests agree are not opened in the
        logs. Days of a service that have counts but no digests at all are recounted whole; rows that neither digests nor
        counts know of are not noticed. Digests and roll-up may be compacted at different times.
        """
        low, high = since and floor_to(since, 1), until and ceil_to(until, 1)
        counts = in_range(self.rollup(), low, high, "bucket_start")
        days = unequal(DIGEST.merged(self.rollup_cover(low, high, measure=DIGEST), 1440), digest_of_counts(counts, 1440))
        days = written(days, "unequal-days")
        dates = [row[0] for row in days.select(F.to_date("bucket_start")).distinct().collect()]
        if not dates:
            return minute_differences(self.spark.createDataFrame([], STORED_LOGS), counts.where(F.lit(False)))
        on_day = days.select(F.to_date("bucket_start").alias("log_date"), "service", "known")
        counts = counts.where(F.col("log_date").isin(dates)).join(on_day, ["log_date", "service"], "left_semi")
        kept = in_range(self.rollup(DIGEST), low, high, "bucket_start").where(F.col("log_date").isin(dates))
        kept = DIGEST.merged(kept.join(on_day, ["log_date", "service"], "left_semi"), 1)
        minutes = written(unequal(kept, digest_of_counts(counts, 1)), "unequal-minutes")
        stored = {day.isoformat() for day in dates} & self.folders("logs", "log_date").keys()
        paths = [f"{self.path('logs')}/log_date={day}" for day in sorted(stored)]
        logs = self.spark.read.schema(STORED_LOGS).option("basePath", self.path("logs")).parquet(*paths) if paths else self.spark.createDataFrame([], STORED_LOGS)
        logs = in_range(logs, low, high).withColumn("bucket_start", F.date_trunc("minute", "timestamp"))
        undigested = logs.join(on_day.where("NOT known"), ["log_date", "service"], "left_semi").join(minutes, ["bucket_start", "service"], "left_anti")
        logs = logs.join(minutes, ["bucket_start", "service"], "left_semi").unionByName(undigested)
        return minute_differences(logs, counts.join(minutes, ["bucket_start", "service"], "left_semi"))

    def repair_rollup(self, since: datetime | None = None, until: datetime | None = None) -> int:
        """Add what `reconcile` finds to the roll-up as deltas of a stream of its own, and return how many counts that corrects."""
        found = written(self.reconcile(since, until), "differences")
        corrected = found.count()
        if corrected:
            stream, run = self.stream_of(self.path("repairs")), self._next("repairs", "run")
            self.append_rollup(found.withColumn("count", F.col("missing")), run, stream)
        return corrected

    def compact_all(self, drop_before: datetime | None = None) -> None:
        """Compact every measure that has been stored."""
        for measure in MEASURES:
            if self.has(measure.deltas) or measure is COUNTS:
                self.compact_rollup(drop_before, measure)

    def compact_rollup(self, drop_before: datetime | None = None, measure: Measure = COUNTS) -> Compaction | None:
        """Merge the finished deltas into a new generation of the days they touch, optionally without expired buckets.

        Other days stay as they are. Coarser levels are made from the finest one: of the months that are touched, the
        days that are touched anew and the others as they were. Readers switch once the generation is marked complete.
        What it replaces is kept until the next compaction, for readers that are still at it.
        """
        history = self._compactions(measure)
        base = history[-1] if history else None
        finished = self.epochs(measure.deltas)
        new = {key: path for key, path in finished.items() if not base or key[1] > base.upto.get(key[0], -1)}
        if not new and not drop_before:
            self._clean(base, finished, measure)
            return base
        upto = dict(base.upto if base else {})
        for stream, epoch in new:
            upto[stream] = max(epoch, upto.get(stream, -1))
        current = Compaction(0, upto, None)
        fresh = self._deltas(self._pending(base) & ~self._pending(current), measure) if new else self._deltas(F.lit(False), measure)
        first_day = drop_before.date() if drop_before else None
        if base and base.first_day:
            first_day = max(first_day or base.first_day, base.first_day)
        touched = {row[0] for row in fresh.select("log_date").distinct().collect()} if new else set()
        if drop_before:
            touched.add(drop_before.date())
        rows = measure.merged(self._compacted(base, touched, measure).unionByName(fresh))
        if drop_before:
            rows = rollup_kept(rows, drop_before)
        if first_day:
            rows = rows.where(F.to_date("bucket_start") >= F.lit(first_day))
        generation = base.generation + 1 if base else 0
        path = f"{self.path(measure.compact)}/generation={generation}"
        dated = rows.withColumn("log_date", F.to_date("bucket_start")).hint("rebalance", F.col("log_date"))
        dated.sortWithinPartitions("log_date", measure.keys[0], "bucket_start").write.mode("overwrite").partitionBy("log_date").parquet(path)
        if drop_before and base:
            self._hide(path, "log_date", drop_before.date(), measure)
        self._write_levels(base, generation, touched, drop_before, measure)
        for stream, epoch in upto.items():
            self._mark(f"{path}/_upto.{stream}.{epoch}")
        if first_day:
            self._mark(f"{path}/_from.{first_day.isoformat()}")
        self._mark(f"{path}/{LEVELLED}")
        self._mark(f"{path}/{COMPLETE}")
        self._clean(base, finished, measure)
        return Compaction(generation, upto, first_day)

    def _write_levels(self, base: Compaction | None, generation: int, touched: set[date], drop_before: datetime | None, measure: Measure) -> None:
        """The hours and days of the touched months; all months if the generation before has no levels yet."""
        dated = _with(measure.schema, T.StructField("log_date", T.DateType()))
        finest = self.spark.read.schema(dated).parquet(f"{self.path(measure.compact)}/generation={generation}")
        levelled = base is not None and base.levelled
        if base and not levelled:
            others = {day for day in self._compact_days(base.generation, measure) if day not in touched}
            finest = finest.unionByName(self._compacted(base, others, measure))
        months = {day.replace(day=1) for day in touched}
        for minutes in measure.levels[1:]:
            rows = measure.merged(finest, minutes)
            if levelled:
                kept = self._compacted(base, months, measure, minutes)
                kept = kept.where(~F.col("log_date").isin(sorted(touched))) if touched else kept
                rows = rows.unionByName(kept.drop("log_date"))
            path = f"{self.path(measure.table(minutes))}/generation={generation}"
            rows = rows.withColumn("log_month", F.trunc("bucket_start", "month")).hint("rebalance", F.col("log_month"))
            ordered = rows.sortWithinPartitions("log_month", "bucket_start", measure.keys[0])
            ordered.write.mode("overwrite").partitionBy("log_month").parquet(path)
            if drop_before and base:
                self._hide(path, "log_month", drop_before.date().replace(day=1), measure)

    def _hide(self, generation: str, key: str, day: date, measure: Measure) -> None:
        """A cutoff day or month of which nothing is left has no folder in the new generation; an empty one stands for it."""
        path = f"{generation}/{key}={day.isoformat()}"
        if not self._is_file(path):
            self.spark.createDataFrame([], measure.schema).write.parquet(path)

    def _clean(self, base: Compaction | None, finished: dict[tuple[int, int], str], measure: Measure) -> None:
        """Drop what the compaction before the newest one (`base`) had already replaced."""
        if base is None:
            return
        for (stream, epoch), path in finished.items():
            if epoch <= base.upto.get(stream, -1):
                self._drop(path)
        for minutes in measure.levels:
            first = base.first_day
            first = first.replace(day=1) if first and minutes != measure.levels[0] else first
            for day, found in self._compact_days(base.generation, measure, minutes).items():
                for _, path in found if first and day < first else found[:-1]:
                    self._drop(path)

    # Retention

    def drop_expired_days(self, limit: datetime) -> list[date]:
        """Delete the folders of days that lie wholly before the cutoff; no row is rewritten."""
        dropped = []
        for text, path in self.folders("logs", "log_date").items():
            day = date.fromisoformat(text)
            if datetime(day.year, day.month, day.day) + timedelta(days=1) <= limit:
                self._drop(path)
                self._drop(f"{self.path('signatures')}/log_date={text}")
                dropped.append(day)
        return sorted(dropped)

    # Rules

    def add_rules(self, rules: DataFrame) -> None:
        """Store rule definitions; of definitions with one id the last added counts. A running alert loop sees
        them from its next tick on, and never writes to them."""
        if rules.where((F.col("id") < 0) | (F.col("id") >= MAX_RULE)).limit(1).count():
            raise ValueError(f"rule ids must be between 0 and {MAX_RULE - 1}")
        rules.select(*RULES.names).hint("rebalance").write.parquet(f"{self.path('rules')}/added={self._next('rules', '_added')}")

    def create_rule(self, service: str | None, threshold: int | None, window_minutes: int | None, webhook_url: str | None) -> DataFrame:
        """Check and store a new rule under the next free id, and return its row."""
        row = self.spark.createDataFrame([(0, service, threshold, window_minutes, webhook_url, None)], RULES)
        checked = with_rule_check(row)
        reason = checked.first()["reason"]
        if reason:
            raise ValueError(reason)
        highest = self.rules().agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        number = highest + 1
        while not self._mark(f"{self.path('rules')}/_id.{number}"):
            number += 1
        created = checked.drop("reason").withColumn("id", F.lit(number).cast("long")).select(*RULES.names)
        self.add_rules(created)
        return created

    def rules(self, stream: int | None = None, before: int | None = None) -> DataFrame:
        """The rules with their last trigger times; those of the given stream's ticks only before `before`."""
        folders = self.folders("rules", "added")
        if not folders:
            return self.spark.createDataFrame([], RULES)
        added = _with(RULES, T.StructField("added", T.LongType(), False))
        rows = self.spark.read.schema(added).parquet(self.path("rules"))
        fields = F.struct("added", *RULES.names)
        latest = rows.groupBy(F.col("id").alias("_id")).agg(F.max_by(fields, "added").alias("rule")).select("rule.*")
        seen = self.read_epochs("triggers", TRIGGERS)
        if before is not None:
            seen = seen.where((F.col("stream") != (stream or 0)) | (F.col("epoch") < before))
        last = seen.groupBy(F.col("rule_id").alias("_rule")).agg(F.max("triggered_at").alias("_last"))
        joined = latest.join(last, F.col("id") == F.col("_rule"), "left")
        return joined.withColumn("last_triggered_at", F.greatest("last_triggered_at", "_last")).select(*RULES.names)

    # Notifications

    def notifications(self) -> DataFrame:
        """All notifications, their read state folded in."""
        rows = self.read_epochs("notifications", NOTIFICATIONS)
        if not self.folders("receipts", "added"):
            return rows
        receipts = self.spark.read.schema(RECEIPTS).parquet(self.path("receipts"))
        until = receipts.agg(F.max("all_until")).first()[0]
        return with_read_state(rows, receipts.where("id IS NOT NULL").select("id"), until)

    def mark_read(self, notification_id: int) -> None:
        self._receipt(notification_id, None)

    def mark_all_read(self, as_of: datetime) -> None:
        """Everything up to this instant has been read; what comes later has not."""
        self._receipt(None, as_of)

    def _receipt(self, notification_id: int | None, until: datetime | None) -> None:
        row = self.spark.createDataFrame([(notification_id, until)], RECEIPTS)
        row.coalesce(1).write.parquet(f"{self.path('receipts')}/added={self._next('receipts', '_added')}")
