"""The one-minute roll-up: delta rows that are always summed on read."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderlog.functions.times import ts_literal

KEYS = ("bucket_start", "service", "level")


def build_rollup(logs: DataFrame, *keys: str) -> DataFrame:
    """Counts per minute, service and level; Spark sums map-side first, so hot services only
    send one row per minute and level from each task."""
    grouped = logs.groupBy(*keys, F.window("timestamp", "1 minute").alias("minute"), "service", "level")
    return grouped.agg(F.count("*").alias("count")).select(
        *keys, F.col("minute.start").alias("bucket_start"), "service", "level", "count"
    )


def merge_deltas(*parts: DataFrame) -> DataFrame:
    """Flushed rows and pending deltas as one roll-up; the reader sums, so no merge happens here."""
    merged = parts[0].select(*KEYS, "count")
    for part in parts[1:]:
        merged = merged.unionByName(part.select(*KEYS, "count"))
    return merged


def compacted(rollup: DataFrame) -> DataFrame:
    """One row per key."""
    return rollup.groupBy(*KEYS).agg(F.sum("count").alias("count"))


def rollup_kept(rollup: DataFrame, cutoff: datetime) -> DataFrame:
    return rollup.where(F.col("bucket_start") >= ts_literal(cutoff, rollup, "bucket_start"))


def reconcile(logs: DataFrame, rollup: DataFrame, bucket: str = "1 hour") -> DataFrame:
    """Raw counts against roll-up counts per bucket, service and level, and how many are missing."""
    def counted(df: DataFrame, column: str, total, name: str) -> DataFrame:
        grouped = df.groupBy(F.window(column, bucket).alias("w"), "service", "level").agg(total.alias(name))
        return grouped.select(F.col("w.start").alias("bucket_start"), "service", "level", name)

    raw = counted(logs, "timestamp", F.count("*"), "raw_count")
    rolled = counted(rollup, "bucket_start", F.sum("count"), "rollup_count")
    both = raw.join(rolled, list(KEYS), "full_outer").na.fill(0, ["raw_count", "rollup_count"])
    return both.withColumn("missing", F.col("raw_count") - F.col("rollup_count"))


def unequal(kept: DataFrame, counted: DataFrame) -> DataFrame:
    """(bucket_start, service, known) of which two tables of digests do not say the same; known if the first has any."""
    names = ["bucket_start", "service"]
    other = counted.select(*names, F.col("n").alias("other_n"), F.col("digest").alias("other_digest"))
    both = kept.select(*names, "n", "digest").join(other, names, "full_outer")
    return both.where(~(F.col("n").eqNullSafe(F.col("other_n")) & F.col("digest").eqNullSafe(F.col("other_digest")))).select(*names, F.col("n").isNotNull().alias("known"))


def minute_differences(logs: DataFrame, rollup: DataFrame) -> DataFrame:
    """Minutes whose counts are not those of the rows: bucket_start, service, level, raw_count, rollup_count, missing."""
    raw = build_rollup(logs).withColumnRenamed("count", "raw_count")
    rolled = compacted(rollup).withColumnRenamed("count", "rollup_count")
    both = raw.join(rolled, list(KEYS), "full_outer").na.fill(0, ["raw_count", "rollup_count"])
    return both.withColumn("missing", F.col("raw_count") - F.col("rollup_count")).where("missing <> 0")
