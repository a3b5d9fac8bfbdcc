"""Time-based retention: what expires, exactly and by whole chunks."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderlog.functions.times import ts_literal

# Defaults of a run.
RETENTION_DAYS = 30
CHUNK_DAYS = 7


def cutoff(as_of: datetime, days: int = RETENTION_DAYS) -> datetime:
    return as_of - timedelta(days=days)


def expired_count(logs: DataFrame, limit: datetime) -> DataFrame:
    """How many rows are strictly older than the cutoff."""
    old = logs.where(F.col("timestamp") < ts_literal(limit, logs))
    old = old.where(F.col("log_date") <= F.lit(limit.date())) if "log_date" in logs.columns else old
    return old.agg(F.count("*").alias("deleted"))


def kept(logs: DataFrame, limit: datetime) -> DataFrame:
    rows = logs.where(F.col("timestamp") >= ts_literal(limit, logs))
    return rows.where(F.col("log_date") >= F.lit(limit.date())) if "log_date" in logs.columns else rows


def chunks(rows: DataFrame, limit: datetime, days: int = CHUNK_DAYS) -> DataFrame:
    """Chunks of the table and whether each goes: only one that lies wholly before the cutoff does.

    Chunks begin on whole minutes, so the roll-up (a table with bucket_start) counts them exactly and cheaply.
    """
    rolled = "bucket_start" in rows.columns
    time, count = ("bucket_start", F.sum("count")) if rolled else ("timestamp", F.count("*"))
    counted = rows.groupBy(F.window(time, f"{days} days").alias("w")).agg(count.alias("count"))
    gone = F.col("w.end") <= ts_literal(limit, rows, time)
    return counted.select(F.col("w.start").alias("chunk_start"), F.col("w.end").alias("chunk_end"), "count", gone.alias("dropped"))
