"""Notifications: made from alerts and retention runs, read through a feed and receipts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderlog.functions.times import literal_like, time_type, ts_literal
from cinderlog.operators.alerts import rule_scope


def alert_notifications(firing: DataFrame, as_of: datetime) -> DataFrame:
    # Types, titles and messages of notifications, here and below.
    scope = rule_scope(F.col("service"))
    now = literal_like(as_of, time_type(firing, "last_triggered_at"))
    return firing.select(
        F.col("id").alias("rule_id"),
        F.lit("alert").alias("type"),
        F.format_string("Alert: %s", F.coalesce(scope, F.lit("all"))).alias("title"),
        F.format_string("%d errors in %d min (threshold: %d)", "errors", "window_minutes", "threshold").alias("message"),
        scope.alias("service"),
        F.lit("error").alias("level"),
        F.lit(False).alias("is_read"),
        now.alias("created_at"),
    )


def retention_notification(expired: DataFrame, days: int, as_of: datetime, dtype) -> DataFrame:
    """From the one-row expired count; no row when nothing expired."""
    return expired.where("deleted > 0").select(
        F.lit("retention").alias("type"),
        F.lit("Retention Run Complete").alias("title"),
        F.format_string("Deleted %d logs older than %d days", "deleted", F.lit(days)).alias("message"),
        F.lit(None).cast("string").alias("service"),
        F.lit(None).cast("string").alias("level"),
        F.lit(False).alias("is_read"),
        literal_like(as_of, dtype).alias("created_at"),
    )


def feed(notifications: DataFrame, limit: int = 50) -> DataFrame:
    """Unread first, newest first."""
    return notifications.orderBy("is_read", F.desc("created_at"), F.desc("id")).limit(limit)


def unread_count(notifications: DataFrame) -> DataFrame:
    return notifications.agg(F.count_if(~F.col("is_read")).alias("count"))


def with_read_state(notifications: DataFrame, receipts: DataFrame, mark_all_at: datetime | None = None) -> DataFrame:
    """Fold the receipts (id) and the latest mark-all instant into `is_read`."""
    seen = receipts.select("id", F.lit(True).alias("_seen")).distinct()
    is_read = F.col("is_read") | F.coalesce(F.col("_seen"), F.lit(False))
    if mark_all_at:
        is_read = is_read | (F.col("created_at") <= ts_literal(mark_all_at, notifications, "created_at"))
    return notifications.join(seen, "id", "left").withColumn("is_read", is_read).select(*notifications.columns)
