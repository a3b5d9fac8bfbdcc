"""Background jobs over the store: alert ticks and retention runs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cinderlog.functions.times import literal_like
from cinderlog.operators.alerts import alert_payloads, alerts_firing
from cinderlog.operators.notifications import alert_notifications, retention_notification
from cinderlog.operators.retention import RETENTION_DAYS, cutoff, expired_count
from cinderlog.schemas import NOTIFICATIONS
from cinderlog.sources.tables import EXPIRED, TRIGGERS, LogStore

# A notification's id is a prefix that only its run has, and the rule's id.
RULE_BITS, PREFIX_BITS = 31, 32
ALERT_KIND, RETENTION_KIND = 0, 1


def _write_notifications(store: LogStore, rows: DataFrame, run: int, stream: int, kind: int, position: Column) -> None:
    first = store.id_prefix("notification_ids", stream, 2 * run + kind, PREFIX_BITS) << RULE_BITS
    numbered = rows.withColumn("id", F.lit(first).cast("long") + position)
    numbered = numbered.withColumn("created_at", F.col("created_at").cast("timestamp"))
    store.write_epoch(numbered.select(*NOTIFICATIONS.names), "notifications", 2 * run + kind, stream)


def alert_tick(store: LogStore, as_of: datetime, tick: int, stream: int = 0) -> None:
    """Evaluate all rules at one instant. Reads trigger times as they were before this tick and writes only to folders
    of this tick, and only if a rule fires, so it can be repeated and quiet ticks leave nothing behind."""
    rules = store.rules(stream, before=tick)
    fired = alerts_firing(store.logs(), rules, as_of, store.rollup()).persist()
    try:
        if fired.isEmpty():
            store.drop_epoch("alerts", tick, stream)
            store.drop_epoch("triggers", tick, stream)
            store.drop_epoch("notifications", 2 * tick + ALERT_KIND, stream)
            return
        store.write_epoch(alert_payloads(fired, as_of), "alerts", tick, stream)
        _write_notifications(store, alert_notifications(fired, as_of), tick, stream, ALERT_KIND, F.col("rule_id"))
        now = literal_like(as_of, TRIGGERS["triggered_at"].dataType).alias("triggered_at")
        store.write_epoch(fired.select(F.col("id").alias("rule_id"), now), "triggers", tick, stream)
    finally:
        fired.unpersist()


def alert_stream(store: LogStore, checkpoint: str, interval: str = "60 seconds") -> StreamingQuery:
    """Run a tick per trigger. The rate source only provides the beat, and its batch time is kept
    in the checkpoint. Rules may be added before and while it runs."""
    beat = store.spark.readStream.format("rate").load().select(F.current_timestamp().cast("timestamp_ntz").alias("now"))
    stream = store.stream_of(checkpoint)

    def run(rows: DataFrame, tick: int) -> None:
        now = rows.agg(F.max("now")).first()[0]
        if now is not None:
            alert_tick(store, now, tick, stream)

    writer = beat.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return writer.trigger(processingTime=interval).start()


def run_retention(store: LogStore, as_of: datetime, run: int, days: int = RETENTION_DAYS) -> int:
    """Count what has expired, drop whole days, trim the roll-up, leave a notification.

    The count is written under the run's number first: a run that failed half-way and is repeated reports what it
    began with, although some of it may be gone already.
    """
    limit = cutoff(as_of, days)
    if (0, run) not in store.epochs("retention"):
        store.write_epoch(expired_count(store.logs(until=limit), limit).select("deleted"), "retention", run)
    report = store.read_epochs("retention", EXPIRED).where((F.col("stream") == 0) & (F.col("epoch") == run)).select("deleted")
    store.drop_expired_days(limit)
    store.compact_all(drop_before=limit)
    notice = retention_notification(report, days, as_of, NOTIFICATIONS["created_at"].dataType)
    _write_notifications(store, notice, run, 0, RETENTION_KIND, F.lit(0))
    # A count is a single number.
    return report.first()["deleted"]
