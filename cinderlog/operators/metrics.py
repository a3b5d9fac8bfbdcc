"""Overview and dashboard figures. Those the dashboard reads from bucket counts take the roll-up,
with its whole-minute edges; the others take the logs table."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderlog.functions.numbers import half_up, percent
from cinderlog.functions.text import mask_digits
from cinderlog.functions.times import iso_millis, ts_literal
from cinderlog.operators.aggregate import aggregate_rollup, last, rollup_rows
from cinderlog.operators.measures import latency_quantile
from cinderlog.operators.quantile import exact_quantile, histogram
from cinderlog.operators.search import in_range, newest_first
from cinderlog.sources.workspace import written

HOUR, DAY, WEEK = timedelta(hours=1), timedelta(days=1), timedelta(days=7)

# Service health by events in the last hour, and the size estimate per event.
BUSY, OVERLOADED = 100, 500
SCORES = (99.9, 95.0, 85.0)
KB_PER_EVENT = "0.512"
# Error rates, in percent, from which a service counts as WARNING and DEGRADED.
WARNING_RATE, DEGRADED_RATE = 1.0, 2.5
STATUS_ORDER = ("HEALTHY", "WARNING", "DEGRADED")


def overview(logs: DataFrame, rollup: DataFrame | None = None) -> DataFrame:
    """Totals in one pass: the rows shrink to (service, level) before anything distinct.

    With a roll-up everything but the exact first and last instant comes from it, and raw rows are only read of
    the minutes in which those lie.
    """
    if rollup is None:
        pairs = logs.groupBy("service", "level").agg(
            F.count("*").alias("n"), F.min("timestamp").alias("oldest"), F.max("timestamp").alias("newest")
        )
        oldest, newest = F.min("oldest"), F.max("newest")
    else:
        pairs = rollup.groupBy("service", "level").agg(F.sum("count").alias("n"))
        ends = rollup.agg(F.min("bucket_start").alias("first"), F.max("bucket_start").alias("last")).first()
        oldest, newest = (_instant(logs, minute, pick) for minute, pick in ((ends["first"], F.min), (ends["last"], F.max)))
    return pairs.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total_logs"),
        F.count_distinct("service").alias("services_count"),
        F.count_distinct("level").alias("levels_count"),
        oldest.alias("oldest"),
        newest.alias("newest"),
    )


def _instant(logs: DataFrame, minute: datetime | None, pick) -> Column:
    """The first or last instant of a minute, as a scalar subquery over that minute's rows."""
    if minute is None:
        return F.lit(None).cast(logs.schema["timestamp"].dataType)
    rows = in_range(logs, minute, minute + timedelta(minutes=1))
    return rows.agg(pick("timestamp")).scalar()


def _recent(logs: DataFrame, as_of: datetime) -> DataFrame:
    """The last 24 hours, without their first instant."""
    start = as_of - DAY
    recent = logs.where(F.col("timestamp") > ts_literal(start, logs))
    return recent.where(F.col("log_date") >= F.lit(start.date())) if "log_date" in logs.columns else recent


def recent_by_level(logs: DataFrame, as_of: datetime) -> DataFrame:
    counts = _recent(logs, as_of).groupBy("level").agg(F.count("*").alias("count"))
    return counts.orderBy(F.desc("count"), "level")


def recent_top_services(logs: DataFrame, as_of: datetime, top: int = 8) -> DataFrame:
    counts = _recent(logs, as_of).groupBy("service").agg(F.count("*").alias("count"))
    return counts.orderBy(F.desc("count"), "service").limit(top)


def overview_json(logs: DataFrame, as_of: datetime, rollup: DataFrame | None = None) -> DataFrame:
    """The overview as one JSON document. The lists hold four levels and eight services at most."""
    def packed(counts: DataFrame, key: str, name: str) -> DataFrame:
        # Sorting by the negated count gives the biggest first, then by name.
        items = F.sort_array(F.collect_list(F.struct((-F.col("count")).alias("rank"), F.col(key), F.col("count"))))
        return counts.agg(
            F.transform(items, lambda x: F.struct(x[key].alias(key), x["count"].alias("count"))).alias(name)
        )

    levels = packed(recent_by_level(logs, as_of), "level", "last_24h_by_level").scalar()
    services = packed(recent_top_services(logs, as_of), "service", "last_24h_by_service").scalar()
    document = F.struct(
        "total_logs", "services_count",
        iso_millis(F.col("oldest")).alias("oldest"), iso_millis(F.col("newest")).alias("newest"),
        levels.alias("last_24h_by_level"), services.alias("last_24h_by_service"),
    )
    return overview(logs, rollup).select(F.to_json(document).alias("context"))


def _summed(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.coalesce(F.sum("count"), F.lit(0)).alias(name))


def errors_last_hour(rollup: DataFrame, as_of: datetime) -> DataFrame:
    return _summed(rollup_rows(rollup, last(as_of, HOUR, "1h", level="error")), "errors")


def ingest_rate(rollup: DataFrame, as_of: datetime) -> DataFrame:
    """Events per hour over the last 24 hours, rounded."""
    day = _summed(rollup_rows(rollup, last(as_of, DAY, "1h")), "events")
    return day.select(half_up(F.col("events") / 24).alias("per_hour"))


def daily_volume(rollup: DataFrame, as_of: datetime) -> DataFrame:
    return aggregate_rollup(rollup, last(as_of, WEEK, "1d")).select("start", "count")


def total_last_week(rollup: DataFrame, as_of: datetime) -> DataFrame:
    return _summed(rollup_rows(rollup, last(as_of, WEEK, "1d")), "total")


def active_services(rollup: DataFrame, as_of: datetime) -> DataFrame:
    day = rollup_rows(rollup, last(as_of, DAY, "1h"))
    return day.agg(F.count_distinct("service").alias("services"))


def services_in_newest(logs: DataFrame, rows: int = 1000) -> DataFrame:
    newest = newest_first(logs.select("timestamp", "id", "service")).limit(rows)
    return newest.agg(F.count_distinct("service").alias("services"))


def _shares(rollup: DataFrame, as_of: datetime, key: str, default: str) -> DataFrame:
    """Count and share of the total per key over the last day. The total is a scalar subquery, so
    no row set passes through a single task."""
    day = rollup_rows(rollup, last(as_of, DAY, "1h"))
    counts = day.groupBy(F.coalesce(F.nullif(F.col(key), F.lit("")), F.lit(default)).alias(key)).agg(F.sum("count").alias("count"))
    whole = day.agg(F.sum("count").alias("whole")).scalar()
    return counts.select(key, "count", percent(F.col("count"), whole, 1).alias("pct"))


def level_distribution(rollup: DataFrame, as_of: datetime) -> DataFrame:
    return _shares(rollup, as_of, "level", "info").orderBy(F.desc("count"), "level")


def storage_by_service(rollup: DataFrame, as_of: datetime) -> DataFrame:
    kb = F.round(F.col("count").cast("decimal(18,0)") * F.lit(KB_PER_EVENT).cast("decimal(4,3)"), 2)
    shares = _shares(rollup, as_of, "service", "unknown")
    return shares.withColumn("storage_kb", kb.cast("double")).orderBy(F.desc("count"), "service")


def service_health(rollup: DataFrame, as_of: datetime, shown: int = 5) -> DataFrame:
    """Score of the services seen first in the last hour's five-minute buckets."""
    buckets = aggregate_rollup(rollup, last(as_of, HOUR, "5m", group_by="service"))
    services = buckets.groupBy(F.col("group").alias("service")).agg(
        F.sum("count").alias("total"), F.min("start").alias("first_bucket")
    )
    fine, busy, overloaded = SCORES
    score = F.when(F.col("total") < BUSY, fine).when(F.col("total") < OVERLOADED, busy).otherwise(overloaded)
    ranked = services.withColumn("health", score).orderBy("first_bucket", "service")
    return ranked.limit(shown).select("service", "total", "health")


def service_summary(logs: DataFrame, duration: str = "duration_ms", exact: bool = True) -> DataFrame:
    """Count, P99 latency, error rate and status per service.

    The exact P99 takes a second scan of (service, duration); the approximate one is a sketch in
    the same scan as the counts.
    """
    errors = F.count_if(F.col("level") == "error").alias("errors")
    if exact:
        bins = histogram(logs, "service", duration, errors)
        counts = bins.groupBy("service").agg(F.sum("n").alias("total"), F.sum("errors").alias("errors"))
        counts = counts.join(exact_quantile(logs, bins, "service", duration, 0.99, "p99_ms"), "service", "left")
    else:
        latency = F.percentile_approx(duration, 0.99).alias("p99_ms")
        counts = logs.groupBy("service").agg(F.count("*").alias("total"), errors, latency)
    return _rated(counts)


def service_summary_rollup(rollup: DataFrame, latency: DataFrame) -> DataFrame:
    """The same from roll-up rows of counts and of latency sketches (any levels); the P99 has the sketch's rank error."""
    errors = F.sum(F.when(F.col("level") == "error", F.col("count")).otherwise(0)).alias("errors")
    counts = rollup.groupBy("service").agg(F.sum("count").alias("total"), errors)
    tails = latency_quantile(latency).select("service", F.col("latency").alias("p99_ms"))
    return _rated(counts.join(tails, "service", "left"))


def _rated(counts: DataFrame) -> DataFrame:
    rate = percent(F.col("errors"), F.col("total"), 2)
    status = (
        F.when(F.col("error_rate") >= DEGRADED_RATE, "DEGRADED")
        .when(F.col("error_rate") >= WARNING_RATE, "WARNING")
        .otherwise("HEALTHY")
    )
    rated = counts.withColumn("error_rate", rate).withColumn("status", status)
    return rated.select("service", "total", "p99_ms", "error_rate", "status")


def summary_filter(summary: DataFrame, text: str) -> DataFrame:
    """Services whose name or status contains the text."""
    if not text:
        return summary
    needle = F.lower(F.lit(text))
    return summary.where(F.lower("service").contains(needle) | F.lower("status").contains(needle))


def summary_page(summary: DataFrame, page: int = 1, by: str = "service", size: int = 5) -> DataFrame:
    """One page of the summary table, by name or from healthy to degraded."""
    rank = F.array_position(F.array(*map(F.lit, STATUS_ORDER)), F.col("status"))
    order = [rank, F.col("service")] if by == "status" else [F.col("service")]
    return summary.orderBy(*order).offset((page - 1) * size).limit(size)


def top_errors(logs: DataFrame, top: int = 10) -> DataFrame:
    """The `top` (1 to 1000) most frequent error messages, alike up to their digits; the earlier one first among equals.

    Messages may be long, so they are counted by digest, and only the texts of the winners, at
    most `top` of them, are fetched afterwards.
    """
    if not 1 <= top <= 1000:
        raise ValueError("top must be between 1 and 1000")
    template = mask_digits(F.col("message"))
    errors = logs.where(F.col("level") == "error").select("timestamp", template.alias("template"))
    errors = errors.withColumn("digest", F.md5("template"))
    clusters = errors.groupBy("digest").agg(
        F.count("*").alias("count"), F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen")
    )
    winners = written(clusters.orderBy(F.desc("count"), "first_seen", "digest").limit(top), "top-errors")
    # At most `top` instants: with them the second read opens only the row groups that can hold a winner's first text.
    seen = [row[0] for row in winners.select("first_seen").distinct().collect()]
    first = in_range(logs, min(seen), max(seen) + timedelta(microseconds=1)) if seen else logs.where("false")
    first = first.where((F.col("level") == "error") & F.col("timestamp").isin([ts_literal(t.replace(tzinfo=None), logs) for t in seen]))
    first = first.select(template.alias("template")).withColumn("digest", F.md5("template"))
    named = first.groupBy("digest").agg(F.first("template").alias("template")).join(winners, "digest")
    return named.select("template", "count", "first_seen", "last_seen").orderBy(F.desc("count"), "first_seen")


def volume_change(buckets: DataFrame) -> DataFrame:
    """Change against the service's previous bucket, in percent. A window holds one row per bucket
    of a service, never raw rows."""
    previous = F.lag("count").over(Window.partitionBy("group").orderBy("start"))
    change = F.col("count") - F.col("previous")
    return buckets.withColumn("previous", previous).select(
        "start", F.col("group").alias("service"), "count", "previous",
        F.when(F.col("previous").isNotNull(), percent(change, F.col("previous"), 1)).alias("change_pct"),
    )
