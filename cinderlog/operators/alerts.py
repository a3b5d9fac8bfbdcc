"""Error-threshold rules: counting, firing with a cooldown, and what firing leaves behind."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinderlog.functions.times import MINUTE_US, ceil_minute, epoch_micros, epoch_minute, iso_millis, literal_like, micros, minute_number, time_type, ts_literal
from cinderlog.schemas import ALERT_COOLDOWN_MINUTES


def rule_scope(service: Column) -> Column:
    """A rule without a service looks at all of them."""
    return F.nullif(service, F.lit(""))


def recent_errors(logs: DataFrame, oldest: Column) -> DataFrame:
    errors = logs.where((F.col("level") == "error") & (F.col("timestamp") >= oldest))
    return errors.where(F.col("log_date") >= oldest.cast("date")) if "log_date" in logs.columns else errors


def widest_window(rules: DataFrame) -> Column:
    """The longest look-back of all rules, as a scalar subquery that bounds the scan of the logs."""
    return rules.agg(F.coalesce(F.max("window_minutes"), F.lit(0))).scalar()


def by_scope(counts: DataFrame, *keys: str) -> DataFrame:
    """Counts per (service, keys) plus the counts over all services, under a NULL service."""
    everything = counts.groupBy(*keys).agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("service"), *keys, "n")
    return counts.unionByName(everything)


def _age(column: str, as_of: datetime) -> Column:
    """Whole minutes before as_of, rounded up."""
    since = micros(F.col(column)) - F.lit(epoch_micros(as_of))
    return (-((since - F.pmod(since, F.lit(MINUTE_US))) / MINUTE_US)).cast("long")


def _edge_errors(logs: DataFrame, windows: list[int], as_of: datetime) -> DataFrame:
    """(service, age, n): for each window the errors in that part of a minute that it begins with.

    Only the days of those minutes are read, and of their rows only the minutes themselves.
    """
    starts = [as_of - timedelta(minutes=window) for window in windows]
    into = epoch_micros(as_of) % MINUTE_US
    errors = logs.where(F.col("level") == "error")
    errors = errors.where((F.col("timestamp") >= ts_literal(min(starts), logs)) & (F.col("timestamp") < ts_literal(ceil_minute(max(starts)), logs)))
    if "log_date" in logs.columns:
        errors = errors.where(F.col("log_date").isin(sorted({start.date() for start in starts})))
    age = F.lit(epoch_minute(as_of)) - minute_number(F.col("timestamp"))
    inside = F.pmod(micros(F.col("timestamp")), F.lit(MINUTE_US)) >= into
    return errors.where(inside & age.isin(windows)).groupBy("service", age.alias("age")).agg(F.count("*").alias("n"))


def alert_counts(logs: DataFrame, rules: DataFrame, as_of: datetime, rollup: DataFrame | None = None) -> DataFrame:
    """Rules with `errors`, the matching errors in each rule's own look-back.

    An error's age in whole minutes, rounded up from `as_of`, decides exactly which windows it is
    in, so the logs shrink to (service, age) counts first. A running sum over ages then answers
    every window length; a window partition holds one row per minute of the longest look-back.

    With a roll-up, whole minutes come from it, and raw rows only answer for the part of a minute
    that a window begins with when as_of is not on a minute. The distinct window lengths of the
    rules are fetched for that.
    """
    partial = None
    if rollup is None:
        oldest = literal_like(as_of, time_type(logs, "timestamp")) - F.make_dt_interval(mins=widest_window(rules))
        ages = recent_errors(logs, oldest).groupBy("service", _age("timestamp", as_of).alias("age")).agg(F.count("*").alias("n"))
    else:
        windows = sorted(row[0] for row in rules.where("window_minutes > 0").select("window_minutes").distinct().collect())
        oldest = ceil_minute(as_of - timedelta(minutes=max(windows, default=0)))
        minutes = rollup.where((F.col("level") == "error") & (F.col("bucket_start") >= ts_literal(oldest, rollup, "bucket_start")))
        if "log_date" in rollup.columns:
            minutes = minutes.where(F.col("log_date") >= F.lit(oldest.date()))
        ages = minutes.groupBy("service", _age("bucket_start", as_of).alias("age")).agg(F.sum("count").alias("n"))
        if windows and ceil_minute(as_of) != as_of:
            partial = by_scope(_edge_errors(logs, windows, as_of), "age")
    known = by_scope(ages, "age").withColumn("is_rule", F.lit(False))
    asked = rules.select(
        rule_scope(F.col("service")).alias("service"), F.col("window_minutes").cast("long").alias("age")
    ).where("age IS NOT NULL").distinct().select("service", "age", F.lit(0).cast("long").alias("n"), F.lit(True).alias("is_rule"))
    upto = Window.partitionBy("service").orderBy("age").rangeBetween(Window.unboundedPreceding, 0)
    answers = known.unionByName(asked).withColumn("errors", F.sum("n").over(upto)).where("is_rule")
    answers = answers.select(F.col("service").alias("_scope"), F.col("age").alias("_window"), "errors")
    same = rule_scope(rules["service"]).eqNullSafe(answers["_scope"]) & (rules["window_minutes"].cast("long") == answers["_window"])
    counted = rules.join(answers, same, "left")
    errors = F.coalesce("errors", F.lit(0))
    if partial is not None:
        partial = partial.select(F.col("service").alias("_edge_scope"), F.col("age").alias("_edge_window"), F.col("n").alias("_edge"))
        same = rule_scope(rules["service"]).eqNullSafe(partial["_edge_scope"]) & (rules["window_minutes"].cast("long") == partial["_edge_window"])
        counted = counted.join(partial, same, "left")
        errors = errors + F.coalesce("_edge", F.lit(0))
    return counted.select(*[rules[c] for c in rules.columns], errors.alias("errors"))


def alerts_firing(logs: DataFrame, rules: DataFrame, as_of: datetime, rollup: DataFrame | None = None) -> DataFrame:
    """Rules over their threshold whose last alert is at least the cooldown ago."""
    counted = alert_counts(logs, rules, as_of, rollup)
    now = ts_literal(as_of, rules, "last_triggered_at")
    rested = F.col("last_triggered_at") <= now - F.expr(f"INTERVAL {ALERT_COOLDOWN_MINUTES} MINUTES")
    return counted.where((F.col("errors") >= F.col("threshold")) & F.coalesce(rested, F.lit(True)))


def alert_payloads(firing: DataFrame, as_of: datetime) -> DataFrame:
    """The document that goes to each fired rule's URL."""
    # The field names, the name of the alert, and `all` for a rule without a service.
    payload = F.struct(
        F.lit("error_threshold_exceeded").alias("alert"),
        F.coalesce(rule_scope(F.col("service")), F.lit("all")).alias("service"),
        F.col("errors").alias("error_count"),
        "threshold",
        "window_minutes",
        iso_millis(literal_like(as_of, T.TimestampType())).alias("triggered_at"),
    )
    return firing.select(F.col("id").alias("rule_id"), "webhook_url", F.to_json(payload).alias("payload"))


def rules_after(rules: DataFrame, fired: DataFrame, as_of: datetime) -> DataFrame:
    """The rules with the trigger time of the fired ones moved to now."""
    hit = fired.select(F.col("id"), F.lit(True).alias("_fired")).distinct()
    now = ts_literal(as_of, rules, "last_triggered_at")
    moved = F.when(F.col("_fired"), now).otherwise(F.col("last_triggered_at"))
    return rules.join(hit, "id", "left").withColumn("last_triggered_at", moved).select(*rules.columns)


def with_rule_check(rules: DataFrame) -> DataFrame:
    """Add `reason`: what an incoming rule lacks. A negative threshold is a threshold."""
    complete = (
        (F.coalesce(F.col("threshold"), F.lit(0)) != 0)
        & (F.coalesce(F.col("window_minutes"), F.lit(0)) != 0)
        & (F.coalesce(F.col("webhook_url"), F.lit("")) != "")
    )
    # Fixed value: the reason.
    return rules.withColumn(
        "reason", F.when(~complete, "threshold, window_minutes, and webhook_url are required")
    ).withColumn("service", rule_scope(F.col("service")))


def valid_rules(rules: DataFrame) -> DataFrame:
    return with_rule_check(rules).where("reason IS NULL").drop("reason")


def list_rules(rules: DataFrame) -> DataFrame:
    return rules.orderBy(F.desc("id"))
