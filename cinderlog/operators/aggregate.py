"""Tumbling bucket counts, from the roll-up where it can answer and from raw rows otherwise."""

from __future__ import annotations

from dataclasses import replace
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderlog.functions.times import ceil_minute, floor_minute
from cinderlog.operators.rollup import merge_deltas
from cinderlog.operators.search import in_range, raw_rows
from cinderlog.plans.spec import AggSpec


def _bucketed(df: DataFrame, column: str, count: Column, spec: AggSpec) -> DataFrame:
    """Counts per bucket (and group), buckets aligned to the epoch; empty ones do not appear."""
    groups = [spec.group_by] if spec.group_by else []
    window = F.window(column, f"{spec.minutes} minutes").alias("w")
    counted = df.groupBy(window, *groups).agg(count.alias("count"))
    group = F.col(spec.group_by) if spec.group_by else F.lit(None).cast("string")
    return counted.select(F.col("w.start").alias("start"), group.alias("group"), "count")


def aggregate_raw(logs: DataFrame, spec: AggSpec) -> DataFrame:
    return _bucketed(raw_rows(logs, spec), "timestamp", F.count("*"), spec)


def rollup_rows(rollup: DataFrame, spec: AggSpec) -> DataFrame:
    """Roll-up rows in range. The lower bound is floored to the minute and the upper one is not,
    so whole minutes are counted at both edges."""
    df = in_range(rollup, floor_minute(spec.since), spec.until, "bucket_start")
    if spec.service:
        df = df.where(F.col("service") == spec.service)
    if spec.level:
        df = df.where(F.col("level") == spec.level)
    return df


def aggregate_rollup(rollup: DataFrame, spec: AggSpec) -> DataFrame:
    if spec.source != "rollup":
        raise ValueError("the roll-up cannot filter on text or attributes")
    return _bucketed(rollup_rows(rollup, spec), "bucket_start", F.sum("count"), spec)


def aggregate(logs: DataFrame, rollup: DataFrame, spec: AggSpec) -> DataFrame:
    """Answer from the cheapest table that can, ordered by bucket and group."""
    if spec.source == "rollup":
        buckets = aggregate_rollup(rollup, spec)
    else:
        buckets = aggregate_raw(logs, spec)
    return buckets.orderBy("start", "group")


def aggregate_exact(logs: DataFrame, rollup: DataFrame, spec: AggSpec) -> DataFrame:
    """Exact [since, until) at roll-up cost: whole minutes from the roll-up, edge minutes from
    raw rows."""
    if spec.source != "rollup":
        return aggregate_raw(logs, spec)
    first, last = ceil_minute(spec.since), floor_minute(spec.until)
    if last <= first:
        return aggregate_raw(logs, spec)
    inner = aggregate_rollup(rollup, replace(spec, since=first, until=last))
    parts = [inner]
    if spec.since < first:
        parts.append(aggregate_raw(logs, replace(spec, until=first)))
    if last < spec.until:
        parts.append(aggregate_raw(logs, replace(spec, since=last)))
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged.groupBy("start", "group").agg(F.sum("count").alias("count"))


def aggregate_with_pending(flushed: DataFrame, pending: DataFrame, spec: AggSpec) -> DataFrame:
    """Counts that include accepted rows whose deltas are not flushed yet."""
    return aggregate_rollup(merge_deltas(flushed, pending), spec)


def volume_series(rollup: DataFrame, spec: AggSpec, services: list[str]) -> DataFrame:
    """Bucket counts of the chosen services, one row per bucket and service."""
    return aggregate_rollup(rollup.where(F.col("service").isin(*services)), replace(spec, group_by="service"))


def last(as_of, span: timedelta, bucket: str, **filters) -> AggSpec:
    """The request of a dashboard tile: the span that ends now."""
    return AggSpec(since=as_of - span, until=as_of, bucket=bucket, **filters)
