"""Filtered, stably ordered, keyset-paginated search over the logs table."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from cinderlog.functions.text import matches_text
from cinderlog.functions.times import iso_micros, ts_literal
from cinderlog.plans.cursor import Cursor
from cinderlog.plans.spec import AggSpec, LogQuery


def newest_first(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("timestamp"), F.desc("id"))


def in_range(df: DataFrame, since: datetime | None, until: datetime | None, column: str = "timestamp") -> DataFrame:
    """since <= column < until. On a dated table the same bounds also prune directories, which
    Spark cannot derive from the time column by itself."""
    dated = "log_date" in df.columns
    if since:
        df = df.where(F.col(column) >= ts_literal(since, df, column))
        df = df.where(F.col("log_date") >= F.lit(since.date())) if dated else df
    if until:
        df = df.where(F.col(column) < ts_literal(until, df, column))
        df = df.where(F.col("log_date") <= F.lit(until.date())) if dated else df
    return df


def after_cursor(df: DataFrame, cursor: Cursor) -> DataFrame:
    """Rows that sort behind the cursor's row. Written out, since a struct comparison would not
    reach the Parquet scan."""
    at, stamp = ts_literal(cursor.timestamp, df), F.col("timestamp")
    df = df.where((stamp < at) | ((stamp == at) & (F.col("id") < cursor.id)))
    if "log_date" in df.columns:
        df = df.where(F.col("log_date") <= F.lit(cursor.timestamp.date()))
    return df


def content_filter(df: DataFrame, q: str | None, attributes: dict[str, str]) -> DataFrame:
    if q:
        df = df.where(matches_text(F.col("message"), q))
    for key, value in attributes.items():
        df = df.where(F.col("attributes")[key] == value)
    return df


def filter_logs(logs: DataFrame, query: LogQuery) -> DataFrame:
    """Every filter of a search except the cursor, the order and the limit."""
    df = in_range(logs, query.since, query.until)
    if query.service:
        df = df.where(F.col("service") == query.service)
    if query.levels:
        df = df.where(F.col("level").isin(*query.levels))
    return content_filter(df, query.q, query.attributes)


def search(logs: DataFrame, query: LogQuery) -> DataFrame:
    """One page: a bounded heap per task, no global sort."""
    df = filter_logs(logs, query)
    if query.cursor:
        df = after_cursor(df, query.cursor)
    return newest_first(df).limit(query.limit)


def total(logs: DataFrame, query: LogQuery) -> DataFrame:
    return filter_logs(logs, query).agg(F.count("*").alias("total"))


def next_cursor(page: DataFrame, limit: int) -> DataFrame:
    """One row with the cursor behind a page; NULL unless the page is full."""
    last = F.min(F.struct("timestamp", "id"))
    counted = page.agg(F.count("*").alias("n_rows"), last.alias("last"))
    return counted.select("n_rows", _cursor_after(F.col("n_rows"), limit).alias("next_cursor"))


def search_response(logs: DataFrame, query: LogQuery) -> DataFrame:
    """One row that answers a search: `logs` (the page, newest first), `total` (of all matching rows) and `next_cursor`.

    The page is at most 1000 rows; it is searched once, and the total is a count next to it.
    """
    page = search(logs, query).withColumn("attributes", F.to_json("attributes"))
    fields = F.struct("timestamp", "id", "level", "service", "message", "attributes")
    last = F.min(F.struct("timestamp", "id"))
    packed = page.agg(F.sort_array(F.collect_list(fields), asc=False).alias("logs"), last.alias("last"))
    return packed.select("logs", total(logs, query).scalar().alias("total"), _cursor_after(F.size("logs"), query.limit).alias("next_cursor"))


def _cursor_after(rows: Column, limit: int) -> Column:
    """The cursor behind a page that ends with the row `last`; NULL unless the page is full."""
    text = F.to_json(F.struct(iso_micros(F.col("last.timestamp")).alias("timestamp"), F.col("last.id").alias("id")))
    return F.when(rows == limit, F.base64(text))


def pages(logs: DataFrame, query: LogQuery) -> Iterator[list[Row]]:
    """Walk all pages. Only one page (at most 1000 rows) is on the driver at a time."""
    while True:
        rows = search(logs, query).collect()
        yield rows
        if len(rows) < query.limit:
            return
        last = rows[-1]
        stamp = last["timestamp"]
        query = replace(query, cursor=Cursor(stamp.replace(tzinfo=None), last["id"]))


def newest(stored: DataFrame, query: LogQuery, days: list[date]) -> DataFrame:
    """A search without lower bound on a dated table, reading from the newest day backwards.

    `days` are those the table holds (from the names of its folders; nothing is read to learn them).

    The span doubles until the page is full, so that the usual "latest logs" request opens a few
    directories instead of all of them. Each probe counts at most `limit` rows.
    """
    if query.since or not days:
        return search(stored, query)
    oldest_day, newest_day = min(days), max(days)
    if query.until:
        newest_day = min(newest_day, query.until.date())
    if query.cursor:
        newest_day = min(newest_day, query.cursor.timestamp.date())
    span = 1
    while newest_day - timedelta(days=span) >= oldest_day:
        start = newest_day - timedelta(days=span - 1)
        recent = stored.where(F.col("log_date") >= F.lit(start))
        matching = filter_logs(recent, query)
        matching = after_cursor(matching, query.cursor) if query.cursor else matching
        if matching.limit(query.limit).count() == query.limit:
            return search(recent, query)
        span *= 2
    return search(stored, query)


def raw_rows(logs: DataFrame, spec: AggSpec) -> DataFrame:
    """The raw rows an aggregation counts, with exact time bounds."""
    df = in_range(logs, spec.since, spec.until)
    if spec.service:
        df = df.where(F.col("service") == spec.service)
    if spec.level:
        df = df.where(F.col("level") == spec.level)
    return content_filter(df, spec.q, spec.attributes)


def log_detail(logs: DataFrame) -> DataFrame:
    """Rows as the explorer displays them."""
    return logs.select(
        "id",
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSS").alias("time"),
        F.upper("level").alias("level"),
        "service",
        "message",
        F.to_json("attributes").alias("attributes"),
    )
