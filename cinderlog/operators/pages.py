"""Pages by number at any depth, found by prefix sums over bucket counts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cinderlog.functions.times import ceil_minute, epoch_micros, floor_minute, micros, minute_number
from cinderlog.operators.measures import DAY_MINUTES
from cinderlog.operators.rollup import build_rollup
from cinderlog.operators.search import after_cursor, filter_logs, in_range, newest_first
from cinderlog.plans.cursor import Cursor
from cinderlog.plans.spec import LogQuery

#: Rows a task may keep to find a page; pages behind that many rows are looked up in the counts first.
SHALLOW = 10_000
#: Into how many parts a stretch that holds too many rows is cut at a time.
PARTS = 1000
EPOCH = datetime(1970, 1, 1)

#: (since, until, coarsest minutes) -> roll-up rows, and (since, until) -> log rows.
Counts = Callable[[datetime | None, datetime | None, int], DataFrame]
Logs = Callable[[datetime | None, datetime | None], DataFrame]


@dataclass(frozen=True)
class Stretch:
    """Where a page lies: in [since, until), behind the cursor if there is one, after `skip` of the rows there."""

    since: datetime | None
    until: datetime | None
    skip: int
    cursor: Cursor | None = None


def search_offset(logs: DataFrame, query: LogQuery, page: int, rollup: DataFrame | None = None, shallow: int = SHALLOW) -> DataFrame:
    """Page `page` (from 1) of a search over a table, at any depth; counts come from its roll-up, if given."""
    counts = None if rollup is None else lambda since, until, coarsest: in_range(rollup, since and floor_minute(since), until, "bucket_start")
    return numbered_page(lambda since, until: in_range(logs, since, until), counts, query, page, shallow)


def numbered_page(logs: Logs, counts: Counts | None, query: LogQuery, page: int, shallow: int = SHALLOW) -> DataFrame:
    """Page `page` (from 1), newest first; empty behind the last one.

    The first rows are found by a heap per task. Behind `shallow` rows, counts by day say on which days the page lies,
    counts by minute of those days in which minutes, and the rows are looked for only there. Counts come from the
    roll-up (its coarsest level first), or from a pass over the matching rows where text or attributes are filtered or there
    is no roll-up. A minute that alone holds too many rows is cut further, by time and then by id, so that no task ever
    keeps more than `shallow` rows and a page. A roll-up must agree with the rows, as a compacted and reconciled one does.
    """
    if page < 1:
        raise ValueError("page must be at least 1")
    if query.cursor:
        raise ValueError("pages are addressed by number or by cursor, not both")
    place = Stretch(query.since, query.until, (page - 1) * query.limit)
    if place.skip > shallow:
        place = _by_minute(logs, counts, query, place.skip)
        place = place and _narrowed(logs, place, query, shallow)
        if place is None:
            return filter_logs(logs(query.since, query.until), query).limit(0)
    rows = filter_logs(logs(place.since, place.until), replace(query, since=place.since, until=place.until))
    rows = after_cursor(rows, place.cursor) if place.cursor else rows
    return newest_first(rows).offset(place.skip).limit(query.limit)


def _behind(counted: DataFrame, key: str, before: int, skip: int, limit: int) -> list[tuple]:
    """(key, rows in front) of the parts that hold one of `limit` rows behind `skip`, newest first; at most `limit` of them."""
    newer = Window.orderBy(F.desc(key)).rowsBetween(Window.unboundedPreceding, -1)
    summed = counted.select(key, "n", (F.coalesce(F.sum("n").over(newer), F.lit(0)) + before).alias("front"))
    held = summed.where((F.col("front") < skip + limit) & (F.col("front") + F.col("n") > skip) & (F.col("n") > 0))
    return [(row[0], row[1]) for row in held.orderBy(F.desc(key)).select(key, "front").collect()]


def _counted(rows: DataFrame, minutes: int) -> DataFrame:
    """Counts by the number of the day or minute since the epoch."""
    return rows.groupBy(F.floor(minute_number(F.col("bucket_start")) / minutes).alias("start")).agg(F.sum("count").alias("n"))


def _by_minute(logs: Logs, counts: Counts | None, query: LogQuery, skip: int) -> Stretch | None:
    """The minutes that hold the page, by counts of days and then of the minutes in the days found.

    Sums run over one row per day and then over the minutes of at most `limit` days.
    """
    days = _behind(_counted(_matching(logs, counts, query, DAY_MINUTES), DAY_MINUTES), "start", 0, skip, query.limit)
    if not days:
        return None
    low, high = EPOCH + timedelta(days=days[-1][0]), EPOCH + timedelta(days=days[0][0] + 1)
    low, high = max(low, query.since or low), min(high, query.until or high)
    inside = replace(query, since=low, until=high)
    minutes = _behind(_counted(_matching(logs, counts, inside, 1), 1), "start", days[0][1], skip, query.limit)
    if not minutes:
        return None
    until = min(EPOCH + timedelta(minutes=minutes[0][0] + 1), high)
    return Stretch(max(EPOCH + timedelta(minutes=minutes[-1][0]), low), until, skip - minutes[0][1])


def _matching(logs: Logs, counts: Counts | None, query: LogQuery, coarsest: int) -> DataFrame:
    """(bucket_start, count) of the rows a query matches: whole minutes from the roll-up, cut ones from rows."""
    def raw(part: LogQuery) -> DataFrame:
        return build_rollup(filter_logs(logs(part.since, part.until), part)).select("bucket_start", "count")

    if counts is None or query.q or query.attributes:
        return raw(query)
    first, last = query.since and ceil_minute(query.since), query.until and floor_minute(query.until)
    if first and last and first >= last:
        return raw(query)
    rows = in_range(counts(first, last, coarsest), first, last, "bucket_start")
    if query.service:
        rows = rows.where(F.col("service") == query.service)
    if query.levels:
        rows = rows.where(F.col("level").isin(*query.levels))
    rows = rows.select("bucket_start", "count")
    if first and query.since < first:
        rows = rows.unionByName(raw(replace(query, until=first)))
    if last and last < query.until:
        rows = rows.unionByName(raw(replace(query, since=last)))
    return rows


def _narrowed(logs: Logs, place: Stretch, query: LogQuery, shallow: int) -> Stretch | None:
    """The same page where at most `shallow` rows come before it: the part with its first row is cut again and again."""
    since = None
    while place.skip > shallow:
        low, high = epoch_micros(place.since), epoch_micros(place.until)
        if high - low <= 1:  # one instant holds them
            place = _by_id(logs, place, query, shallow)
            break
        step = -(-(high - low) // PARTS)
        rows = filter_logs(logs(place.since, place.until), replace(query, since=place.since, until=place.until))
        part = F.floor((micros(F.col("timestamp")) - low) / step)
        found = _behind(rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")), "part", 0, place.skip, query.limit)
        if not found:
            return None
        start, stop = (EPOCH + timedelta(microseconds=low + number * step) for number in (found[0][0], found[0][0] + 1))
        since = since or max(place.since, EPOCH + timedelta(microseconds=low + found[-1][0] * step))
        place = Stretch(max(place.since, start), min(place.until, stop), place.skip - found[0][1])
    return replace(place, since=since or place.since)


def _by_id(logs: Logs, place: Stretch, query: LogQuery, shallow: int) -> Stretch:
    """Within one instant, the id that the page begins behind."""
    rows = filter_logs(logs(place.since, place.until), replace(query, since=place.since, until=place.until))
    low, high = rows.agg(F.min("id"), F.max("id")).first()
    low, high, skip = low, high + 1, place.skip
    while skip > shallow and high - low > 1:
        step = -(-(high - low) // PARTS)
        inside = rows.where((F.col("id") >= low) & (F.col("id") < high))
        counted = inside.groupBy(F.floor((F.col("id") - low) / step).alias("part")).agg(F.count("*").alias("n"))
        (part, front), *_ = _behind(counted, "part", 0, skip, query.limit)
        low, high, skip = low + part * step, min(high, low + (part + 1) * step), skip - front
    return Stretch(place.since, place.until, skip, Cursor(place.since, high))
