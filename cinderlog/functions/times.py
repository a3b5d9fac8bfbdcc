"""Time helpers. Sessions run in UTC, so TIMESTAMP and TIMESTAMP_NTZ columns behave alike."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MINUTE_US = 60_000_000

# ISO-8601 date, optionally with a time of day and a zone. Anything looser is refused: Spark's
# cast would read "12:30" as today and "2024" as the first of January.
ISO_PATTERN = (
    r"^\d{4}-\d{2}-\d{2}"
    r"([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:\d{2})?)?$"
)
_ISO = re.compile(ISO_PATTERN, re.ASCII)


def parse_iso(text) -> datetime | None:
    """Naive UTC datetime, or None when the text is not a timestamp."""
    if isinstance(text, datetime):
        return text.astimezone(timezone.utc).replace(tzinfo=None) if text.tzinfo else text
    if not isinstance(text, str) or not _ISO.match(text):
        return None
    # datetime keeps microseconds; further digits are cut off.
    text = re.sub(r"(\.\d{6})\d+", r"\1", text)
    try:
        value = datetime.fromisoformat(text)
    except ValueError:
        return None
    return value.astimezone(timezone.utc).replace(tzinfo=None) if value.tzinfo else value


def floor_minute(value: datetime) -> datetime:
    return value.replace(second=0, microsecond=0)


def ceil_minute(value: datetime) -> datetime:
    floored = floor_minute(value)
    return floored if floored == value else floored + timedelta(minutes=1)


def time_type(df: DataFrame, column: str) -> T.DataType:
    return df.schema[column].dataType


def literal_like(value: datetime, dtype: T.DataType) -> Column:
    """A literal of the column's own type, so that the comparison reaches the Parquet scan."""
    return F.lit(value.strftime("%Y-%m-%d %H:%M:%S.%f")).cast(dtype)


def ts_literal(value: datetime, df: DataFrame, column: str = "timestamp") -> Column:
    return literal_like(value, time_type(df, column))


def micros(col: Column) -> Column:
    return F.unix_micros(col.cast("timestamp"))


def minute_number(col: Column) -> Column:
    """Minutes since the epoch, rounded down (also before 1970)."""
    us = micros(col)
    return ((us - F.pmod(us, F.lit(MINUTE_US))) / MINUTE_US).cast("long")


def minute_to_time(minute: Column, dtype: T.DataType) -> Column:
    return F.timestamp_seconds(minute * 60).cast(dtype)


def epoch_minute(value: datetime) -> int:
    return int((value - datetime(1970, 1, 1)) // timedelta(minutes=1))


def epoch_micros(value: datetime) -> int:
    return (value - datetime(1970, 1, 1)) // timedelta(microseconds=1)


def iso_millis(col: Column) -> Column:
    return F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def iso_micros(col: Column) -> Column:
    return F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
