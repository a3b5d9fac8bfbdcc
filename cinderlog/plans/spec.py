"""Search and aggregation requests."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import datetime, timedelta

from cinderlog.functions.times import parse_iso
from cinderlog.plans.cursor import Cursor
from cinderlog.schemas import BUCKETS, DEFAULT_LIMIT, LEVELS, MAX_LIMIT

ATTR_PREFIX = "attr."

# The time ranges offered by the explorer ("all" has no lower bound).
RELATIVE_RANGES = {
    "15m": timedelta(minutes=15),
    "1h": timedelta(hours=1),
    "6h": timedelta(hours=6),
    "24h": timedelta(hours=24),
    "7d": timedelta(days=7),
    "all": None,
}


def _millis(value: datetime | None) -> datetime | None:
    """Request times have millisecond resolution."""
    return value and value.replace(microsecond=value.microsecond // 1000 * 1000)


def _check_level(level: str) -> None:
    if level not in LEVELS:
        raise ValueError(f"invalid level: '{level}'")


def _single(params: dict, name: str):
    """A request parameter; an empty one counts as absent, a repeated one is refused."""
    value = params.get(name)
    if isinstance(value, (list, tuple)):
        raise ValueError(f"'{name}' must be given once")
    return value or None


def _attributes(params: dict) -> dict[str, str]:
    found = {}
    for name, value in params.items():
        if name.startswith(ATTR_PREFIX):
            if isinstance(value, (list, tuple)):
                raise ValueError(f"'{name}' must be given once")
            found[name[len(ATTR_PREFIX):]] = str(value)
    return found


def parse_limit(value) -> int:
    if not value:
        return DEFAULT_LIMIT
    text = str(value).strip()
    number = float(text) if re.fullmatch(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?", text) else None
    if text == "":
        number = 0.0
    if number is None or not number.is_integer():
        raise ValueError("limit must be a number")
    if not 1 <= number <= MAX_LIMIT:
        raise ValueError(f"limit must be between 1 and {MAX_LIMIT}")
    return int(number)


@dataclass(frozen=True)
class LogQuery:
    service: str | None = None
    levels: tuple[str, ...] = ()
    since: datetime | None = None
    until: datetime | None = None
    q: str | None = None
    attributes: dict[str, str] = field(default_factory=dict)
    cursor: Cursor | None = None
    limit: int = DEFAULT_LIMIT

    def __post_init__(self):
        for level in self.levels:
            _check_level(level)
        if not 1 <= self.limit <= MAX_LIMIT:
            raise ValueError(f"limit must be between 1 and {MAX_LIMIT}")
        if self.since and self.until and self.until <= self.since:
            raise ValueError("'until' must be after 'since'")

    @staticmethod
    def from_params(params: dict) -> "LogQuery":
        """Build from request parameters (text values), checking them in a fixed order."""
        level = _single(params, "level")
        levels = tuple(level.split(",")) if level else ()
        for name in levels:
            _check_level(name)
        limit = parse_limit(params.get("limit"))
        bounds = {}
        for name in ("since", "until"):
            text = _single(params, name)
            bounds[name] = parse_iso(text) if text else None
            if text and bounds[name] is None:
                raise ValueError(f"invalid '{name}' timestamp")
        if bounds["since"] and bounds["until"] and bounds["until"] <= bounds["since"]:
            raise ValueError("'until' must be after 'since'")
        cursor = _single(params, "cursor")
        return LogQuery(
            service=_single(params, "service"),
            levels=levels,
            since=_millis(bounds["since"]),
            until=_millis(bounds["until"]),
            q=_single(params, "q"),
            attributes=_attributes(params),
            cursor=Cursor.decode(cursor) if cursor else None,
            limit=limit,
        )

    @staticmethod
    def from_explorer(as_of: datetime, time_range: str = "all", levels=(), service=None, q=None,
                      limit: int = 25, cursor: Cursor | None = None) -> "LogQuery":
        """The explorer's form: a relative range, and no level filter when all are ticked."""
        span = RELATIVE_RANGES[time_range]
        chosen = tuple(levels) if 0 < len(set(levels)) < len(LEVELS) else ()
        return LogQuery(
            service=service or None, levels=chosen, since=_millis(as_of - span) if span else None,
            q=q or None, limit=limit, cursor=cursor,
        )

    @staticmethod
    def from_feed(text: str, limit: int = 50) -> "LogQuery":
        """The live feed's box: service:x and level:x words filter, the last plain word is q."""
        params = {"limit": str(limit)}
        for word in text.split(" "):
            name, colon, rest = word.partition(":")
            if not colon:
                params["q"] = word
            elif name in ("service", "level"):
                params[name] = rest.split(":")[0]
        return LogQuery.from_params(params)


@dataclass(frozen=True)
class AggSpec:
    since: datetime
    until: datetime
    bucket: str
    group_by: str | None = None
    service: str | None = None
    level: str | None = None
    q: str | None = None
    attributes: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        if self.bucket not in BUCKETS:
            raise ValueError("bucket must be one of: 1m, 5m, 1h, 1d")
        if self.group_by not in (None, "service", "level"):
            raise ValueError("group_by must be 'service' or 'level'")
        if self.until <= self.since:
            raise ValueError("'until' must be after 'since'")
        if self.level:
            _check_level(self.level)

    @property
    def minutes(self) -> int:
        return BUCKETS[self.bucket]

    @property
    def source(self) -> str:
        """The roll-up knows nothing of message text and attributes; those need raw rows."""
        return "raw" if self.q or self.attributes else "rollup"

    @staticmethod
    def from_params(params: dict) -> "AggSpec":
        since, until = _single(params, "since"), _single(params, "until")
        if not since or not until:
            raise ValueError("'since' and 'until' are required")
        bucket, group_by = _single(params, "bucket"), _single(params, "group_by")
        if not bucket:
            raise ValueError("'bucket' is required")
        if bucket not in BUCKETS:
            raise ValueError("bucket must be one of: 1m, 5m, 1h, 1d")
        if group_by not in (None, "service", "level"):
            raise ValueError("group_by must be 'service' or 'level'")
        start, end = parse_iso(since), parse_iso(until)
        if start is None or end is None:
            raise ValueError("invalid 'since' or 'until' timestamp")
        return AggSpec(
            since=_millis(start), until=_millis(end), bucket=bucket, group_by=group_by,
            service=_single(params, "service"), level=_single(params, "level"),
            q=_single(params, "q"), attributes=_attributes(params),
        )
