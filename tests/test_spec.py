from datetime import datetime

import pytest

from cinderlog.functions.text import substring_pattern
from cinderlog.functions.times import parse_iso
from cinderlog.plans.cursor import Cursor
from cinderlog.plans.spec import AggSpec, LogQuery

RANGE = {"since": "2024-01-01T00:00:00Z", "until": "2024-01-02T00:00:00Z"}


@pytest.mark.parametrize("given, limit", [(None, 100), ("", 100), ("1", 1), ("1000", 1000), ("1e2", 100), ("7.0", 7), (" 5 ", 5), (0, 100)])
def test_limits(given, limit):
    assert LogQuery.from_params({"limit": given}).limit == limit


@pytest.mark.parametrize("given, text", [
    ("0", "between"), ("1001", "between"), ("-1", "between"), (" ", "between"), ("10.5", "a number"), ("abc", "a number"), ("nan", "a number"), ("1_0", "a number"),
])
def test_wrong_limits(given, text):
    with pytest.raises(ValueError, match=text):
        LogQuery.from_params({"limit": given})


@pytest.mark.parametrize("given, shown", [("warn,", ""), ("Warn", "Warn"), ("critical", "critical"), ("info, warn", " warn")])
def test_wrong_levels(given, shown):
    with pytest.raises(ValueError, match=f"invalid level: '{shown}'"):
        LogQuery.from_params({"level": given})


def test_search_parameters():
    query = LogQuery.from_params({
        **RANGE, "service": "", "level": "warn,error", "q": "x", "attr.a.b": "1", "attr.k": 2, "until": "2024-01-02T02:00:00.1239+02:00", "page": "3",
    })
    assert query.service is None and query.levels == ("warn", "error")
    assert query.until == datetime(2024, 1, 2, 0, 0, 0, 123000)
    assert query.attributes == {"a.b": "1", "k": "2"}


@pytest.mark.parametrize("params, text", [
    ({"since": "12:30"}, "invalid 'since'"), ({"until": "2024"}, "invalid 'until'"),
    ({"since": RANGE["until"], "until": RANGE["until"]}, "must be after"),
    ({"since": RANGE["until"], "until": RANGE["since"], "cursor": "zzz"}, "must be after"),
    ({"cursor": "not-a-valid-cursor"}, "invalid cursor"), ({"level": ["warn", "error"]}, "given once"), ({"attr.k": ["1", "2"]}, "given once"),
])
def test_wrong_search_parameters(params, text):
    with pytest.raises(ValueError, match=text):
        LogQuery.from_params(params)


@pytest.mark.parametrize("missing, text", [
    ({"bucket": "1h"}, "'since' and 'until' are required"), ({**RANGE}, "'bucket' is required"),
    ({**RANGE, "bucket": "2h"}, "one of: 1m, 5m, 1h, 1d"), ({**RANGE, "bucket": "1h", "group_by": "message"}, "group_by must be"),
    ({"since": "x", "until": "y", "bucket": "1h"}, "invalid 'since' or 'until'"),
    ({"since": RANGE["until"], "until": RANGE["since"], "bucket": "1h", "level": "nope"}, "must be after"),
    ({**RANGE, "bucket": "1h", "level": "warn,error"}, "invalid level: 'warn,error'"),
])
def test_wrong_aggregate_parameters(missing, text):
    with pytest.raises(ValueError, match=text):
        AggSpec.from_params(missing)


def test_routing():
    params = {**RANGE, "bucket": "5m"}
    assert AggSpec.from_params(params).source == "rollup"
    assert AggSpec.from_params({**params, "service": "a", "level": "info", "group_by": "level"}).source == "rollup"
    assert AggSpec.from_params({**params, "q": "x"}).source == "raw"
    assert AggSpec.from_params({**params, "attr.k": ""}).source == "raw"


def test_cursor_round_trip():
    cursor = Cursor(datetime(2026, 8, 2, 11, 59, 0, 123456), 7)
    assert Cursor.decode(cursor.encode()) == cursor


@pytest.mark.parametrize("body", ["[]", "null", '{"timestamp":5,"id":1}', '{"timestamp":"2024-01-01T00:00:00Z","id":"1"}', '{"timestamp":"soon","id":1}', "{"])
def test_wrong_cursors(body):
    import base64

    with pytest.raises(ValueError, match="invalid cursor"):
        Cursor.decode(base64.b64encode(body.encode()).decode())


def test_feed_words():
    query = LogQuery.from_feed("first service:auth level:warn,error foo:bar second")
    assert (query.service, query.levels, query.q, query.limit) == ("auth", ("warn", "error"), "second", 50)
    assert LogQuery.from_feed("word ").q is None


def test_explorer_form():
    now = datetime(2024, 1, 2)
    assert LogQuery.from_explorer(now, "1h", levels=("warn",)).since == datetime(2024, 1, 1, 23)
    assert LogQuery.from_explorer(now, levels=("debug", "info", "warn", "error")).levels == ()
    assert LogQuery.from_explorer(now).since is None


def test_patterns():
    assert substring_pattern("a_b%") == "%a_b%%"
    assert substring_pattern(r"a\x") == "%ax%"
    assert substring_pattern("z\\") == "%z\\%"
    assert substring_pattern(r"\%\_\\") == r"%\%\_\\%"


@pytest.mark.parametrize("text, value", [
    ("2024-01-01", datetime(2024, 1, 1)), ("2024-01-01T00:00:10+02:00", datetime(2023, 12, 31, 22, 0, 10)),
    ("2024-01-01T00:00:00.1234567Z", datetime(2024, 1, 1, 0, 0, 0, 123456)), ("2024-02-30", None), ("12:30", None), (5, None),
])
def test_iso(text, value):
    assert parse_iso(text) == value
