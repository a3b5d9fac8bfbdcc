import re
from datetime import datetime

import pytest

from cinderlog.operators.pages import search_offset
from cinderlog.operators.search import filter_logs, log_detail, newest, next_cursor, pages, search, total
from cinderlog.plans.cursor import Cursor
from cinderlog.plans.spec import LogQuery


def expected(sample, keep=lambda r: True):
    return [r[0] for r in sorted(filter(keep, sample), key=lambda r: (r[1], r[0]), reverse=True)]


def ids(df):
    return [r["id"] for r in df.collect()]


@pytest.mark.parametrize("limit", [37, 100, 650])
def test_pages_hold_every_row_once(sample, sample_df, limit):
    walked = list(pages(sample_df, LogQuery(limit=limit)))
    assert [r["id"] for page in walked for r in page] == expected(sample)
    # An exact multiple ends with an empty page.
    assert len(walked) == len(sample) // limit + 1


def test_pages_of_a_filtered_search(sample, sample_df):
    query = LogQuery(service="hot", levels=("error", "info"), limit=50)
    walked = [r["id"] for page in pages(sample_df, query) for r in page]
    assert walked == expected(sample, lambda r: r[3] == "hot" and r[2] in ("error", "info"))


def test_cursor_only_behind_full_pages(sample, sample_df):
    page = search(sample_df, LogQuery(limit=10))
    row = next_cursor(page, 10).first()
    last = page.collect()[-1]
    assert Cursor.decode(row["next_cursor"]) == Cursor(last["timestamp"], last["id"])
    assert next_cursor(search(sample_df, LogQuery(service="nobody")), 100).first()["next_cursor"] is None


def test_offset_pages_and_total(sample, sample_df):
    query = LogQuery(limit=100)
    assert ids(search_offset(sample_df, query, 2)) == expected(sample)[100:200]
    assert total(sample_df, query).first()["total"] == len(sample)
    with pytest.raises(ValueError):
        search_offset(sample_df, query, 0)


@pytest.mark.parametrize("q, pattern", [
    ("REQUEST 1_", r"request 1."), ("took_3", r"took.3"), ("1%00%", r"1.*00"), ("at\\x", None), (r"100\%", r"100%"),
    (r"took\_4", r"took_4"), ("z\\", None), ("ook\\_", r"ook_"),
])
def test_text_search(sample, sample_df, q, pattern):
    found = set(ids(filter_logs(sample_df, LogQuery(q=q))))
    keep = (lambda r: re.search(pattern, r[4], re.I)) if pattern else (lambda r: False)
    assert found == set(expected(sample, keep))


def test_attribute_search(sample, sample_df):
    found = set(ids(filter_logs(sample_df, LogQuery(attributes={"a.b": "x", "k": "3"}))))
    assert found == set(expected(sample, lambda r: r[5] and r[5]["k"] == "3"))
    assert ids(filter_logs(sample_df, LogQuery(attributes={"nokey": "3"}))) == []


def test_time_bounds_are_half_open(sample, sample_df):
    since, until = sample[30][1], sample[300][1]
    found = set(ids(filter_logs(sample_df, LogQuery(since=since, until=until))))
    assert found == set(expected(sample, lambda r: since <= r[1] < until))


def test_stored_table_gives_the_same(sample, stored):
    query = LogQuery(since=datetime(2024, 3, 2, 5), until=datetime(2024, 3, 4), levels=("warn",), limit=1000)
    assert ids(search(stored.logs(), query)) == expected(sample, lambda r: query.since <= r[1] < query.until and r[2] == "warn")


@pytest.mark.parametrize("query", [
    LogQuery(limit=5), LogQuery(limit=1000), LogQuery(service="mail", limit=100), LogQuery(service="nobody"),
    LogQuery(until=datetime(2024, 3, 2, 12), limit=20), LogQuery(cursor=Cursor(datetime(2024, 3, 3), 5), limit=300),
    LogQuery(since=datetime(2024, 3, 2), limit=20),
])
def test_newest_first_walk(stored, query):
    assert ids(newest(stored.logs(), query, stored.log_days())) == ids(search(stored.logs(), query))


def plan(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", 5000)
    return df._jdf.queryExecution().executedPlan().toString()


def test_range_and_cursor_prune_and_push_down(stored):
    query = LogQuery(service="auth", since=datetime(2024, 3, 2, 5), until=datetime(2024, 3, 3), cursor=Cursor(datetime(2024, 3, 2, 20), 9))
    text = plan(search(stored.logs(), query))
    assert "TakeOrderedAndProject" in text and "Sort [" not in text
    assert re.search(r"PartitionFilters: \[.*log_date.* >= 2024-03-02", text)
    assert re.search(r"PartitionFilters: \[.*log_date#\d+ <= 2024-03-02\b", text)
    pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", text).group(1)
    for part in ("EqualTo(service,auth)", "GreaterThanOrEqual(timestamp", "LessThan(timestamp", "Or(LessThan(timestamp"):
        assert part in pushed


def test_only_needed_columns_are_read(stored):
    text = plan(total(stored.logs(), LogQuery(service="auth")))
    assert re.search(r"ReadSchema: struct<service:string>", text)


def test_detail(sample_df):
    row = log_detail(sample_df.where("id = 4")).first()
    assert (row["time"], row["level"], row["attributes"]) == ("2024-03-01 00:16:37.000", "DEBUG", '{"a.b":"x","k":"4"}')


def test_pages_of_one_row_with_equal_timestamps(sample_df):
    walked = pages(sample_df.where("id < 6"), LogQuery(limit=1))
    assert [page[0]["id"] for page in walked if page] == [5, 4, 3, 2, 1, 0]
