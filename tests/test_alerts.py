from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cinderlog.functions.times import epoch_minute
from cinderlog.operators import alerts as a
from cinderlog.operators import notifications as n
from cinderlog.operators.rollup import build_rollup
from cinderlog.operators.replay import replay_alerts, sliding_counts
from cinderlog.schemas import LOGS, RULES

NOW = datetime(2024, 3, 5, 12, 0, 30)


def rules_df(spark, *rows):
    return spark.createDataFrame(rows, RULES)


def errors_df(spark, moments, service="auth"):
    return spark.createDataFrame([(i, t, "error", service, "m", None) for i, t in enumerate(moments)], LOGS)


def counted(df):
    return {r["id"]: r["errors"] for r in df.collect()}


def test_counts_at_the_window_edges(spark):
    us = timedelta(microseconds=1)
    hour = timedelta(minutes=60)
    logs = errors_df(spark, [NOW - hour - us, NOW - hour, NOW - hour + us, NOW - timedelta(minutes=1), NOW, NOW + us, NOW + timedelta(minutes=4)])
    rules = rules_df(
        spark, (1, None, 1, 60, "u", None), (2, "auth", 1, 61, "u", None), (3, "auth", 1, 1, "u", None), (4, "nobody", 1, 60, "u", None),
        (5, "", 1, 60, "u", None), (6, "auth", 1, 60, "u", None),
    )
    assert counted(a.alert_counts(logs, rules, NOW)) == {1: 6, 2: 7, 3: 4, 4: 0, 5: 6, 6: 6}


def test_counts_match_brute_force(spark, sample, sample_df):
    as_of = datetime(2024, 3, 4, 7, 7, 7)
    rules = [(i, s, 1, w, "u", None) for i, (s, w) in enumerate((s, w) for s in ("hot", "auth", None, "nobody") for w in (1, 17, 600, 5000, 20000))]
    want = {
        i: sum(r[2] == "error" and r[1] >= as_of - timedelta(minutes=w) and s in (None, r[3]) for r in sample)
        for i, s, _, w, _, _ in rules
    }
    assert counted(a.alert_counts(sample_df, rules_df(spark, *rules), as_of)) == want


def test_counts_on_the_stored_table(spark, stored, sample_df):
    as_of = datetime(2024, 3, 4, 7, 7, 7)
    rules = rules_df(spark, (1, "hot", 1, 100, "u", None), (2, None, 1, 1000, "u", None))
    assert counted(a.alert_counts(stored.logs(), rules, as_of)) == counted(a.alert_counts(sample_df, rules, as_of))


def test_cooldown_boundary_and_threshold(spark):
    logs = errors_df(spark, [NOW] * 3)
    minute = timedelta(minutes=1)
    rules = rules_df(
        spark, (1, None, 3, 60, "u", None), (2, None, 4, 60, "u", None), (3, None, 3, 60, "u", NOW - 9.99 * minute),
        (4, None, 3, 60, "u", NOW - 10 * minute), (5, "nobody", 0, 60, "u", None), (6, "nobody", -1, 60, "u", None),
    )
    firing = a.alerts_firing(logs, rules, NOW)
    assert set(counted(firing)) == {1, 4, 5, 6}
    after = {r["id"]: r["last_triggered_at"] for r in a.rules_after(rules, firing, NOW).collect()}
    assert after[1] == after[4] == NOW and after[2] is None and after[3] == NOW - 9.99 * minute
    notes = {r["title"]: r["message"] for r in n.alert_notifications(firing, NOW).collect()}
    assert notes["Alert: all"] == "3 errors in 60 min (threshold: 3)"


def test_rule_check(spark):
    rules = rules_df(
        spark, (1, "", 1, 60, "u", None), (2, None, 0, 60, "u", None), (3, None, 1, None, "u", None), (4, None, 1, 60, "", None), (5, "x", -1, 60, "u", None),
    )
    kept = {r["id"]: r["service"] for r in a.valid_rules(rules).collect()}
    assert kept == {1: None, 5: "x"}
    assert [r["id"] for r in a.list_rules(rules).collect()] == [5, 4, 3, 2, 1]


def brute_replay(errors, rules, start, end):
    """Look at every minute, one rule at a time."""
    counts = Counter((s, epoch_minute(t)) for s, t in errors)
    fired = set()
    for rule_id, service, threshold, window, _, _ in rules:
        last = None
        for tick in range(epoch_minute(start) + 1, epoch_minute(end) + 1):
            seen = sum(c for (s, m), c in counts.items() if tick - window <= m < tick and service in (None, s))
            if seen >= threshold and (last is None or tick - last >= 10):
                fired.add((rule_id, datetime(1970, 1, 1) + timedelta(minutes=tick), seen))
                last = tick
    return fired


@pytest.mark.parametrize("as_of", [datetime(2024, 3, 3, 7, 0), datetime(2024, 3, 3, 7, 0, 23, 500_000), datetime(2024, 3, 2, 0, 0, 0, 1)])
def test_counts_from_the_rollup_are_those_from_raw_rows(spark, sample_df, stored, as_of):
    windows = (1, 2, 7, 60, 1440, 5000)
    rules = rules_df(spark, *[(i, s, 1, w, "u", None) for i, (s, w) in enumerate((s, w) for s in (None, "hot", "nobody") for w in windows)])
    counts = lambda df: {r["id"]: r["errors"] for r in df.collect()}
    raw = counts(a.alert_counts(sample_df, rules, as_of))
    assert counts(a.alert_counts(stored.logs(), rules, as_of, build_rollup(sample_df))) == raw
    plan = a.alert_counts(stored.logs(), rules, as_of, build_rollup(sample_df))._jdf.queryExecution().executedPlan().toString()
    assert ("log_date" in plan) == (as_of.second + as_of.microsecond > 0)


@pytest.mark.parametrize("start, end", [
    (datetime(2024, 3, 1, 21), datetime(2024, 3, 2, 4)), (datetime(2024, 3, 2), datetime(2024, 3, 3)), (datetime(2024, 3, 1, 23, 55), datetime(2024, 3, 2, 0, 5)),
])
def test_replay_matches_a_minute_by_minute_loop(spark, start, end):
    base = datetime(2024, 3, 1, 20)
    moments = [("auth", base + timedelta(seconds=(i * i * 7) % 30000)) for i in range(60)] + [("hot", base + timedelta(minutes=236 + i)) for i in range(0, 9)]
    rows = [(i, t, "error", s, "m", None) for i, (s, t) in enumerate(moments)] + [(99, base, "info", "auth", "m", None)]
    rules = [
        (i, s, threshold, w, "u", None)
        for i, (s, threshold, w) in enumerate((s, t, w) for s in (None, "auth", "hot", "nobody") for t in (-1, 1, 2, 5) for w in (1, 7, 90, 3000))
    ]
    logs, rules_frame = spark.createDataFrame(rows, LOGS), rules_df(spark, *rules)
    got = replay_alerts(logs, rules_frame, start, end).collect()
    assert sorted(got) == sorted(replay_alerts(build_rollup(logs), rules_frame, start, end).collect())
    assert len(got) == len({tuple(r) for r in got})
    assert {(r["rule_id"], r["fired_at"], r["errors"]) for r in got} == brute_replay(moments, rules, start, end)


def test_replay_begins_with_the_rest_of_a_cooldown(spark):
    start, end = datetime(2024, 3, 1, 21), datetime(2024, 3, 1, 21, 40)
    logs = errors_df(spark, [datetime(2024, 3, 1, 20, 30)])
    ago = [None, 25, 10, 5, 4.5, 0, -3]
    rules = rules_df(spark, *[(i, None, 1, 600, "u", None if m is None else start - timedelta(minutes=m)) for i, m in enumerate(ago)])
    first = {r["rule_id"]: r["m"] for r in replay_alerts(logs, rules, start, end).groupBy("rule_id").agg(F.min("fired_at").alias("m")).collect()}
    wait = {i: 1 for i in (0, 1, 2, 6)} | {3: 5, 4: 6, 5: 10}
    assert first == {i: start + timedelta(minutes=m) for i, m in wait.items()}


def test_sliding_counts_cover_every_tick_once(spark):
    start, end = datetime(2024, 3, 1, 22), datetime(2024, 3, 3, 1)
    logs = errors_df(spark, [start + timedelta(minutes=5 * i) for i in range(20)])
    rules = rules_df(spark, (1, None, 1, 30, "u", None), (2, "auth", 1, 2000, "u", None))
    spans = sliding_counts(logs, rules, start, end).orderBy("window_minutes", "tick_from").collect()
    for window in (30, 2000):
        mine = [s for s in spans if s["window_minutes"] == window]
        assert mine[0]["tick_from"] == epoch_minute(start) + 1 and mine[-1]["tick_to"] == epoch_minute(end) + 1
        assert all(x["tick_to"] == y["tick_from"] for x, y in zip(mine, mine[1:]))


def test_notifications(spark):
    t = datetime(2024, 1, 1)
    rows = [(i, "alert", "t", "m", None, None, i % 3 == 0, t + timedelta(hours=i % 5)) for i in range(120)]
    frame = spark.createDataFrame(rows, "id long, type string, title string, message string, service string, level string, is_read boolean, created_at timestamp")
    shown = [r["id"] for r in n.feed(frame).collect()]
    assert shown == [r[0] for r in sorted(rows, key=lambda r: (r[6], -r[7].timestamp(), -r[0]))][:50]
    assert n.unread_count(frame).first()["count"] == 80
    seen = n.with_read_state(frame, frame.where("id in (1, 2)").union(frame.where("id = 1")).select("id"), t + timedelta(hours=1))
    assert seen.count() == 120
    want = {r[0] for r in rows if r[6] or r[0] in (1, 2) or r[7] <= t + timedelta(hours=1)}
    assert {r["id"] for r in seen.where("is_read").collect()} == want


def test_replay_of_no_rules(spark, sample_df):
    assert replay_alerts(sample_df, rules_df(spark, *[]), datetime(2024, 3, 1), datetime(2024, 3, 2)).count() == 0
