from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from cinderlog.operators import metrics as m
from cinderlog.operators.aggregate import aggregate, aggregate_exact, aggregate_raw, aggregate_rollup, aggregate_with_pending
from cinderlog.operators.quantile import exact_quantile, histogram
from cinderlog.operators.rollup import build_rollup, compacted, merge_deltas, reconcile
from cinderlog.plans.spec import AggSpec
from cinderlog.schemas import BUCKETS

ALIGNED = (datetime(2024, 3, 1, 6), datetime(2024, 3, 3, 6))
ODD = (datetime(2024, 3, 1, 6, 0, 30), datetime(2024, 3, 3, 6, 0, 30))
EPOCH = datetime(1970, 1, 1)


def brute(sample, spec, since, until):
    width = timedelta(minutes=BUCKETS[spec.bucket])
    column = {"service": 3, "level": 2, None: None}[spec.group_by]
    counts = Counter()
    for r in sample:
        if since <= r[1] < until and spec.service in (None, r[3]) and spec.level in (None, r[2]):
            start = EPOCH + (r[1] - EPOCH) // width * width
            counts[start, r[column] if column else None] += 1
    return counts


def found(df):
    return Counter({(r["start"], r["group"]): r["count"] for r in df.collect()})


@pytest.fixture(scope="module")
def rollup(sample_df):
    return compacted(build_rollup(sample_df)).persist()


@pytest.mark.parametrize("bucket", list(BUCKETS))
@pytest.mark.parametrize("filters", [{}, {"group_by": "service"}, {"group_by": "level", "service": "hot"}, {"level": "error"}])
def test_raw_and_rollup_agree_on_whole_minutes(sample, sample_df, rollup, bucket, filters):
    spec = AggSpec(*ALIGNED, bucket, **filters)
    want = brute(sample, spec, *ALIGNED)
    assert found(aggregate_raw(sample_df, spec)) == want
    assert found(aggregate_rollup(rollup, spec)) == want


def test_edges_off_the_minute(spark, sample):
    from cinderlog.schemas import LOGS
    from tests.conftest import log_row

    rows = sample + [
        log_row(5000 + i, edge + timedelta(seconds=s)) for edge in ODD for i, s in enumerate((-29, -1, 0, 1, 29, 31))
    ]
    logs = spark.createDataFrame(rows, LOGS)
    rollup = build_rollup(logs)
    for spec in (AggSpec(*ODD, "1h", group_by="service"), AggSpec(*ODD, "1m")):
        # The roll-up counts whole minutes: the lower edge rounds down, the upper one up.
        minute_edges = datetime(2024, 3, 1, 6), datetime(2024, 3, 3, 6, 1)
        assert found(aggregate_rollup(rollup, spec)) == brute(rows, spec, *minute_edges)
        assert found(aggregate_exact(logs, rollup, spec)) == brute(rows, spec, *ODD)
    inside = AggSpec(ODD[0], ODD[0] + timedelta(seconds=20), "1m")
    assert found(aggregate_exact(logs, rollup, inside)) == brute(rows, inside, inside.since, inside.until)
    half = AggSpec(ODD[0], ALIGNED[1], "1h")
    assert found(aggregate_exact(logs, rollup, half)) == brute(rows, half, half.since, half.until)


def test_text_and_attributes_go_to_raw_rows(sample, sample_df, rollup):
    spec = AggSpec(*ALIGNED, "1d", q="took_3")
    want = brute([r for r in sample if "took_3" in r[4]], spec, *ALIGNED)
    assert found(aggregate(sample_df, rollup, spec)) == want
    with pytest.raises(ValueError):
        aggregate_rollup(rollup, spec)
    ordered = [r["start"] for r in aggregate(sample_df, rollup, AggSpec(*ALIGNED, "1h", group_by="level")).collect()]
    assert ordered == sorted(ordered)


def test_pending_deltas_count(sample, sample_df):
    flushed, pending = (build_rollup(sample_df.where(f"id % 2 = {i}")) for i in (0, 1))
    spec = AggSpec(*ALIGNED, "1h", group_by="service")
    assert found(aggregate_with_pending(flushed, pending, spec)) == brute(sample, spec, *ALIGNED)
    assert compacted(merge_deltas(flushed, pending)).agg(F.sum("count")).first()[0] == len(sample)
    missing = reconcile(sample_df, flushed).agg(F.sum("missing")).first()[0]
    assert missing == sum(r[0] % 2 for r in sample)
    assert reconcile(sample_df, merge_deltas(flushed, pending)).where("missing <> 0").count() == 0


def test_rows_before_1970_round_down(spark):
    rows = [(1, datetime(1969, 12, 31, 23, 59, 30), "info", "a", "m", None)]
    from cinderlog.schemas import LOGS

    assert build_rollup(spark.createDataFrame(rows, LOGS)).first()["bucket_start"] == datetime(1969, 12, 31, 23, 59)


def values_for(kind, rng):
    return {
        "hot": rng.exponential(100, 5000), "same": np.full(300, 7.25), "one": np.array([3.5]), "two": np.array([1.0, 2.0]),
        "signed": rng.normal(0, 5, 900), "zeros": np.concatenate([np.zeros(500), rng.random(4)]),
        "tight": 1000 + rng.random(700) * 1e-9, "wide": 10 ** rng.uniform(-12, 12, 600),
    }[kind]


@pytest.mark.parametrize("p", [0.0, 0.5, 0.99, 1.0])
def test_exact_quantile(spark, p):
    rng = np.random.default_rng(5)
    groups = {k: values_for(k, rng) for k in ("hot", "same", "one", "two", "signed", "zeros", "tight", "wide")}
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("hot", None), ("empty", None)]
    frame = spark.createDataFrame(rows, "g string, x double")
    got = exact_quantile(frame, histogram(frame, "g", "x"), "g", "x", p, "q").collect()
    assert {r["g"]: r["q"] for r in got} == pytest.approx({g: np.quantile(xs, p) for g, xs in groups.items()}, rel=1e-12)


@pytest.mark.parametrize("p", [0.0, 0.3, 0.5, 0.9, 1.0])
def test_quantile_of_nan_and_infinity_is_that_of_percentile(spark, p):
    inf, nan = float("inf"), float("nan")
    groups = {
        "nan": [1, 2, 3, 50, nan], "nans": [nan] * 7, "inf": [1, 2, inf], "infs": [inf, inf, 3, -inf], "both": [-inf, 0, inf, nan],
        "same": [4.0] * 900 + [5, -inf], "none": [None, None],
    }
    frame = spark.createDataFrame([(g, None if x is None else float(x)) for g, xs in groups.items() for x in xs], "g string, x double")
    got = {r["g"]: repr(r["q"]) for r in exact_quantile(frame, histogram(frame, "g", "x"), "g", "x", p, "q").collect()}
    built_in = frame.where("x is not null").groupBy("g").agg(F.percentile("x", F.lit(p)).alias("q")).collect()
    assert got == {r["g"]: repr(r["q"]) for r in built_in}


def test_summary(spark):
    rows = [("ok", "info", 1.0)] * 200 + [("ok", "error", 5.0)] + [("bad", "error", 2.0)] * 3 + [("bad", "info", None)] * 97 + [("warm", "error", 1.0), ("warm", "info", 1.0)] + [("warm", "info", 1.0)] * 98
    logs = spark.createDataFrame(rows, "service string, level string, duration_ms double")
    summary = {r["service"]: r for r in m.service_summary(logs).collect()}
    assert {s: (r["total"], r["error_rate"], r["status"]) for s, r in summary.items()} == {
        "ok": (201, 0.5, "HEALTHY"), "bad": (100, 3.0, "DEGRADED"), "warm": (100, 1.0, "WARNING"),
    }
    approximate = {r["service"]: r["status"] for r in m.service_summary(logs, exact=False).collect()}
    assert approximate == {s: r["status"] for s, r in summary.items()}
    by_status = [r["service"] for r in m.summary_page(m.service_summary(logs), by="status").collect()]
    assert by_status == ["ok", "warm", "bad"]
    assert [r["service"] for r in m.summary_filter(m.service_summary(logs), "GRADED").collect()] == ["bad"]


def test_figures_of_an_empty_table(spark, sample_df):
    nothing = build_rollup(sample_df.where("false"))
    now = datetime(2024, 3, 3)
    assert m.ingest_rate(nothing, now).first()["per_hour"] == 0
    assert m.errors_last_hour(nothing, now).first()["errors"] == 0
    assert m.level_distribution(nothing, now).collect() == []
    assert m.overview(sample_df.where("false")).first()["total_logs"] == 0
    assert '"last_24h_by_level":[]' in m.overview_json(sample_df.where("false"), now).first()["context"]


def test_health_shows_the_first_services(spark):
    now = datetime(2024, 3, 3, 12, 0, 1)
    rows = [(now - timedelta(minutes=50 - i), f"s{i}", "info", count) for i, count in enumerate((99, 100, 499, 500, 1, 1))]
    rollup = spark.createDataFrame(rows, "bucket_start timestamp, service string, level string, count long")
    shown = [(r["service"], r["health"]) for r in m.service_health(rollup, now).collect()]
    assert shown == [("s0", 99.9), ("s1", 95.0), ("s2", 95.0), ("s3", 85.0), ("s4", 99.9)]
