"""Roll-up levels, sketches and pages by number."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cinderlog.operators import measures as ms
from cinderlog.operators.aggregate import aggregate_raw
from cinderlog.operators.pages import numbered_page, search_offset
from cinderlog.operators.rollup import build_rollup, compacted
from cinderlog.plans.cursor import Cursor
from cinderlog.plans.spec import AggSpec, LogQuery
from cinderlog.schemas import LOGS
from cinderlog.sources.tables import LEVELLED, LogStore

from .conftest import log_row

EPOCH = datetime(1970, 1, 1)


@pytest.mark.parametrize("seed", range(30))
def test_cover_is_the_range_in_aligned_stretches(seed):
    draw = random.Random(seed)
    since = datetime(2023, 12, 20) + timedelta(seconds=draw.randrange(3_000_000))
    until = since + timedelta(seconds=draw.choice([1, 40, 4000, 90_000, 40_000_000]))
    for coarsest in (1, 5, 60, 1440):
        stretches = ms.COUNTS.cover(since, until, coarsest)
        assert stretches[0][1] == since.replace(second=0) and ms.ceil_to(until, 1) == stretches[-1][2]
        assert all(a[2] == b[1] for a, b in zip(stretches, stretches[1:]))
        for minutes, low, high in stretches:
            assert minutes <= coarsest and (low - EPOCH) % timedelta(minutes=minutes) == (high - EPOCH) % timedelta(minutes=minutes) == timedelta(0)
        if coarsest == 1440:
            assert sum((high - low) // timedelta(minutes=minutes) for minutes, low, high in stretches) <= (until - since).days + 2 * (60 + 24) + 2
    assert ms.COUNTS.cover(None, None) == [(1440, None, None)]


def spread_logs(spark, days, per_day, seed=1):
    draw = random.Random(seed)
    rows = [
        log_row(day * per_day + i, datetime(2023, 11, 10) + timedelta(days=day, seconds=draw.randrange(86_400)), draw.choice(["info", "error"]), draw.choice(["a", "b", "c"]))
        for day in range(days) for i in range(per_day)
    ]
    return spark.createDataFrame(rows, LOGS)


def levels_of(store, measure=ms.COUNTS):
    """Whether each level holds what the finest one does."""
    base = store._compactions(measure)[-1]
    finest = measure.merged(store._compacted(base, measure=measure))
    for minutes in measure.levels[1:]:
        level = store._compacted(base, measure=measure, minutes=minutes).select(*measure.schema.names)
        assert sorted(map(tuple, level.collect())) == sorted(map(tuple, measure.merged(finest, minutes).select(*measure.schema.names).collect()))


def test_compaction_keeps_all_levels_equal(spark, store):
    logs = spread_logs(spark, 70, 12).cache()
    for epoch in range(3):
        store.append_rollup(build_rollup(logs.where(F.pmod("id", F.lit(3)) == epoch)), epoch)
        store.compact_rollup()
        levels_of(store)
    store.append_rollup(build_rollup(logs.where("id < 40")), 3)
    store.compact_rollup()
    levels_of(store)
    store.compact_rollup(drop_before=datetime(2023, 12, 5, 7, 30))
    levels_of(store)
    assert store.rollup().agg(F.min("bucket_start")).first()[0] >= datetime(2023, 12, 5, 7, 30)
    cover = store.rollup_cover(None, None)
    assert cover.agg(F.sum("count")).first() == store.rollup().agg(F.sum("count")).first()
    # A cutoff that leaves nothing of its day and month.
    store.compact_rollup(drop_before=datetime(2023, 12, 31, 23, 59, 59))
    levels_of(store)
    assert store.rollup_cover(None, datetime(2024, 1, 1)).count() == 0


def test_levels_are_made_up_for_an_older_compaction(spark, store):
    logs = spread_logs(spark, 50, 5).cache()
    store.append_rollup(build_rollup(logs.where("id % 2 = 0")), 0)
    store.compact_rollup()
    store._drop(store.path("compact_60"))
    store._drop(store.path("compact_1440"))
    store._drop(f"{store.path('compact')}/generation=0/{LEVELLED}")
    assert store.rollup_cover(None, None).agg(F.sum("count")).first()[0] == logs.where("id % 2 = 0").count()
    store.append_rollup(build_rollup(logs.where("id = 1")), 1)
    store.compact_rollup()
    levels_of(store)
    assert store.rollup_cover(None, None).agg(F.sum("count")).first()[0] == logs.where("id % 2 = 0 or id = 1").count()


def test_a_year_is_read_by_days(spark, store):
    logs = spread_logs(spark, 366, 10).cache()
    store.append_logs(logs, 0)
    store.append_rollup(build_rollup(logs.where("id % 5 > 0")), 0)
    store.compact_rollup()
    store.append_rollup(build_rollup(logs.where("id % 5 = 0")), 1)
    since, until = datetime(2023, 11, 12, 10, 20, 30), datetime(2024, 11, 3, 3, 4, 5)
    for bucket, exact in (("1d", False), ("1d", True), ("1h", False), ("5m", True)):
        spec = AggSpec(since, until, bucket, group_by="service")
        wanted = spec if exact else AggSpec(since.replace(second=0), until.replace(second=0) + timedelta(minutes=1), bucket, group_by="service")
        found = sorted(map(tuple, store.aggregate(spec, exact).collect()))
        assert found == sorted(map(tuple, aggregate_raw(logs, wanted).collect()))
    compact = store.rollup_cover(since, until, 1440).where("count > 0")
    pending = store.rollup_cover(since, until, 1440).join(store._deltas(store._pending(store._compactions()[-1])), ["bucket_start", "service", "level"], "left_semi")
    assert compact.count() - pending.count() <= 2 * 3 * (357 + 2 * (24 + 60))
    assert not any("compact/" in name and "log_date=2024-05" in name for name in compact.inputFiles())
    assert any("compact_1440/" in name for name in compact.inputFiles())


@pytest.fixture(scope="module")
def dense(spark):
    """A month with a crowded minute and a crowded instant in it."""
    draw = random.Random(7)
    start = datetime(2024, 3, 1)
    rows = [log_row(i, start + timedelta(minutes=draw.randrange(40_000)), service=draw.choice("ab")) for i in range(600)]
    rows += [log_row(1000 + i, start + timedelta(days=9, microseconds=draw.randrange(60_000_000)), service="a") for i in range(900)]
    rows += [log_row(5000 + 7 * i, start + timedelta(days=9, seconds=30), service="a", message=f"odd {i % 2}") for i in range(1500)]
    return spark.createDataFrame(rows, LOGS).cache(), sorted(rows, key=lambda r: (r[1], r[0]), reverse=True)


@pytest.mark.parametrize("query, keep", [
    (LogQuery(limit=40), lambda r: True),
    (LogQuery(limit=7, service="a", since=datetime(2024, 3, 2, 1, 1, 1), until=datetime(2024, 3, 20, 2, 2, 2)), lambda r: r[3] == "a" and datetime(2024, 3, 2, 1, 1, 1) <= r[1] < datetime(2024, 3, 20, 2, 2, 2)),
    (LogQuery(limit=25, q="odd 1"), lambda r: r[4] == "odd 1"),
])
@pytest.mark.parametrize("rolled", [True, False])
def test_deep_pages_equal_brute_force(dense, query, keep, rolled):
    logs, rows = dense
    wanted = [r[0] for r in rows if keep(r)]
    rollup = build_rollup(logs) if rolled else None
    draw = random.Random(3)
    last = len(wanted) // query.limit + 1
    for page in {last, last + 1, draw.randrange(1, last + 1), draw.randrange(1, last + 1)}:
        found = [r.id for r in search_offset(logs, query, page, rollup, shallow=10).collect()]
        assert found == wanted[(page - 1) * query.limit : page * query.limit], page


def test_page_numbers_are_checked(dense):
    logs, _ = dense
    with pytest.raises(ValueError, match="at least 1"):
        search_offset(logs, LogQuery(), 0)
    with pytest.raises(ValueError, match="not both"):
        search_offset(logs, LogQuery(cursor=Cursor(EPOCH, 1)), 2)
    assert search_offset(logs, LogQuery(since=datetime(2030, 1, 1)), 10**9).collect() == []


def test_a_stored_page_opens_its_days_only(spark, dense, store):
    logs, rows = dense
    store.append_logs(logs, 0)
    store.append_rollup(build_rollup(logs), 0)
    store.compact_rollup()
    page = numbered_page(store.logs, store.rollup_cover, LogQuery(limit=20), 8, shallow=5)
    assert [r.id for r in page.collect()] == [r[0] for r in rows[140:160]]
    days = {r[1].date() for r in rows[140:160]}
    assert {date.fromisoformat(name.split("log_date=")[1][:10]) for name in page.inputFiles()} == days
    assert store.page(LogQuery(limit=20), 8).count() == 20


def durations(spark, rows, seed):
    draw = random.Random(seed)
    data = [(i, datetime(2024, 3, 1) + timedelta(minutes=draw.randrange(4000)), draw.choice("ab"), draw.choice([draw.gauss(100, 20), draw.expovariate(0.01), None, float("nan")])) for i in range(rows)]
    return spark.createDataFrame(data, "id long, timestamp timestamp, service string, took double")


def test_latency_sketches_keep_their_bound(spark, store):
    logs = durations(spark, 20_000, 1).cache()
    for epoch in range(3):
        store.append_rollup(ms.latency_rollup(logs.where(F.pmod("id", F.lit(3)) == epoch), F.col("took")), epoch, epoch % 2, ms.LATENCY)
        if epoch < 2:
            store.compact_all()
    since, until = datetime(2024, 3, 1, 3), datetime(2024, 3, 3, 7)
    plain = logs.where((F.col("timestamp") >= F.lit(since)) & (F.col("timestamp") < F.lit(until)) & F.col("took").isNotNull() & ~F.isnan("took"))
    for _ in range(2):
        for r in store.latency(since, until).collect():
            values = sorted(x.took for x in plain.where(F.col("service") == r.service).collect())
            assert r.n == len(values)
            assert abs(sum(v <= r.latency for v in values) / len(values) - 0.99) <= ms.RANK_ERROR + 1 / len(values)
        store.compact_all()
    assert not any(name.startswith("logs") for name in store._names(store.root))
    assert store.latency(datetime(2030, 1, 1), datetime(2030, 2, 1)).collect() == []


def test_distinct_sketches_of_streams_are_those_of_one(spark, store, tmp_path):
    logs = durations(spark, 6000, 2).withColumn("user", F.col("id") % 1700).cache()
    fields = {"service": F.col("service"), "user": F.col("user"), "none": F.lit(None)}
    one = LogStore(spark, str(tmp_path / "one"))
    one.append_rollup(ms.distinct_rollup(logs, fields), 0, 0, ms.DISTINCT)
    for stream in range(3):
        store.append_rollup(ms.distinct_rollup(logs.where(F.pmod("id", F.lit(3)) == stream), fields), 0, stream, ms.DISTINCT)
        store.compact_all()
    found = [{r.field: r.estimate for r in ms.distinct_estimates(s.rollup_cover(None, None, measure=ms.DISTINCT)).collect()} for s in (one, store)]
    assert set(found[0]) == set(found[1]) == {"service", "user"} and found[0]["service"] == found[1]["service"] == 2
    assert all(abs(f["user"] - 1700) <= 4 * ms.DISTINCT_ERROR * 1700 for f in found)
    assert abs(found[0]["user"] - found[1]["user"]) <= 2 * ms.DISTINCT_ERROR * 1700
    assert compacted(store.rollup()).count() == 0
