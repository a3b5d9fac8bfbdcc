"""Windows that are final once the watermark has passed, and amendments for what comes later."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cinderlog.operators.rollup import compacted
from cinderlog.schemas import LOGS
from cinderlog.streaming.windows import WindowJob, amendments, final_windows, open_windows, watermark

from .conftest import log_row

T0 = datetime(2024, 3, 1)


def batch(spark, *minutes):
    return spark.createDataFrame([log_row(i, T0 + timedelta(minutes=m)) for i, m in enumerate(minutes)], LOGS)


def seen(df):
    return {(r["bucket_start"] - T0) // timedelta(minutes=1): r["count"] for r in df.collect()}


@pytest.fixture
def job(store):
    return WindowJob(store, 4, 10, timedelta(minutes=15))


def test_late_rows_amend_final_windows(spark, store, job):
    job(batch(spark, 1, 2, 11), 0)
    assert watermark(store, 4) == T0 - timedelta(minutes=4)
    job(batch(spark, 3, 35), 1)
    # The watermark is at 20 minutes: the windows from 0 and from 10 have ended, the latter just now.
    assert seen(final_windows(store, 4, 10)) == {0: 3, 10: 1} and seen(open_windows(store, 4, 10)) == {30: 1}
    final = seen(final_windows(store, 4, 10))
    job(batch(spark, 4, 19, 20, 29), 2)
    assert seen(final_windows(store, 4, 10)) == final
    assert seen(amendments(store, 4)) == {0: 1, 10: 1} and seen(open_windows(store, 4, 10)) == {20: 2, 30: 1}
    # The watermark never goes back, not even without rows.
    job(spark.createDataFrame([], LOGS), 3)
    assert watermark(store, 4) == T0 + timedelta(minutes=20)
    job(batch(spark, 5), 4)
    assert seen(amendments(store, 4)) == {0: 2, 10: 1}


def test_replays_split_rows_as_before(spark, store, job):
    batches = [batch(spark, 1, 40), batch(spark, 2, 100), batch(spark, 3, 41, 99)]
    for epoch, rows in enumerate(batches):
        job(rows, epoch)
    before = [seen(final_windows(store, 4, 10)), seen(open_windows(store, 4, 10)), seen(amendments(store, 4))]
    job(batches[1], 1)
    job(batches[2], 2)
    assert before == [seen(final_windows(store, 4, 10)), seen(open_windows(store, 4, 10)), seen(amendments(store, 4))]


def test_nothing_is_lost_and_streams_are_apart(spark, store, sample_df):
    job, other = (WindowJob(store, number, 60, timedelta(hours=2)) for number in (1, 2))
    for epoch in range(6):
        job(sample_df.where(F.pmod(F.xxhash64("id"), F.lit(6)) == epoch), epoch)
    other(sample_df.where("id < 100"), 0)
    parts = [final_windows(store, 1, 60), open_windows(store, 1, 60), amendments(store, 1)]
    assert all(part.count() for part in parts)
    whole = compacted(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    raw = sample_df.groupBy(F.date_trunc("hour", "timestamp").alias("bucket_start"), "service", "level").count()
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, raw.collect()))
    assert amendments(store, 2).count() == 0
