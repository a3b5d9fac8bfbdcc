"""Reconciliation by digests: what the roll-up lost or counted twice is found without reading other days."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from cinderlog.operators import measures as ms
from cinderlog.operators.rollup import build_rollup, minute_differences, reconcile
from cinderlog.schemas import LOGS


def filled(store, rows, lost, twice="false"):
    store.append_logs(rows, 0)
    for epoch in range(2):
        part = rows.where(F.pmod("id", F.lit(2)) == epoch)
        store.append_rollup(ms.digest_rollup(part), epoch, measure=ms.DIGEST)
        store.append_rollup(build_rollup(part.where(f"NOT ({lost})").unionByName(part.where(twice))), epoch)


def as_rows(df):
    return sorted(tuple(r) for r in df.select("bucket_start", "service", "level", "raw_count", "rollup_count", "missing").collect())


def expected(rows, lost, twice="false"):
    counted = build_rollup(rows.where(f"NOT ({lost})").unionByName(rows.where(twice)))
    return as_rows(reconcile(rows, counted, "1 minute").where("missing <> 0"))


@pytest.mark.parametrize("compact", [False, True])
def test_losses_and_repeats_are_found_and_repaired(store, sample_df, compact):
    lost, twice = "id BETWEEN 300 AND 330", "id % 50 = 7 AND id < 200"
    filled(store, sample_df, lost, twice)
    if compact:
        store.compact_all()
    assert as_rows(store.reconcile()) == expected(sample_df, lost, twice) != []
    assert store.repair_rollup() == len(expected(sample_df, lost, twice))
    assert store.reconcile().collect() == [] and store.repair_rollup() == 0
    store.compact_all()
    assert store.reconcile().collect() == []
    assert minute_differences(sample_df, store.rollup()).collect() == []


def test_only_unequal_days_are_opened(store, sample_df, monkeypatch):
    lost = "id = 777"
    filled(store, sample_df, lost)
    store.compact_all()
    day = sample_df.where(lost).first()["timestamp"].date()
    for other in store.log_days():
        if other != day:
            # A day that is opened would fail: its folder holds no readable file any more.
            for name, path in store._log_files([other]).items():
                store._drop(path)
                store._mark(path)
    assert as_rows(store.reconcile()) == expected(sample_df, lost)


def test_one_row_counted_in_a_wrong_minute_or_level(store, spark, sample_df):
    store.append_logs(sample_df, 0)
    store.append_rollup(ms.digest_rollup(sample_df), 0, measure=ms.DIGEST)
    wrong = sample_df.withColumn("level", F.when(F.col("id") == 40, "debugx").otherwise(F.col("level")))
    wrong = wrong.withColumn("timestamp", F.when(F.col("id") == 900, F.col("timestamp") + F.expr("interval 1 minute")).otherwise(F.col("timestamp")))
    store.append_rollup(build_rollup(wrong), 0)
    found = as_rows(store.reconcile())
    assert len(found) == 4 and sorted(r[-1] for r in found) == [-1, -1, 1, 1]


def test_ranges_and_stores_without_digests(store, spark, sample_df):
    store.append_logs(sample_df, 0)
    store.append_rollup(build_rollup(sample_df.where("id <> 5")), 0)
    assert len(as_rows(store.reconcile())) == 1
    assert store.reconcile(datetime(2024, 3, 3, 10, 0, 30), datetime(2024, 3, 4)).collect() == []
    empty = spark.createDataFrame([], LOGS)
    assert ms.digest_rollup(empty).collect() == []
