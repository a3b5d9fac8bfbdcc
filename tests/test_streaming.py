import json
from datetime import date, datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cinderlog.functions.times import literal_like
from cinderlog.operators.rollup import build_rollup, compacted
from cinderlog.operators.validation import accepted, rejected, validate
from cinderlog.schemas import LOGS, RULES
from cinderlog.sources.batches import open_batches, read_bodies
from cinderlog.sources.export import log_rows, write_csv
from cinderlog.sources.synthetic import as_bodies, synthetic_logs
from cinderlog.sources.tables import BLOCK_EPOCHS
from cinderlog.streaming import ingest
from cinderlog.streaming.ingest import IngestJob, ingest_stream
from cinderlog.streaming.jobs import alert_stream, alert_tick, run_retention

NOW = datetime(2024, 2, 1)


def store_logs(store, logs, epoch=0):
    """What an ingest leaves: rows and their counts."""
    store.append_logs(logs, epoch)
    store.append_rollup(build_rollup(logs), epoch)


def land(folder: Path, bodies, first=0):
    folder.mkdir(exist_ok=True)
    for i, body in enumerate(bodies, first):
        (folder / f"{i:05}.json").write_text(body)


def make_bodies(spark, rows=600, size=50):
    good = [r["body"] for r in as_bodies(synthetic_logs(spark, rows, NOW), size).orderBy("batch_id").collect()]
    spoiled = json.loads(good[0])
    spoiled["logs"][1]["level"] = "loud"
    spoiled["logs"][2] = None
    return [json.dumps(spoiled), *good[1:], "{bad", '{"logs":5}', '{"logs":[]}']


def rollup_of(store):
    return {tuple(r) for r in compacted(store.rollup()).collect()}


def rollup_of_logs(store):
    return {tuple(r) for r in build_rollup(store.logs()).collect()}


def test_stream_equals_batch(spark, store, tmp_path):
    landing = tmp_path / "landing"
    land(landing, make_bodies(spark))
    ingest_stream(store, str(landing), store.path("checkpoint"), as_of=NOW, max_files=4).awaitTermination()
    opened = open_batches(read_bodies(spark, str(landing)))
    batch = validate(opened, literal_like(NOW, LOGS["timestamp"].dataType))
    columns = ["timestamp", "level", "service", "message", F.to_json("attributes").alias("attributes")]
    got = sorted(store.logs().select(*columns).collect())
    assert got == sorted(accepted(batch).select(*columns).collect()) and len(got) == 598
    ids = [r["id"] for r in store.logs().select("id").collect()]
    assert len(set(ids)) == len(ids)
    rejects = spark.read.parquet(store.path("rejected")).select("index", "reason").collect()
    assert sorted(rejects) == sorted(rejected(batch).select("index", "reason").collect()) and len(rejects) == 2
    reasons = [r["reason"] for r in spark.read.parquet(store.path("quarantine")).collect()]
    assert sorted(reasons) == ["body must contain a 'logs' array", "malformed JSON"]
    assert rollup_of(store) == rollup_of_logs(store)


def test_bodies_as_lines(spark, store, tmp_path):
    landing, bodies = tmp_path / "landing", make_bodies(spark, 200)
    land(landing, ["\n".join(bodies[:2]), "\r\n".join(["", *bodies[2:], "  "])])
    ingest_stream(store, str(landing), store.path("checkpoint"), as_of=NOW, lines=True).awaitTermination()
    assert store.logs().count() == 198 == store.logs().select("id").distinct().count()
    reasons = {Path(r["source_file"]).name: r["reason"] for r in spark.read.parquet(store.path("quarantine")).collect()}
    assert reasons == {"00001.json#4": "malformed JSON", "00001.json#5": "body must contain a 'logs' array"}


def test_lines_keep_their_numbers_when_files_are_read_in_blocks(spark, store, tmp_path):
    landing, bodies = tmp_path / "landing", make_bodies(spark, 200, 10)
    texts = [f'{{"logs":{i}}}' if i % 3 else "" for i in range(400)]
    land(landing, ["\n".join([*bodies, *texts]), "\r\n".join([*texts[1:], bodies[0]]) + "\r\n"])
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        assert spark.read.text(str(landing)).rdd.getNumPartitions() > 20
        found = {(Path(r.source_file).name, r.body) for r in read_bodies(spark, str(landing), lines=True).collect()}
        ingest_stream(store, str(landing), store.path("checkpoint"), as_of=NOW, lines=True).awaitTermination()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    lines = {"00000.json": [*bodies, *texts], "00001.json": [*texts[1:], bodies[0]]}
    assert found == {(f"{name}#{i}", line) for name, rows in lines.items() for i, line in enumerate(rows, 1) if line}
    bad = {Path(r["source_file"]).name for r in spark.read.parquet(store.path("quarantine")).collect()}
    assert bad == {name for name, line in found if line == "{bad" or (line.startswith('{"logs":') and line[8].isdigit())}


def test_a_body_may_span_lines(spark, store, tmp_path):
    landing = tmp_path / "landing"
    land(landing, [json.dumps(json.loads(body), indent=2) for body in make_bodies(spark, 100)[:2]])
    ingest_stream(store, str(landing), store.path("checkpoint"), as_of=NOW).awaitTermination()
    assert store.logs().count() == 98 == store.logs().select("id").distinct().count()


def test_replayed_batch_changes_nothing(spark, store, tmp_path):
    landing = tmp_path / "landing"
    land(landing, make_bodies(spark, 200))
    opened = open_batches(read_bodies(spark, str(landing))).withColumn("as_of", literal_like(NOW, LOGS["timestamp"].dataType))
    job = IngestJob(store)
    job(opened, 3)
    first = sorted(map(str, store.logs().collect())), rollup_of(store)
    job(opened, 3)
    assert (sorted(map(str, store.logs().collect())), rollup_of(store)) == first
    job(opened, 4)
    assert store.logs().count() == 2 * len(first[0])
    assert store.logs().select("id").distinct().count() == 2 * len(first[0])


def test_stream_resumes_and_compaction_keeps_the_counts(spark, store, tmp_path):
    landing, bodies = tmp_path / "landing", make_bodies(spark, 400)
    for part in (bodies[:3], bodies[3:]):
        land(landing, part, len(list(landing.glob("*.json"))) if landing.exists() else 0)
        ingest_stream(store, str(landing), store.path("checkpoint"), as_of=NOW, max_files=2).awaitTermination()
        before = rollup_of(store)
        assert before == rollup_of_logs(store)
        store.compact_rollup()
        assert rollup_of(store) == before
        # Again, with nothing new.
        store.compact_rollup()
        assert rollup_of(store) == before and store.epochs("deltas") == {}


def test_two_streams_and_a_new_checkpoint_share_a_store(spark, store, tmp_path):
    bodies = make_bodies(spark, 300)
    for number, part in enumerate((bodies[:2], bodies[2:4], bodies[4:])):
        land(tmp_path / f"landing{number}", part)
        ingest_stream(store, str(tmp_path / f"landing{number}"), store.path(f"checkpoint{number}"), as_of=NOW).awaitTermination()
        store.compact_rollup()
    assert store.logs().count() == 298 == store.logs().select("id").distinct().count()
    assert rollup_of(store) == rollup_of_logs(store)
    assert {r["stream"] for r in store.logs().select("stream").distinct().collect()} == {1, 2, 3}
    assert store.stream_of(store.path("checkpoint1")) == 2


def test_a_micro_batch_of_very_many_bodies(spark, store):
    body = F.concat(F.lit('{"logs":[{"timestamp":"2024-01-05T00:00:00Z","level":"info","service":"s","message":"m'), F.col("id"), F.lit('"}]}'))
    bodies = spark.range(20_000).select(F.format_string("f%09d", "id").alias("source_file"), body.alias("body"))
    opened = open_batches(bodies).withColumn("as_of", literal_like(NOW, LOGS["timestamp"].dataType))
    IngestJob(store)(opened, 0)
    IngestJob(store)(opened.where("source_file < 'f000000010'"), 1)
    assert store.logs().select("id").distinct().count() == store.logs().count() == 20_010
    with pytest.raises(ValueError):
        IngestJob(store)(opened, -1)


def test_stream_and_epoch_numbers_have_no_bound(spark, store, tmp_path):
    body = '{"logs":[{"timestamp":"2024-01-05T00:00:00Z","level":"info","service":"s","message":"m"}]}'
    bodies = spark.createDataFrame([(f"f{i}", body) for i in range(3)], "source_file string, body string")
    opened = open_batches(bodies).withColumn("as_of", literal_like(NOW, LOGS["timestamp"].dataType))
    for number in range(1, 130):
        store._mark(f"{store.path('streams')}/taken.{number}")
    land(tmp_path / "landing", [body, body])
    ingest_stream(store, str(tmp_path / "landing"), store.path("checkpoint"), as_of=NOW).awaitTermination()
    assert store.stream_of(store.path("checkpoint")) == 130
    runs = [(0, 0), (0, (1 << 24) + 1), (0, 1 << 40), (131, 5), (131, BLOCK_EPOCHS + 5), (0, (1 << 24) + 1)]
    for stream, epoch in runs:
        IngestJob(store, stream)(opened, epoch)
    ids = {(r["stream"], r["epoch"]): sorted(r["ids"]) for r in store.logs().groupBy("stream", "epoch").agg(F.collect_list("id").alias("ids")).collect()}
    assert set(ids) == {(130, 0), *runs} and len({i for found in ids.values() for i in found}) == 2 + 5 * 3
    assert all(0 <= i < 1 << 63 for found in ids.values() for i in found)
    # A replay has the same ids, and a block that is taken twice stays with its epochs.
    IngestJob(store, 131)(opened, 5)
    assert sorted(r["id"] for r in store.logs().where("stream = 131 and epoch = 5").collect()) == ids[131, 5]
    taken = {store.id_prefix("ids", stream, epoch, 31) for stream in range(40) for epoch in (0, 1, 1023, 1024, 1 << 30)}
    assert len(taken) == 200 and taken == {store.id_prefix("ids", stream, epoch, 31) for stream in range(40) for epoch in (0, 1, 1023, 1024, 1 << 30)}
    with pytest.raises(ValueError, match="taken"):
        store.id_prefix("ids", 41, 0, 8)


def test_compaction_keeps_one_old_generation(spark, store):
    rows = [(i, datetime(2024, 1, 1 + i, 12), "info", "a", "m", None) for i in range(4)]
    logs = spark.createDataFrame(rows, LOGS)
    store.append_rollup(build_rollup(logs), 0)
    store.compact_rollup()
    earlier = store.rollup()
    store.append_rollup(build_rollup(logs.where("id = 2")), 1)
    store.compact_rollup()
    assert len(list(Path(store.path("compact/generation=1")).glob("log_date=*"))) == 1
    assert compacted(earlier).agg(F.sum("count")).first()[0] == 4
    assert compacted(store.rollup()).agg(F.sum("count")).first()[0] == 5


def test_reads_of_a_range_open_only_its_days(spark, store):
    rows = [(i, datetime(2024, 1, 1 + i), "info", "a", "m", None) for i in range(9)]
    store.append_logs(spark.createDataFrame(rows, LOGS), 0)
    part = store.logs(datetime(2024, 1, 4), datetime(2024, 1, 5))
    assert sorted(r["id"] for r in part.collect()) == [3, 4]
    assert {Path(f).parent.parent.parent.name for f in part.inputFiles()} == {"log_date=2024-01-04", "log_date=2024-01-05"}
    assert store.logs(datetime(2025, 1, 1)).collect() == []


def test_a_failed_retention_run_is_repeated(spark, store, monkeypatch):
    rows = [(i, datetime(2024, 1, 1, 12) + timedelta(days=i), "info", "a", "m", None) for i in range(40)]
    store.append_logs(spark.createDataFrame(rows, LOGS), 0)
    monkeypatch.setattr(type(store), "compact_rollup", lambda *a, **k: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        run_retention(store, datetime(2024, 2, 10, 18), 1)
    monkeypatch.undo()
    assert run_retention(store, datetime(2024, 2, 10, 18), 1) == 11
    assert [r["message"] for r in store.notifications().collect()] == ["Deleted 11 logs older than 30 days"]


def test_rules_added_between_ticks(spark, store):
    start = datetime(2024, 3, 1)
    store_logs(store, spark.createDataFrame([(i, start, "error", "auth", "m", None) for i in range(5)], LOGS))
    assert store.create_rule("auth", 3, 60, "http://example.invalid/a").first()["id"] == 1
    alert_tick(store, start, 0)
    assert store.create_rule(None, 5, 60, "http://example.invalid/b").first()["id"] == 2
    alert_tick(store, start + timedelta(minutes=1), 1)
    # A new alert loop begins at tick 0 again and sees what the other one has triggered.
    alert_tick(store, start + timedelta(minutes=2), 0, stream=4)
    assert sorted((r["stream"], r["epoch"], r["rule_id"]) for r in spark.read.parquet(store.path("alerts")).collect()) == [(0, 0, 1), (0, 1, 2)]
    assert {r["id"]: r["last_triggered_at"] for r in store.rules().collect()} == {1: start, 2: start + timedelta(minutes=1)}
    with pytest.raises(ValueError, match="required"):
        store.create_rule("auth", 0, 60, "http://example.invalid/a")
    with pytest.raises(ValueError, match="rule ids"):
        store.add_rules(spark.createDataFrame([(1 << 31, None, 1, 1, "u", None)], RULES))


def test_read_marks_are_kept(spark, store):
    start = datetime(2024, 3, 1)
    store_logs(store, spark.createDataFrame([(i, start, "error", "auth", "m", None) for i in range(5)], LOGS))
    rules = [(i, None, 1, 60, "http://example.invalid/a", None) for i in range(3)]
    store.add_rules(spark.createDataFrame(rules, RULES))
    alert_tick(store, start, 0)
    unread = lambda: sorted(r["id"] for r in store.notifications().where("not is_read").collect())
    ids = unread()
    assert len(ids) == 3
    store.mark_read(ids[0])
    assert unread() == ids[1:]
    store.mark_all_read(start)
    assert unread() == []
    alert_tick(store, start + timedelta(minutes=10), 1)
    assert len(unread()) == 3


def test_limits_of_a_stream(store, tmp_path):
    with pytest.raises(ValueError):
        ingest_stream(store, str(tmp_path), store.path("checkpoint"), max_files=0)


def test_a_hot_day_is_split(spark, store):
    start = datetime(2024, 3, 1)
    rows = spark.range(200_000).select(
        F.col("id"), (F.lit("2024-03-01").cast("timestamp") + F.make_dt_interval(secs=F.col("id") % 80_000)).alias("timestamp"),
        F.lit("info").alias("level"), F.lit("hot").alias("service"), F.repeat(F.sha2(F.col("id").cast("string"), 512), 2).alias("message"),
        F.lit(None).cast("map<string,string>").alias("attributes"),
    )
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "4MB")
    try:
        store.append_logs(rows, 0)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    files = list(Path(store.path("logs")).rglob("*.parquet"))
    assert len(files) > 1 and {p.parent.parent.parent.name for p in files} == {"log_date=2024-03-01"}
    assert store.logs().count() == 200_000 and store.logs().agg(F.min("timestamp")).first()[0] == start


def test_retention_run(spark, store):
    t = datetime(2024, 1, 1, 12)
    rows = [(i, t + timedelta(days=i), "info", "a", "m", None) for i in range(40)]
    logs = spark.createDataFrame(rows, LOGS)
    store.append_logs(logs, 0)
    store.append_rollup(build_rollup(logs), 0)
    as_of = datetime(2024, 2, 10, 18)
    # Rows before 11 January 18:00 have expired; that day itself stays on disk.
    assert run_retention(store, as_of, 1) == 11
    assert store.logs().agg(F.min("timestamp")).first()[0] == datetime(2024, 1, 11, 12)
    assert compacted(store.rollup()).agg(F.min("bucket_start")).first()[0] == datetime(2024, 1, 12, 12)
    note = store.notifications().collect()
    assert [r["message"] for r in note] == ["Deleted 11 logs older than 30 days"]
    # The row of the cutoff day is still counted as expired, but nothing more is dropped.
    assert run_retention(store, as_of, 2) == 1
    assert min(store.folders("logs", "log_date")) == date(2024, 1, 11).isoformat()
    store.append_rollup(build_rollup(logs.limit(1)), 1)
    assert compacted(store.rollup()).count() == 30


def test_alert_ticks(spark, store):
    start = datetime(2024, 3, 1)
    store_logs(store, spark.createDataFrame([(i, start, "error", "auth", "m", None) for i in range(5)], LOGS))
    rules = [(1, "auth", 3, 60, "http://example.invalid/a", None), (2, None, 6, 60, "http://example.invalid/b", None)]
    store.add_rules(spark.createDataFrame(rules, RULES))
    for tick in (0, 9, 10, 11):
        alert_tick(store, start + timedelta(minutes=tick), tick)
        alert_tick(store, start + timedelta(minutes=tick), tick)
    alerts = spark.read.parquet(store.path("alerts")).collect()
    assert sorted((r["epoch"], r["rule_id"]) for r in alerts) == [(0, 1), (10, 1)]
    assert json.loads(alerts[0]["payload"])["error_count"] == 5
    notes = store.notifications().collect()
    assert len(notes) == 2 and len({r["id"] for r in notes}) == 2
    last = {r["id"]: r["last_triggered_at"] for r in store.rules().collect()}
    assert last == {1: start + timedelta(minutes=10), 2: None}


def test_alert_loop(spark, store):
    now = spark.sql("SELECT current_timestamp() AS t").first()["t"]
    store_logs(store, spark.createDataFrame([(1, now, "error", "auth", "m", None)], LOGS))
    store.add_rules(spark.createDataFrame([(1, None, 1, 600, "http://example.invalid/a", None)], RULES))
    query = alert_stream(store, store.path("checkpoint"), "1 second")
    try:
        for _ in range(60):
            query.awaitTermination(1)
            if store.has("alerts") and spark.read.parquet(store.path("alerts")).count():
                break
    finally:
        query.stop()
    assert spark.read.parquet(store.path("alerts")).count() == 1


def test_csv_bytes(spark, tmp_path):
    rows = [
        (1, datetime(2024, 1, 1), "info", "a,b", 'say "hi"', None), (2, datetime(2024, 1, 1, 0, 0, 0, 1999), "warn", " x ", "two\nlines", None),
        (3, datetime(2024, 1, 1), "warn", "x", "", None), (4, datetime(2024, 1, 1), "warn", "x", "semi;tab\tüñ", None),
    ]
    write_csv(log_rows(spark.createDataFrame(rows, LOGS).coalesce(1)), str(tmp_path / "out"))
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("*.csv"))
    assert text == (
        'Timestamp,Level,Service,Message\n2024-01-01T00:00:00.000Z,info,"a,b","say ""hi"""\n2024-01-01T00:00:00.001Z,warn, x ,"two\nlines"\n'
        "2024-01-01T00:00:00.000Z,warn,x,\n2024-01-01T00:00:00.000Z,warn,x,semi;tab\tüñ\n"
    )


def test_generated_logs(spark):
    logs = synthetic_logs(spark, 7000, NOW).persist()
    share = {r["level"]: r["count"] / 7000 for r in logs.groupBy("level").count().collect()}
    assert share == pytest.approx({"debug": 1 / 7, "info": 3 / 7, "warn": 2 / 7, "error": 1 / 7}, abs=0.03)
    assert logs.select("service").distinct().count() == 8
    bounds = logs.agg(F.min("timestamp"), F.max("timestamp")).first()
    assert NOW - timedelta(days=30) < bounds[0] and bounds[1] <= NOW
    again = synthetic_logs(spark, 7000, NOW).withColumn("attributes", F.to_json("attributes"))
    assert logs.withColumn("attributes", F.to_json("attributes")).exceptAll(again).count() == 0


def test_small_files_share_a_micro_batch_up_to_its_bytes(spark, store, tmp_path, monkeypatch):
    bodies = [json.dumps({"logs": [{"timestamp": "2024-01-15T00:00:00Z", "level": "info" if i % 2 else "loud", "service": "auth", "message": f"m{i}"}]}) for i in range(1100)]
    land(tmp_path / "landing", bodies)
    ingest_stream(store, str(tmp_path / "landing"), store.path("checkpoint"), as_of=NOW).awaitTermination()
    assert store.logs().count() == 550 and {r["epoch"] for r in store.logs().select("epoch").distinct().collect()} == {0}
    rejects = spark.read.parquet(store.path("rejected"))
    assert rejects.count() == 550 and len(rejects.inputFiles()) == 1
    monkeypatch.setattr(ingest, "MICRO_BATCH_BYTES", sum(map(len, bodies)) // 3)
    ingest_stream(store, str(tmp_path / "landing"), store.path("checkpoint2"), as_of=NOW).awaitTermination()
    again = store.logs().where("stream = 2")
    assert again.count() == 550 and again.select("epoch").distinct().count() > 2
