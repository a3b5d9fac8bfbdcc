"""Bucket counts, the roll-up and the dashboard figures."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from cinderlog.catalog import datasets as d
from cinderlog.catalog.query import Query, with_ctes
from cinderlog.operators import aggregate as agg
from cinderlog.operators import measures as ms
from cinderlog.operators import metrics as m
from cinderlog.operators import rollup as r
from cinderlog.operators.pages import numbered_page
from cinderlog.operators.quantile import exact_quantile, histogram
from cinderlog.operators.rollup import build_rollup
from cinderlog.operators.search import in_range
from cinderlog.plans.spec import AggSpec, LogQuery
from cinderlog.schemas import LOGS
from cinderlog.sources.export import read_csv, storage_rows, write_csv
from cinderlog.sources.tables import LogStore
from cinderlog.sources.workspace import new_folder
from cinderlog.streaming.windows import (
    amendments, final_windows, open_windows, rollup_delta_stream, window_count_stream, window_counts, window_job_stream,
)

MONTH = (datetime(2024, 1, 1), datetime(2024, 2, 1))
# Bounds that are not on a minute show where roll-up and raw counts differ.
ODD = (datetime(2024, 1, 10, 0, 0, 30), datetime(2024, 1, 12, 0, 0, 30))
ODD_SQL = "{0} >= TIMESTAMP '2024-01-10 00:00:30' AND {0} < TIMESTAMP '2024-01-12 00:00:30'"
ROLLUP_ODD_SQL = "bucket_start >= TIMESTAMP '2024-01-10 00:00:00' AND bucket_start < TIMESTAMP '2024-01-12 00:00:30'"
# A range that begins and ends within minutes, hours and days.
RAGGED = (datetime(2024, 1, 3, 5, 7, 30), datetime(2024, 1, 27, 22, 41, 15))
RAGGED_SQL = "{0} >= TIMESTAMP '2024-01-03 05:07:30' AND {0} < TIMESTAMP '2024-01-27 22:41:15'"
ROLLUP_RAGGED_SQL = "bucket_start >= TIMESTAMP '2024-01-03 05:07:00' AND bucket_start < TIMESTAMP '2024-01-27 22:41:15'"
WHOLE_HOURS = (datetime(2024, 1, 3, 5), datetime(2024, 1, 27, 22))
WHOLE_HOURS_SQL = "timestamp >= TIMESTAMP '2024-01-03 05:00:00' AND timestamp < TIMESTAMP '2024-01-27 22:00:00'"
WIDTH = {"1m": "1 MINUTE", "5m": "5 MINUTES", "1h": "1 HOUR", "1d": "1 DAY"}
NO_GROUP = "CAST(NULL AS VARCHAR)"

# The dashboard's ranges at d.NOW, with the lower bound floored to the minute.
LAST_HOUR = "bucket_start >= TIMESTAMP '2024-01-30 11:34:00' AND bucket_start < TIMESTAMP '2024-01-30 12:34:56.789'"
LAST_DAY = "bucket_start >= TIMESTAMP '2024-01-29 12:34:00' AND bucket_start < TIMESTAMP '2024-01-30 12:34:56.789'"
LAST_WEEK = "bucket_start >= TIMESTAMP '2024-01-23 12:34:00' AND bucket_start < TIMESTAMP '2024-01-30 12:34:56.789'"
RECENT = "timestamp > TIMESTAMP '2024-01-29 12:34:56.789'"

SUMMARY = d.LOGS + """,
summary AS (
  SELECT service, total, p99_ms, error_rate,
         CASE WHEN error_rate >= 2.5 THEN 'DEGRADED' WHEN error_rate >= 1.0 THEN 'WARNING' ELSE 'HEALTHY' END AS status
  FROM (SELECT service, count(*) AS total, round(quantile_cont(duration_ms, 0.99), 6) AS p99_ms,
               CAST(round(CAST(100 * count(*) FILTER (level = 'error') AS DECIMAL(18,8)) / count(*), 2) AS DOUBLE) AS error_rate
        FROM logs GROUP BY service))"""


def _raw(bucket: str, span=MONTH, **filters):
    return lambda spark, sf: agg.aggregate_raw(d.logs(spark, sf), AggSpec(*span, bucket, **filters))


def _rolled(bucket: str, span=ODD, **filters):
    return lambda spark, sf: agg.aggregate_rollup(d.rollup(spark, sf), AggSpec(*span, bucket, **filters))


def _counts_sql(bucket: str, group: str = NO_GROUP, where: str = "TRUE", source: str = "logs") -> str:
    column, count = ("timestamp", "count(*)") if source == "logs" else ("bucket_start", "CAST(sum(count) AS BIGINT)")
    ctes = d.LOGS if source == "logs" else d.ROLLUP
    return with_ctes(ctes, f"""
        SELECT time_bucket(INTERVAL '{WIDTH[bucket]}', {column}) AS start, {group} AS "group", {count} AS count
        FROM {source} WHERE {where} GROUP BY 1, 2""")


def _pending(spark, sf):
    deltas = d.deltas(spark, sf)
    flushed, pending = deltas.where("epoch = 0"), deltas.where("epoch = 1")
    return agg.aggregate_with_pending(flushed, pending, AggSpec(*ODD, "1h", group_by="service"))


def _reconcile_digests(spark, sf):
    """A store whose roll-up has lost rows of the first days and counted some of the eighth twice; only those days are read again."""
    store, rows = LogStore(spark, new_folder(spark, "reconciled")), d.logs(spark, sf).select(*LOGS.names)
    rows = rows.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    store.append_logs(rows, 0)
    store.append_rollup(ms.digest_rollup(rows), 0, measure=ms.DIGEST)
    store.append_rollup(build_rollup(rows.where("NOT (day(timestamp) <= 3 AND id % 5 = 0)")), 0)
    store.compact_all()
    store.append_rollup(build_rollup(rows.where("day(timestamp) = 8 AND id % 7 = 0")), 1)
    found = store.reconcile()
    return found.withColumn("bucket_start", F.col("bucket_start").cast("timestamp_ntz"))


def _reconcile(spark, sf):
    return r.reconcile(d.logs(spark, sf), d.deltas(spark, sf).where("epoch = 0"))


def _rollup_append(spark, sf):
    """Write the deltas of two flushes, one of them twice as a retry would, and read the sums."""
    store = LogStore(spark, new_folder(spark, "rollup"))
    deltas = d.deltas(spark, sf)
    for epoch in (0, 1, 1):
        store.append_rollup(deltas.where(F.col("epoch") == epoch).drop("epoch"), epoch)
    return r.compacted(store.rollup()).withColumn("bucket_start", F.col("bucket_start").cast("timestamp_ntz"))


def _stored(spark, sf):
    """All events in a store: logs of two epochs, and a roll-up of which one half has been compacted."""
    store = LogStore(spark, new_folder(spark, "stored"))
    logs = d.logs(spark, sf).select("id", F.col("timestamp").cast("timestamp").alias("timestamp"), "level", "service", "message", F.lit(None).cast("map<string,string>").alias("attributes"))
    for epoch in (0, 1):
        part = logs.where(F.pmod("id", F.lit(2)) == epoch)
        store.append_logs(part, epoch)
        store.append_rollup(r.build_rollup(part), epoch)
        if epoch == 0:
            store.compact_rollup()
    return store


def _stored_aggregate(spark, sf):
    """Through the routing of `aggregate`, from the stored roll-up."""
    store = _stored(spark, sf)
    counts = agg.aggregate(store.logs(), store.rollup(), AggSpec(*ODD, "1h", group_by="service"))
    return counts.withColumn("start", F.col("start").cast("timestamp_ntz"))


def _pyramid(bucket: str, exact: bool = False, **filters):
    """Through the levels of a store of which one half is compacted and one is not."""
    def run(spark, sf):
        counts = _stored(spark, sf).aggregate(AggSpec(*RAGGED, bucket, **filters), exact)
        return counts.withColumn("start", F.col("start").cast("timestamp_ntz"))

    return run


def _stored_page(spark, sf):
    """A deep page of a service within ragged bounds, by the counts of a store."""
    store, query = _stored(spark, sf), LogQuery(service="auth", since=RAGGED[0], until=RAGGED[1], limit=50)
    page = numbered_page(store.logs, store.rollup_cover, query, 5, shallow=0)
    return page.select("id", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "service")


def _sketched(spark, sf):
    """A store whose latency and distinct sketches come from two streams, the first compacted."""
    store = LogStore(spark, new_folder(spark, "sketches"))
    for stream in (0, 1):
        part = d.logs(spark, sf).where(F.pmod("id", F.lit(2)) == stream)
        store.append_rollup(build_rollup(part), 0, stream)
        store.append_rollup(ms.latency_rollup(part, F.col("duration_ms")), 0, stream, ms.LATENCY)
        fields = {"service": F.col("service"), "attr.user_id": F.col("attributes")["user_id"], "attr.k": F.col("attributes")["k"]}
        store.append_rollup(ms.distinct_rollup(part, fields), 0, stream, ms.DISTINCT)
        if stream == 0:
            store.compact_all()
    return store


def _latency_sketch(spark, sf):
    """P99 of a range from sketches, and whether as many durations lie at or below it as must, up to the sketch's bound."""
    found = _sketched(spark, sf).latency(*WHOLE_HOURS).select("service", "n", "latency")
    rows = d.logs(spark, sf).select("timestamp", "service", "duration_ms").where("duration_ms is not null")
    rows = in_range(rows, *WHOLE_HOURS).join(found, "service")
    below = F.count_if(F.col("duration_ms") <= F.col("latency")) / F.count("*")
    strictly = F.count_if(F.col("duration_ms") < F.col("latency")) / F.count("*")
    # One value more or less is allowed for, since ranks of few values are coarse.
    slack = F.lit(ms.RANK_ERROR) + 1 / F.count("*")
    return rows.groupBy("service").agg(F.first("n").alias("n"), ((below >= 0.99 - slack) & (strictly <= 0.99 + slack)).alias("within"))


def _distinct_sketch(spark, sf):
    """Distinct services and attribute values of a range by sketches, and whether they are within four standard errors."""
    found = ms.distinct_estimates(_sketched(spark, sf).rollup_cover(*WHOLE_HOURS, measure=ms.DISTINCT))
    logs = in_range(d.logs(spark, sf), *WHOLE_HOURS)
    values = {"service": F.col("service"), "attr.user_id": F.col("attributes")["user_id"], "attr.k": F.col("attributes")["k"]}
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("field"), v.cast("string").alias("value")) for k, v in values.items()]))
    exact = logs.select(pairs.alias("p")).groupBy("p.field").agg(F.count_distinct("p.value").alias("exact"))
    off = F.abs(F.col("estimate") - F.col("exact")) <= 4 * ms.DISTINCT_ERROR * F.col("exact") + 1
    return exact.join(found, "field").select("field", "exact", off.alias("within"))


def _stored_summary(spark, sf):
    """The service summary of a range without its P99, which is a sketch's."""
    found = _sketched(spark, sf).service_summary(*WHOLE_HOURS)
    return found.select("service", "total", "error_rate", "status")


def _stored_newest(spark, sf):
    page = _stored(spark, sf).newest(LogQuery(levels=("error",), limit=200))
    return page.select("id", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "service")


def _rollup_after_compaction(spark, sf):
    """Both halves compacted one after the other, and once more with nothing new."""
    store = _stored(spark, sf)
    store.compact_rollup()
    store.compact_rollup()
    return r.compacted(store.rollup()).withColumn("bucket_start", F.col("bucket_start").cast("timestamp_ntz"))


def _halves(spark, sf, same_checkpoint_name: bool):
    """Two streams over the halves of the events into one store, with a compaction in between.

    Either two landing tables with a checkpoint each, or one stream that is started again on a new checkpoint.
    """
    store = LogStore(spark, new_folder(spark, "two-streams"))
    for half in (0, 1):
        folder = new_folder(spark, "half")
        _events_as_logs(spark.read.parquet(f"{sf}/events.parquet")).where(F.pmod("event_id", F.lit(2)) == half).write.parquet(folder)
        rows = spark.readStream.schema("event_id long, timestamp timestamp, service string, level string").parquet(folder)
        name = "checkpoint" if same_checkpoint_name else f"checkpoint-{half}"
        rollup_delta_stream(rows, store, f"{new_folder(spark, 'checkpoints')}/{name}").awaitTermination()
        store.compact_rollup()
    return r.compacted(store.rollup()).withColumn("bucket_start", F.col("bucket_start").cast("timestamp_ntz"))


def _events_as_logs(events):
    return events.select("event_id", F.col("ts").cast("timestamp").alias("timestamp"), F.expr(d.SERVICE_SQL).alias("service"), F.expr(d.LEVEL_SQL).alias("level"))


def _odd_quantiles(spark, sf):
    """The exact median of values among which are NaN and infinities, in text so that engines agree on them."""
    events = d.table(spark, sf, "events").select("event_type", "event_id", F.col("value").cast("double").alias("value"))
    turn = F.pmod("event_id", F.lit(100))
    odd = F.when(turn < 20, float("nan")).when(turn < 25, float("inf")).when(turn < 30, -float("inf")).otherwise(F.col("value"))
    rows = events.withColumn("value", odd)
    found = exact_quantile(rows, histogram(rows, "event_type", "value"), "event_type", "value", 0.9, "p90")
    low = exact_quantile(rows, histogram(rows, "event_type", "value"), "event_type", "value", 0.01, "p1")
    mid = exact_quantile(rows, histogram(rows, "event_type", "value"), "event_type", "value", 0.4, "p40")
    joined = found.join(low, "event_type").join(mid, "event_type")
    return joined.select("event_type", F.isnan("p90").alias("p90_nan"), (F.col("p1") == -float("inf")).alias("p1_low"), F.round("p40", 6).alias("p40"))


def _event_stream(spark, sf):
    """The events file as a stream of (timestamp, service, level)."""
    events = spark.readStream.schema(d.table(spark, sf, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return events.select(F.col("ts").cast("timestamp").alias("timestamp"), F.expr(d.SERVICE_SQL).alias("service"), F.expr(d.LEVEL_SQL).alias("level"))


def _stream_deltas(spark, sf):
    store = LogStore(spark, new_folder(spark, "stream"))
    rollup_delta_stream(_event_stream(spark, sf), store, store.path("checkpoint")).awaitTermination()
    return r.compacted(store.rollup()).withColumn("bucket_start", F.col("bucket_start").cast("timestamp_ntz"))


def _stream_windows(spark, sf):
    root = new_folder(spark, "windows")
    counts = window_counts(_event_stream(spark, sf), "1 hour", "10 minutes")
    window_count_stream(counts, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    out = spark.read.schema(counts.schema).parquet(f"{root}/out")
    return out.withColumn("bucket_start", F.col("bucket_start").cast("timestamp_ntz"))


def _late_rows(spark, sf):
    """`events` in five deliveries by day, a ninth of them five days late: what was counted in time, and what afterwards."""
    store, landed = LogStore(spark, new_folder(spark, "late")), new_folder(spark, "deliveries")
    rows = d.logs(spark, sf).select(*LOGS.names).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    rows = rows.withColumn("delivery", F.floor((F.dayofmonth("timestamp") + F.when(F.col("id") % 9 == 0, 5).otherwise(0)) / 8))
    for number in range(5):
        rows.where(F.col("delivery") == number).drop("delivery").coalesce(1).write.mode("append").parquet(landed)
    stream = spark.readStream.schema(LOGS).option("maxFilesPerTrigger", 1).parquet(landed)
    window_job_stream(stream, store, store.path("checkpoint"), 60, timedelta(hours=6)).awaitTermination()
    number = store.stream_of(store.path("checkpoint"))
    keys = ["bucket_start", "service", "level"]
    counted = final_windows(store, number, 60).withColumn("closed", F.lit(True))
    counted = counted.unionByName(open_windows(store, number, 60).withColumn("closed", F.lit(False))).withColumnRenamed("count", "counted")
    amended = amendments(store, number).withColumnRenamed("count", "amended")
    both = counted.join(amended, keys, "full_outer").na.fill(0, ["counted", "amended"]).na.fill(True, ["closed"])
    return both.withColumn("bucket_start", F.col("bucket_start").cast("timestamp_ntz"))


def _export(spark, sf):
    path = new_folder(spark, "storage-csv")
    write_csv(storage_rows(m.storage_by_service(d.rollup(spark, sf), d.NOW)), path)
    return read_csv(spark, path, "`Service` string, `Events (24h)` string, `% of Total` string, `Est. Storage` string")


def _trend(spark, sf):
    spec = AggSpec(*ODD, "1m")
    return agg.volume_series(d.rollup(spark, sf), spec, ["checkout", "auth"])


def _change(spark, sf):
    return m.volume_change(agg.aggregate_rollup(d.rollup(spark, sf), AggSpec(*MONTH, "1h", group_by="service")))


def _tile(operator):
    return lambda spark, sf: operator(d.rollup(spark, sf), d.NOW)


def _summary(spark, sf):
    """The engines interpolate with different roundings in the last digit."""
    return m.service_summary(d.logs(spark, sf)).withColumn("p99_ms", F.round("p99_ms", 6))


STORAGE_SQL = d.ROLLUP + f""",
storage AS (
  SELECT service, CAST(sum(count) AS BIGINT) AS count,
         CAST(round(CAST(100 * sum(count) AS DECIMAL(28,8)) / (SELECT sum(count) FROM rollup WHERE {LAST_DAY}), 1) AS DOUBLE) AS pct,
         CAST(round(CAST(sum(count) AS DECIMAL(18,0)) * CAST(0.512 AS DECIMAL(4,3)), 2) AS DOUBLE) AS storage_kb
  FROM rollup WHERE {LAST_DAY} GROUP BY service)"""

QUERIES = [
    Query("agg_1m", _raw("1m"), _counts_sql("1m")),
    Query("agg_5m", _raw("5m"), _counts_sql("5m")),
    Query("agg_1h", _raw("1h"), _counts_sql("1h")),
    Query("agg_1d", _raw("1d"), _counts_sql("1d")),
    Query("agg_1h_by_service", _raw("1h", group_by="service"), _counts_sql("1h", "service")),
    Query("agg_1h_by_level", _raw("1h", group_by="level"), _counts_sql("1h", "level")),
    Query("agg_level_filter", _rolled("1h", level="error", group_by="service"), _counts_sql("1h", "service", f"level = 'error' AND {ROLLUP_ODD_SQL}", "rollup")),
    Query("agg_rollup_path", _rolled("1h"), _counts_sql("1h", where=ROLLUP_ODD_SQL, source="rollup")),
    Query("agg_text_filter", _raw("1h", ODD, q="user_1"), _counts_sql("1h", where="message ILIKE '%user_1%' AND " + ODD_SQL.format("timestamp"))),
    Query(
        "agg_attr_filter", _raw("1d", MONTH, attributes={"k": "1"}, group_by="level"),
        _counts_sql("1d", "level", "attr_k = '1'"),
    ),
    Query(
        "agg_exact_edges",
        lambda spark, sf: agg.aggregate_exact(d.logs(spark, sf), d.rollup(spark, sf), AggSpec(*ODD, "1h", group_by="service")),
        _counts_sql("1h", "service", ODD_SQL.format("timestamp")),
    ),
    Query("agg_with_pending", _pending, _counts_sql("1h", "service", ROLLUP_ODD_SQL, "rollup")),
    Query("rollup_build", d.rollup, with_ctes(d.ROLLUP, "SELECT * FROM rollup")),
    Query("rollup_append", _rollup_append, with_ctes(d.ROLLUP, "SELECT * FROM rollup")),
    Query("stream_rollup_delta", _stream_deltas, with_ctes(d.ROLLUP, "SELECT * FROM rollup")),
    Query(
        "stream_window_counts", _stream_windows,
        with_ctes(d.LOGS, """
            SELECT * FROM (SELECT time_bucket(INTERVAL '1 HOUR', timestamp) AS bucket_start, service, level, count(*) AS count FROM logs GROUP BY 1, 2, 3)
            WHERE bucket_start + INTERVAL '1 HOUR' <= (SELECT max(timestamp) FROM logs) - INTERVAL '10 MINUTES'"""),
    ),
    Query(
        "stream_late_rows", _late_rows,
        with_ctes(d.LOGS + """,
            dealt AS (SELECT *, time_bucket(INTERVAL '1 HOUR', timestamp) AS bucket_start, (day(timestamp) + CASE WHEN id % 9 = 0 THEN 5 ELSE 0 END) // 8 AS delivery FROM logs),
            marks AS (SELECT n.delivery, (SELECT max(timestamp) - INTERVAL '6 HOURS' FROM dealt d WHERE d.delivery < n.delivery) AS mark FROM (SELECT DISTINCT delivery FROM dealt) n),
            split AS (SELECT dealt.*, coalesce(bucket_start + INTERVAL '1 HOUR' <= mark, false) AS late FROM dealt JOIN marks USING (delivery))""", """
            SELECT bucket_start, service, level, count(*) FILTER (NOT late) AS counted, count(*) FILTER (late) AS amended,
                   bucket_start + INTERVAL '1 HOUR' <= (SELECT max(timestamp) - INTERVAL '6 HOURS' FROM logs) AS closed
            FROM split GROUP BY bucket_start, service, level"""),
    ),
    Query(
        "rollup_reconcile", _reconcile,
        with_ctes(d.LOGS, """
            SELECT time_bucket(INTERVAL '1 HOUR', timestamp) AS bucket_start, service, level, count(*) AS raw_count,
                   count(*) FILTER (id % 2 = 0) AS rollup_count, count(*) FILTER (id % 2 = 1) AS missing
            FROM logs GROUP BY ALL"""),
    ),
    Query(
        "rollup_reconcile_digests", _reconcile_digests,
        with_ctes(d.LOGS, """
            SELECT * FROM (
              SELECT date_trunc('minute', timestamp) AS bucket_start, service, level, count(*) AS raw_count,
                     count(*) FILTER (NOT (day(timestamp) <= 3 AND id % 5 = 0)) + count(*) FILTER (day(timestamp) = 8 AND id % 7 = 0) AS rollup_count,
                     raw_count - rollup_count AS missing
              FROM logs GROUP BY ALL) WHERE missing <> 0"""),
    ),
    Query(
        "overview", lambda spark, sf: m.overview(d.logs(spark, sf), d.rollup(spark, sf)),
        with_ctes(d.LOGS, """SELECT count(*) AS total_logs, count(DISTINCT service) AS services_count, count(DISTINCT level) AS levels_count,
            min(timestamp) AS oldest, max(timestamp) AS newest FROM logs"""),
    ),
    Query(
        "recent_by_level", lambda spark, sf: m.recent_by_level(d.logs(spark, sf), d.NOW),
        with_ctes(d.LOGS, f"SELECT level, count(*) AS count FROM logs WHERE {RECENT} GROUP BY level"),
    ),
    Query(
        "recent_top_services", lambda spark, sf: m.recent_top_services(d.logs(spark, sf), d.NOW),
        with_ctes(d.LOGS, f"SELECT service, count(*) AS count FROM logs WHERE {RECENT} GROUP BY service ORDER BY count DESC, service LIMIT 8"),
    ),
    Query(
        "overview_json", lambda spark, sf: m.overview_json(d.logs(spark, sf), d.NOW, d.rollup(spark, sf)),
        with_ctes(d.LOGS + f""",
            by_level AS (SELECT level, count(*) AS n FROM logs WHERE {RECENT} GROUP BY level),
            by_service AS (SELECT service, count(*) AS n FROM logs WHERE {RECENT} GROUP BY service ORDER BY n DESC, service LIMIT 8)""", """
            SELECT concat('{"total_logs":', count(*), ',"services_count":', count(DISTINCT service),
              ',"oldest":"', strftime(min(timestamp), '%Y-%m-%dT%H:%M:%S.%gZ'), '","newest":"', strftime(max(timestamp), '%Y-%m-%dT%H:%M:%S.%gZ'),
              '","last_24h_by_level":[', (SELECT string_agg(concat('{"level":"', level, '","count":', n, '}'), ',' ORDER BY n DESC, level) FROM by_level),
              '],"last_24h_by_service":[', (SELECT string_agg(concat('{"service":"', service, '","count":', n, '}'), ',' ORDER BY n DESC, service) FROM by_service),
              ']}') AS context FROM logs"""),
    ),
    Query(
        "kpi_errors_1h", _tile(m.errors_last_hour),
        with_ctes(d.ROLLUP, f"SELECT CAST(coalesce(sum(count), 0) AS BIGINT) AS errors FROM rollup WHERE level = 'error' AND {LAST_HOUR}"),
    ),
    Query(
        "kpi_ingest_rate", _tile(m.ingest_rate),
        with_ctes(d.ROLLUP, f"SELECT CAST(floor(coalesce(sum(count), 0) / 24.0 + 0.5) AS BIGINT) AS per_hour FROM rollup WHERE {LAST_DAY}"),
    ),
    Query(
        "level_distribution", _tile(m.level_distribution),
        with_ctes(d.ROLLUP, f"""SELECT level, CAST(sum(count) AS BIGINT) AS count,
            CAST(round(CAST(100 * sum(count) AS DECIMAL(28,8)) / (SELECT sum(count) FROM rollup WHERE {LAST_DAY}), 1) AS DOUBLE) AS pct
            FROM rollup WHERE {LAST_DAY} GROUP BY level"""),
    ),
    Query("storage_by_service", _tile(m.storage_by_service), with_ctes(STORAGE_SQL, "SELECT * FROM storage")),
    Query(
        "export_storage_csv", _export,
        with_ctes(STORAGE_SQL, """SELECT service AS "Service", CAST(count AS VARCHAR) AS "Events (24h)",
            concat(CAST(CAST(pct AS DECIMAL(5,1)) AS VARCHAR), '%') AS "% of Total",
            concat(CAST(CAST(storage_kb AS DECIMAL(20,2)) AS VARCHAR), ' KB') AS "Est. Storage" FROM storage"""),
    ),
    Query(
        "volume_7d", _tile(m.daily_volume),
        with_ctes(d.ROLLUP, f"SELECT time_bucket(INTERVAL '1 DAY', bucket_start) AS start, CAST(sum(count) AS BIGINT) AS count FROM rollup WHERE {LAST_WEEK} GROUP BY 1"),
    ),
    Query("kpi_total_7d", _tile(m.total_last_week), with_ctes(d.ROLLUP, f"SELECT CAST(coalesce(sum(count), 0) AS BIGINT) AS total FROM rollup WHERE {LAST_WEEK}")),
    Query("kpi_active_services", _tile(m.active_services), with_ctes(d.ROLLUP, f"SELECT count(DISTINCT service) AS services FROM rollup WHERE {LAST_DAY}")),
    Query(
        "kpi_services_newest_1000", lambda spark, sf: m.services_in_newest(d.logs(spark, sf)),
        with_ctes(d.LOGS, "SELECT count(DISTINCT service) AS services FROM (SELECT service FROM logs ORDER BY timestamp DESC, id DESC LIMIT 1000)"),
    ),
    Query(
        "service_health", _tile(m.service_health),
        with_ctes(d.ROLLUP, f"""SELECT service, CAST(sum(count) AS BIGINT) AS total,
            CASE WHEN sum(count) < 100 THEN 99.9::DOUBLE WHEN sum(count) < 500 THEN 95.0::DOUBLE ELSE 85.0::DOUBLE END AS health
            FROM rollup WHERE {LAST_HOUR} GROUP BY service ORDER BY min(time_bucket(INTERVAL '5 MINUTES', bucket_start)), service LIMIT 5"""),
    ),
    Query("service_summary", _summary, with_ctes(SUMMARY, "SELECT * FROM summary")),
    Query(
        "service_summary_filter", lambda spark, sf: m.summary_filter(_summary(spark, sf), "Api"),
        with_ctes(SUMMARY, "SELECT * FROM summary WHERE contains(lower(service), 'api') OR contains(lower(status), 'api')"),
    ),
    Query(
        "service_summary_page", lambda spark, sf: m.summary_page(_summary(spark, sf), 2, "status"),
        with_ctes(SUMMARY, """SELECT * FROM summary
            ORDER BY CASE status WHEN 'HEALTHY' THEN 0 WHEN 'WARNING' THEN 1 ELSE 2 END, service LIMIT 5 OFFSET 5"""),
    ),
    Query(
        "top_errors", lambda spark, sf: m.top_errors(d.documents(spark, sf)),
        with_ctes(d.DOCS, """SELECT regexp_replace(message, '[0-9]+', '#', 'g') AS template, count(*) AS count, min(timestamp) AS first_seen,
            max(timestamp) AS last_seen FROM docs WHERE level = 'error' GROUP BY 1 ORDER BY count DESC, first_seen, md5(template) LIMIT 10"""),
    ),
    Query(
        "volume_trend", _trend,
        _counts_sql("1m", "service", f"service IN ('checkout', 'auth') AND {ROLLUP_ODD_SQL}", "rollup"),
    ),
    Query(
        "volume_vs_prev", _change,
        with_ctes(d.ROLLUP + """,
            hours AS (SELECT time_bucket(INTERVAL '1 HOUR', bucket_start) AS start, service, CAST(sum(count) AS BIGINT) AS count FROM rollup GROUP BY 1, 2),
            paired AS (SELECT *, lag(count) OVER (PARTITION BY service ORDER BY start) AS previous FROM hours)""", """
            SELECT start, service, count, previous,
                   CAST(round(CAST(100 * (count - previous) AS DECIMAL(18,8)) / previous, 1) AS DOUBLE) AS change_pct FROM paired"""),
    ),
    Query("stored_agg_rollup", _stored_aggregate, _counts_sql("1h", "service", ROLLUP_ODD_SQL, "rollup")),
    Query("agg_pyramid_1d", _pyramid("1d", group_by="level"), _counts_sql("1d", "level", ROLLUP_RAGGED_SQL, "rollup")),
    Query("agg_pyramid_1h", _pyramid("1h", group_by="service"), _counts_sql("1h", "service", ROLLUP_RAGGED_SQL, "rollup")),
    Query("agg_pyramid_5m", _pyramid("5m", service="auth"), _counts_sql("5m", where=f"service = 'auth' AND {ROLLUP_RAGGED_SQL}", source="rollup")),
    Query("agg_pyramid_exact", _pyramid("1d", exact=True, level="error"), _counts_sql("1d", where="level = 'error' AND " + RAGGED_SQL.format("timestamp"))),
    Query(
        "stored_page_deep", _stored_page,
        with_ctes(d.LOGS, f"""SELECT id, timestamp, service FROM logs WHERE service = 'auth' AND {RAGGED_SQL.format('timestamp')}
            ORDER BY timestamp DESC, id DESC LIMIT 50 OFFSET 200"""),
    ),
    Query(
        "latency_sketch", _latency_sketch,
        with_ctes(d.LOGS, f"SELECT service, count(*) AS n, true AS within FROM logs WHERE duration_ms IS NOT NULL AND {WHOLE_HOURS_SQL} GROUP BY service"),
    ),
    Query(
        "distinct_sketch", _distinct_sketch,
        with_ctes(d.LOGS + f", ranged AS (SELECT * FROM logs WHERE {WHOLE_HOURS_SQL})", """
            SELECT 'service' AS field, count(DISTINCT service) AS exact, true AS within FROM ranged
            UNION ALL SELECT 'attr.user_id', count(DISTINCT attr_user_id), true FROM ranged
            UNION ALL SELECT 'attr.k', count(DISTINCT attr_k), true FROM ranged"""),
    ),
    Query(
        "stored_service_summary", _stored_summary,
        with_ctes(d.LOGS, f"""SELECT service, total, error_rate, CASE WHEN error_rate >= 2.5 THEN 'DEGRADED' WHEN error_rate >= 1.0 THEN 'WARNING' ELSE 'HEALTHY' END AS status
            FROM (SELECT service, count(*) AS total, CAST(round(CAST(100 * count(*) FILTER (level = 'error') AS DECIMAL(18,8)) / count(*), 2) AS DOUBLE) AS error_rate
                  FROM logs WHERE {WHOLE_HOURS_SQL} GROUP BY service)"""),
    ),
    Query(
        "stored_newest", _stored_newest,
        with_ctes(d.LOGS, "SELECT id, timestamp, service FROM logs WHERE level = 'error' ORDER BY timestamp DESC, id DESC LIMIT 200"),
    ),
    Query("rollup_after_compaction", _rollup_after_compaction, with_ctes(d.ROLLUP, "SELECT * FROM rollup")),
    Query("stream_two_sources", lambda spark, sf: _halves(spark, sf, False), with_ctes(d.ROLLUP, "SELECT * FROM rollup")),
    Query("stream_new_checkpoint", lambda spark, sf: _halves(spark, sf, True), with_ctes(d.ROLLUP, "SELECT * FROM rollup")),
    Query(
        "quantile_with_nan", _odd_quantiles,
        """WITH odd AS (SELECT event_type, CASE WHEN event_id % 100 < 20 THEN 'NaN'::DOUBLE WHEN event_id % 100 < 25 THEN 'Infinity'::DOUBLE
             WHEN event_id % 100 < 30 THEN '-Infinity'::DOUBLE ELSE CAST(value AS DOUBLE) END AS value FROM events),
           ranked AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) - 1 AS last FROM odd WHERE value IS NOT NULL),
           picked AS (SELECT event_type, any_value(last) AS last,
             max(CASE WHEN i = ceil(0.9 * last) THEN value END) AS high90, max(CASE WHEN i = floor(0.01 * last) THEN value END) AS low1,
             max(CASE WHEN i = floor(0.4 * last) THEN value END) AS low40, max(CASE WHEN i = ceil(0.4 * last) THEN value END) AS high40 FROM ranked GROUP BY event_type)
           SELECT event_type, isnan(high90) AS p90_nan, low1 = '-Infinity'::DOUBLE AS p1_low,
             round(low40 + (0.4::DOUBLE * last - floor(0.4::DOUBLE * last)) * (high40 - low40), 6) AS p40 FROM picked""",
    ),
]
