"""Batch opening, validation, storing and the ingest stream."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinderlog.catalog import datasets as d
from cinderlog.catalog.query import Query, with_ctes
from cinderlog.functions.times import literal_like
from cinderlog.operators import validation as v
from cinderlog.sources.batches import MALFORMED, NO_ARRAY, bad_batches, open_batches
from cinderlog.sources.synthetic import ATTEMPTS, BUILDS, HOSTS, LEVEL_WEIGHTS, SERVICES, TEXTS, USERS, cyclic_logs, logs_from
from cinderlog.sources.tables import LogStore
from cinderlog.sources.workspace import new_folder
from cinderlog.streaming.ingest import ingest_stream



def _opened(spark, sf):
    return open_batches(d.bodies(spark, sf))


def _checked(spark, sf):
    return v.validate(_opened(spark, sf), literal_like(d.INGEST_TIME, T.TimestampType()))


def _plain(df):
    """Comparable types: the time without zone, the attributes as text."""
    columns = {
        "timestamp": F.col("timestamp").cast("timestamp_ntz"),
        "attributes": F.to_json("attributes"),
    }
    return df.withColumns({name: column for name, column in columns.items() if name in df.columns})


def _explode(spark, sf):
    def text(name):
        return F.try_variant_get("entry", f"$.{name}", "string").alias(name)

    entries = _opened(spark, sf).where("index IS NOT NULL")
    return entries.select("batch_id", "index", F.regexp_extract(F.schema_of_variant("entry"), "^[A-Z]+", 0).alias("kind"), text("level"), text("service"), text("message"))


def _bad(spark, sf):
    return bad_batches(_opened(spark, sf)).select("batch_id", F.col("batch_error").alias("reason"))


def _results(spark, sf):
    results = v.batch_results(_checked(spark, sf))
    return results.withColumn("rejected", F.to_json("rejected"))


def _attributes(spark, sf):
    opened = _opened(spark, sf).where("index IS NOT NULL")
    values = v.normalize_attributes(F.try_variant_get("entry", "$.attributes", "variant"))
    return opened.select("batch_id", "index", F.to_json(values).alias("attributes"))


def _append(spark, sf):
    """Write the accepted rows twice, as a replayed epoch would, and read the table."""
    store = LogStore(spark, new_folder(spark, "logs"))
    rows = v.with_ids(v.accepted(_checked(spark, sf), "batch_id"))
    store.append_logs(rows, 0)
    store.append_logs(rows, 0)
    return _plain(store.logs().drop("stream", "epoch"))


def _land(spark, sf):
    """The batches as files, one body each."""
    path = new_folder(spark, "landing")
    d.bodies(spark, sf).select("body").write.option("maxRecordsPerFile", 1).text(path)
    return path


def _stream(spark, sf):
    store = LogStore(spark, new_folder(spark, "ingest"))
    ingest_stream(store, _land(spark, sf), store.path("checkpoint"), as_of=d.INGEST_TIME).awaitTermination()
    return _plain(store.logs().drop("id", "stream", "epoch", "log_date"))


def _stream_lines(spark, sf):
    """The batches as lines of a few files."""
    store, path = LogStore(spark, new_folder(spark, "ingest")), new_folder(spark, "landing-lines")
    d.bodies(spark, sf).select("body").repartition(3).write.text(path)
    ingest_stream(store, path, store.path("checkpoint"), as_of=d.INGEST_TIME, max_files=2, lines=True).awaitTermination()
    return _plain(store.logs().drop("id", "stream", "epoch", "log_date"))


def _synthetic(spark, sf):
    numbers = d.table(spark, sf, "events").select(F.col("event_id").alias("id"))
    return _plain(logs_from(numbers, datetime(2024, 1, 31)))


def _cyclic(spark, sf):
    numbers = d.table(spark, sf, "events").select(F.col("event_id").alias("id"))
    return _plain(cyclic_logs(numbers, datetime(2024, 1, 31)))


def _draw_sql(salt: int, size: int) -> str:
    return f"((((id % 1000003) * 7919 + {salt} * 104729) % 1000003 * 48271) % 2147483647) % {size}"


def _pick_sql(values, salt: int) -> str:
    items = ", ".join(f"'{x}'" for x in values)
    return f"[{items}][{_draw_sql(salt, len(values))} + 1]"


def _synthetic_sql() -> str:
    texts = " ".join(f"WHEN '{level}' THEN {_pick_sql(values, 4)}" for level, values in TEXTS.items())
    base = f"""numbers AS (SELECT event_id AS id FROM events),
    rows AS (SELECT id, TIMESTAMP '2024-01-31 00:00:00' - ({_draw_sql(1, 30 * 86400)}) * INTERVAL 1 SECOND AS timestamp,
                    {_pick_sql(LEVEL_WEIGHTS, 2)} AS level, {_pick_sql(SERVICES, 3)} AS service FROM numbers)"""
    return with_ctes(base, f"""
        SELECT id, timestamp, level, service, CASE level {texts} END AS message,
          concat('{{"host":"node-', CAST({_draw_sql(5, HOSTS)} AS VARCHAR), '","build":"b', CAST({_draw_sql(6, BUILDS)} AS VARCHAR), '"',
            CASE WHEN {_draw_sql(7, 4)} > 0 THEN concat(',"user_id":"', CAST({_draw_sql(8, USERS)} AS VARCHAR), '"') ELSE '' END,
            CASE WHEN level IN ('warn', 'error') THEN concat(',"attempt":"', CAST({_draw_sql(9, ATTEMPTS)} + 1 AS VARCHAR), '"') ELSE '' END,
            '}}') AS attributes FROM rows""")


ACCEPTED_SQL = "SELECT {columns} FROM opened WHERE reason IS NULL"
ROW = "timestamp, level, service, message, attributes"

QUERIES = [
    Query(
        "ingest_explode", _explode,
        with_ctes(d.ENTRIES, """SELECT batch_id, index, CASE kind WHEN 16 THEN 'VOID' WHEN 17 THEN 'ARRAY' WHEN 18 THEN 'STRING' ELSE 'OBJECT' END AS kind,
            CASE WHEN kind = 3 THEN 'critical' WHEN kind = 19 THEN 'loud' WHEN kind IN (4, 16, 17, 18) THEN NULL ELSE level END AS level,
            CASE WHEN kind = 5 THEN '  ' WHEN kind = 19 THEN ' ' WHEN kind BETWEEN 16 AND 18 THEN NULL ELSE service END AS service,
            CASE WHEN kind = 6 THEN '' WHEN kind BETWEEN 16 AND 18 THEN NULL ELSE message END AS message FROM opened"""),
    ),
    Query(
        "ingest_bad_batches", _bad,
        with_ctes(d.ENTRIES, f"""SELECT DISTINCT batch_id, CASE batch_id % 7 WHEN 1 THEN '{MALFORMED}' ELSE '{NO_ARRAY.replace("'", "''")}' END AS reason
            FROM entries WHERE batch_id % 7 IN (1, 2, 3)"""),
    ),
    Query(
        "validate_accepted", lambda spark, sf: _plain(v.accepted(_checked(spark, sf), "batch_id")),
        with_ctes(d.ENTRIES, ACCEPTED_SQL.format(columns="batch_id, index, " + ROW)),
    ),
    Query(
        "validate_rejected", lambda spark, sf: v.rejected(_checked(spark, sf), "batch_id"),
        with_ctes(d.ENTRIES, "SELECT batch_id, index, reason FROM opened WHERE reason IS NOT NULL"),
    ),
    Query(
        "batch_result", _results,
        with_ctes(d.ENTRIES + """,
            results AS (SELECT batch_id, batch_id % 7 AS fate, count(*) FILTER (reason IS NULL) AS good,
              coalesce(string_agg(concat('{"index":', index, ',"reason":"', reason, '"}'), ',' ORDER BY index) FILTER (reason IS NOT NULL), '') AS bad
              FROM entries GROUP BY batch_id)""", f"""
            SELECT batch_id, CASE WHEN fate IN (1, 2, 3, 4) THEN 0 ELSE good END AS accepted,
              concat('[', CASE WHEN fate IN (1, 2, 3, 4) THEN '' ELSE bad END, ']') AS rejected,
              CASE fate WHEN 1 THEN '{MALFORMED}' WHEN 2 THEN '{NO_ARRAY.replace("'", "''")}' WHEN 3 THEN '{NO_ARRAY.replace("'", "''")}' END AS error,
              CAST(CASE WHEN fate NOT IN (1, 2, 3, 4) AND good > 0 THEN 200 ELSE 400 END AS INTEGER) AS status FROM results"""),
    ),
    Query(
        "normalize_attributes", _attributes,
        with_ctes(d.ENTRIES, """SELECT batch_id, index, CASE WHEN kind BETWEEN 7 AND 12 OR kind BETWEEN 16 AND 18 THEN NULL
            ELSE concat('{"resolved":"false","retries":"3","user_id":"', regexp_extract(message, 'user_([0-9]+)', 1), '"}') END AS attributes FROM opened"""),
    ),
    Query(
        "logs_append", _append,
        with_ctes(d.ENTRIES, ACCEPTED_SQL.format(columns=f"batch_id * 16777216 + index AS id, {ROW}, CAST(timestamp AS DATE) AS log_date")),
    ),
    Query("stream_ingest", _stream, with_ctes(d.ENTRIES, ACCEPTED_SQL.format(columns=ROW))),
    Query("stream_ingest_lines", _stream_lines, with_ctes(d.ENTRIES, ACCEPTED_SQL.format(columns=ROW))),
    Query("synthetic_logs", _synthetic, _synthetic_sql()),
    Query(
        "synthetic_cycle", _cyclic,
        """SELECT event_id AS id, TIMESTAMP '2024-01-31 00:00:00' AS timestamp, ['debug', 'info', 'warn', 'error'][event_id % 4 + 1] AS level,
          ['ledger', 'search', 'mailer'][event_id % 3 + 1] AS service, concat('row ', event_id, ' of a cycle') AS message,
          concat('{"shard":"', event_id % 11, '"}') AS attributes FROM events""",
    ),
]
