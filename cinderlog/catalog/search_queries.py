"""Search, paging and export queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from cinderlog.catalog import datasets as d
from cinderlog.catalog.query import Query, with_ctes
from cinderlog.operators import search as ops
from cinderlog.operators.pages import search_offset
from cinderlog.plans.cursor import Cursor
from cinderlog.plans.spec import LogQuery
from cinderlog.schemas import LOGS
from cinderlog.sources.export import log_rows, read_csv, write_csv
from cinderlog.sources.tables import LogStore
from cinderlog.sources.workspace import new_folder

SINCE, UNTIL = datetime(2024, 1, 10, 0, 0, 30), datetime(2024, 1, 12, 0, 0, 30)
CURSOR = Cursor(datetime(2024, 1, 20, 12), 5_000)
COMBINED = {
    "service": "auth", "level": "warn,error", "since": "2024-01-05T00:00:00Z", "until": "2024-01-25T00:00:00+02:00",
    "q": "user_1", "limit": "200",
}
FEED = "service:checkout level:error other:word unused% load"

COLUMNS = "id, timestamp, level, service, message, attributes"
NEWEST = "ORDER BY timestamp DESC, id DESC"


def shown(df):
    """Result rows with the attributes as text."""
    return df.select("id", "timestamp", "level", "service", "message", F.to_json("attributes").alias("attributes"))


def _filter(query: LogQuery):
    return lambda spark, sf: shown(ops.filter_logs(d.logs(spark, sf), query))


def _page(query: LogQuery):
    return lambda spark, sf: shown(ops.search(d.logs(spark, sf), query))


def _deep(query: LogQuery):
    """A page behind the first quarter of all matching rows, looked up in the counts however small the table is."""
    def run(spark, sf):
        logs = d.logs(spark, sf)
        page = ops.total(logs, query).first()["total"] // (4 * query.limit) + 2
        return shown(search_offset(logs, query, page, d.rollup(spark, sf), shallow=0))

    return run


def _sql(rest: str) -> str:
    return with_ctes(d.LOGS, f"SELECT {COLUMNS} FROM logs {rest}")


def _page2(spark, sf):
    """The page behind the first one, whose cursor is the only thing that reaches the driver."""
    logs = d.logs(spark, sf)
    first = ops.search(logs, LogQuery(limit=37))
    cursor = ops.next_cursor(first, 37).first()["next_cursor"]
    return shown(ops.search(logs, LogQuery(limit=37, cursor=Cursor.decode(cursor) if cursor else None)))


def _export(spark, sf):
    path = new_folder(spark, "logs-csv")
    write_csv(log_rows(d.documents(spark, sf)), path)
    return read_csv(spark, path, "`Timestamp` string, `Level` string, `Service` string, `Message` string")


def _response(spark, sf):
    found = ops.search_response(d.logs(spark, sf), LogQuery(service="auth", limit=37))
    ids = F.array_join(F.transform("logs", lambda row: row["id"].cast("string")), ",")
    return found.select(ids.alias("ids"), "total", "next_cursor")


def _signed(query: LogQuery):
    """All matching rows of stored and signed logs, read from the files that may hold the text."""
    def run(spark, sf):
        store = LogStore(spark, new_folder(spark, "signed-logs"))
        store.append_logs(d.logs(spark, sf).select(*LOGS.names).withColumn("timestamp", F.col("timestamp").cast("timestamp")), 0)
        store.sign_logs()
        found = ops.filter_logs(store.logs(query.since, query.until, query.q), query)
        return shown(found.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz")))

    return run


QUERIES = [
    Query(
        "search_response", _response,
        with_ctes(d.LOGS + f", found AS (SELECT * FROM logs WHERE service = 'auth'), page AS (SELECT timestamp, id FROM found {NEWEST} LIMIT 37)", """
            SELECT (SELECT string_agg(CAST(id AS VARCHAR), ',' ORDER BY timestamp DESC, id DESC) FROM page) AS ids, (SELECT count(*) FROM found) AS total,
                   CASE WHEN (SELECT count(*) FROM page) = 37 THEN base64(encode(concat('{"timestamp":"', strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%f'), 'Z","id":', CAST(id AS VARCHAR), '}'))) END AS next_cursor
            FROM page ORDER BY timestamp, id LIMIT 1"""),
    ),
    Query("search_service", _filter(LogQuery(service="checkout")), _sql("WHERE service = 'checkout'")),
    Query("search_levels", _filter(LogQuery(levels=("warn", "error"))), _sql("WHERE level IN ('warn', 'error')")),
    Query(
        "search_range", _filter(LogQuery(since=SINCE, until=UNTIL)),
        _sql("WHERE timestamp >= TIMESTAMP '2024-01-10 00:00:30' AND timestamp < TIMESTAMP '2024-01-12 00:00:30'"),
    ),
    Query(
        "search_text", lambda spark, sf: ops.filter_logs(d.documents(spark, sf), LogQuery(q="über")).select("id", "level", "service", "message"),
        with_ctes(d.DOCS, "SELECT id, level, service, message FROM docs WHERE message ILIKE '%über%'"),
    ),
    Query("search_text_wildcard", _filter(LogQuery(q="BY USER_1%5%")), _sql("WHERE message ILIKE '%BY USER_1%5%%'")),
    Query(
        "search_text_signed", _signed(LogQuery(q="BY user_1_ at 9%")),
        _sql("WHERE message ILIKE '%by user_1_ at 9%%'"),
    ),
    Query("search_attr", _filter(LogQuery(attributes={"k": "1"})), _sql("WHERE attr_k = '1'")),
    Query(
        "search_attr_multi", _filter(LogQuery(attributes={"k": "1", "user_id": "2"})),
        _sql("WHERE attr_k = '1' AND attr_user_id = '2'"),
    ),
    Query(
        "search_cursor", _page(LogQuery(cursor=CURSOR, limit=1000)),
        _sql(f"""WHERE timestamp < TIMESTAMP '2024-01-20 12:00:00' OR (timestamp = TIMESTAMP '2024-01-20 12:00:00' AND id < 5000)
                 {NEWEST} LIMIT 1000"""),
    ),
    Query(
        "search_combined", _page(LogQuery.from_params(COMBINED)),
        _sql(f"""WHERE service = 'auth' AND level IN ('warn', 'error') AND timestamp >= TIMESTAMP '2024-01-05 00:00:00'
                 AND timestamp < TIMESTAMP '2024-01-24 22:00:00' AND message ILIKE '%user_1%' {NEWEST} LIMIT 200"""),
    ),
    Query(
        "search_last_24h",
        lambda spark, sf: shown(ops.filter_logs(d.logs(spark, sf), LogQuery.from_explorer(d.NOW, "24h", levels=("debug", "info", "warn", "error")))),
        _sql("WHERE timestamp >= TIMESTAMP '2024-01-29 12:34:56.789'"),
    ),
    Query(
        "feed_query", _page(LogQuery.from_feed(FEED)),
        _sql(f"WHERE service = 'checkout' AND level = 'error' AND message ILIKE '%load%' {NEWEST} LIMIT 50"),
    ),
    Query("search_latest", _page(LogQuery()), _sql(f"{NEWEST} LIMIT 100")),
    Query("search_page2", _page2, _sql(f"{NEWEST} LIMIT 37 OFFSET 37")),
    Query(
        "next_cursor", lambda spark, sf: ops.next_cursor(ops.search(d.logs(spark, sf), LogQuery(limit=37)), 37),
        with_ctes(d.LOGS + f", page AS (SELECT timestamp, id FROM logs {NEWEST} LIMIT 37)", """
            SELECT (SELECT count(*) FROM page) AS n_rows,
                   base64(encode(concat('{"timestamp":"', strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%f'), 'Z","id":', CAST(id AS VARCHAR), '}'))) AS next_cursor
            FROM page ORDER BY timestamp, id LIMIT 1"""),
    ),
    Query(
        "search_offset_page", lambda spark, sf: shown(search_offset(d.logs(spark, sf), LogQuery(limit=100), 3)),
        _sql(f"{NEWEST} LIMIT 100 OFFSET 200"),
    ),
    Query(
        "search_offset_deep", _deep(LogQuery(limit=100)),
        _sql(f"{NEWEST} LIMIT 100 OFFSET (SELECT count(*) // 400 * 100 + 100 FROM logs)"),
    ),
    Query(
        "search_offset_deep_text", _deep(LogQuery(q="by user_1", since=SINCE, limit=20)),
        with_ctes(d.LOGS + ", found AS (SELECT * FROM logs WHERE message ILIKE '%by user_1%' AND timestamp >= TIMESTAMP '2024-01-10 00:00:30')",
                  f"SELECT {COLUMNS} FROM found {NEWEST} LIMIT 20 OFFSET (SELECT count(*) // 80 * 20 + 20 FROM found)"),
    ),
    Query(
        "search_total", lambda spark, sf: ops.total(d.logs(spark, sf), LogQuery.from_params(COMBINED)),
        with_ctes(d.LOGS, """SELECT count(*) AS total FROM logs WHERE service = 'auth' AND level IN ('warn', 'error')
            AND timestamp >= TIMESTAMP '2024-01-05 00:00:00' AND timestamp < TIMESTAMP '2024-01-24 22:00:00' AND message ILIKE '%user_1%'"""),
    ),
    Query(
        "log_detail", lambda spark, sf: ops.log_detail(d.logs(spark, sf)),
        with_ctes(d.LOGS, """SELECT id, strftime(date_trunc('millisecond', timestamp), '%Y-%m-%d %H:%M:%S.%g') AS time, upper(level) AS level,
            service, message, attributes FROM logs"""),
    ),
    Query(
        "export_logs_csv", _export,
        with_ctes(d.DOCS, """SELECT strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%gZ') AS "Timestamp", level AS "Level",
            service AS "Service", message AS "Message" FROM docs"""),
    ),
]

