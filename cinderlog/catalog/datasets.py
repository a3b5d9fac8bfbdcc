"""The given tables seen as logs, rules, batches and notifications, in Spark and in SQL.

Both sides spell out the same mapping, so that results can be compared.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderlog.operators.rollup import build_rollup
from cinderlog.sources.synthetic import SERVICES, bodies_of

# The instants queries are asked at: on a minute for alerts, off it for the dashboard's edges.
AS_OF = datetime(2024, 1, 31)
NOW = datetime(2024, 1, 30, 12, 34, 56, 789000)
INGEST_TIME = datetime(2024, 2, 1)
BATCH = 100

_LEVEL = {"error": "error", "purchase": "warn", "view": "debug"}


def _cases(subject: str, values: dict, other: str) -> str:
    arms = " ".join(f"WHEN {key!r} THEN {value!r}" for key, value in values.items())
    return f"CASE {subject} {arms} ELSE {other} END"


LEVEL_SQL = _cases("event_type", _LEVEL, "'info'")
SERVICE_SQL = _cases("user_id % 8", dict(enumerate(SERVICES[:7])), f"'{SERVICES[7]}'")
RULE_SERVICE_SQL = _cases("s_suppkey % 11", {**dict(enumerate(SERVICES)), 8: "nosuch", 9: ""}, "NULL")
RULE_WINDOW_SQL = "CASE s_suppkey % 7 WHEN 0 THEN 15 WHEN 1 THEN 60 WHEN 2 THEN 360 WHEN 3 THEN 0 ELSE 1440 END"
RULE_URL_SQL = "CASE WHEN s_suppkey % 13 = 0 THEN '' ELSE concat('http://example.invalid/', CAST(s_suppkey AS {text})) END"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as logs, with the event's value as the duration."""
    k = F.get_json_object("props", "$.k")
    user = F.col("user_id").cast("string")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("ts").alias("timestamp"),
        F.expr(LEVEL_SQL).alias("level"),
        F.expr(SERVICE_SQL).alias("service"),
        F.concat(F.upper("event_type"), F.lit(" by user_"), user, F.lit(" at "), k, F.lit("% load")).alias("message"),
        F.create_map(F.lit("k"), k, F.lit("user_id"), user).alias("attributes"),
        F.col("value").alias("duration_ms"),
    )


LOGS = f"""logs AS (
  SELECT event_id AS id, ts AS timestamp, {LEVEL_SQL} AS level, {SERVICE_SQL} AS service,
         concat(upper(event_type), ' by user_', CAST(user_id AS VARCHAR), ' at ', json_extract_string(props, '$.k'), '% load') AS message,
         json_extract_string(props, '$.k') AS attr_k, CAST(user_id AS VARCHAR) AS attr_user_id,
         concat('{{"k":"', json_extract_string(props, '$.k'), '","user_id":"', CAST(user_id AS VARCHAR), '"}}') AS attributes,
         value AS duration_ms
  FROM events)"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents` as logs, one per minute: long multilingual messages."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, CAST(doc_id AS INT))").alias("timestamp"),
        F.expr("CASE doc_id % 4 WHEN 0 THEN 'debug' WHEN 1 THEN 'info' WHEN 2 THEN 'warn' ELSE 'error' END").alias("level"),
        F.col("source").alias("service"),
        F.col("text").alias("message"),
        F.create_map(F.lit("lang"), F.col("lang")).alias("attributes"),
    )


DOCS = """docs AS (
  SELECT doc_id AS id, TIMESTAMP '2024-01-01 00:00:00' + doc_id * INTERVAL 1 MINUTE AS timestamp,
         CASE doc_id % 4 WHEN 0 THEN 'debug' WHEN 1 THEN 'info' WHEN 2 THEN 'warn' ELSE 'error' END AS level,
         source AS service, text AS message, lang AS attr_lang
  FROM documents)"""


def rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_rollup(logs(spark, sf_dir))


ROLLUP = f"""{LOGS},
rollup AS (
  SELECT date_trunc('minute', timestamp) AS bucket_start, service, level, count(*) AS count
  FROM logs GROUP BY ALL)"""


def deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The roll-up as two flushes wrote it: odd and even rows, so keys occur in both."""
    flushed = logs(spark, sf_dir).withColumn("epoch", F.pmod("id", F.lit(2)))
    return build_rollup(flushed, "epoch")


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One alert rule per supplier, some of them incomplete, some in cooldown."""
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("id"),
        F.expr(RULE_SERVICE_SQL).alias("service"),
        F.expr("CAST(s_suppkey % 23 - 1 AS INT)").alias("threshold"),
        F.expr(f"CAST({RULE_WINDOW_SQL} AS INT)").alias("window_minutes"),
        F.expr(RULE_URL_SQL.format(text="STRING")).alias("webhook_url"),
        F.expr("""CASE s_suppkey % 4 WHEN 1 THEN timestamp_ntz'2024-01-30 23:51:00'
                  WHEN 2 THEN timestamp_ntz'2024-01-30 23:50:00' WHEN 3 THEN timestamp_ntz'2024-01-20 00:00:00' END""")
        .alias("last_triggered_at"),
    )


RULES = f"""rules AS (
  SELECT s_suppkey AS id, {RULE_SERVICE_SQL} AS service, CAST(s_suppkey % 23 - 1 AS INTEGER) AS threshold,
         CAST({RULE_WINDOW_SQL} AS INTEGER) AS window_minutes, {RULE_URL_SQL.format(text="VARCHAR")} AS webhook_url,
         CASE s_suppkey % 4 WHEN 1 THEN TIMESTAMP '2024-01-30 23:51:00' WHEN 2 THEN TIMESTAMP '2024-01-30 23:50:00'
              WHEN 3 THEN TIMESTAMP '2024-01-20 00:00:00' END AS last_triggered_at
  FROM supplier),
valid_rules AS (
  SELECT id, nullif(service, '') AS service, threshold, window_minutes, webhook_url, last_triggered_at
  FROM rules WHERE threshold <> 0 AND window_minutes <> 0 AND webhook_url <> '')"""


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as entry texts (number, entry), all but four of twenty spoiled: one in two ways, three are no objects."""
    kind = F.pmod("id", F.lit(20))

    def spoiled(normal, cases: dict):
        value = None
        for number, text in cases.items():
            value = F.when(kind == number, text) if value is None else value.when(kind == number, text)
        return value.otherwise(normal)

    def quoted(name, value):
        return F.concat(F.lit(f'"{name}":"'), value, F.lit('"'))

    stamp = F.concat(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    user = F.col("attributes")["user_id"]
    good = F.concat(F.lit('"attributes":{"user_id":"'), user, F.lit('","retries":3,"resolved":false}'))
    parts = [
        quoted("timestamp", spoiled(stamp, {0: "", 1: "not-a-date", 2: "2024-02-01T00:05:00.001Z"})),
        spoiled(quoted("level", F.col("level")), {3: '"level":"critical"', 4: None, 19: '"level":"loud"'}),
        quoted("service", spoiled(F.col("service"), {5: "  ", 19: " "})),
        quoted("message", spoiled(F.col("message"), {6: ""})),
        spoiled(good, {
            7: '"attributes":{"z":1,"user":{"id":"42"}}', 8: '"attributes":{"tags":["a","b"]}',
            9: '"attributes":[1,2,3]', 10: '"attributes":"hello"', 11: '"attributes":{"z":1,"a":null}',
            12: '"attributes":null',
        }),
    ]
    text = spoiled(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")), {16: "null", 17: '[1,{"level":"info"}]', 18: '"text"'})
    return logs(spark, sf_dir).select(F.col("id").alias("number"), text.alias("entry"))


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries in batches; some bodies are cut short, misnamed, no array, or empty."""
    number = F.pmod("batch_id", F.lit(7))
    body = (
        F.when(number == 1, F.expr("left(body, length(body) - 1)"))
        .when(number == 2, F.replace("body", F.lit('{"logs":'), F.lit('{"rows":')))
        .when(number == 3, F.concat(F.lit('{"logs":{"first":'), F.expr("substr(body, 9)"), F.lit("}")))
        .when(number == 4, '{"logs":[]}')
        .otherwise(F.col("body"))
    )
    return bodies_of(entries(spark, sf_dir), BATCH).select("batch_id", body.alias("body"))


# What validation must say about each entry, told from how it was spoiled.
ENTRIES = f"""{LOGS},
entries AS (
  SELECT id, id // {BATCH} AS batch_id, id % {BATCH} AS index, id % 20 AS kind,
         CASE id % 20 WHEN 0 THEN 'timestamp is required' WHEN 1 THEN 'invalid timestamp'
              WHEN 2 THEN 'timestamp too far in the future' WHEN 3 THEN 'invalid level: ''critical'''
              WHEN 4 THEN 'invalid level: ''undefined''' WHEN 5 THEN 'service is required' WHEN 6 THEN 'message is required'
              WHEN 7 THEN 'nested object in attribute ''user''' WHEN 8 THEN 'nested object in attribute ''tags'''
              WHEN 9 THEN 'attributes must be a flat object' WHEN 10 THEN 'attributes must be a flat object'
              WHEN 11 THEN 'invalid attribute value for ''a'''
              WHEN 16 THEN 'entry must be an object' WHEN 17 THEN 'entry must be an object' WHEN 18 THEN 'entry must be an object'
              WHEN 19 THEN 'invalid level: ''loud''' END AS reason,
         date_trunc('second', timestamp) AS timestamp, level, service, message,
         CASE WHEN id % 20 BETWEEN 13 AND 15 THEN concat('{{"resolved":"false","retries":"3","user_id":"', attr_user_id, '"}}') END AS attributes
  FROM logs),
opened AS (SELECT * FROM entries WHERE batch_id % 7 NOT IN (1, 2, 3, 4))"""


def notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.pmod("id", F.lit(2)) == 0
    return logs(spark, sf_dir).select(
        "id", F.when(even, "alert").otherwise("retention").alias("type"),
        F.concat(F.lit("Notice "), F.col("id").cast("string")).alias("title"), "message", "service", "level",
        (F.pmod("id", F.lit(3)) == 0).alias("is_read"), F.col("timestamp").alias("created_at"),
    )


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("event_type = 'click'").select(F.col("event_id").alias("id"))


NOTIFICATIONS = f"""{LOGS},
notifications AS (
  SELECT id, CASE WHEN id % 2 = 0 THEN 'alert' ELSE 'retention' END AS type,
         concat('Notice ', CAST(id AS VARCHAR)) AS title, message, service, level, id % 3 = 0 AS is_read, timestamp AS created_at
  FROM logs),
receipts AS (SELECT event_id AS id FROM events WHERE event_type = 'click')"""
