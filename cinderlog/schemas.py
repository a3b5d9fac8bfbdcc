"""Table schemas and the fixed vocabularies of the log model."""

from pyspark.sql import types as T

# Accepted levels, and the supported bucket names with their length in minutes.
LEVELS = ("debug", "info", "warn", "error")
BUCKETS = {"1m": 1, "5m": 5, "1h": 60, "1d": 1440}

# Request limits.
DEFAULT_LIMIT = 100
MAX_LIMIT = 1000
MAX_BODY_BYTES = 20 * 1024 * 1024
FUTURE_SLACK_MINUTES = 5
ALERT_COOLDOWN_MINUTES = 10

ATTRIBUTES = T.MapType(T.StringType(), T.StringType())

LOGS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("timestamp", T.TimestampType(), False),
    T.StructField("level", T.StringType(), False),
    T.StructField("service", T.StringType(), False),
    T.StructField("message", T.StringType(), False),
    T.StructField("attributes", ATTRIBUTES, True),
])

# What the stored table has on top: these columns live in directory names.
STORED_LOGS = T.StructType(LOGS.fields + [
    T.StructField("log_date", T.DateType(), False),
    T.StructField("stream", T.LongType(), False),
    T.StructField("epoch", T.LongType(), False),
])

ROLLUP = T.StructType([
    T.StructField("bucket_start", T.TimestampType(), False),
    T.StructField("service", T.StringType(), False),
    T.StructField("level", T.StringType(), False),
    T.StructField("count", T.LongType(), False),
])

REJECTED = T.StructType([
    T.StructField("batch_id", T.LongType(), False),
    T.StructField("index", T.LongType(), False),
    T.StructField("reason", T.StringType(), False),
])

RULES = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("service", T.StringType(), True),
    T.StructField("threshold", T.IntegerType(), True),
    T.StructField("window_minutes", T.IntegerType(), True),
    T.StructField("webhook_url", T.StringType(), True),
    T.StructField("last_triggered_at", T.TimestampType(), True),
])

NOTIFICATIONS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("type", T.StringType(), False),
    T.StructField("title", T.StringType(), False),
    T.StructField("message", T.StringType(), False),
    T.StructField("service", T.StringType(), True),
    T.StructField("level", T.StringType(), True),
    T.StructField("is_read", T.BooleanType(), False),
    T.StructField("created_at", T.TimestampType(), False),
])
