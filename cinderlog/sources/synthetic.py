"""Generated logs for load tests: the same number always gives the same row."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderlog.functions.times import epoch_micros
from cinderlog.schemas import LEVELS

# Service names, level weights by repetition.
SERVICES = (
    "checkout", "auth", "inventory-api", "payment-gateway",
    "frontend-web", "worker-node", "proxy-ingress", "database-master",
)
LEVEL_WEIGHTS = ("debug", "info", "info", "info", "warn", "warn", "error")
HOSTS, BUILDS, USERS, ATTEMPTS = 240, 36, 5_000, 6
SPREAD_DAYS = 30
TEXTS = {
    "debug": ("parsed 14 header fields", "index segment merged", "timer wheel advanced"),
    "info": ("snapshot 12 uploaded", "worker joined the ring", "schema check passed"),
    "warn": ("clock drift of 41 ms", "queue holds 6,000 items", "lease renewed late"),
    "error": ("checksum mismatch in block 9", "leader lost its quorum", "image could not be decoded"),
}

CYCLE_SERVICES = ("ledger", "search", "mailer")


def draw(number: Column, salt: int, size: int) -> Column:
    """A scattered choice out of `size`, from plain integer arithmetic."""
    mixed = F.pmod(F.pmod(number, F.lit(1_000_003)) * 7919 + salt * 104_729, F.lit(1_000_003))
    return F.pmod(mixed * 48_271, F.lit(2_147_483_647)) % size


def _pick(values: tuple[str, ...], number: Column, salt: int) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (draw(number, salt, len(values)) + 1).cast("int"))


def logs_from(numbers: DataFrame, as_of: datetime, days: int = SPREAD_DAYS) -> DataFrame:
    """Log rows from a DataFrame with a column `id`, spread over the days before `as_of`."""
    n = F.col("id")
    seconds = draw(n, 1, days * 86_400)
    level, service = _pick(LEVEL_WEIGHTS, n, 2), _pick(SERVICES, n, 3)
    message = None
    for name, texts in TEXTS.items():
        text = _pick(texts, n, 4)
        message = F.when(F.col("level") == name, text) if message is None else message.when(F.col("level") == name, text)

    def entry(key: str, value: Column, condition: Column | None = None) -> Column:
        pair = F.create_map(F.lit(key), value)
        return pair if condition is None else F.when(condition, pair).otherwise(F.create_map().cast("map<string,string>"))

    # Three rows in four have a user; only what went wrong says which attempt it was.
    attributes = F.map_concat(
        entry("host", F.concat(F.lit("node-"), draw(n, 5, HOSTS).cast("string"))),
        entry("build", F.concat(F.lit("b"), draw(n, 6, BUILDS).cast("string"))),
        entry("user_id", draw(n, 8, USERS).cast("string"), draw(n, 7, 4) > 0),
        entry("attempt", (draw(n, 9, ATTEMPTS) + 1).cast("string"), F.col("level").isin("warn", "error")),
    )
    rows = numbers.select(
        n, F.timestamp_micros(F.lit(epoch_micros(as_of)) - seconds * 1_000_000).alias("timestamp"),
        level.alias("level"), service.alias("service"),
    )
    return rows.select("id", "timestamp", "level", "service", message.alias("message"), attributes.alias("attributes"))


def synthetic_logs(spark: SparkSession, rows: int, as_of: datetime, days: int = SPREAD_DAYS) -> DataFrame:
    return logs_from(spark.range(rows), as_of, days)


def cyclic_logs(numbers: DataFrame, as_of: datetime) -> DataFrame:
    """Rows of one instant with levels and services in turn."""
    n = F.col("id")

    def turn(values: tuple[str, ...]) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), (F.pmod(n, F.lit(len(values))) + 1).cast("int"))

    return numbers.select(
        n, F.timestamp_micros(F.lit(epoch_micros(as_of))).alias("timestamp"), turn(LEVELS).alias("level"), turn(CYCLE_SERVICES).alias("service"),
        F.concat(F.lit("row "), n.cast("string"), F.lit(" of a cycle")).alias("message"),
        F.create_map(F.lit("shard"), F.pmod(n, F.lit(11)).cast("string")).alias("attributes"),
    )


def as_bodies(logs: DataFrame, batch_size: int) -> DataFrame:
    """Wrap rows as JSON batches (batch_id, body) of `batch_size` entries."""
    entry = F.to_json(F.struct(
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"),
        "level", "service", "message", "attributes",
    ))
    return bodies_of(logs.select(F.col("id").alias("number"), entry.alias("entry")), batch_size)


def bodies_of(entries: DataFrame, batch_size: int) -> DataFrame:
    """Batches from numbered entry texts; each group has at most `batch_size` of them."""
    batch = ((F.col("number") - F.pmod(F.col("number"), F.lit(batch_size))) / batch_size).cast("long")
    items = F.sort_array(F.collect_list(F.struct("number", "entry")))
    grouped = entries.groupBy(batch.alias("batch_id")).agg(items.alias("items"))
    texts = F.array_join(F.transform("items", lambda x: x["entry"]), ",")
    return grouped.select("batch_id", F.concat(F.lit('{"logs":['), texts, F.lit("]}")).alias("body"))
