"""CSV exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderlog.functions.times import iso_millis


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; only cells with a comma, a quote or a line break are quoted, a quote is
    doubled, spaces stay, and empty and missing cells are both empty."""
    (
        df.write.mode("overwrite")
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("emptyValue", "")
        .option("nullValue", "")
        .csv(path)
    )


def read_csv(spark, path: str, schema: str) -> DataFrame:
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", True)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def log_rows(logs: DataFrame) -> DataFrame:
    return logs.select(
        iso_millis(F.col("timestamp")).alias("Timestamp"), F.col("level").alias("Level"),
        F.col("service").alias("Service"), F.col("message").alias("Message"),
    )


def storage_rows(storage: DataFrame) -> DataFrame:
    """The storage breakdown as shown: one decimal for the share, two for the size."""
    share = F.concat(F.col("pct").cast("decimal(5,1)").cast("string"), F.lit("%"))
    size = F.concat(F.col("storage_kb").cast("decimal(20,2)").cast("string"), F.lit(" KB"))
    return storage.select(
        F.col("service").alias("Service"), F.col("count").cast("string").alias("Events (24h)"),
        share.alias("% of Total"), size.alias("Est. Storage"),
    )
