"""Session settings the engine relies on."""

from pyspark.sql import SparkSession

# Runtime settings, safe to apply to a session somebody else created.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    # A JSON object that repeats a key keeps the last value instead of being malformed.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # A micro-batch lists its files anew; the default is a task per file, which takes longer to schedule than to run.
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "64",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("cinderlog")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
    )
    spark = configure(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark
