"""JSON batches: bodies of the form {"logs": [...]}, one row per batch, opened to one row per entry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cinderlog.schemas import MAX_BODY_BYTES

# What is wrong with a body that holds no entries to validate.
MALFORMED = "malformed JSON"
TOO_LARGE = "payload too large"
NO_ARRAY = "body must contain a 'logs' array"

# Numbers whose text may have to be written anew: with an exponent, or below a millionth.
EXPONENT_VALUE = r":\s*-?(?:[0-9.]+[eE][+-]?[0-9]+|0\.0{6}[0-9]*)\s*[,}]"


def read_bodies(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(source_file, body): one file per batch, or with `lines` one line of a file."""
    if lines:
        return numbered_lines(_lines(spark.read.option("lineSep", "\n").text(path)))
    return _named(spark.read.text(path, wholetext=True))


def stream_bodies(spark: SparkSession, path: str, max_files: int | None, lines: bool = False, max_bytes: int | None = None) -> DataFrame:
    """Files as bodies; with `lines` rows that `numbered_lines` makes bodies of, in each micro-batch.

    A micro-batch has max_files files, or if that is None max_bytes of files (one file at least).
    """
    limit = ("maxBytesPerTrigger", max_bytes) if max_files is None else ("maxFilesPerTrigger", max_files)
    reader = spark.readStream.option(*limit)
    return _lines(reader.option("lineSep", "\n").text(path)) if lines else _named(reader.text(path, wholetext=True))


def _lines(read: DataFrame) -> DataFrame:
    return read.select(
        F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("block"),
        F.regexp_replace("value", "\r$", "").alias("body"),
    )


def numbered_lines(rows: DataFrame) -> DataFrame:
    """Each line of a file as a batch of its own, named by the file and the line's number; blank lines are none.

    Files are read in blocks, by as many tasks as there are. A block's lines come in order from one task; how many
    lines the blocks before hold, a row per block, makes their numbers those of the file.
    """
    placed = rows.withColumn("_place", F.monotonically_increasing_id())
    blocks = placed.groupBy("source_file", "block").agg(F.min("_place").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("source_file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("source_file", "block", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    named = placed.where(F.trim("body") != "").join(F.broadcast(blocks), ["source_file", "block"])
    name = F.concat("source_file", F.lit("#"), (F.col("_place") + F.col("_shift")).cast("string"))
    return named.withColumn("source_file", name).drop("block", "_place", "_shift")


def _named(files: DataFrame) -> DataFrame:
    return files.select(F.col("_metadata.file_path").alias("source_file"), F.col("value").alias("body"))


def is_nested(value: Column) -> Column:
    kind = F.schema_of_variant(value)
    return kind.startswith("OBJECT") | kind.startswith("ARRAY")


def is_null_value(value: Column) -> Column:
    """JSON null; Spark hands it out as a null variant or as SQL NULL."""
    return F.coalesce(F.is_variant_null(value), F.lit(True))


def attribute_values(entry: Column) -> Column:
    return F.try_variant_get(entry, "$.attributes", "map<string,variant>")


def faulty_attributes(entry: Column) -> Column:
    return F.map_filter(attribute_values(entry), lambda _, v: is_null_value(v) | is_nested(v))


def open_batches(bodies: DataFrame) -> DataFrame:
    """Explode bodies into entries, parsing each body once.

    Adds `batch_error` (why a body cannot be opened), `has_exponents` (whether it may hold numbers
    like 1e7), `index`, `entry` (a Variant) and `raw` (the entry's text). A body without entries keeps one row, with NULL `index`. The text is there only
    for bodies in which some attribute is faulty: naming the first fault needs the source order of
    the keys, which a Variant does not keep, and a second parse is the price. No filter may sit
    between the parse and the explode, since Spark would evaluate the parse again for it.
    """
    parsed = bodies.withColumn(
        "_doc",
        F.when(F.octet_length("body") <= MAX_BODY_BYTES, F.try_parse_json("body")),
    ).withColumn("_entries", F.try_variant_get("_doc", "$.logs", "array<variant>"))
    needs_text = F.exists("_entries", lambda e: F.coalesce(F.size(faulty_attributes(e)) > 0, F.lit(False)))
    texts = F.from_json("body", "logs array<string>").getField("logs")
    no_texts = F.array().cast("array<string>")
    opened = parsed.withColumn(
        "batch_error",
        F.when(F.octet_length("body") > MAX_BODY_BYTES, TOO_LARGE)
        .when(F.col("_doc").isNull(), MALFORMED)
        .when(F.col("_entries").isNull(), NO_ARRAY),
    ).withColumn("has_exponents", F.col("body").rlike(EXPONENT_VALUE)).withColumn(
        "_items",
        F.arrays_zip("_entries", F.when(needs_text, texts).otherwise(no_texts))
        .cast("array<struct<entry:variant,raw:string>>"),
    )
    keys = [c for c in bodies.columns if c != "body"]
    return opened.select(
        *keys, "batch_error", "has_exponents", F.posexplode_outer("_items").alias("index", "_item")
    ).select(
        *keys, "batch_error", "has_exponents", F.col("index").cast("long").alias("index"),
        F.col("_item.entry").alias("entry"), F.col("_item.raw").alias("raw"),
    )


def bad_batches(opened: DataFrame) -> DataFrame:
    """The quarantine: bodies that could not be opened, with the reason."""
    return opened.where("batch_error IS NOT NULL").drop("has_exponents", "index", "entry", "raw")
