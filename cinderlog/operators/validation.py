"""Entry validation: one `reason` column, NULL for accepted entries; the first failure wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderlog.functions.text import SMALL_FORM, is_blank, script_number, small_number
from cinderlog.functions.times import ISO_PATTERN
from cinderlog.schemas import FUTURE_SLACK_MINUTES, LEVELS
from cinderlog.sources.batches import faulty_attributes, is_null_value, is_nested

# An entry's id is its batch number and its index; a body under the size limit has fewer entries.
INDEX_BITS = 24


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def _absent(value: Column) -> Column:
    return value.isNull() | F.is_variant_null(value)


def _text(field: str) -> Column:
    return F.try_variant_get("entry", f"$.{field}", "string")


def _value(field: str) -> Column:
    return F.try_variant_get("entry", f"$.{field}", "variant")


def _is_missing_text(field: str) -> Column:
    """Not a string, or a blank one."""
    return F.coalesce(_kind(_value(field)) != "STRING", F.lit(True)) | is_blank(F.col(field))


def _is_falsy(value: Column, text: Column) -> Column:
    """Missing, null, empty text, false or zero."""
    zero = F.coalesce(text.try_cast("double") == 0, F.lit(False)) | (text == "false")
    return _absent(value) | F.when(_kind(value) == "STRING", text == "").otherwise(zero)


def _shown_level(value: Column, text: Column) -> Column:
    """How a wrong level reads in the message, whatever its type."""
    items = F.transform(F.try_variant_get(value, "$", "array<string>"), lambda x: F.coalesce(x, F.lit("")))
    return (
        F.when(value.isNull(), "undefined")
        .when(F.is_variant_null(value), "null")
        .when(_kind(value).startswith("OBJECT"), "[object Object]")
        .when(_kind(value).startswith("ARRAY"), F.array_join(items, ","))
        .otherwise(text)
    )


def _first_fault(raw: Column) -> Column:
    """The key of the first faulty attribute: whole-number keys first, then in source order."""
    faulty = faulty_attributes(F.col("entry"))
    keys = F.filter(
        F.json_object_keys(F.get_json_object(raw, "$.attributes")),
        lambda k: F.map_contains_key(faulty, k),
    )
    numeric = F.filter(keys, lambda k: k.rlike("^(0|[1-9][0-9]{0,8})$"))
    lowest = F.array_min(F.transform(numeric, lambda k: k.cast("long"))).cast("string")
    return F.coalesce(lowest, F.get(keys, F.lit(0)), F.get(F.array_sort(F.map_keys(faulty)), F.lit(0)))


def _fault_reason(raw: Column) -> Column:
    key = _first_fault(raw)
    faulty = faulty_attributes(F.col("entry"))
    return F.when(
        is_null_value(faulty[key]), F.concat(F.lit("invalid attribute value for '"), key, F.lit("'"))
    ).otherwise(F.concat(F.lit("nested object in attribute '"), key, F.lit("'")))


def _rewritten(texts: Column, source: Column, path: str) -> Column:
    """Attribute texts with the numbers written anew that had an exponent, or are too small to be
    written without: the former are DOUBLE to Spark, other numbers are exact and keep their text."""
    values = F.try_variant_get(source, path, "map<string,variant>")

    def text_of(key: Column, text: Column) -> Column:
        small = text.rlike(SMALL_FORM) & _kind(values[key]).startswith("DECIMAL")
        return F.when(small, small_number(text)).when(_kind(values[key]) == "DOUBLE", script_number(text)).otherwise(text)

    return F.transform_values(texts, text_of)


def validate(opened: DataFrame, as_of: Column) -> DataFrame:
    """Add `reason` and the typed fields to opened entries.

    `as_of` is one instant per batch: a literal, or the micro-batch's own time column. Rows without
    an entry (empty or bad batches) pass through with NULL `index` and NULL `reason`.
    """
    # Sound entries only pay for the typed fields here. What a value is, beyond its text, is looked
    # up inside the branches for entries that failed a check.
    fields = opened.select(
        "*",
        *[_text(name).alias(name) for name in ("level", "service", "message")],
        _text("timestamp").alias("stamp"),
        F.try_variant_get("entry", "$.attributes", "map<string,string>").alias("attributes"),
    ).withColumn(
        "timestamp", F.when(F.col("stamp").rlike(ISO_PATTERN), F.col("stamp").try_cast("timestamp"))
    )
    entry, level, attributes = F.col("entry"), F.col("level"), F.col("attributes")
    latest = as_of.cast("timestamp") + F.expr(f"INTERVAL {FUTURE_SLACK_MINUTES} MINUTES")
    is_object = F.coalesce(_kind(entry).startswith("OBJECT"), F.lit(False))
    # The text is only there where some attribute of the batch is faulty.
    has_fault = F.col("raw").isNotNull() & F.coalesce(F.size(faulty_attributes(entry)) > 0, F.lit(False))
    # The reasons.
    bad_time = (
        F.when(~is_object, "entry must be an object")
        .when(_is_falsy(_value("timestamp"), F.col("stamp")), "timestamp is required")
        .otherwise("invalid timestamp")
    )
    reason = (
        F.when(F.col("index").isNull(), None)
        .when(F.col("timestamp").isNull(), bad_time)
        .when(F.date_trunc("millisecond", "timestamp") > latest, "timestamp too far in the future")
        # No number, flag or list reads like a level.
        .when(
            ~F.coalesce(level.isin(*LEVELS), F.lit(False)),
            F.concat(F.lit("invalid level: '"), _shown_level(_value("level"), level), F.lit("'")),
        )
        .when(_is_missing_text("service"), "service is required")
        .when(_is_missing_text("message"), "message is required")
        .when(attributes.isNull() & ~_absent(_value("attributes")), "attributes must be a flat object")
        .when(has_fault, _fault_reason(F.col("raw")))
    )
    exact = F.when(F.col("has_exponents"), _rewritten(attributes, entry, "$.attributes")).otherwise(attributes)
    result = F.struct(
        reason.alias("reason"), "timestamp", "level", "service", "message", exact.alias("attributes"),
    )
    kept = [c for c in opened.columns if c not in ("entry", "raw", "has_exponents")]
    # As the output of a generator the result is computed once. A plain column would be computed
    # again for a filter on it, since Spark moves filters below projections.
    results = fields.select(*kept, F.array(result).alias("results"))
    return results.select(*kept, F.explode_outer("results").alias("r")).select(*kept, "r.*")


def accepted(checked: DataFrame, *keys: str) -> DataFrame:
    """Entries that go into the logs table, with their key columns."""
    good = F.col("index").isNotNull() & F.col("reason").isNull()
    return checked.where(good).select(*keys, "index", "timestamp", "level", "service", "message", "attributes")


def rejected(checked: DataFrame, *keys: str) -> DataFrame:
    return checked.where(F.col("reason").isNotNull()).select(*keys, "index", "reason")


def with_ids(entries: DataFrame, batch_number: str = "batch_id") -> DataFrame:
    """Ids that order by batch and index and come out the same when a batch is replayed."""
    row_id = F.shiftleft(F.col(batch_number).cast("long"), INDEX_BITS) + F.col("index")
    return entries.select(row_id.alias("id"), "timestamp", "level", "service", "message", "attributes")


def batch_results(checked: DataFrame, key: str = "batch_id") -> DataFrame:
    """Per batch: how many entries were accepted, which were rejected and why, and the status."""
    is_entry = F.col("index").isNotNull()
    fault = F.when(F.col("reason").isNotNull(), F.struct("index", "reason"))
    grouped = checked.groupBy(key).agg(
        F.count_if(is_entry & F.col("reason").isNull()).alias("accepted"),
        F.sort_array(F.collect_list(fault)).alias("rejected"),
        F.max("batch_error").alias("error"),
    )
    return grouped.select(
        key, "accepted", "rejected", "error", F.when(F.col("accepted") > 0, 200).otherwise(400).alias("status")
    )


def normalize_attributes(attributes: Column) -> Column:
    """A flat JSON object (Variant) as text values; NULL when a value is null or nested."""
    values = F.try_variant_get(attributes, "$", "map<string,variant>")
    faulty = F.map_filter(values, lambda _, v: is_null_value(v) | is_nested(v))
    texts = F.try_variant_get(attributes, "$", "map<string,string>")
    return F.when(F.size(faulty) == 0, _rewritten(texts, attributes, "$"))
