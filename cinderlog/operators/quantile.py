"""Exact quantiles per group without ever holding a group in one place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderlog.sources.workspace import written

# Bins are logarithmic: 128 per factor e (at most some thousand in practice), then 4096 times finer. Infinities
# have bins of their own beyond all others, and NaN, which counts as larger than anything, one above them.
COARSE, FINE = 128, 128 * 4096
INFINITE, NOT_A_NUMBER = 1 << 40, (1 << 40) + 1


def _bin(value: Column, scale: int) -> Column:
    """A bin number that never decreases as the value grows."""
    def size(v: Column) -> Column:
        return F.floor(F.ln(v) * scale) + 1000 * scale

    infinite = F.abs(value) == float("inf")
    special = F.when(F.isnan(value), NOT_A_NUMBER).when(infinite & (value > 0), INFINITE).when(infinite, -INFINITE)
    return special.when(value > 0, size(value)).when(value < 0, -size(-value)).when(value == 0, 0).cast("long")


def histogram(df: DataFrame, group: str, value: str, *figures: Column) -> DataFrame:
    """(group, bin, n, figures): a row count per coarse bin, NULL values in the bin NULL, and any
    other figures that can be added up. Small, and written out, so that it costs one scan."""
    binned = df.groupBy(group, _bin(F.col(value).cast("double"), COARSE).alias("bin"))
    return written(binned.agg(F.count("*").alias("n"), *figures), "histogram")


def _located(counts: DataFrame, targets: DataFrame, keys: list[str], item: str) -> DataFrame:
    """For each target (keys, slot, rank), the item whose rows hold that rank, and the rank
    inside the item. Ranks count from 0 in item order."""
    order = Window.partitionBy(*keys).orderBy(item)
    placed = counts.withColumn("before", F.sum("n").over(order) - F.col("n"))
    hit = (F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("n"))
    found = placed.join(targets, keys).where(hit)
    return found.select(*keys, "slot", item, (F.col("rank") - F.col("before")).alias("rank"), "n")


def exact_quantile(df: DataFrame, bins: DataFrame, group: str, value: str, p: float, name: str) -> DataFrame:
    """(group, name): the p-quantile with linear interpolation, per group; `bins` is the histogram.

    The histogram tells the one or two bins around the wanted rank. Only their rows are taken, in a
    second scan, and counted by finer bins, so that what remains of even the largest group is tiny;
    of equal values only a count remains. The lists of bins are written out, so that their size is
    known: Spark broadcasts them while small, and otherwise joins on (group, bin), which spreads a
    hot group over many tasks. NaN and infinities are values like others, as in `percentile`.
    """
    counts = bins.where("bin IS NOT NULL").select(group, "bin", "n")
    sizes = counts.groupBy(group).agg(F.sum("n").alias("size"))
    position = F.lit(p) * (F.col("size") - 1)
    wanted = sizes.select(group, F.posexplode(F.array(F.floor(position), F.ceil(position))).alias("slot", "rank"))
    keys = [group, "bin"]
    targets = written(_located(counts, wanted, [group], "bin"), "quantile-bins")
    number = F.col(value).cast("double")
    rows = df.where(number.isNotNull()).select(group, _bin(number, COARSE).alias("bin"), number.alias("value"))
    rows = rows.join(targets.select(*keys).distinct(), keys)
    rows = rows.groupBy(*keys, "value").agg(F.count("*").alias("n")).withColumn("fine", _bin(F.col("value"), FINE))
    rows = written(rows, "quantile-values")
    counts = rows.groupBy(*keys, "fine").agg(F.sum("n").alias("n"))
    targets = written(_located(counts, targets.drop("n"), keys, "fine"), "quantile-fine-bins")
    keys = [group, "bin", "fine"]
    rows = rows.join(targets.select(*keys).distinct(), keys)
    values = rows.select(*keys, "value", "n")
    picked = _located(values, targets.drop("n"), keys, "value").groupBy(group).agg(
        F.max(F.when(F.col("slot") == 0, F.col("value"))).alias("low"),
        F.max(F.when(F.col("slot") == 1, F.col("value"))).alias("high"),
    )
    between = (F.ceil(position) - position) * F.col("low") + (position - F.floor(position)) * F.col("high")
    exact = F.when((F.ceil(position) == F.floor(position)) | (F.col("low") == F.col("high")), F.col("low")).otherwise(between)
    return picked.join(sizes, group).select(group, exact.alias(name))
