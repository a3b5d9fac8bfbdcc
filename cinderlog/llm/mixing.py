"""Mixing sources to target weights by weighted sampling without replacement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderlog.llm.common import running_totals, word_count
from cinderlog.sources.workspace import written

WEIGHTS, MOST_EPOCHS, SEED = (1, 2, 3), 3, "mix"


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_size) -> the same with `target` and `before`, the sizes of all sources in front of this one.

    Sources in order of code points, null last, get the weights in turn and share the size of all. None gets more than
    `most` times its size: in order of size by weight, the level that is left for the rest only falls, so one pass
    tells which are full, and the first that is not has the level of all others. One row per source is in play.
    """
    order = F.asc_nulls_last("source")
    turn = (F.row_number().over(Window.orderBy(order)) - 1) % len(weights)
    before = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    filled = Window.orderBy("ratio", order)
    everything = Window.partitionBy()
    rows = (
        sources.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (turn + 1).cast("int")))
        .withColumn("before", F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("most", F.lit(most) * F.col("source_size"))
        .withColumn("ratio", F.col("source_size") / F.col("weight"))
        .withColumn("all_size", F.sum("source_size").over(everything))
        .withColumn("spent", F.coalesce(F.sum("most").over(filled.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("open_weight", F.sum("weight").over(filled.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("all_size") - F.col("spent")).cast("double") / F.col("open_weight"))
        .withColumn("full", F.col("most") <= F.col("level") * F.col("weight"))
        .withColumn("level", F.max(F.when(~F.col("full"), F.col("level"))).over(everything))
    )
    target = F.when(F.col("full"), F.col("most").cast("double")).otherwise(F.col("level") * F.col("weight"))
    return rows.select("source", "source_size", "before", target.alias("target"))


def draw(doc_id: Column, quality: Column, seed: str = SEED) -> Column:
    """An exponential key: small keys come first, and a document of twice the quality has half the key on average."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))
    uniform = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))
    return -F.log(uniform) / quality


def mix(
    docs: DataFrame, quality: DataFrame | None = None, weights: Sequence[int] = WEIGHTS,
    most: int = MOST_EPOCHS, seed: str = SEED,
) -> DataFrame:
    """How often each document is taken so that sources come to their targets, in words.

    docs: doc_id, text, source. quality: (doc_id, quality), positive, at most one row per doc_id; 1.0 where absent.
    Gives one row per row of docs: doc_id, source, size, source_size, target, copies, taken = copies * size.

    Each source takes as many whole epochs as fit its target. What is left is drawn without replacement in order of
    exponential keys scaled by quality (Efraimidis and Spirakis): documents are taken whole while at least half of
    them fits, so a source misses its target by at most half of one document. Ties in the key go by doc_id and size.
    Null text has size 0, a null source is a source, an empty table gives no rows; rows that share a doc_id are
    documents of their own with the same key. The size of a source does not matter: rows are dealt by ranges of
    (source, key), so a source that holds most rows spreads over as many tasks as it needs.
    """
    rows = docs.select(docs["doc_id"], docs["source"], word_count(docs["text"]).alias("size"))
    if quality is not None:
        weight = quality.select(F.col("doc_id").alias("rated_id"), F.col("quality").cast("double").alias("quality"))
        rows = rows.join(weight, rows["doc_id"] == F.col("rated_id"), "left").drop("rated_id")
        rows = rows.withColumn("quality", F.coalesce("quality", F.lit(1.0)))
    else:
        rows = rows.withColumn("quality", F.lit(1.0))
    rows = rows.withColumn("draw", draw(F.col("doc_id"), F.col("quality"), seed)).drop("quality")
    order = [F.asc_nulls_last("source"), F.col("draw"), F.col("doc_id"), F.col("size")]
    ordered = written(running_totals(rows, order, "through", "size"), "mix-order")
    goals = written(targets(ordered.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most), "mix-targets")
    goals = goals.withColumnRenamed("source", "goal_source")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.col("target") - F.col("epochs") * F.col("source_size")
    through = F.col("through") - F.col("before")
    chosen = (2 * through - F.col("size")) <= 2 * F.col("rest")
    mixed = (
        ordered.join(goals, F.col("source").eqNullSafe(F.col("goal_source")))
        .withColumn("epochs", epochs)
        .withColumn("rest", rest)
        .withColumn("copies", (F.col("epochs") + F.when(chosen & (F.col("rest") > 0), 1).otherwise(0)).cast("long"))
    )
    return mixed.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def take(docs: DataFrame, mixture: DataFrame) -> DataFrame:
    """The documents of a mixture, as often as they are taken, with the columns of docs.

    Rows that share a doc_id are matched to rows of the mixture in order of source and size.
    """
    same = Window.partitionBy("doc_id")
    numbered = docs.withColumn("_mix_row", F.row_number().over(same.orderBy("source", word_count(F.col("text")), "text")))
    copies = mixture.select(
        F.col("doc_id").alias("_mix_id"), F.col("copies").alias("_mix_copies"),
        F.row_number().over(same.orderBy("source", "size", "copies")).alias("_mix_nth"),
    ).where("_mix_copies > 0")
    matched = F.col("doc_id").eqNullSafe(F.col("_mix_id")) & (F.col("_mix_row") == F.col("_mix_nth"))
    repeated = numbered.join(copies, matched).withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_copies"))))
    return repeated.select(*docs.columns)
