"""Connected components of a graph that no machine holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderlog.sources.workspace import written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a long, b long): root is the smallest node it reaches.

    Alternates between linking the larger neighbours of each node to its smallest neighbour and linking the smaller
    ones, until the edges are stars. Minima are taken map-side first and joined back, so that a node with very many
    neighbours is never gathered in one place. Each round is written to the shared folder.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    pairs = written(pairs, "links")
    seen = None
    while True:
        state = pairs.agg(F.count("*"), F.expr("bit_xor(xxhash64(hi, lo))"), F.expr("sum(cast(xxhash64(lo, hi) as decimal(38,0)))")).first()
        if state == seen or state[0] == 0:
            break
        seen = state
        pairs = written(_small_star(_large_star(pairs)), "links")
    roots = pairs.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
    return pairs.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(roots)


def _large_star(pairs: DataFrame) -> DataFrame:
    both = pairs.selectExpr("hi u", "lo v").union(pairs.selectExpr("lo u", "hi v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    up = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
    return up.distinct()


def _small_star(pairs: DataFrame) -> DataFrame:
    least = pairs.groupBy("hi").agg(F.min("lo").alias("m"))
    joined = pairs.join(least, "hi").select("hi", "lo", "m")
    down = joined.where("lo <> m").selectExpr("lo hi", "m lo").union(joined.selectExpr("hi", "m lo"))
    return down.distinct()
