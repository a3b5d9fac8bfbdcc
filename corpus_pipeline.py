"""A corpus pipeline: reject poor documents, drop repeated lines and near copies, mix sources, pack for training."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderlog.llm import lines, mixing, packing, quality, simhash
from cinderlog.sources.workspace import written

VOCABULARY = "byte_bpe_50k.json"


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier keeps."""
    return quality.keep_good(docs)


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier document or line has, up to one word; empty ones go."""
    return lines.without_repeats(docs, lines.line_decisions(docs))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, Jaccard similarity of 0.8 or more), that of smallest doc_id."""
    return simhash.one_of_near_copies(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, good ones first where a source is not taken whole."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    worst = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("worst"))
    rated = worst.select("doc_id", F.when(F.col("worst") >= 1, 2.0).otherwise(0.5).alias("quality"))
    return mixing.take(docs, mixing.mix(docs, rated))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens, with their ids."""
    return packing.pack(docs, public_tokenizers.path(VOCABULARY))


STAGES = [
    ("quality", good_quality),
    ("line_dedup", fresh_lines),
    ("near_dedup", one_of_near_copies),
    ("mixing", mixed_sources),
    ("packing", packed),
]

#: SQL has no similarity fingerprints and no tokenizer; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; what one stage returns is written and read as the next one's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
