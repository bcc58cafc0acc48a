"""A corpus from raw documents to packed sequences, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from judgespark.llm import exact_dedup, mixing, near_dedup, packing, quality
from judgespark.llm.common import numbered, scratch
from judgespark.llm.queries import QUALITY_THRESHOLD, quality_space, word_bpe

# Of the shingles of five words that two documents have, the share in both above which they are near
# duplicates. `op5_minhash_dedup` has a threshold of its own.
NEAR_PERCENT = 80


def _good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    scored = quality.scores(docs, quality_space(spark, docs, sf_dir))
    return scored.where(F.col("_score") >= QUALITY_THRESHOLD).drop("_score")


def _distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays."""
    index = exact_dedup.DigestIndex(spark, scratch(spark)).open()
    dropped = exact_dedup.ingest(index, docs).where("NOT kept").select("_row")
    return numbered(docs).join(dropped, "_row", "left_anti").drop("_row")


def _unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    groups = near_dedup.near_groups(docs, percent=NEAR_PERCENT, bands=near_dedup.bands_for(NEAR_PERCENT))
    dropped = groups.where("NOT kept").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(docs.columns)


def _mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source as often as its target asks, in the order of the output shards."""
    return mixing.mixed(docs).drop("_shard", "_place")


def _packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in full context windows."""
    return packing.pack(docs, word_bpe())


STAGES = [
    ("quality classifier", _good),
    ("exact dedup", _distinct),
    ("near dedup", _unlike),
    ("source mixing", _mixed),
    ("packing", _packed),
]

# Training, near duplicates and packing have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result stored and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            path = scratch(spark)
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
