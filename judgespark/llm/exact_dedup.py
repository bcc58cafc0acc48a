"""Exact deduplication against a persistent digest index, bucketed and sorted by hash.

The index is a table of ``(digest, keep_id)`` in hash buckets sorted by digest. A new batch is folded
to one row per digest, a sort-merge anti-join finds the digests the index lacks, and those are
appended bucket by bucket. The index side of that join is read in its buckets and never shuffled.

Null texts count as empty; rows without ``doc_id`` rank below all others; of repeated rows (same id,
same text) one stays; an empty batch appends nothing; other columns are not read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from judgespark.llm.common import lookup, stored, text_of


@dataclass(frozen=True)
class DigestIndex:
    """The index at ``path``, which names its bucket count; opening it again finds what was appended."""

    spark: SparkSession
    path: str
    buckets: int = 64

    @property
    def table(self) -> str:
        return "digests_" + hashlib.sha256(f"{self.path}:{self.buckets}".encode()).hexdigest()[:24]

    def open(self) -> DigestIndex:
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} (digest BINARY, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS "
            f"LOCATION '{self.path}/buckets={self.buckets}'"
        )
        self.spark.catalog.refreshTable(self.table)
        return self

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def append(self, fresh: DataFrame) -> None:
        by_bucket = fresh.select("digest", "keep_id").repartition(self.buckets, "digest")
        by_bucket.write.insertInto(self.table)
        self.spark.catalog.refreshTable(self.table)


def row_digests(docs: DataFrame) -> DataFrame:
    """``(_row, doc_id, digest)``; ``docs`` is a stored table, so that ``_row`` is the same at every scan."""
    return docs.select(
        F.monotonically_increasing_id().alias("_row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.unhex(F.sha2(text_of(), 256)).alias("digest"),
    )


def ingest(index: DigestIndex, docs: DataFrame) -> DataFrame:
    """Decide every row of a batch and append its new digests.

    Returns ``(_row, doc_id, digest, keep_id, group_size, known, kept)``: ``known`` when the index had
    the digest before (``keep_id`` is then the stored id and no row of the batch stays), else the row
    with the largest ``doc_id`` stays. ``group_size`` counts the equal rows of the batch.
    """
    rows = stored(row_digests(docs))
    best = F.max(F.struct(F.coalesce("doc_id", F.lit(-(2**63))).alias("id"), (-F.col("_row")).alias("no"), "doc_id"))
    groups = rows.groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
    groups = groups.select("digest", "group_size", F.col("best.doc_id").alias("first_id"), (-F.col("best.no")).alias("stays"))
    held = index.rows().hint("merge")
    fresh = groups.join(held, "digest", "left_anti").withColumn("keep_id", F.col("first_id"))
    seen = groups.join(held, "digest", "inner")
    resolved = stored(
        fresh.withColumn("known", F.lit(False)).unionByName(seen.withColumn("known", F.lit(True))).drop("first_id")
    )
    index.append(resolved.where(~F.col("known")))
    kept = ~F.col("known") & (F.col("_row") == F.col("stays"))
    return lookup(rows, resolved, "digest", "group_size").withColumn("kept", kept).drop("stays")
