"""Queries: streams of outcomes, replayed to the end and compared with the batch results."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from judgespark.operators.crosstab import METRIC_COLUMNS
from judgespark.plans import inputs
from judgespark.plans import sqltext as q
from judgespark.plans.registry import query
from judgespark.plans.scratch import shared_folder
from judgespark.streaming import live


def outcome_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as a file stream of outcomes."""
    schema = inputs.table(spark, sf_dir, "lineitem").schema
    lines = spark.readStream.schema(schema).parquet(sf_dir, pathGlobFilter="lineitem.parquet")
    return inputs.outcomes_from(lines)


@query(
    "w1_live_progress",
    q.with_ctes(
        "SELECT pillar, count(*) FILTER (WHERE NOT failed) AS succeeded, count(*) FILTER (WHERE failed) AS failed,"
        " (SELECT count(*) FROM outcomes) AS done, CAST(1000000 AS BIGINT) AS total FROM outcomes GROUP BY pillar",
        "outcomes",
    ),
)
def live_progress(spark, sf_dir):
    folder = shared_folder(spark)
    stream = outcome_stream(spark, sf_dir)
    live.start_progress(stream, folder + "/progress", folder + "/checkpoint", available_now=True).awaitTermination()
    return live.progress(spark, folder + "/progress", total_tasks=1_000_000)


def in_batches(spark: SparkSession, path: str, batches: int) -> DataFrame:
    """The files below ``path`` as a stream, in the order in which they came, dealt over ``batches`` micro-batches."""
    sent = spark.read.parquet(path)
    files = math.ceil(len(sent.inputFiles()) / batches)
    return spark.readStream.schema(sent.schema).option("maxFilesPerTrigger", files).parquet(path)


_COLUMNS = ("pillar", "support", *METRIC_COLUMNS)


@query("w2_live_agreement", q.with_ctes(f"SELECT {', '.join(_COLUMNS)} FROM report", "report"))
def live_agreement(spark, sf_dir):
    folder = shared_folder(spark)
    rows = live.prepare_rows(inputs.eval_rows(spark, sf_dir), folder + "/rows")
    live.start_agreement(
        outcome_stream(spark, sf_dir), rows, folder + "/parts", folder + "/checkpoint", available_now=True
    ).awaitTermination()
    return live.live_agreement(spark, folder + "/parts").select(*_COLUMNS)


@query("w2_live_agreement_resent", q.with_ctes(f"SELECT {', '.join(_COLUMNS)} FROM report", "report"))
def live_agreement_resent(spark, sf_dir):
    """Every outcome is sent twice and counts once, over several micro-batches."""
    folder = shared_folder(spark)
    rows = live.prepare_rows(inputs.eval_rows(spark, sf_dir), folder + "/rows")
    lines = inputs.table(spark, sf_dir, "lineitem")
    # Halves, each written where its lines are read: as many files as tasks, and no shuffle.
    half = F.pmod(F.xxhash64("l_orderkey", "l_linenumber"), F.lit(2))
    for part in (0, 1, 0, 1):
        lines.where(half == part).write.mode("append").parquet(folder + "/sent")
    stream = in_batches(spark, folder + "/sent", 4)
    live.start_agreement(
        inputs.outcomes_from(stream),
        rows,
        folder + "/parts",
        folder + "/checkpoint",
        available_now=True,
        unique_by=("outcome_index", "record_id", "pillar", "latency_ms"),
    ).awaitTermination()
    return live.live_agreement(spark, folder + "/parts").select(*_COLUMNS)


@query("w2_live_agreement_bounded", q.with_ctes(f"SELECT {', '.join(_COLUMNS)} FROM report", "report"))
def live_agreement_bounded(spark, sf_dir):
    """Every outcome is sent twice, and the state that tells so lasts for an hour of outcome time."""
    folder = shared_folder(spark)
    rows = live.prepare_rows(inputs.eval_rows(spark, sf_dir), folder + "/rows")
    # Outcome time runs through the batches, a second time some minutes behind.
    lines = inputs.table(spark, sf_dir, "lineitem").withColumn("part", F.pmod(F.col("l_orderkey"), F.lit(4)).cast("int"))
    clock = F.lit("2024-01-01").cast("timestamp")
    sent = lines.withColumn("sent_at", clock + F.make_dt_interval(hours="part"))
    again = lines.withColumn("sent_at", clock + F.make_dt_interval(hours="part", mins=F.lit(1)))
    for part in range(4):
        now = sent.where(F.col("part") == part).unionByName(again.where(F.col("part") == part))
        now.write.mode("append").parquet(folder + "/sent")
    stream = in_batches(spark, folder + "/sent", 4)
    outcomes = inputs.outcomes_from(stream, ["sent_at"])
    live.start_agreement(
        outcomes,
        rows,
        folder + "/parts",
        folder + "/checkpoint",
        available_now=True,
        unique_by=("outcome_index", "record_id", "pillar", "latency_ms"),
        event_time="sent_at",
        delay="1 hour",
    ).awaitTermination()
    return live.live_agreement(spark, folder + "/parts").select(*_COLUMNS)
