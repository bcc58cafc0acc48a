"""Live progress and live agreement over a stream of outcomes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from judgespark.operators.crosstab import agreement_report
from judgespark.operators.scored import latest_rows, ledger_crosstab, record_ledger
from judgespark.operators.tasks import pillar_counts


def _write(stream: DataFrame, mode: str, process, checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = stream.writeStream.outputMode(mode).foreachBatch(process).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def start_progress(
    outcomes: DataFrame, path: str, checkpoint: str, available_now: bool = False
) -> StreamingQuery:
    """Keep ``path`` at the succeeded and failed outcomes per pillar.

    The state is one row per pillar.
    """

    def publish(batch: DataFrame, batch_id: int) -> None:
        batch.coalesce(1).write.mode("overwrite").parquet(path)

    return _write(pillar_counts(outcomes), "complete", publish, checkpoint, available_now)


def progress(spark: SparkSession, path: str, total_tasks: int) -> DataFrame:
    """Per-pillar counts with the run-wide done / total."""
    counts = spark.read.parquet(path)
    done = counts.agg(F.coalesce(F.sum(F.col("succeeded") + F.col("failed")), F.lit(0))).scalar()
    return counts.withColumns({"done": done, "total": F.lit(total_tasks).cast("long")})


def prepare_rows(rows: DataFrame, path: str) -> DataFrame:
    """Last row per record, written once so that micro-batches need not reduce the rows again."""
    latest_rows(rows).write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.parquet(path)


def unique_outcomes(
    outcomes: DataFrame, unique_by: Sequence[str], event_time: str | None = None, delay: str = "1 hour"
) -> DataFrame:
    """The first of the outcomes that agree on ``unique_by``; with ``event_time``, the state lasts for ``delay``."""
    if not unique_by:
        return outcomes
    if event_time is None:
        return outcomes.dropDuplicates(list(unique_by))
    return outcomes.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(unique_by))


def start_agreement(
    outcomes: DataFrame,
    rows: DataFrame,
    parts: str,
    checkpoint: str,
    pillars: Sequence[str] | None = None,
    attributes: Sequence[str] = (),
    available_now: bool = False,
    unique_by: Sequence[str] = (),
    event_time: str | None = None,
    delay: str = "1 hour",
) -> StreamingQuery:
    """Keep the running crosstab of all micro-batches under ``parts``.

    ``rows`` must be unique per record (see ``prepare_rows``). A batch is folded to one row per record before it
    meets the rows, and its counts are added to those up to the batch before. Two parts take
    turns, so a replayed batch starts from the same counts, and there are never more than two parts.
    With ``unique_by`` an outcome that is sent again, told by those columns, counts once. The stream then
    keeps their values as state: for ever, or, with the time column ``event_time``, until the latest time seen is
    ``delay`` past an outcome's own. An outcome may come again, or for the first time, that much late;
    one that is later still does not count, as nothing could tell by then whether it had.
    """
    # A micro-batch can't leave out columns by itself, and all that it has are shuffled to the state.
    score = F.when(F.col("result").isNotNull(), F.struct(F.col("result.score").alias("score"))).alias("result")
    kept = dict.fromkeys([*unique_by, *([event_time] if event_time else []), "record_id", "pillar"])
    narrow = outcomes.select(*kept) if "result" in kept else outcomes.select(*kept, score)
    stream = unique_outcomes(narrow, unique_by, event_time, delay)
    keys = [*attributes, "pillar", "judge", "human"]

    def publish(batch: DataFrame, batch_id: int) -> None:
        ledger = record_ledger(rows, batch, pillars, attributes, unique_rows=True)
        counts = ledger_crosstab(ledger, pillars, attributes)
        if batch_id:
            before = batch.sparkSession.read.schema(counts.schema).parquet(_part(parts, batch_id - 1))
            counts = counts.unionByName(before).groupBy(*keys).agg(F.sum("n").alias("n"))
        marked = counts.withColumn("batch_id", F.lit(batch_id).cast("long"))
        # Without attributes there are at most 25 rows a pillar; with them, as many files as they need.
        (marked if attributes else marked.coalesce(1)).write.mode("overwrite").parquet(_part(parts, batch_id))

    return _write(stream, "append", publish, checkpoint, available_now)


def _part(parts: str, batch_id: int) -> str:
    return f"{parts}/turn={batch_id % 2}"


def live_crosstab(spark: SparkSession, parts: str, keys: Sequence[str] = ()) -> DataFrame:
    """Running crosstab: the part of the last batch."""
    both = spark.read.parquet(parts)
    last = both.agg(F.max("batch_id")).scalar()
    counts = both.where(F.col("batch_id") == last).groupBy(*keys, "pillar", "judge", "human")
    return counts.agg(F.sum("n").alias("n"))


def live_agreement(
    spark: SparkSession, parts: str, pillars: Sequence[str] | None = None, keys: Sequence[str] = ()
) -> DataFrame:
    """Agreement report over everything seen so far."""
    return agreement_report(live_crosstab(spark, parts, keys), keys, pillars)
