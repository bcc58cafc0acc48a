"""What a run cost, and how often each failure tag was given."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from judgespark.operators.crosstab import quoted
from judgespark.schema import PILLARS


def rates_table(spark: SparkSession, rates: Mapping[str, tuple[float, float]]) -> DataFrame:
    """``(model_name, input_rate, output_rate)``: prices of a million tokens by model."""
    rows = [f"struct({quoted(m)} AS model_name, {float(i)!r}D AS input_rate, {float(o)!r}D AS output_rate)" for m, (i, o) in rates.items()]
    if not rows:
        return spark.createDataFrame([], "model_name string, input_rate double, output_rate double")
    return spark.range(1).selectExpr(f"inline(array({', '.join(rows)}))")


def judge_usage(outcomes: DataFrame, rates: DataFrame | None = None, pillars: Sequence[str] | None = None) -> DataFrame:
    """Calls, latency, tokens and cost per pillar and model.

    Latencies are summed as whole microseconds, so the mean does not depend on partitioning. Missing token counts add
    nothing and are counted as ``calls_without_usage``; ``cost_estimate`` is null for a model without rates.
    """
    active = outcomes.where(F.col("pillar").isin(list(PILLARS if pillars is None else pillars)))
    ok = F.col("result").isNotNull()
    tokens_in, tokens_out = F.col("usage.input_tokens"), F.col("usage.output_tokens")
    micros = F.round(F.col("latency_ms") * 1000).cast("decimal(28, 0)")
    sums = active.groupBy("pillar", "model_name").agg(
        F.count(F.lit(1)).alias("calls"),
        F.count_if(ok).alias("succeeded"),
        F.count_if(~ok).alias("failed"),
        F.sum("attempts").alias("attempts"),
        (F.try_divide(F.sum(micros).cast("double"), F.count("latency_ms").cast("double")) / 1000).alias("avg_latency_ms"),
        F.coalesce(F.sum(tokens_in), F.lit(0)).alias("tokens_in"),
        F.coalesce(F.sum(tokens_out), F.lit(0)).alias("tokens_out"),
        F.count_if(tokens_in.isNull() | tokens_out.isNull()).alias("calls_without_usage"),
    )
    if rates is None:
        return sums.withColumn("cost_estimate", F.lit(None).cast("double"))
    cost = (F.col("tokens_in").cast("double") * F.col("input_rate") + F.col("tokens_out").cast("double") * F.col("output_rate")) / 1e6
    return sums.join(rates, "model_name", "left").withColumn("cost_estimate", cost).drop("input_rate", "output_rate")


def failure_tags(outcomes: DataFrame, pillars: Sequence[str] | None = None) -> DataFrame:
    """``(pillar, tag, n, share, rank)``: how many successful outcomes of a pillar have each failure tag.

    Most frequent first, ties by name; a tag that an outcome repeats counts once. ``share`` is of all successful outcomes.
    """
    active = list(PILLARS if pillars is None else pillars)
    ok = outcomes.where(F.col("result").isNotNull() & F.col("pillar").isin(active))
    # An outcome counts once, under no tag, and once under each of its tags.
    named = F.concat(F.array(F.lit(None).cast("string")), F.coalesce(F.array_distinct(F.filter("result.failure_tags", F.isnotnull)), F.array().cast("array<string>")))
    counts = ok.select("pillar", F.explode(named).alias("tag")).groupBy("pillar", "tag").agg(F.count(F.lit(1)).alias("n"))
    by_pillar = Window.partitionBy("pillar")
    scored = F.max(F.when(F.col("tag").isNull(), F.col("n"))).over(by_pillar)
    out = counts.withColumn("share", F.col("n").cast("double") / scored).where(F.col("tag").isNotNull())
    return out.withColumn("rank", F.row_number().over(by_pillar.orderBy(F.desc("n"), "tag")))
