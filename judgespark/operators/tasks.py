"""Scoring tasks: planning, content keys, reuse of stored outcomes, gating, scorers, summaries."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from judgespark.functions.text import reasons
from judgespark.operators.crosstab import quoted
from judgespark.operators.ordinal import dense_ordinal, exact_percentiles
from judgespark.operators.skew import skew_join
from judgespark.schema import NORMALIZED_FIELDS

EXECUTION_ERROR = "JudgeExecutionError"
CONFIG_FIELDS = (
    "prompt_version",
    "rubric_version",
    "model_alias",
    "model_name",
    "temperature",
    "max_output_tokens",
)


def check_pillars(pillars: Sequence[str]) -> None:
    if not pillars:
        raise ValueError("at least one pillar is required")
    for p in pillars:
        if list(pillars).count(p) > 1:
            raise ValueError(f"pillar {p!r} is listed more than once")


def plan_tasks(rows: DataFrame, pillars: Sequence[str]) -> DataFrame:
    """One task per row and pillar, with the row's columns, ``pillar_index`` and ``task_id``."""
    check_pillars(pillars)
    names = ", ".join(quoted(p) for p in pillars)
    return rows.selectExpr("*", f"posexplode(array({names})) AS (pillar_index, pillar)").withColumn(
        "task_id", F.concat("record_id", F.lit("::"), "pillar")
    )


def task_batches(rows: DataFrame, pillars: Sequence[str], size: int) -> DataFrame:
    """Tasks with a ``batch_id``: consecutive runs of ``size`` tasks in (row, pillar) order."""
    if size < 1:
        raise ValueError(f"size must be at least 1, got {size}")
    numbered = dense_ordinal(rows, ["row_index"], "_row")
    tasks = plan_tasks(numbered, pillars)
    ordinal = F.col("_row") * len(pillars) + F.col("pillar_index")
    return tasks.withColumn("batch_id", F.floor(ordinal / size)).drop("_row")


def judge_configs(spark: SparkSession, configs: Mapping[str, Mapping[str, object]]) -> DataFrame:
    """Configurations per pillar as a table; fields as in ``CONFIG_FIELDS``."""
    types = {"temperature": "double", "max_output_tokens": "int"}

    def literal(value: object, field: str) -> str:
        text = "NULL" if value is None else quoted(str(value))
        return f"CAST({text} AS {types.get(field, 'string')}) AS {field}"

    rows = [
        f"struct({quoted(p)} AS pillar, {', '.join(literal(c.get(f), f) for f in CONFIG_FIELDS)})"
        for p, c in configs.items()
    ]
    return spark.range(1).selectExpr(f"inline(array({', '.join(rows)}))")


def with_cache_keys(
    tasks: DataFrame,
    configs: DataFrame,
    row_columns: Sequence[str] | None = None,
    kb_fingerprint: str | None = None,
) -> DataFrame:
    """Add ``cache_key``: a digest of everything that can change the outcome of a task.

    All normalized columns of the row count, unless ``row_columns`` names fewer. The run id stays
    out on purpose. Configurations are one row per pillar and broadcast.
    """
    if row_columns is None:
        row_columns = [c for c in NORMALIZED_FIELDS if c in tasks.columns]
    joined = tasks.join(
        F.broadcast(configs.select("pillar", F.struct(*CONFIG_FIELDS).alias("_config"))), "pillar"
    )
    parts = {
        **{f: F.col(f"_config.{f}") for f in CONFIG_FIELDS},
        "kb_fingerprint": F.lit(kb_fingerprint).cast("string"),
        "pillar": F.col("pillar"),
        "row": F.struct(*sorted(row_columns)),
    }
    payload = F.struct(*[parts[name].alias(name) for name in sorted(parts)])
    text = F.to_json(payload, {"ignoreNullFields": "false"})
    return joined.withColumn("cache_key", F.sha2(text, 256)).drop("_config")


def storable_outcomes(outcomes: DataFrame) -> DataFrame:
    """Outcomes worth storing: successful ones, the last per key."""
    ok = outcomes.where(F.col("result").isNotNull() & F.col("error").isNull())
    last = F.max_by(F.struct(*[c for c in ok.columns if c != "cache_key"]), "outcome_index").alias("_o")
    return ok.groupBy("cache_key").agg(last).select("cache_key", "_o.*")


def cached_outcomes(tasks: DataFrame, store: DataFrame) -> DataFrame:
    """Stored outcomes of the tasks found in ``store``, returned as they were stored."""
    keys = tasks.select("cache_key", "row_index", "pillar_index")
    return skew_join(keys, store, ["cache_key"], F.col("row_index"))


def uncached_tasks(tasks: DataFrame, store: DataFrame) -> DataFrame:
    """Tasks that still need a scorer.

    Equal rows share a key, so one key may hold many tasks; the store has each key once.
    """
    known = store.select("cache_key", F.lit(True).alias("_known"))
    joined = skew_join(tasks, known, ["cache_key"], F.col("row_index"), how="left")
    return joined.where(F.col("_known").isNull()).drop("_known")


def missing_inputs(columns: Sequence[str]) -> Column:
    """The rubric-required inputs a task lacks; needs ``required_inputs``.

    Empty lists and empty objects count as missing, empty text does not.
    """

    def absent(name: str) -> Column:
        if name not in columns:
            return F.lit(True)
        if name in ("retrieved_context", "chat_history"):
            return F.coalesce(F.size(name) <= 0, F.lit(True))
        if name == "metadata":
            return F.coalesce(F.col(name) == "{}", F.lit(True))
        return F.col(name).isNull()

    names = [
        "user_input",
        "agent_output",
        "category",
        "retrieved_context",
        "chat_history",
        "metadata",
        "intent",
        "topic",
        "ground_truth_answer",
        "policy_reference",
    ]
    lacking = reasons({n: absent(n) for n in names})
    # Reported in the order of the rubric.
    return F.filter("required_inputs", lambda n: F.array_contains(lacking, n))


def gate_tasks(tasks: DataFrame, rubrics: DataFrame) -> DataFrame:
    """Tasks with ``missing_inputs``; a task with any is failed instead of scored."""
    joined = tasks.join(F.broadcast(rubrics.select("pillar", "required_inputs")), "pillar")
    return joined.withColumn("missing_inputs", missing_inputs(tasks.columns)).drop("required_inputs")


def gate_failures(gated: DataFrame) -> DataFrame:
    """Error outcomes of the tasks that lack inputs."""
    names = F.array_join(F.transform("missing_inputs", lambda n: F.concat(F.lit("'"), n, F.lit("'"))), ", ")
    # Fixed text.
    message = F.concat(
        F.lit("Unhandled judge exception: Row '"),
        F.col("record_id"),
        F.lit("' is missing rubric-required input(s) ["),
        names,
        F.lit("] for pillar '"),
        F.col("pillar"),
        F.lit("'."),
    )
    return gated.where(F.size("missing_inputs") > 0).select(
        "row_index",
        "record_id",
        "pillar",
        F.lit(0.0).alias("latency_ms"),
        F.lit(0).alias("attempts"),
        message.alias("error"),
        F.lit(EXECUTION_ERROR).alias("error_type"),
    )


# --- scorers --------------------------------------------------------------------

Scorer = Callable[[dict], "str | dict"]
RAW_SCHEMA = (
    "row_index long, record_id string, pillar string, raw string, latency_ms double, attempts int,"
    " input_tokens long, output_tokens long, model_name string, error string, error_type string"
)


class ScorerRegistry:
    """Scorers by pillar. A scorer takes a task as a dict and returns raw JSON text.

    It may instead return a dict with ``raw`` and optionally ``latency_ms``, ``attempts``,
    ``input_tokens``, ``output_tokens`` and ``model_name``.
    """

    def __init__(self) -> None:
        self._scorers: dict[str, Scorer] = {}

    def register(self, pillar: str, scorer: Scorer, force: bool = False) -> None:
        if not pillar:
            raise ValueError("pillar must not be empty")
        known = self._scorers.get(pillar)
        if known is not None and known is not scorer and not force:
            raise ValueError(f"pillar {pillar!r} already has a scorer; pass force=True to replace it")
        self._scorers[pillar] = scorer

    def resolve(self, pillar: str) -> Scorer:
        if pillar not in self._scorers:
            available = ", ".join(sorted(self._scorers)) or "(none)"
            raise KeyError(f"no scorer for pillar {pillar!r}, registered: {available}")
        return self._scorers[pillar]

    def pillars(self) -> list[str]:
        return sorted(self._scorers)


def run_scorers(
    tasks: DataFrame,
    registry: ScorerRegistry,
    pillars: Sequence[str],
    columns: Sequence[str],
    max_parallel: int | None = None,
) -> DataFrame:
    """Raw scorer outputs (``RAW_SCHEMA``), one per task.

    ``columns`` are the task columns a scorer sees. An exception in one task becomes that task's
    error. ``max_parallel`` caps the number of scorer calls in flight.
    """
    scorers = {p: registry.resolve(p) for p in pillars}
    needed = list(dict.fromkeys(["row_index", "record_id", "pillar", *columns]))
    selected = tasks.where(F.col("pillar").isin(list(scorers))).select(*needed)
    if max_parallel is not None:
        selected = selected.repartition(max_parallel, "record_id", "pillar")

    def score(task: dict) -> dict:
        start = time.perf_counter()
        base = {"row_index": task["row_index"], "record_id": task["record_id"], "pillar": task["pillar"]}
        try:
            answer = scorers[task["pillar"]](task)
            fields = answer if isinstance(answer, dict) and "raw" in answer else {"raw": answer}
            raw = fields["raw"] if isinstance(fields["raw"], str) else json.dumps(fields["raw"])
            elapsed = (time.perf_counter() - start) * 1000.0
            return {"latency_ms": elapsed, "attempts": 1, **base, **fields, "raw": raw}
        except Exception as exc:  # one task must never fail the run
            return {
                **base,
                "latency_ms": 0.0,
                "attempts": 0,
                "error": f"Unhandled judge exception: {exc}",
                "error_type": type(exc).__name__,
            }

    names = [part.strip().split()[0] for part in RAW_SCHEMA.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            results = [score(task) for task in batch.to_dict("records")]
            frame = pd.DataFrame(results, columns=names)
            for name in ("raw", "model_name", "error", "error_type"):
                frame[name] = frame[name].astype(object).where(frame[name].notna(), None)
            for name in ("input_tokens", "output_tokens", "row_index"):
                frame[name] = frame[name].astype("Int64")
            frame["attempts"] = frame["attempts"].astype("Int32")
            yield frame

    return selected.mapInPandas(run, RAW_SCHEMA)


# --- summaries --------------------------------------------------------------------


def ordered_outcomes(outcomes: DataFrame) -> DataFrame:
    """Outcomes in (row, pillar name) order."""
    return outcomes.orderBy("row_index", "pillar")


def _ok() -> Column:
    return F.col("result").isNotNull() & F.col("error").isNull()


def latency_percentiles(outcomes: DataFrame) -> DataFrame:
    """Exact p50 and p95 of the latency over all outcomes, failed ones included."""
    return exact_percentiles(
        outcomes, F.col("latency_ms"), {"latency_ms_p50": 0.5, "latency_ms_p95": 0.95}
    )


def run_summary(outcomes: DataFrame, cache_hits: int = 0, duration_s: float = 0.0) -> DataFrame:
    """Totals, latency percentiles and token sums of a run as one row."""
    totals = outcomes.agg(
        F.count(F.lit(1)).alias("total_tasks"),
        F.count_if(_ok()).alias("succeeded"),
        F.count_if(~_ok()).alias("failed"),
        F.coalesce(F.sum("usage.input_tokens"), F.lit(0)).alias("total_input_tokens"),
        F.coalesce(F.sum("usage.output_tokens"), F.lit(0)).alias("total_output_tokens"),
    )
    percentiles = latency_percentiles(outcomes).select(F.struct("latency_ms_p50", "latency_ms_p95")).scalar()
    return totals.withColumn("_p", percentiles).select(
        "total_tasks",
        "succeeded",
        "failed",
        F.lit(cache_hits).cast("long").alias("cache_hits"),
        F.lit(duration_s).alias("duration_s"),
        F.col("_p.latency_ms_p50").alias("latency_ms_p50"),
        F.col("_p.latency_ms_p95").alias("latency_ms_p95"),
        "total_input_tokens",
        "total_output_tokens",
    )


def pillar_counts(outcomes: DataFrame) -> DataFrame:
    """Succeeded and failed outcomes per pillar that occurs."""
    return outcomes.groupBy("pillar").agg(
        F.count_if(_ok()).alias("succeeded"), F.count_if(~_ok()).alias("failed")
    )
