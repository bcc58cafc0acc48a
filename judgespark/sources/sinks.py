"""Results as flat tables: metric rows, outcome snapshots, trace rows, export rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from judgespark.functions.text import redact_or_truncate
from judgespark.operators.crosstab import METRIC_COLUMNS, quoted
from judgespark.operators.gates import STATUS_CODES, pillar_status
from judgespark.operators.scored import outcomes_with_rows
from judgespark.operators.skew import HOT_MIN_ROWS
from judgespark.schema import OVERALL, PILLARS

_KEY = r"regexp_replace({}, '[^A-Za-z0-9_\\-./ ]', '_')"


def _long(df: DataFrame, run_id: str, entries: Mapping[str, str]) -> DataFrame:
    """``(run_id, key, value)`` rows; ``entries`` maps a key expression to a value expression.

    NULL values are dropped: a zero would claim a measurement that does not exist.
    """
    structs = ", ".join(f"struct({key} AS key, double({value}) AS value)" for key, value in entries.items())
    return df.selectExpr(f"{quoted(run_id)} AS run_id", f"inline(array({structs}))").where("value IS NOT NULL")


def _prefixed(prefix: str, columns: Sequence[str]) -> dict[str, str]:
    return {f"concat({prefix}, '/{c}')": c for c in columns}


def agreement_metrics(report: DataFrame, run_id: str) -> DataFrame:
    """Metric rows ``<pillar>/<metric>`` of an agreement report."""
    name = f"IF(pillar = '{OVERALL}', 'overall', pillar)"
    return _long(report, run_id, _prefixed(name, ["support", *METRIC_COLUMNS]))


def slice_metrics(sliced: DataFrame, run_id: str) -> DataFrame:
    """``slice/<slice>/<pillar>/...`` support and alignment of a sliced report."""
    prefix = f"'slice/', {_KEY.format('slice')}, '/', pillar"
    shown = sliced.where(F.col("pillar") != OVERALL)
    return _long(shown, run_id, _prefixed(prefix, ["support", "severity_aware_alignment"]))


def reviewer_metrics(report: DataFrame, pairs: DataFrame, run_id: str) -> DataFrame:
    """Metric rows of the reviewer report and of the reviewer pairs."""
    key = _KEY.format("reviewer")
    counts = _long(
        report.where(F.col("pillar") == OVERALL), run_id, {f"concat('reviewer/', {key}, '/sample_count')": "sample_count"}
    )
    prefix = f"'reviewer/', {key}, '/', pillar"
    pillars = _long(
        report.where(F.col("pillar") != OVERALL),
        run_id,
        {
            **_prefixed(prefix, ["support", *METRIC_COLUMNS, "disagreement_rate", "within_1_agreement"]),
            f"concat({prefix}, '/large_miss_rate')": "large_miss_3_rate",
        },
    )
    prefix = f"'reviewer_pair/', {_KEY.format('reviewer_a')}, '__', {_KEY.format('reviewer_b')}"
    pair_rows = _long(
        pairs,
        run_id,
        {
            **_prefixed(prefix, ["overlap", "exact_match_rate", "within_1_rate"]),
            f"concat({prefix}, '/large_miss_rate')": "large_miss_3_rate",
        },
    )
    return counts.unionByName(pillars).unionByName(pair_rows)


def gate_metrics(report: DataFrame, gates: DataFrame, run_id: str) -> DataFrame:
    """``threshold/<pillar>/...`` status codes, and values under ``..._value``."""

    def code(status: str) -> str:
        return f"CASE {status} " + " ".join(f"WHEN '{s}' THEN {c}D" for s, c in STATUS_CODES.items()) + " END"

    prefix = "'threshold/', replace(pillar, '/', '_'), '/'"
    per_gate = _long(
        gates, run_id, {f"concat({prefix}, metric)": code("status"), f"concat({prefix}, metric, '_value')": "value"}
    )
    overall = _long(pillar_status(report, gates), run_id, {f"concat({prefix}, 'overall')": code("overall")})
    return overall.unionByName(per_gate)


def diagnostics_metrics(diagnostics: DataFrame, run_id: str) -> DataFrame:
    """``diag/<pillar>/...`` scalars and the compatibility flag."""
    prefix = f"'diag/', {_KEY.format('pillar')}"
    entries = {
        f"concat({prefix}, '/mean_residual_judge_minus_human')": "mean_residual",
        **_prefixed(
            prefix,
            ["pct_positive_residual", "ols_slope", "ols_intercept", "ols_r2", "js_vs_baseline", "psi_vs_baseline"],
        ),
    }
    flag = diagnostics.agg(F.coalesce(F.bool_or("baseline_compatible"), F.lit(False)).alias("compatible"))
    return _long(diagnostics, run_id, entries).unionByName(
        _long(flag, run_id, {"'diag/baseline_compatible'": "IF(compatible, 1D, 0D)"})
    )


def run_metadata(rows: DataFrame, fingerprint: DataFrame, run: Mapping[str, object]) -> DataFrame:
    """One row describing a run.

    ``run`` holds ``run_id``, ``provider``, ``pillars`` and per-pillar mappings ``model_alias``,
    ``model_name``, ``prompt_version`` and ``rubric_version``; ``kb_version`` and
    ``run_config_hash`` are optional.
    """
    pillars = list(run["pillars"])
    per_pillar = ["model_alias", "model_name", "prompt_version", "rubric_version"]
    missing = sorted(p for p in pillars if any(p not in run[name] for name in per_pillar))
    if missing:
        raise KeyError(f"run metadata lacks entries for pillars {missing}")

    def text(value: object) -> str:
        return "CAST(NULL AS STRING)" if value is None else quoted(str(value))

    maps = [
        f"map({', '.join(f'{quoted(p)}, {text(run[name][p])}' for p in pillars)}) AS {name}" for name in per_pillar
    ]
    counted = rows.agg(F.count(F.lit(1)).alias("dataset_row_count"))
    return counted.withColumn("dataset_fingerprint", fingerprint.scalar()).selectExpr(
        f"{text(run['run_id'])} AS run_id",
        "dataset_fingerprint",
        "dataset_row_count",
        f"array({', '.join(quoted(p) for p in pillars)}) AS pillars",
        f"{text(run.get('provider', 'unknown'))} AS provider",
        f"{text(run.get('run_config_hash'))} AS run_config_hash",
        f"{text(run.get('kb_version'))} AS kb_version",
        *maps,
    )


def metadata_params(metadata: DataFrame, pillars: Sequence[str] = PILLARS) -> DataFrame:
    """Run metadata as flat ``(key, value)`` text rows; unset optional values are left out."""
    entries = {
        "run_id": "run_id",
        "dataset_fingerprint": "dataset_fingerprint",
        "dataset_row_count": "string(dataset_row_count)",
        "pillars": "array_join(pillars, ',')",
        "provider": "provider",
        "run_config_hash": "run_config_hash",
        "kb_version": "kb_version",
    }
    for p in pillars:
        for name in ("model_alias", "model_name", "prompt_version", "rubric_version"):
            entries[f"{name}_{p}"] = f"{name}[{quoted(p)}]"
    structs = ", ".join(f"struct({quoted(k)} AS key, {v} AS value)" for k, v in entries.items())
    return metadata.selectExpr(f"inline(array({structs}))").where("value IS NOT NULL")


# --- outcomes -----------------------------------------------------------------


def outcome_snapshot(
    outcomes: DataFrame, max_outcomes: int = 500, order: Sequence[str] = ("outcome_index",)
) -> DataFrame:
    """The first outcomes in ``order``, each with a flag whether the run has more."""
    first = (
        outcomes.orderBy(*order)
        .limit(max_outcomes)
        .select("outcome_index", "record_id", "pillar", "latency_ms", "error_type", F.col("result.score").alias("score"))
    )
    total = outcomes.agg(F.count(F.lit(1)).alias("n")).scalar()
    return first.withColumn("outcomes_truncated", total > max_outcomes)


def trace_rows(
    rows: DataFrame,
    outcomes: DataFrame,
    redact: bool = False,
    max_length: int = 2048,
    hot_min_rows: int = HOT_MIN_ROWS,
) -> DataFrame:
    """One trace row per outcome whose record has a row: name, metadata, input, output, usage."""
    joined = outcomes_with_rows(rows, outcomes, ["category", "user_input", "agent_output"], hot_min_rows)
    failed = F.col("result").isNull()
    inputs, outputs = (F.coalesce(f"usage.{side}_tokens", F.lit(0).cast("long")) for side in ("input", "output"))
    return joined.select(
        F.concat("pillar", F.lit("@"), "record_id").alias("name"),
        F.struct(
            "record_id",
            "pillar",
            "latency_ms",
            "attempts",
            "category",
            F.col("prompt_versions.prompt").alias("prompt_version"),
            F.col("prompt_versions.rubric").alias("rubric_version"),
            F.when(F.size("extras") > 0, F.col("extras")).alias("extras"),
        ).alias("metadata"),
        F.struct(
            redact_or_truncate(F.col("user_input"), redact, max_length).alias("user_input"),
            redact_or_truncate(F.col("agent_output"), redact, max_length).alias("agent_output"),
        ).alias("input"),
        F.when(
            ~failed,
            F.struct("result.score", "result.confidence", "result.decision_summary", "result.failure_tags"),
        ).alias("output"),
        F.col("model_name").alias("model"),
        F.struct(inputs.alias("input"), outputs.alias("output"), (inputs + outputs).alias("total")).alias("usage"),
        F.when(failed, "ERROR").otherwise("DEFAULT").alias("level"),
        F.when(failed, F.coalesce("error", "error_type", F.lit("judge_failed"))).alias("status_message"),
    )


def export_rows(outcomes: DataFrame) -> DataFrame:
    """Outcomes flattened for export: scalars, JSON result, extras and usage."""
    ok = F.col("result").isNotNull() & F.col("error").isNull()
    return outcomes.select(
        "pillar",
        "record_id",
        ok.alias("ok"),
        "latency_ms",
        "attempts",
        "model_name",
        "run_id",
        "error",
        "error_type",
        F.to_json("extras").alias("extras"),
        F.to_json("result", {"ignoreNullFields": "false"}).alias("result"),
        F.col("usage.input_tokens").alias("input_tokens"),
        F.col("usage.output_tokens").alias("output_tokens"),
        F.col("usage.total_tokens").alias("total_tokens"),
    )


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Append metric rows, one directory per run."""
    metrics.write.mode("append").partitionBy("run_id").parquet(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
