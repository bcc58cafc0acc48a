"""Evaluation inputs derived from the sample tables with the DataFrame API."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from judgespark.schema import OUTCOME, PILLARS, RUBRIC_TAGS, RUBRIC_VERSION


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def eval_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One normalized row per order; every 40th order repeats the record id before it."""
    labels = [
        f"""CAST(CASE WHEN (o_orderkey + {k}) % 11 <> 0
          THEN 1 + (o_orderkey * 7 + {k * 3} + o_custkey % 2) % 5 END AS INT) AS label_{p}"""
        for k, p in enumerate(PILLARS, start=1)
    ]
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS row_index",
        "CAST(IF(o_orderkey % 40 = 1, o_orderkey - 1, o_orderkey) AS STRING) AS record_id",
        "concat('Where is order ', o_orderkey, ' of customer ', o_custkey, '?') AS user_input",
        "concat('Order ', o_orderkey, ' has status ', o_orderstatus, '.') AS agent_output",
        "o_orderpriority AS category",
        "CASE WHEN o_custkey % 4 <> 0 THEN concat('rev-', o_custkey % 12) END AS reviewer_name",
        "CASE WHEN o_custkey % 8 <> 0 THEN concat('id-', o_custkey % 12) END AS reviewer_id",
        "CASE WHEN o_custkey % 7 <> 0 THEN concat('intent_', o_custkey % 7) END AS intent",
        "CASE WHEN o_orderkey % 9 <> 0 THEN o_orderstatus END AS topic",
        "concat('conv-', o_custkey) AS conversation_id",
        "CASE WHEN o_orderkey % 10 <> 0 THEN concat('model-', o_orderkey % 3) END AS model_name",
        *labels,
    )


def pillar_case(number: str) -> str:
    """Pillar names for 1..6 and an inactive pillar for every other number."""
    cases = " ".join(f"WHEN {k} THEN '{p}'" for k, p in enumerate(PILLARS, start=1))
    return f"CASE {number} {cases} ELSE 'tone' END"


def outcomes_from(lineitem: DataFrame, more: Sequence[str] = ()) -> DataFrame:
    """One grader outcome per line item, with ``more`` columns of it; works on batch and streaming input."""
    tags = " ".join(f"WHEN '{p}' THEN '{tags[0]}'" for p, tags in RUBRIC_TAGS.items())
    evidence = OUTCOME["result"].dataType["evidence_for_score"].dataType.simpleString()
    result = f"""named_struct(
        'pillar', pillar,
        'score', score,
        'confidence', confidence,
        'decision_summary', concat('score ', score, ' on ', pillar),
        'evidence_for_score', CAST(NULL AS {evidence}),
        'failure_tags', CASE WHEN tag IS NULL OR score = 5 THEN CAST(array() AS array<string>)
                             WHEN score < 3 THEN array(tag, 'second') ELSE array(tag) END,
        'why_not_higher', CASE WHEN score < 5 THEN 'some claims lack support' END,
        'why_not_lower', CASE WHEN score > 1 THEN 'the core answer is usable' END,
        'rubric_anchor', score,
        'elements_present', CAST(array() AS array<string>),
        'elements_missing', CAST(array() AS array<string>),
        'raw_model_name', model_name,
        'prompt_version', 'v1',
        'rubric_version', '{RUBRIC_VERSION}')"""
    base = lineitem.selectExpr(
        "l_orderkey * 8 + l_linenumber AS outcome_index",
        """CASE WHEN l_orderkey % 997 = 0 THEN concat('ghost-', l_orderkey)
             WHEN l_orderkey % 80 = 1 THEN CAST(l_orderkey - 1 AS STRING)
             ELSE CAST(l_orderkey AS STRING) END AS record_id""",
        f"{pillar_case('l_linenumber')} AS pillar",
        "l_extendedprice / 100 AS latency_ms",
        "CAST(1 + l_suppkey % 3 AS INT) AS attempts",
        "CASE WHEN l_linenumber % 5 <> 0 THEN floor(l_quantity) * 10 END AS input_tokens",
        "l_partkey % 300 AS output_tokens",
        "concat('model-', l_suppkey % 3) AS model_name",
        "l_suppkey % 13 = 0 AS failed",
        "CAST(1 + (l_orderkey * 7 + l_linenumber * 3 + l_partkey % 4) % 5 AS INT) AS score",
        "l_discount * 10 AS confidence",
        *more,
    ).selectExpr("*", f"CASE pillar {tags} END AS tag")
    return base.selectExpr(
        "outcome_index",
        "record_id",
        "pillar",
        "latency_ms",
        "attempts",
        """named_struct('input_tokens', input_tokens, 'output_tokens', output_tokens,
             'total_tokens', input_tokens + output_tokens) AS usage""",
        "model_name",
        "'run-1' AS run_id",
        f"CASE WHEN NOT failed THEN {result} END AS result",
        "CASE WHEN failed THEN 'provider timed out' END AS error",
        "CASE WHEN failed THEN 'ProviderTimeoutError' END AS error_type",
        f"""CASE WHEN NOT failed THEN named_struct('prompt', 'v1', 'rubric', '{RUBRIC_VERSION}') END
             AS prompt_versions""",
        "CAST(map() AS map<string,string>) AS extras",
        *more,
    )


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes_from(table(spark, sf_dir, "lineitem"))
