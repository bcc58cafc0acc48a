"""Rubric tables: one row per pillar with inputs, failure tags and score anchors."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from judgespark.functions.text import reasons
from judgespark.operators.crosstab import quoted
from judgespark.schema import (
    PILLARS,
    RUBRIC_ALLOWED_INPUTS,
    RUBRIC_INPUTS,
    RUBRIC_TAGS,
    RUBRIC_VERSION,
    SCORES,
)

ANCHOR = T.StructType(
    [
        T.StructField("score", T.IntegerType()),
        T.StructField("name", T.StringType()),
        T.StructField("description", T.StringType()),
    ]
)
RUBRIC = T.StructType(
    [
        T.StructField("pillar", T.StringType()),
        T.StructField("version", T.StringType()),
        T.StructField("score_min", T.IntegerType()),
        T.StructField("score_max", T.IntegerType()),
        T.StructField("required_inputs", T.ArrayType(T.StringType())),
        T.StructField("anchors", T.ArrayType(ANCHOR)),
        T.StructField("failure_tags", T.ArrayType(T.StringType())),
    ]
)


def _strings(values: Sequence[str]) -> str:
    return f"CAST(array({', '.join(quoted(v) for v in values)}) AS array<string>)"


def default_rubrics(
    spark: SparkSession,
    anchors: Mapping[str, Sequence[tuple[int, str, str]]] | None = None,
    pillars: Sequence[str] = PILLARS,
) -> DataFrame:
    """The standard pillars; ``anchors`` gives ``(score, name, description)`` per pillar."""
    given = anchors or {}

    def anchor_array(pillar: str) -> str:
        structs = [
            f"named_struct('score', {score}, 'name', {quoted(name)}, 'description', {quoted(text)})"
            for score, name, text in given.get(pillar, [(s, f"level {s}", f"score {s} of 5") for s in SCORES])
        ]
        return f"array({', '.join(structs)})"

    rows = [
        f"""struct({quoted(p)} AS pillar, '{RUBRIC_VERSION}' AS version, {SCORES[0]} AS score_min,
          {SCORES[-1]} AS score_max, {_strings(RUBRIC_INPUTS[p])} AS required_inputs,
          {anchor_array(p)} AS anchors, {_strings(RUBRIC_TAGS[p])} AS failure_tags)"""
        for p in pillars
    ]
    return spark.range(1).selectExpr(f"inline(array({', '.join(rows)}))")


def load_rubrics(spark: SparkSession, path: str) -> DataFrame:
    """Rubrics from JSON files, one object per file or an array of objects."""
    table = spark.read.json(path, schema=RUBRIC, multiLine=True, mode="FAILFAST")
    return table.withColumns(
        {
            "score_min": F.coalesce("score_min", F.lit(SCORES[0])),
            "score_max": F.coalesce("score_max", F.lit(SCORES[-1])),
            "required_inputs": F.coalesce("required_inputs", F.array().cast("array<string>")),
            "failure_tags": F.coalesce("failure_tags", F.array().cast("array<string>")),
        }
    )


def rubric_issues(rubrics: DataFrame) -> DataFrame:
    """``(pillar, issue)`` for every broken rubric rule."""
    scores = F.transform("anchors", lambda a: a["score"])
    scale = F.sequence(F.col("score_min"), F.col("score_max"))
    tags = F.col("failure_tags")
    allowed = F.array(*[F.lit(i) for i in RUBRIC_ALLOWED_INPUTS])
    checks = {
        "invalid_scale": F.col("score_min") >= F.col("score_max"),
        "invalid_pillar": F.col("pillar") != F.lower(F.trim("pillar")),
        "anchor_out_of_scale": F.exists(scores, lambda s: (s < F.col("score_min")) | (s > F.col("score_max"))),
        "duplicate_anchor": F.size(F.array_distinct(scores)) < F.size(scores),
        "missing_anchor": (F.col("score_min") < F.col("score_max")) & (F.size(F.array_except(scale, scores)) > 0),
        "unknown_input": F.size(F.array_except("required_inputs", allowed)) > 0,
        "duplicate_input": F.size(F.array_distinct("required_inputs")) < F.size("required_inputs"),
        "invalid_tag": F.exists(tags, lambda t: (t == "") | (t != F.trim(t))),
        "duplicate_tag": F.size(F.array_distinct(tags)) < F.size(tags),
    }
    return rubrics.select("pillar", F.explode(reasons(checks)).alias("issue"))
