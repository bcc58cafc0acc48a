"""Raw grader output to validated outcomes.

Every check is a column expression that yields reason codes; an output with any reason becomes an
error outcome, all others carry a typed result. Field checks run on the parsed JSON value, so a
wrong type is told apart from a missing field.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from judgespark.functions.text import normal_form, parse_json, reasons
from judgespark.schema import ANCHOR_TOLERANCE, CORE_RESULT, EVIDENCE_STATUSES, SCORES

PARSE_ERROR = "JudgeOutputParseError"
REQUIRED = ("pillar", "score", "confidence", "decision_summary", "rubric_anchor")
_FIELDS = tuple(f.name for f in CORE_RESULT.fields)
_LOW, _HIGH = SCORES[0], SCORES[-1]


# Every check reads the object once split into its fields: ``_fields`` is a map of JSON values and
# ``_kind_<field>`` the JSON type of one of them. Extracting by path would walk the value each time.


def _value(field: str, dtype: str) -> str:
    return f"try_variant_get(_fields['{field}'], '$', '{dtype}')"


def _list_of(field: str, condition: str) -> str:
    items = _value(field, "array<variant>")
    return f"(_kind_{field} LIKE 'ARRAY%' AND forall({items}, x -> {condition}))"


def _evidence_list() -> str:
    statuses = ", ".join(f"'{s}'" for s in EVIDENCE_STATUSES)
    shapes = ", ".join(
        f"'OBJECT<{s}>'"
        for s in (
            "claim: STRING, status: STRING",
            "claim: STRING, status: STRING, support: STRING",
            "claim: STRING, status: STRING, support: VOID",
        )
    )
    return _list_of(
        "evidence_for_score",
        f"schema_of_variant(x) IN ({shapes})"
        f" AND coalesce(try_variant_get(x, '$.status', 'string') IN ({statuses}), false)",
    )


def _valid(field: str) -> str:
    """Condition that a field that is present holds an acceptable value."""
    kind = f"_kind_{field}"
    text = f"{kind} = 'STRING' AND {_value(field, 'string')} <> ''"
    on_scale = f"{kind} = 'BIGINT' AND {_value(field, 'bigint')} BETWEEN {_LOW} AND {_HIGH}"
    conditions = {
        "pillar": text,
        "decision_summary": text,
        "score": on_scale,
        "rubric_anchor": on_scale,
        "confidence": f"{_value(field, 'double')} BETWEEN 0 AND 1",
        "evidence_for_score": _evidence_list(),
        "why_not_higher": f"{kind} IN ('STRING', 'VOID')",
        "why_not_lower": f"{kind} IN ('STRING', 'VOID')",
    }
    return f"coalesce({conditions.get(field) or _list_of(field, "schema_of_variant(x) = 'STRING'")}, false)"


def structure_reasons() -> str:
    """Reasons why the fields do not have the result's structure."""
    # Fewer known fields than keys means that some key is unknown.
    known = " + ".join(f"int(_kind_{f} IS NOT NULL)" for f in _FIELDS)
    allowed = ", ".join(f"'{f}'" for f in _FIELDS)
    named = f"transform(array_sort(array_except(map_keys(_fields), array({allowed}))), k -> concat('unknown_field:', k))"
    unknown = f"IF(size(_fields) > {known}, {named}, CAST(array() AS array<string>))"
    checks = []
    for f in _FIELDS:
        absent = f"'missing:{f}'" if f in REQUIRED else "NULL"
        checks.append(f"CASE WHEN _kind_{f} IS NULL THEN {absent} WHEN NOT {_valid(f)} THEN 'invalid:{f}' END")
    # Joined text instead of an array without NULLs: the latter would not use generated code.
    found = f"array_remove(split(concat_ws(',', {', '.join(checks)}), ','), '')"
    return f"CASE WHEN _fields IS NULL THEN array('not_an_object') ELSE concat({found}, {unknown}) END"


def with_core(raw: DataFrame) -> DataFrame:
    """Add ``structure_reasons`` and, when there are none, the typed result ``core``."""
    split = raw.withColumn("_v", parse_json(F.col("raw"))).withColumn(
        "_fields", F.expr("try_variant_get(_v, '$', 'map<string,variant>')")
    )
    kinds = [f"schema_of_variant(_fields['{f}']) AS _kind_{f}" for f in _FIELDS]
    checked = split.selectExpr("*", *kinds).withColumn("structure_reasons", F.expr(structure_reasons()))
    typed = F.expr(f"try_variant_get(_v, '$', '{CORE_RESULT.simpleString()}')")
    filled = []
    for f in CORE_RESULT.fields:
        c = F.col(f"_typed.{f.name}")
        if f.dataType.typeName() == "array":
            c = F.coalesce(c, F.array().cast(f.dataType))
        filled.append(c.alias(f.name))
    return (
        checked.withColumn("_typed", F.when(F.size("structure_reasons") == 0, typed))
        .withColumn("core", F.when(F.col("_typed").isNotNull(), F.struct(*filled)))
        .drop("_v", "_fields", "_typed", *[f"_kind_{f}" for f in _FIELDS])
    )


def invariant_reasons() -> Column:
    """Broken rules between the fields of ``core``."""
    score, tags = F.col("core.score"), F.col("core.failure_tags")

    def blank(name: str) -> Column:
        return F.coalesce(F.col(f"core.{name}") == "", F.lit(True))

    shared = F.arrays_overlap(
        F.transform("core.elements_present", normal_form), F.transform("core.elements_missing", normal_form)
    )
    checks = {
        "tags_with_top_score": (score == _HIGH) & (F.size(tags) > 0),
        "why_not_higher_missing": (score < _HIGH) & blank("why_not_higher"),
        "why_not_lower_missing": (score > _LOW) & blank("why_not_lower"),
        "anchor_too_far": F.abs(F.col("core.rubric_anchor") - score) > ANCHOR_TOLERANCE,
        "elements_overlap": F.coalesce(shared, F.lit(False)),
    }
    return reasons(checks)


def rubric_reasons() -> Column:
    """Conflicts of ``core`` with the rubric columns of the task's pillar."""
    score, anchor, tags = F.col("core.score"), F.col("core.rubric_anchor"), F.col("core.failure_tags")
    declared = F.size("_tags") > 0
    unknown = F.size(F.array_except(tags, F.col("_tags"))) > 0
    checks = {
        "pillar_mismatch": F.col("core.pillar") != F.col("pillar"),
        "score_out_of_range": ~score.between(F.col("_min"), F.col("_max")),
        "rubric_anchor_out_of_range": ~anchor.between(F.col("_min"), F.col("_max")),
        "unknown_failure_tag": declared & unknown,
        "failure_tags_without_taxonomy": ~declared & (F.size(tags) > 0),
        "duplicate_failure_tag": F.size(F.array_distinct(tags)) < F.size(tags),
    }
    return reasons(checks)


def checked_outputs(raw: DataFrame, rubrics: DataFrame) -> DataFrame:
    """Raw outputs with ``core`` and the three reason arrays.

    Later checks need the earlier ones to hold, so they are empty when an earlier one failed.
    Rubrics are one row per pillar and broadcast; a pillar without rubric is an error.
    """
    rules = rubrics.select(
        "pillar",
        F.col("version").alias("_version"),
        F.col("score_min").alias("_min"),
        F.col("score_max").alias("_max"),
        F.col("failure_tags").alias("_tags"),
    )
    none = F.array().cast("array<string>")
    parsed = with_core(raw).join(F.broadcast(rules), "pillar", "left")
    return parsed.withColumn(
        "invariant_reasons", F.when(F.col("core").isNotNull(), invariant_reasons()).otherwise(none)
    ).withColumn(
        "rubric_reasons",
        F.when(
            F.col("core").isNotNull() & (F.size("invariant_reasons") == 0),
            F.when(F.col("_version").isNull(), F.array(F.lit("no_rubric"))).otherwise(rubric_reasons()),
        ).otherwise(none),
    )


def assemble_outcomes(
    raw: DataFrame, rubrics: DataFrame, run_id: str, prompt_version: str, pillars_extras: Column | None = None
) -> DataFrame:
    """Outcomes from raw scorer outputs: a result, or an error with its type, never both.

    ``raw`` follows ``tasks.RAW_SCHEMA``. ``pillars_extras`` is an optional map column kept on
    successful outcomes.
    """
    checked = checked_outputs(raw, rubrics)
    early = F.concat("structure_reasons", "invariant_reasons")
    failed_rubric = F.concat(
        F.lit("Judge output for pillar '"),
        F.col("pillar"),
        F.lit("' failed rubric validation: "),
        F.array_join("rubric_reasons", ", "),
        F.lit("."),
    )
    message = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(F.size(early) > 0, F.concat(F.lit("Judge output is invalid: "), F.array_join(early, ", "), F.lit(".")))
        .when(F.size("rubric_reasons") > 0, failed_rubric)
    )
    staged = checked.withColumn("_message", message)
    ok = F.col("_message").isNull()
    result = F.struct(
        *[F.col(f"core.{f}").alias(f) for f in _FIELDS],
        F.col("model_name").alias("raw_model_name"),
        F.lit(prompt_version).alias("prompt_version"),
        F.col("_version").alias("rubric_version"),
    )
    extras = pillars_extras if pillars_extras is not None else F.create_map().cast("map<string,string>")
    answered = F.col("error").isNull()
    return staged.select(
        "row_index",
        "record_id",
        "pillar",
        "latency_ms",
        "attempts",
        F.struct(
            "input_tokens", "output_tokens", (F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens")
        ).alias("usage"),
        "model_name",
        F.lit(run_id).alias("run_id"),
        F.when(ok, result).alias("result"),
        F.col("_message").alias("error"),
        F.when(~ok, F.coalesce("error_type", F.lit(PARSE_ERROR))).alias("error_type"),
        F.when(
            answered, F.struct(F.lit(prompt_version).alias("prompt"), F.col("_version").alias("rubric"))
        ).alias("prompt_versions"),
        F.when(ok, extras).otherwise(F.create_map().cast("map<string,string>")).alias("extras"),
    )
