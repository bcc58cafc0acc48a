"""Source columns to normalized rows, with failures kept per row.

One projection turns every mapped cell into a value and an error code; good rows and failures are
two filters over it. Nothing is raised for a bad cell.
"""

from __future__ import annotations

import ast
import json
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from judgespark.functions.text import is_emptyish, null_if_emptyish, parse_json, reasons, strip
from judgespark.operators.ordinal import DIGEST_FANOUT, dense_ordinal, tree_digest
from judgespark.schema import (
    CHUNK,
    CONTEXT_FIELD,
    HISTORY_FIELD,
    INT_FIELDS,
    LABEL_FIELDS,
    METADATA_FIELD,
    NORMALIZED_FIELDS,
    REQUIRED_FIELDS,
    SCORES,
    TEXT_FIELDS,
    TURN,
    TURN_ROLES,
)

# Failure reasons (fixed texts) and the per-field codes behind them.
REASON_CONSTRAINT = "Pydantic validation failed"
REASON_PARSE = "Field parse errors"
CONSTRAINT_CODES = ("missing", "out_of_range")

_JSON_FIELDS = (CONTEXT_FIELD, HISTORY_FIELD, METADATA_FIELD)
# Text that is not JSON but may be a Python literal: a bracket or quote first, or a bare number.
_LITERAL_START = r"""^(?:[\[({'"]|[bBuUrR]['"]|[+-]?[0-9.][0-9a-fA-FxXoOjJ_.+-]*$)"""


# --- mapping ------------------------------------------------------------------


def check_mapping(mapping: Mapping[str, str]) -> None:
    """Raise when the mapping itself is unusable."""
    unknown = sorted(set(mapping) - set(NORMALIZED_FIELDS))
    if unknown:
        raise ValueError(f"unknown normalized fields {unknown}, allowed: {sorted(NORMALIZED_FIELDS)}")
    blank = sorted(target for target, source in mapping.items() if not str(source).strip())
    if blank:
        raise ValueError(f"blank source columns for {blank}")
    used: dict[str, str] = {}
    for target, source in mapping.items():
        if source in used:
            raise ValueError(f"source column {source!r} is mapped to both {used[source]!r} and {target!r}")
        used[source] = target


def mapping_issues(mapping: Mapping[str, str], source_columns: Sequence[str]) -> list[tuple[str, str, str]]:
    """``(column, issue, detail)`` for unmapped required fields and unknown source columns."""
    issues = [
        (field, "missing_required_mapping", f"required field {field!r} is not mapped")
        for field in REQUIRED_FIELDS
        if field not in mapping
    ]
    issues += [
        (field, "unknown_source_column", f"source column {source!r} does not exist")
        for field, source in mapping.items()
        if source not in source_columns
    ]
    return issues


def mapping_report(spark: SparkSession, mapping: Mapping[str, str], source_columns: Sequence[str]) -> DataFrame:
    """:func:`mapping_issues` as a table ``(column, issue, detail)``."""
    schema = "column string, issue string, detail string"
    return spark.createDataFrame(mapping_issues(mapping, source_columns), schema)


def mapping_errors(spark: SparkSession, mapping: Mapping[str, str]) -> DataFrame:
    """Rules of the mapping itself that are broken, as a table ``(column, issue)``: unknown targets, blank
    sources, and sources that a target before already uses."""
    rows, used = [], set()
    for target, source in mapping.items():
        if target not in NORMALIZED_FIELDS:
            rows.append((target, "unknown_target"))
        if not str(source).strip():
            rows.append((target, "blank_source"))
        elif source in used:
            rows.append((target, "source_used_twice"))
        used.add(source)
    return spark.createDataFrame(rows, "column string, issue string")


def mapping_table_issues(mappings: DataFrame, columns: DataFrame) -> DataFrame:
    """``(dataset, column, issue)`` of many mappings at once.

    ``mappings`` has ``(dataset, position, target, source)`` and ``columns`` the ``(dataset, column)`` that the sources
    have. Unmapped required fields and unknown source columns, as :func:`mapping_issues` tells them for one.
    """
    required = F.explode(F.array(*[F.lit(f) for f in REQUIRED_FIELDS])).alias("column")
    mapped = mappings.select("dataset", F.col("target").alias("column"))
    missing = mappings.select("dataset").distinct().select("dataset", required).join(mapped, ["dataset", "column"], "left_anti")
    known = columns.select("dataset", F.col("column").alias("source"))
    unknown = mappings.join(known, ["dataset", "source"], "left_anti")
    return missing.withColumn("issue", F.lit("missing_required_mapping")).unionByName(
        unknown.select("dataset", F.col("target").alias("column"), F.lit("unknown_source_column").alias("issue"))
    )


def mapping_table_errors(mappings: DataFrame) -> DataFrame:
    """``(dataset, column, issue)``: the rules of :func:`mapping_errors` over a table of mappings, by ``position``."""
    blank = F.trim(F.coalesce("source", F.lit(""))) == ""
    nth = F.row_number().over(Window.partitionBy("dataset", "source").orderBy("position", "target"))
    checks = {
        "unknown_target": ~F.col("target").isin(list(NORMALIZED_FIELDS)),
        "blank_source": blank,
        "source_used_twice": ~blank & (F.col("_nth") > 1),
    }
    return mappings.withColumn("_nth", nth).select("dataset", F.col("target").alias("column"), F.explode(reasons(checks)).alias("issue"))


# --- cells --------------------------------------------------------------------


def _source(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _as_text(c: Column, dtype: T.DataType) -> Column:
    """A cell as text: containers as JSON, booleans capitalised, NaN as NULL."""
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(c, {"ignoreNullFields": "false"})
    if isinstance(dtype, T.BooleanType):
        return F.initcap(c.cast("string"))
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c), c.cast("string"))
    return c.cast("string")


@F.pandas_udf(T.StringType())
def _literal_to_json(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """JSON text of Python literals; NULL where the text is none."""

    def convert(text: str | None) -> str | None:
        if text is None:
            return None
        try:
            value = ast.literal_eval(text.strip())
        except (ValueError, SyntaxError, MemoryError, RecursionError):
            return None
        if isinstance(value, dict):
            return json.dumps({str(k): v for k, v in value.items()}, default=str)
        if isinstance(value, list):
            return json.dumps([x if isinstance(x, (dict, str)) or x is None else str(x) for x in value], default=str)
        return json.dumps(str(value))

    for texts in batches:
        yield texts.map(convert, na_action="ignore")


def literal_to_json(c: Column) -> Column:
    """``_literal_to_json`` for the cells that can hold a literal; others skip Python."""
    return _literal_to_json(F.when(F.ltrim(c).rlike(_LITERAL_START), c))


# Integers and floats as Python reads them, digit groups included.
_NUMBER = r"(?i)^[+-]?([0-9]+(_[0-9]+)*(\.([0-9]+(_[0-9]+)*)?)?|\.[0-9]+(_[0-9]+)*)(e[+-]?[0-9]+)?$"
_INFINITE = r"(?i)^[+-]?inf(inity)?$"


def with_int_cells(cells: DataFrame, fields: Mapping[str, T.DataType]) -> DataFrame:
    """Replace the cell ``_<field>`` of integer fields by ``_value_`` and ``_code_`` columns.

    Whole floats such as "5.0" are accepted. Text is trimmed and matched in steps of their own, so
    that each pattern runs once per cell.
    """
    texts = [f for f, dtype in fields.items() if isinstance(dtype, T.StringType)]
    cells = cells.withColumns({f"_{f}": strip(F.col(f"_{f}")) for f in texts})
    numbers = {
        f"_number_{f}": F.when(
            F.col(f"_{f}").rlike(_NUMBER), F.regexp_replace(f"_{f}", "_", "").try_cast("double")
        )
        for f in texts
    }
    cells = cells.withColumns(numbers) if numbers else cells
    columns: dict[str, Column] = {}
    for f, dtype in fields.items():
        c, none = F.col(f"_{f}"), F.lit(None).cast("string")
        if isinstance(dtype, T.BooleanType):
            value, code = F.lit(None).cast("bigint"), F.when(c.isNotNull(), "boolean")
        elif isinstance(dtype, T.IntegralType):
            value, code = c.cast("bigint"), none
        elif isinstance(dtype, T.StringType):
            number = F.col(f"_number_{f}")
            whole = number == F.floor(number)
            value = F.when(whole, F.coalesce(c.try_cast("bigint"), number.try_cast("bigint")))
            code = F.when(is_emptyish(c) | whole, None).otherwise(
                F.when(number.isNotNull() | c.rlike(_INFINITE), "not_an_integer").otherwise("not_a_number")
            )
        else:
            number = F.when(~F.isnan(c.cast("double")), c.cast("double"))
            whole = number == F.floor(number)
            value, code = F.when(whole, number.try_cast("bigint")), F.when(~whole, "not_an_integer")
        columns[f"_value_{f}"], columns[f"_code_{f}"] = value, code
    return cells.withColumns(columns) if columns else cells


# Text of a JSON scalar or object inside retrieved_context.
_CHUNK_TEXT = """CASE
  WHEN schema_of_variant({x}) LIKE 'OBJECT%' OR schema_of_variant({x}) LIKE 'ARRAY%' THEN to_json({x})
  WHEN schema_of_variant({x}) = 'BOOLEAN' THEN initcap(try_variant_get({x}, '$', 'string'))
  WHEN schema_of_variant({x}) LIKE 'DECIMAL%' THEN CAST(try_variant_get({x}, '$', 'double') AS STRING)
  ELSE try_variant_get({x}, '$', 'string') END"""
_CHUNK_OF = (
    "named_struct('kind', IF(schema_of_variant({x}) LIKE 'OBJECT%', 'json', 'text'), 'text', " + _CHUNK_TEXT + ")"
)


def with_kinds(df: DataFrame, parsed: Sequence[str]) -> DataFrame:
    """Add ``_kind<name>``, the JSON type of each parsed value."""
    return df.selectExpr("*", *[f"schema_of_variant({name}) AS _kind{name}" for name in parsed])


def context_value(raw: str, parsed: str) -> Column:
    """Chunks of a retrieved-context cell; text that is not JSON is one chunk."""
    elements = f"transform(try_variant_get({parsed}, '$', 'array<variant>'), x -> {_CHUNK_OF.format(x='x')})"
    listed = F.filter(
        F.expr(elements),
        lambda chunk: chunk["text"].isNotNull() & ((chunk["kind"] == "json") | ~is_emptyish(chunk["text"])),
    )
    kind = F.col(f"_kind{parsed}")
    value = (
        F.when(F.col(parsed).isNull(), F.array(F.struct(F.lit("text").alias("kind"), F.col(raw).alias("text"))))
        .when(kind == "VOID", None)
        .when(kind.startswith("ARRAY"), F.when(F.size(listed) > 0, listed))
        .otherwise(F.array(F.expr(_CHUNK_OF.format(x=parsed))))
    )
    return F.when(~is_emptyish(F.col(raw)), value).cast(T.ArrayType(CHUNK))


def history_value(raw: str, parsed: str) -> tuple[Column, Column]:
    """``(turns, error code)``: a list of objects with exactly ``role`` and ``content``."""
    elements = f"try_variant_get({parsed}, '$', 'array<variant>')"
    roles = ", ".join(f"'{r}'" for r in TURN_ROLES)
    valid = F.expr(
        f"""forall({elements}, x -> schema_of_variant(x) = 'OBJECT<content: STRING, role: STRING>'
              AND coalesce(try_variant_get(x, '$.role', 'string') IN ({roles}), false))"""
    )
    turns = F.expr(
        f"""transform({elements}, x -> named_struct(
              'role', try_variant_get(x, '$.role', 'string'), 'content', try_variant_get(x, '$.content', 'string')))"""
    )
    kind = F.col(f"_kind{parsed}")
    is_list = kind.startswith("ARRAY")
    error = (
        F.when(is_emptyish(F.col(raw)) | (kind == "VOID"), None)
        .when(F.col(parsed).isNull(), "not_parseable")
        .when(~is_list, "not_a_list")
        .when(~valid, "invalid_turn")
    )
    return F.when(~is_emptyish(F.col(raw)) & is_list & valid, turns).cast(T.ArrayType(TURN)), error


def metadata_value(raw: str, parsed: str) -> tuple[Column, Column]:
    """``(JSON text, error code)``: the cell must hold an object."""
    kind = F.col(f"_kind{parsed}")
    error = (
        F.when(is_emptyish(F.col(raw)) | (kind == "VOID"), None)
        .when(F.col(parsed).isNull(), "not_parseable")
        .when(~kind.startswith("OBJECT"), "not_an_object")
    )
    value = F.when(~is_emptyish(F.col(raw)) & kind.startswith("OBJECT"), F.to_json(F.col(parsed)))
    return value, error


# --- rows ---------------------------------------------------------------------


def stage_rows(
    source: DataFrame,
    mapping: Mapping[str, str],
    row_index: str,
    python_literals: bool = True,
) -> DataFrame:
    """Every source row with normalized columns, ``errors`` (field -> code) and bookkeeping.

    ``row_index`` names the ordinal column; it is not part of ``source_extras``. Without
    ``python_literals`` cells that are Python literals instead of JSON count as not parseable,
    and no row leaves the JVM.
    """
    check_mapping(mapping)
    types = {f.name: f.dataType for f in source.schema.fields}
    mapped = {field: col for field, col in mapping.items() if col in types}
    json_fields = [f for f in _JSON_FIELDS if f in mapped]
    extras = [_source(c).alias(c) for c in source.columns if c != row_index]
    cells = source.select(
        _source(row_index).cast("bigint").alias("row_index"),
        F.to_json(F.struct(*extras), {"ignoreNullFields": "false"}).alias("source_extras"),
        *[
            (_source(c) if f in INT_FIELDS else _as_text(_source(c), types[c])).alias(f"_{f}")
            for f, c in mapped.items()
        ],
    )
    parsed = {f: parse_json(F.col(f"_{f}")) for f in json_fields}
    cells = cells.withColumns({f"_v_{f}": v for f, v in parsed.items()})
    literal_fields = [f for f in json_fields if isinstance(types[mapped[f]], T.StringType)]
    if python_literals and literal_fields:
        cells = cells.withColumns(
            {
                f"_l_{f}": literal_to_json(
                    F.when(F.col(f"_v_{f}").isNull() & ~is_emptyish(F.col(f"_{f}")), F.col(f"_{f}"))
                )
                for f in literal_fields
            }
        ).withColumns(
            {f"_v_{f}": F.coalesce(F.col(f"_v_{f}"), parse_json(F.col(f"_l_{f}"))) for f in literal_fields}
        )

    cells = with_kinds(cells, [f"_v_{f}" for f in json_fields])
    cells = with_int_cells(cells, {f: types[mapped[f]] for f in INT_FIELDS if f in mapped})

    values: dict[str, Column] = {}
    errors: dict[str, Column] = {}
    for field in TEXT_FIELDS:
        cell = F.col(f"_{field}") if field in mapped else F.lit(None).cast("string")
        values[field] = strip(null_if_emptyish(cell)) if field in mapped else cell
        if field in REQUIRED_FIELDS:
            errors[field] = F.when(is_emptyish(cell), "missing")
    for field in INT_FIELDS:
        if field not in mapped:
            values[field] = F.lit(None).cast("int" if field in LABEL_FIELDS else "bigint")
            continue
        value, error = F.col(f"_value_{field}"), F.col(f"_code_{field}")
        if field in LABEL_FIELDS:
            inside = value.between(SCORES[0], SCORES[-1])
            errors[field] = F.coalesce(error, F.when(~inside, "out_of_range"))
            values[field] = F.when(inside, value).cast("int")
        else:
            errors[field], values[field] = error, value
    if CONTEXT_FIELD in mapped:
        values[CONTEXT_FIELD] = context_value(f"_{CONTEXT_FIELD}", f"_v_{CONTEXT_FIELD}")
    else:
        values[CONTEXT_FIELD] = F.lit(None).cast(T.ArrayType(CHUNK))
    for field, parse, empty in (
        (HISTORY_FIELD, history_value, T.ArrayType(TURN)),
        (METADATA_FIELD, metadata_value, T.StringType()),
    ):
        if field in mapped:
            values[field], errors[field] = parse(f"_{field}", f"_v_{field}")
        else:
            values[field] = F.lit(None).cast(empty)

    # Field names and codes contain neither commas nor colons; NULL codes drop out.
    found = F.concat_ws(",", *[F.concat(F.lit(f"{f}:"), e.cast("string")) for f, e in errors.items()])
    raw_id = F.col("_record_id") if "record_id" in mapped else F.lit(None).cast("string")
    return cells.select(
        "row_index",
        *[values[f].alias(f) for f in NORMALIZED_FIELDS],
        "source_extras",
        null_if_emptyish(raw_id).alias("_raw_record_id"),
        # A generator instead of a plain column: filters on the errors would otherwise be pushed
        # below this projection and evaluate every check a second time.
        F.explode(F.array(found)).alias("_found"),
    ).select(
        "*",
        F.when(F.col("_found") != "", F.str_to_map("_found", F.lit(","), F.lit(":")))
        .otherwise(F.create_map().cast("map<string,string>"))
        .alias("errors"),
    ).drop("_found")


def with_flags(rows: DataFrame) -> DataFrame:
    """Presence flags derived from the optional fields."""

    def filled(name: str) -> Column:
        return F.coalesce(F.col(name) != "", F.lit(False))

    def any_of(conditions: Sequence[Column]) -> Column:
        result = conditions[0]
        for c in conditions[1:]:
            result = result | c
        return result

    return rows.withColumns(
        {
            "has_reviewer": filled("reviewer_name") | filled("reviewer_id"),
            "has_context": F.coalesce(F.size(CONTEXT_FIELD) > 0, F.lit(False)),
            "has_labels": any_of([F.col(c).isNotNull() for c in LABEL_FIELDS]),
            "has_history": F.coalesce(F.size(HISTORY_FIELD) > 0, F.lit(False)),
            "has_ground_truth": filled("ground_truth_answer"),
        }
    )


def good_rows(staged: DataFrame) -> DataFrame:
    """The rows without any error, as normalized rows with flags."""
    return with_flags(staged.where(F.size("errors") == 0).drop("errors", "_raw_record_id"))


def failures(staged: DataFrame) -> DataFrame:
    """``(row_index, record_id, reason, details)`` of the rejected rows."""
    constraint = F.exists(F.map_values("errors"), lambda code: code.isin(*CONSTRAINT_CODES))
    return staged.where(F.size("errors") > 0).select(
        "row_index",
        F.when(constraint, F.col("_raw_record_id")).otherwise(F.col("record_id")).alias("record_id"),
        F.when(constraint, REASON_CONSTRAINT).otherwise(REASON_PARSE).alias("reason"),
        F.col("errors").alias("details"),
    )


def normalization_summary(staged: DataFrame) -> DataFrame:
    """Counts of good, failed and all rows, and the success rate (0 without rows)."""
    counts = staged.agg(
        F.count_if(F.size("errors") == 0).alias("success_count"),
        F.count_if(F.size("errors") > 0).alias("failure_count"),
        F.count(F.lit(1)).alias("total"),
    )
    rate = F.try_divide(F.col("success_count").cast("double"), F.col("total").cast("double"))
    return counts.withColumn("success_rate", F.coalesce(rate, F.lit(0.0)))


def failure_rollup(failed: DataFrame) -> DataFrame:
    """Failed rows per field, most frequent first; rows without field detail under ``<row>``."""
    fields = F.when(F.size("details") > 0, F.map_keys("details")).otherwise(F.array(F.lit("<row>")))
    counts = failed.select(F.explode(fields).alias("column")).groupBy("column").agg(
        F.count(F.lit(1)).alias("failed_rows")
    )
    catch_all = (F.col("column") == "<row>").cast("int")
    return counts.select(
        "column", F.lit("row_parse_failure").alias("issue"), "failed_rows"
    ).orderBy(catch_all, F.desc("failed_rows"), "column")


def preview(rows: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` rows by position."""
    return rows.orderBy("row_index").limit(n)


def fingerprint_lines(rows: DataFrame) -> DataFrame:
    """``(row_index, line)``: the required columns of each row, tab-joined."""
    line = F.concat_ws("\t", *[F.coalesce(F.col(c), F.lit("")) for c in REQUIRED_FIELDS])
    return rows.select("row_index", line.alias("line"))


def fingerprint_of(root: DataFrame) -> DataFrame:
    """The fingerprint as it is shown, from the root's ``digest``."""
    return root.select(F.concat(F.lit("sha256:"), F.substring("digest", 1, 16)).alias("dataset_fingerprint"))


def dataset_fingerprint(rows: DataFrame, fanout: int = DIGEST_FANOUT) -> DataFrame:
    """Content and order fingerprint over the required columns, one row.

    Rows are numbered densely by ``row_index``, so gaps that failed rows leave do not matter, and
    their tab-joined lines are digested as a tree with ``fanout`` children per node, whatever
    their number. Rows on one position count in the order of their lines.
    """
    lines, n = fingerprint_lines(rows), rows.count()
    numbered = dense_ordinal(lines, ["row_index", "line"], "position", n)
    return fingerprint_of(tree_digest(numbered, "position", "line", fanout, n))
