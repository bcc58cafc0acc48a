"""Queries: file readers, normalization, failure reports, fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from judgespark.operators import ingest, scored
from judgespark.plans import inputs
from judgespark.plans import sqltext as q
from judgespark.plans.registry import query
from judgespark.plans.scratch import shared_folder
from judgespark.schema import PILLARS
from judgespark.sources import readers
from judgespark.sources.fingerprint_store import FingerprintStore

# --- source cells, one row per order, covering every branch of the null, number and JSON rules ----

# column -> {remainder: cell text as SQL}, over o_orderkey modulo the number of cases
_CASES: dict[str, list[str]] = {
    "sme_factual": ["'3'", "' 4 '", "'5.0'", "''", "'abc'", "'3.5'", "'9'", "'1e0'"],
    "sme_halluc": ["'2'", "'N/A'", "' none'", "'4.0'", "'NaN'", "'1'", "'05'"],
    "retrieved_chunks": [
        "NULL",
        """'["a", "n/a", null, "b"]'""",
        """'{"doc": 1, "text": "t"}'""",
        "concat('plain text about ', o_orderkey)",
        """'"quoted"'""",
        "'[]'",
        """'[{"x": 1}, 3, true]'""",
        """'[''single'', None, ''x'']'""",
        "'12'",
    ],
    "chat_history": [
        "''",
        """'[{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yes"}]'""",
        """'[{"role": "boss", "content": "x"}]'""",
        """'[{''role'': ''user'', ''content'': ''single''}]'""",
        """'{"role": "user"}'""",
        "'[]'",
        "'garbage'",
        """'[{"role": "user", "content": "a", "extra": 1}]'""",
        """'[{"role": "user", "content": null}]'""",
        "'null'",
        """'[{"role": "tool", "content": ""}]'""",
    ],
    "meta": [
        "''",
        """'{"k": 1}'""",
        "'[1]'",
        """'{''a'': None}'""",
        "'nope'",
        "'nil'",
        """'{"b": {"c": [1, 2]}}'""",
        "'None'",
        "'{}'",
        "'null'",
        """'{"z": "y"}'""",
        "'  '",
        """'{"t": true}'""",
    ],
}
_SPARSE = {"chat_history": 3, "meta": 2, "sme_factual": 1, "sme_halluc": 1, "retrieved_chunks": 1}


def _cell(column: str) -> str:
    """The cell text; for the sparse columns only every n-th row leaves the empty case."""
    cases = _CASES[column]
    every = _SPARSE[column]
    number = f"(o_orderkey div {every}) % {len(cases)}"
    body = f"CASE {number} " + " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(cases)) + " END"
    return body if every == 1 else f"CASE WHEN o_orderkey % {every} = 0 THEN {body} ELSE '' END"


MAPPING = {
    "record_id": "id",
    "user_input": "prompt",
    "agent_output": "response",
    "category": "topic",
    "retrieved_context": "retrieved_chunks",
    "chat_history": "chat_history",
    "metadata": "meta",
    "intent": "intent",
    "reviewer_name": "sme_reviewer",
    "label_factual_accuracy": "sme_factual",
    "label_hallucination": "sme_halluc",
    "turn_index": "turn",
}
_TEXT_CELLS = {
    "id": "CASE WHEN o_orderkey % 50 = 7 THEN '  n/a ' ELSE concat(' ', o_orderkey, ' ') END",
    "prompt": "CASE WHEN o_orderkey % 31 = 3 THEN '' ELSE concat('Where is order ', o_orderkey, '?') END",
    "response": "concat('Order ', o_orderkey, ' is ', o_orderstatus)",
    "topic": "CASE WHEN o_orderkey % 37 = 5 THEN 'NULL' ELSE o_orderpriority END",
    "intent": "CASE WHEN o_custkey % 3 = 0 THEN ' nil' ELSE concat('intent_', o_custkey % 5) END",
    "sme_reviewer": "CASE WHEN o_custkey % 4 = 0 THEN '' ELSE concat('rev-', o_custkey % 12) END",
}


def source_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Untyped source columns plus an integer column, with ``pos`` as row position."""
    return inputs.table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS pos",
        *[f"{c} AS {name}" for name, c in _TEXT_CELLS.items()],
        *[f"{_cell(name)} AS {name}" for name in _CASES],
        "CAST(o_custkey % 20 AS INT) AS turn",
    )


def staged_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.stage_rows(source_cells(spark, sf_dir), MAPPING, row_index="pos")


# The expected value and error code per case, stated independently of the parsing code.
_NUMBERS = {
    "sme_factual": [3, 4, 5, None, None, None, None, 1],
    "sme_halluc": [2, None, None, 4, None, 1, 5],
}
_NUMBER_ERRORS = {"sme_factual": {4: "not_a_number", 5: "not_an_integer", 6: "out_of_range"}, "sme_halluc": {}}
_CONTEXTS = [
    "NULL",
    "'text:a|text:b'",
    """'json:{"doc":1,"text":"t"}'""",
    "'text:plain text about ' || o_orderkey",
    "'text:quoted'",
    "NULL",
    """'json:{"x":1}|text:3|text:True'""",
    "'text:single|text:x'",
    "'text:12'",
]
_HISTORIES = ["NULL", "'user:hi|assistant:yes'", "NULL", "'user:single'", "NULL", "''", "NULL", "NULL", "NULL", "NULL", "'tool:'"]
_HISTORY_ERRORS = {2: "invalid_turn", 4: "not_a_list", 6: "not_parseable", 7: "invalid_turn", 8: "invalid_turn"}
_METAS = ["NULL", """'{"k":1}'""", "NULL", """'{"a":null}'""", "NULL", "NULL", """'{"b":{"c":[1,2]}}'""", "NULL", "'{}'", "NULL", """'{"z":"y"}'""", "NULL", """'{"t":true}'"""]
_META_ERRORS = {2: "not_an_object", 4: "not_parseable"}


def _expected(column: str, cases: list) -> str:
    every = _SPARSE[column]
    number = f"(o_orderkey // {every}) % {len(_CASES[column])}"
    shown = ["NULL" if c is None else str(c) for c in cases]
    body = f"CASE {number} " + " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(shown)) + " END"
    return body if every == 1 else f"CASE WHEN o_orderkey % {every} = 0 THEN {body} END"


def _expected_error(column: str, errors: dict[int, str]) -> str:
    cases = [f"'{errors[i]}'" if i in errors else None for i in range(len(_CASES[column]))]
    return _expected(column, cases) if errors else "NULL"


_ERRORS = {
    "agent_output": "NULL",
    "category": "CASE WHEN o_orderkey % 37 = 5 THEN 'missing' END",
    "chat_history": _expected_error("chat_history", _HISTORY_ERRORS),
    "label_factual_accuracy": _expected_error("sme_factual", _NUMBER_ERRORS["sme_factual"]),
    "metadata": _expected_error("meta", _META_ERRORS),
    "record_id": "CASE WHEN o_orderkey % 50 = 7 THEN 'missing' END",
    "user_input": "CASE WHEN o_orderkey % 31 = 3 THEN 'missing' END",
}
q.define(
    "cells",
    [],
    "SELECT *, concat_ws(',', "
    + ", ".join(f"'{f}=' || {e}" for f, e in _ERRORS.items() if e != "NULL")
    + ") AS details FROM (SELECT o_orderkey, o_orderkey AS row_index,"
    " CASE WHEN o_orderkey % 50 <> 7 THEN CAST(o_orderkey AS VARCHAR) END AS record_id,"
    " CASE WHEN o_orderkey % 50 <> 7 THEN ' ' || o_orderkey || ' ' END AS raw_id,"
    " CASE WHEN o_orderkey % 31 <> 3 THEN 'Where is order ' || o_orderkey || '?' END AS user_input,"
    " 'Order ' || o_orderkey || ' is ' || o_orderstatus AS agent_output,"
    " CASE WHEN o_orderkey % 37 <> 5 THEN o_orderpriority END AS category,"
    " CASE WHEN o_custkey % 3 <> 0 THEN 'intent_' || (o_custkey % 5) END AS intent,"
    " CASE WHEN o_custkey % 4 <> 0 THEN 'rev-' || (o_custkey % 12) END AS reviewer_name,"
    f" CAST({_expected('sme_factual', _NUMBERS['sme_factual'])} AS INTEGER) AS label_factual_accuracy,"
    f" CAST({_expected('sme_halluc', _NUMBERS['sme_halluc'])} AS INTEGER) AS label_hallucination,"
    f" {_expected('retrieved_chunks', _CONTEXTS)} AS context, {_expected('chat_history', _HISTORIES)} AS history,"
    f" {_expected('meta', _METAS)} AS metadata, o_custkey % 20 AS turn_index FROM orders)",
)
_CONTEXT_TEXT = "array_join(transform(retrieved_context, c -> concat(c.kind, ':', c.text)), '|') AS context"
_HISTORY_TEXT = "array_join(transform(chat_history, t -> concat(t.role, ':', t.content)), '|') AS history"
_ROW_COLUMNS = (
    "row_index, record_id, user_input, agent_output, category, intent, reviewer_name, label_factual_accuracy,"
    " label_hallucination, context, history, metadata, turn_index"
)


@query("i1_normalized_rows", q.with_ctes(f"SELECT {_ROW_COLUMNS} FROM cells WHERE details = ''", "cells"))
def normalized_rows(spark, sf_dir):
    rows = ingest.good_rows(staged_of(spark, sf_dir))
    named = {"context": _CONTEXT_TEXT, "history": _HISTORY_TEXT}
    return rows.selectExpr(*[named.get(c, c) for c in _ROW_COLUMNS.split(", ")])


@query(
    "i2_null_policy",
    "SELECT doc_id, CASE WHEN lower(trim(source)) IN ('', 'null', 'none', 'nan', 'na', 'n/a', 'nil') THEN NULL"
    " ELSE source END AS source, lang IN ('na', 'nil') AS lang_is_empty, FALSE AS text_is_empty FROM documents",
)
def null_policy(spark, sf_dir):
    from judgespark.functions.text import is_emptyish, null_if_emptyish

    return inputs.table(spark, sf_dir, "documents").select(
        "doc_id",
        null_if_emptyish(F.col("source")).alias("source"),
        is_emptyish(F.col("lang")).alias("lang_is_empty"),
        is_emptyish(F.col("text")).alias("text_is_empty"),
    )


@query(
    "i3_trimmed_text",
    "SELECT page_id, trim(html, E' \\t\\n\\r') AS html, trim(E'\\n\\t ' || url || E' \\r\\n', E' \\t\\n\\r') AS url FROM pages",
)
def trimmed_text(spark, sf_dir):
    from judgespark.functions.text import strip

    padded = F.concat(F.lit("\n\t "), F.col("url"), F.lit(" \r\n"))
    return inputs.table(spark, sf_dir, "pages").select(
        "page_id", strip(F.col("html")).alias("html"), strip(padded).alias("url")
    )


def _staged_query(name: str, columns: list[str], sql_columns: str) -> None:
    @query(name, q.with_ctes(f"SELECT row_index, {sql_columns} FROM cells", "cells"))
    def run(spark, sf_dir):
        return staged_of(spark, sf_dir).selectExpr("row_index", *columns)


_staged_query(
    "i4_integer_cells",
    ["label_factual_accuracy", "label_hallucination", "turn_index", "errors['label_factual_accuracy'] AS error"],
    f"label_factual_accuracy, label_hallucination, turn_index, {_ERRORS['label_factual_accuracy']} AS error",
)
_staged_query("i5_retrieved_context", [_CONTEXT_TEXT], "context")
_staged_query(
    "i6_chat_history",
    [_HISTORY_TEXT, "errors['chat_history'] AS error"],
    f"history, {_ERRORS['chat_history']} AS error",
)
_staged_query("i7_metadata", ["metadata", "errors['metadata'] AS error"], f"metadata, {_ERRORS['metadata']} AS error")


@query("i7_event_metadata", "SELECT event_id, replace(props, ' ', '') AS metadata, CAST(NULL AS VARCHAR) AS error FROM events")
def event_metadata(spark, sf_dir):
    events = inputs.table(spark, sf_dir, "events")
    parsed = ingest.with_kinds(events.selectExpr("event_id", "props AS _p", "try_parse_json(props) AS _v"), ["_v"])
    value, error = ingest.metadata_value("_p", "_v")
    return parsed.select("event_id", value.alias("metadata"), error.alias("error"))


@query(
    "i8_python_literals",
    "SELECT o_orderkey AS row_index, '{\"id\":' || o_orderkey || ',\"status\":\"' || o_orderstatus || '\"}' AS value"
    " FROM orders",
)
def python_literals(spark, sf_dir):
    literal = F.concat(
        F.lit("{'id': "), F.col("o_orderkey").cast("string"), F.lit(", 'status': '"), F.col("o_orderstatus"), F.lit("'}")
    )
    return inputs.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row_index"),
        F.to_json(F.try_parse_json(ingest.literal_to_json(literal))).alias("value"),
    )


@query(
    "i9_row_constraints",
    q.with_ctes(
        "SELECT row_index, regexp_matches(details, 'missing|out_of_range') AS constraint_failed FROM cells", "cells"
    ),
)
def row_constraints(spark, sf_dir):
    codes = F.map_values("errors")
    failed = F.exists(codes, lambda c: c.isin(*ingest.CONSTRAINT_CODES))
    return staged_of(spark, sf_dir).select("row_index", failed.alias("constraint_failed"))


@query(
    "i10_failures",
    q.with_ctes(
        "SELECT row_index, CASE WHEN regexp_matches(details, 'missing|out_of_range') THEN raw_id ELSE record_id END"
        f" AS record_id, CASE WHEN regexp_matches(details, 'missing|out_of_range') THEN '{ingest.REASON_CONSTRAINT}'"
        f" ELSE '{ingest.REASON_PARSE}' END AS reason, details FROM cells WHERE details <> ''",
        "cells",
    ),
)
def failures(spark, sf_dir):
    details = "array_join(array_sort(transform(map_entries(details), e -> concat(e.key, '=', e.value))), ',') AS details"
    return ingest.failures(staged_of(spark, sf_dir)).selectExpr("row_index", "record_id", "reason", details)


@query(
    "i11_summary",
    q.with_ctes(
        "SELECT count(*) FILTER (WHERE details = '') AS success_count, count(*) FILTER (WHERE details <> '')"
        " AS failure_count, count(*) AS total, (count(*) FILTER (WHERE details = ''))::DOUBLE / count(*) AS success_rate"
        " FROM cells",
        "cells",
    ),
)
def summary(spark, sf_dir):
    return ingest.normalization_summary(staged_of(spark, sf_dir))


@query(
    "i12_failure_rollup",
    q.with_ctes(
        "SELECT split_part(d, '=', 1) AS \"column\", 'row_parse_failure' AS issue, count(*) AS failed_rows"
        " FROM (SELECT unnest(string_split(details, ',')) AS d FROM cells WHERE details <> '') GROUP BY ALL",
        "cells",
    ),
)
def failure_rollup(spark, sf_dir):
    return ingest.failure_rollup(ingest.failures(staged_of(spark, sf_dir)))


@query(
    "i15_flags",
    q.with_ctes(
        "SELECT row_index, reviewer_name IS NOT NULL AS has_reviewer, context IS NOT NULL AS has_context,"
        " (label_factual_accuracy IS NOT NULL OR label_hallucination IS NOT NULL) AS has_labels,"
        " coalesce(history <> '', FALSE) AS has_history, FALSE AS has_ground_truth FROM cells WHERE details = ''",
        "cells",
    ),
)
def flags(spark, sf_dir):
    return ingest.good_rows(staged_of(spark, sf_dir)).select(
        "row_index", "has_reviewer", "has_context", "has_labels", "has_history", "has_ground_truth"
    )


@query(
    "i16_source_extras",
    "SELECT event_id AS row_index, '{\"event_type\":\"' || event_type || '\",\"props\":\"' || replace(props, '\"', '\\\"')"
    " || '\",\"blank\":null}' AS source_extras FROM events",
)
def source_extras(spark, sf_dir):
    source = inputs.table(spark, sf_dir, "events").selectExpr(
        "event_id AS pos", "event_type", "props", "CAST(NULL AS STRING) AS blank"
    )
    return ingest.stage_rows(source, {"record_id": "event_type"}, "pos").select("row_index", "source_extras")


@query(
    "i17_row_index",
    "SELECT count(*) AS n, CAST(min(rn) AS BIGINT) AS lowest, CAST(max(rn) AS BIGINT) AS highest, count(DISTINCT rn)"
    " AS distinct_positions FROM (SELECT row_number() OVER () - 1 AS rn FROM lineitem)",
)
def row_index(spark, sf_dir):
    indexed = readers.with_row_index(inputs.table(spark, sf_dir, "lineitem").select("l_orderkey"))
    # Positions are unique exactly if every position group has one row.
    positions = indexed.groupBy("row_index").agg(F.count(F.lit(1)).alias("c"))
    return positions.agg(
        F.sum("c").alias("n"),
        F.min("row_index").alias("lowest"),
        F.max("row_index").alias("highest"),
        F.count(F.lit(1)).alias("distinct_positions"),
    )


_LINE = "record_id || chr(9) || user_input || chr(9) || agent_output || chr(9) || category"


def tree_sql(lines: str, order: str, levels: int = 7, fanout: int = 1000) -> str:
    """The root digest, as column ``line``, of the column ``line`` of ``lines`` by ``order``."""
    sql = (
        f"SELECT nth // {fanout} AS pos, sha256(string_agg(line, chr(10) ORDER BY nth)) AS line"
        f" FROM (SELECT line, row_number() OVER (ORDER BY {order}) - 1 AS nth FROM ({lines})) GROUP BY ALL"
    )
    for _ in range(levels - 1):
        sql = (
            f"SELECT pos // {fanout} AS pos, CASE WHEN count(*) = 1 THEN max(line) ELSE"
            f" sha256(string_agg(line, chr(10) ORDER BY pos)) END AS line FROM ({sql}) GROUP BY pos // {fanout}"
        )
    return sql


def fingerprint_sql(where: str = "TRUE", rows: str = "eval_rows") -> str:
    lines = f"SELECT {_LINE} AS line, row_index FROM {rows} WHERE {where}"
    return f"SELECT 'sha256:' || substr(line, 1, 16) AS dataset_fingerprint FROM ({tree_sql(lines, 'row_index')})"


@query("i18_dataset_fingerprint", q.with_ctes(fingerprint_sql(), "eval_rows"))
def dataset_fingerprint(spark, sf_dir):
    return ingest.dataset_fingerprint(inputs.eval_rows(spark, sf_dir))


@query("i18_fingerprint_with_gaps", q.with_ctes(fingerprint_sql(), "eval_rows"))
def fingerprint_with_gaps(spark, sf_dir):
    """All rows, on positions with gaps of several sizes; the digest is that of the dense ones."""
    gaps = F.expr("row_index * 3 + row_index DIV 900 * 10000")
    return ingest.dataset_fingerprint(inputs.eval_rows(spark, sf_dir).withColumn("row_index", gaps))


@query("i18_fingerprint_of_batches", q.with_ctes(fingerprint_sql(), "eval_rows"))
def fingerprint_of_batches(spark, sf_dir):
    """All rows taken in as three batches, each of which reads only its own rows."""
    rows, store = inputs.eval_rows(spark, sf_dir), FingerprintStore(spark, shared_folder(spark))
    last = rows.agg(F.max("row_index")).first()[0] or 0
    third = F.floor(F.col("row_index") * 3 / (last + 1))
    for batch in range(3):
        store.append(rows.where(third == batch), batch + 1)
    return store.fingerprint()


@query("i18_fingerprint_far_positions", q.with_ctes(fingerprint_sql(), "eval_rows"))
def fingerprint_far_positions(spark, sf_dir):
    """Positions as partition-wise numbering gives them; the digest is that of the dense ones."""
    far = F.col("row_index") * 1_000_003 * 1_000_000 + 5
    return ingest.dataset_fingerprint(inputs.eval_rows(spark, sf_dir).withColumn("row_index", far))


@query(
    "i19_latest_rows",
    q.with_ctes("SELECT record_id, row_index, user_input, category FROM latest", "latest"),
)
def latest_rows(spark, sf_dir):
    return scored.latest_rows(inputs.eval_rows(spark, sf_dir)).select("record_id", "row_index", "user_input", "category")


@query(
    "i20_preview",
    q.with_ctes(
        "SELECT row_index, record_id, category FROM cells WHERE details = '' ORDER BY row_index LIMIT 10", "cells"
    ),
)
def preview(spark, sf_dir):
    return ingest.preview(ingest.good_rows(staged_of(spark, sf_dir))).select("row_index", "record_id", "category")


# --- files written from the tables and read back --------------------------------


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.table(spark, sf_dir, "conversations").selectExpr(
        "CAST(conv_id AS STRING) AS conv_id", "CAST(turn AS STRING) AS turn", "role", "text"
    )


_TURNS_SQL = "SELECT CAST(conv_id AS VARCHAR) AS conv_id, CAST(turn AS VARCHAR) AS turn, role, text FROM conversations"


@query("s1_csv", _TURNS_SQL)
def csv_scan(spark, sf_dir):
    path = shared_folder(spark) + "/turns.csv"
    _turns(spark, sf_dir).write.csv(path, header=True, quote='"', escape='"')
    return readers.load_dataset(spark, path)


@query("s2_tsv", _TURNS_SQL)
def tsv_scan(spark, sf_dir):
    path = shared_folder(spark) + "/turns.tsv"
    _turns(spark, sf_dir).write.csv(path, sep="\t", header=True, quote='"', escape='"')
    return readers.load_dataset(spark, path)


DOCUMENT_ROWS = 200


def _write_documents(df: DataFrame, path: str, opening: str, closing: str) -> str:
    """JSON documents of at most ``DOCUMENT_ROWS`` rows, one per file."""
    body = F.concat(F.lit(opening), F.array_join(F.collect_list("j"), ",\n"), F.lit(closing))
    part = F.floor(F.col("_position") / DOCUMENT_ROWS).alias("part")
    numbered = readers.with_row_index(df, "_position")
    docs = numbered.select(part, F.to_json(F.struct(*df.columns)).alias("j")).groupBy("part").agg(body.alias("value"))
    docs.write.partitionBy("part").text(path)
    return path


@query("s3_json_array", _TURNS_SQL)
def json_array(spark, sf_dir):
    path = _write_documents(_turns(spark, sf_dir), shared_folder(spark) + "/turns.json", "[", "]")
    return readers.load_dataset(spark, path).drop("part")


@query("s4_ndjson", _TURNS_SQL)
def ndjson(spark, sf_dir):
    path = shared_folder(spark) + "/turns.json"
    _turns(spark, sf_dir).write.json(path)
    return readers.load_dataset(spark, path).select("conv_id", "turn", "role", "text")


@query("s5_json_envelope", _TURNS_SQL + " UNION ALL " + _TURNS_SQL)
def json_envelope(spark, sf_dir):
    folder = shared_folder(spark)
    turns = _turns(spark, sf_dir)
    rows = _write_documents(turns, folder + "/rows.json", '{"rows": [', "]}")
    data = _write_documents(turns, folder + "/data.json", '{"note": "x", "data": [', "]}")
    columns = ["conv_id", "turn", "role", "text"]
    return readers.load_dataset(spark, rows).select(columns).union(readers.load_dataset(spark, data).select(columns))


@query("s1_csv_split", _TURNS_SQL.replace("text FROM", "replace(text, chr(10), ' ') AS text FROM"))
def csv_split(spark, sf_dir):
    """Cells on one line, so that a file can be split over tasks."""
    path = shared_folder(spark) + "/turns.csv"
    turns = _turns(spark, sf_dir).withColumn("text", F.replace("text", F.lit("\n"), F.lit(" ")))
    turns.write.csv(path, header=True, quote='"', escape='"')
    return readers.load_dataset(spark, path, multi_line=False)


@query("s5_one_line_envelopes", _TURNS_SQL)
def one_line_envelopes(spark, sf_dir):
    """A folder of envelopes on one line each, many files."""
    path = shared_folder(spark) + "/rows.json"
    turns = readers.with_row_index(_turns(spark, sf_dir), "_position")
    part = F.floor(F.col("_position") / DOCUMENT_ROWS).alias("part")
    row = F.struct("conv_id", "turn", "role", "text")
    documents = turns.groupBy(part).agg(F.to_json(F.struct(F.collect_list(row).alias("rows"))).alias("value"))
    documents.write.partitionBy("part").text(path)
    return readers.load_dataset(spark, path).select("conv_id", "turn", "role", "text")


@query("s5_empty_envelope", "SELECT count(*) AS n, 0 AS rows FROM conversations")
def empty_envelope(spark, sf_dir):
    """An envelope without rows beside the table's own row count."""
    path = shared_folder(spark) + "/empty.json"
    turns = _turns(spark, sf_dir)
    turns.limit(1).select(F.lit('{"rows": []}').alias("value")).write.text(path)
    rows = readers.load_dataset(spark, path).count()
    return turns.agg(F.count(F.lit(1)).alias("n"), F.lit(rows).cast("int").alias("rows"))


def conversation_mappings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Each conversation as a dataset of its own: a mapping onto one text column per role, and the columns it has."""
    turns = inputs.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("dataset"), "role")
    column = F.explode(F.array(F.lit("conv_id"), F.concat(F.lit("text_"), F.col("role")))).alias("column")
    mappings = turns.select("dataset").distinct().selectExpr(
        "dataset",
        "inline(filter(array("
        + ", ".join(
            f"struct({k} AS position, '{t}' AS target, '{source}' AS source, {when} AS wanted)"
            for k, (t, source, when) in enumerate(
                [
                    ("record_id", "conv_id", "true"),
                    ("user_input", "text_user", "true"),
                    ("agent_output", "text_assistant", "true"),
                    ("category", "text_system", "dataset % 3 <> 0"),
                    ("intent", " ", "dataset % 4 = 0"),
                    ("topic", "text_user", "dataset % 5 = 0"),
                    ("mood", "conv_id", "dataset % 7 = 0"),
                ]
            )
        )
        + "), m -> m.wanted))",
    ).drop("wanted")
    return mappings, turns.select("dataset", column).distinct()


q.define(
    "mappings",
    [],
    """SELECT dataset, position, target, source FROM (SELECT DISTINCT conv_id AS dataset FROM conversations) CROSS JOIN (VALUES
  (0, 'record_id', 'conv_id', 1, TRUE), (1, 'user_input', 'text_user', 1, TRUE), (2, 'agent_output', 'text_assistant', 1, TRUE),
  (3, 'category', 'text_system', 3, FALSE), (4, 'intent', ' ', 4, TRUE), (5, 'topic', 'text_user', 5, TRUE),
  (6, 'mood', 'conv_id', 7, TRUE)) AS m(position, target, source, n, at_zero) WHERE (dataset % n = 0) = at_zero""",
)


@query(
    "i13_mapping_issues",
    q.with_ctes(
        """SELECT dataset, target AS "column", 'missing_required_mapping' AS issue
FROM (SELECT DISTINCT dataset FROM mappings) CROSS JOIN (VALUES ('record_id'), ('user_input'), ('agent_output'), ('category')) AS r(target)
ANTI JOIN mappings USING (dataset, target)
UNION ALL
SELECT dataset, target, 'unknown_source_column' FROM mappings
ANTI JOIN (SELECT DISTINCT conv_id AS dataset, unnest(['conv_id', 'text_' || role]) AS source FROM conversations) USING (dataset, source)""",
        "mappings",
    ),
)
def mapping_issues(spark, sf_dir):
    return ingest.mapping_table_issues(*conversation_mappings(spark, sf_dir))


@query(
    "i14_mapping_rules",
    q.with_ctes(
        """SELECT dataset, target AS "column", 'unknown_target' AS issue FROM mappings WHERE target = 'mood'
UNION ALL SELECT dataset, target, 'blank_source' FROM mappings WHERE trim(source) = ''
UNION ALL SELECT dataset, target, 'source_used_twice' FROM mappings m WHERE trim(source) <> '' AND EXISTS (
  SELECT 1 FROM mappings e WHERE e.dataset = m.dataset AND e.source = m.source AND e.position < m.position)""",
        "mappings",
    ),
)
def mapping_rules(spark, sf_dir):
    return ingest.mapping_table_errors(conversation_mappings(spark, sf_dir)[0])


@query(
    "s6_ragged_rows",
    "SELECT conv_id, turn, role, CASE WHEN role = 'user' THEN text END AS text,"
    " CASE WHEN role <> 'user' THEN length(text) END AS size FROM conversations",
)
def ragged_rows(spark, sf_dir):
    path = shared_folder(spark) + "/ragged.ndjson"
    turns = inputs.table(spark, sf_dir, "conversations").withColumns(
        {
            "size": F.when(F.col("role") != "user", F.length("text")),
            "text": F.when(F.col("role") == "user", F.col("text")),
        }
    )
    turns.write.json(path)
    return readers.load_dataset(spark, path).select("conv_id", "turn", "role", "text", "size")


@query("s6_ragged_union", "SELECT doc_id, lang, CAST(NULL AS INTEGER) AS quality FROM documents UNION ALL"
       " SELECT doc_id, NULL AS lang, quality FROM labels")
def ragged_union(spark, sf_dir):
    return readers.union_ragged(
        inputs.table(spark, sf_dir, "documents").select("doc_id", "lang"),
        inputs.table(spark, sf_dir, "labels").select("doc_id", "quality"),
    )


@query("s7_parquet", "SELECT doc_id, quality, toxic FROM labels")
def parquet(spark, sf_dir):
    return readers.load_dataset(spark, f"{sf_dir}/labels.parquet")


@query(
    "s9_scrub_nans",
    "SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN value END AS value,"
    " CASE WHEN event_id % 5 <> 0 THEN 1 ELSE 0 END AS kept FROM events",
)
def scrub_nans(spark, sf_dir):
    holed = inputs.table(spark, sf_dir, "events").select(
        "event_id",
        F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("value"),
    ).withColumn("kept", F.array("value"))
    return readers.scrub_nans(holed).select(
        "event_id", "value", F.size(F.array_compact("kept")).alias("kept")
    )


@query(
    "s8_dispatch",
    "SELECT format, count(*) AS n FROM conversations CROSS JOIN (VALUES ('csv'), ('ndjson'), ('parquet')) AS f(format)"
    " GROUP BY format",
)
def dispatch(spark, sf_dir):
    """The same rows through three file types chosen by extension."""
    folder = shared_folder(spark)
    turns = _turns(spark, sf_dir)
    turns.write.csv(folder + "/a.csv", header=True, quote='"', escape='"')
    turns.write.json(folder + "/a.jsonl")
    turns.write.parquet(folder + "/a.pq")
    parts = [
        readers.load_dataset(spark, folder + name).select(F.lit(readers.detect_format(name)).alias("format"), "text")
        for name in ("/a.csv", "/a.jsonl", "/a.pq")
    ]
    return parts[0].union(parts[1]).union(parts[2]).groupBy("format").agg(F.count(F.lit(1)).alias("n"))


@query(
    "i1_normalized_labels",
    q.with_ctes(
        " UNION ALL ".join(
            f"SELECT row_index, '{p}' AS pillar, label_{p} AS human_score FROM cells WHERE details = ''"
            for p in PILLARS[:2]
        ),
        "cells",
    ),
)
def normalized_labels(spark, sf_dir):
    rows = ingest.good_rows(staged_of(spark, sf_dir))
    return scored.labels_long(rows, PILLARS[:2]).select("row_index", "pillar", "human_score")
