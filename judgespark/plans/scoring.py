"""Queries: tasks, prompts, raw outputs, outcomes, knowledge bank, sinks, streams."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from judgespark.functions.text import keywords, normal_form
from judgespark.operators import calls, gates, ingest, kb, outcomes, prompts, reviewers, rubric, scored, tasks
from judgespark.operators.skew import hot_keys, local, skew_join
from judgespark.plans import inputs
from judgespark.plans import sqltext as q
from judgespark.plans.agreement import base, report_of, reviewer_report_of, reviews_of, sliced_of
from judgespark.plans.ingestion import fingerprint_sql, tree_sql
from judgespark.plans.registry import query
from judgespark.plans.reports import diagnostics_of, gates_of
from judgespark.plans.scratch import shared_folder
from judgespark.schema import (
    CHUNK,
    KB_ENTRY,
    KEYWORD_PATTERN,
    OVERALL,
    PILLARS,
    RUBRIC_INPUTS,
    RUBRIC_TAGS,
    STOPWORDS,
    TURN,
)
from judgespark.sources import metric_sink, readers, sinks
from judgespark.sources.outcome_store import Lookup, OutcomeStore
from judgespark.sources.rounds import rounds_for, share, stored

# --- chat rows: every assistant turn is a record ----------------------------------


def chat_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns as rows: previous user text as input, earlier turns as history.

    A conversation is bounded by its turns; only turns of one conversation meet in a group.
    """
    turns = inputs.table(spark, sf_dir, "conversations")
    order = W.partitionBy("conv_id").orderBy("turn")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    earlier = F.collect_list(F.struct("role", F.col("text").alias("content"))).over(before)
    with_history = turns.select(
        "*",
        earlier.alias("chat_history"),
        F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(before).alias("user_input"),
    )
    return with_history.where("role = 'assistant'").selectExpr(
        "conv_id * 100 + turn AS row_index",
        "concat('c', conv_id, '-', turn) AS record_id",
        "coalesce(user_input, '') AS user_input",
        "text AS agent_output",
        "CASE WHEN conv_id % 2 = 0 THEN 'even' ELSE 'odd' END AS category",
        f"CAST(chat_history AS array<{TURN.simpleString()}>) AS chat_history",
        f"""CAST(CASE WHEN conv_id % 3 = 0 THEN array(
              named_struct('kind', 'text', 'text', concat('passage for ', conv_id)),
              named_struct('kind', 'json', 'text', concat('{{"doc":', turn, ',"kind":"faq"}}'))) END
            AS array<{CHUNK.simpleString()}>) AS retrieved_context""",
        "CASE WHEN conv_id % 5 <> 0 THEN concat('{\"conv\":', conv_id, '}') END AS metadata",
        "CASE WHEN conv_id % 7 <> 0 THEN 'chat' END AS intent",
    )


q.define(
    "chat_rows",
    [],
    """SELECT conv_id, turn, conv_id * 100 + turn AS row_index, 'c' || conv_id || '-' || turn AS record_id,
  coalesce(user_input, '') AS user_input, text AS agent_output,
  CASE WHEN conv_id % 2 = 0 THEN 'even' ELSE 'odd' END AS category, history_size,
  conv_id % 3 = 0 AS has_context, conv_id % 5 <> 0 AS has_metadata FROM (SELECT *,
    last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER w AS user_input, count(*) OVER w AS history_size
    FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  WHERE role = 'assistant'""",
)


@query(
    "i6_typed_history",
    q.with_ctes(
        "SELECT row_index, record_id, user_input, history_size > 0 AS has_history, has_context FROM chat_rows", "chat_rows"
    ),
)
def typed_history(spark, sf_dir):
    """Chat rows that already carry typed lists, through the same normalization."""
    source = chat_rows(spark, sf_dir).drop("intent")
    mapping = {
        "record_id": "record_id",
        "user_input": "user_input",
        "agent_output": "agent_output",
        "category": "category",
        "chat_history": "chat_history",
    }
    staged = ingest.stage_rows(source, mapping, "row_index", python_literals=False)
    return (
        ingest.with_flags(staged)
        .join(source.select("row_index", (F.col("retrieved_context").isNotNull()).alias("ctx")), "row_index")
        .select(
            "row_index",
            "record_id",
            F.coalesce("user_input", F.lit("")).alias("user_input"),
            "has_history",
            F.col("ctx").alias("has_context"),
        )
    )


# --- tasks ------------------------------------------------------------------------


@query(
    "t1_task_plan",
    q.with_ctes(
        f"SELECT row_index, record_id, CAST(k AS INTEGER) AS pillar_index, pillar, record_id || '::' || pillar AS task_id"
        f" FROM chat_rows CROSS JOIN {q.pillar_values()}",
        "chat_rows",
    ),
)
def task_plan(spark, sf_dir):
    plan = tasks.plan_tasks(chat_rows(spark, sf_dir), PILLARS)
    return plan.select("row_index", "record_id", "pillar_index", "pillar", "task_id")


@query(
    "t2_task_batches",
    q.with_ctes(
        f"SELECT row_index, pillar, (row_number() OVER (ORDER BY row_index, k) - 1) // 64 AS batch_id"
        f" FROM chat_rows CROSS JOIN {q.pillar_values()}",
        "chat_rows",
    ),
)
def task_batches(spark, sf_dir):
    return tasks.task_batches(chat_rows(spark, sf_dir), PILLARS, 64).select("row_index", "pillar", "batch_id")


CONFIGS = {
    p: {
        "prompt_version": f"{p}.v1",
        "rubric_version": "v1.0",
        "model_alias": "judge-default",
        "model_name": "model-x",
        "temperature": 0.0,
        "max_output_tokens": 1024,
    }
    for p in PILLARS
}
_KEY_COLUMNS = (
    "agent_output",
    "category",
    "conversation_id",
    "intent",
    "label_bias_discrimination",
    "label_completeness",
    "label_factual_accuracy",
    "label_hallucination",
    "label_relevance",
    "label_toxicity",
    "model_name",
    "record_id",
    "reviewer_id",
    "reviewer_name",
    "topic",
    "user_input",
)
q.define(
    "keyed_tasks",
    ["latest"],
    f"""SELECT row_index, record_id, pillar, sha256(CAST(json_object('kb_fingerprint', 'kb.v1', 'max_output_tokens', 1024,
  'model_alias', 'judge-default', 'model_name', 'model-x', 'pillar', pillar, 'prompt_version', pillar || '.v1',
  'row', json_object({', '.join(f"'{c}', {c}" for c in _KEY_COLUMNS)}), 'rubric_version', 'v1.0',
  'temperature', 0::DOUBLE) AS VARCHAR)) AS cache_key
  FROM latest CROSS JOIN {q.pillar_values()}""",
)


def keyed_tasks(spark: SparkSession, sf_dir: str, at: int = 0, of: int = 1) -> DataFrame:
    """Tasks with keys, of the records of one of several rounds."""
    rows = scored.latest_rows(share(inputs.eval_rows(spark, sf_dir), "record_id", at, of))
    plan = tasks.plan_tasks(rows, PILLARS)
    return tasks.with_cache_keys(plan, tasks.judge_configs(spark, CONFIGS), kb_fingerprint="kb.v1")


@query("t3_cache_keys", q.with_ctes("SELECT row_index, pillar, cache_key FROM keyed_tasks", "keyed_tasks"))
def cache_keys(spark, sf_dir):
    return keyed_tasks(spark, sf_dir).select("row_index", "pillar", "cache_key")


def earlier_outcomes(spark: SparkSession, sf_dir: str, at: int, of: int, hot: DataFrame) -> DataFrame:
    """Outcomes of an earlier run with the keys of their tasks, of the records of one of several rounds."""
    # The plan lies by record, so its keys are folded and met there; one by one they would be shuffled.
    entry = F.struct("pillar", "cache_key")
    keys = keyed_tasks(spark, sf_dir, at, of).groupBy("record_id").agg(F.map_from_entries(F.collect_list(entry)).alias("keys"))
    earlier = share(inputs.outcomes(spark, sf_dir), "record_id", at, of)
    earlier = skew_join(earlier, keys, ["record_id"], F.col("outcome_index"), hot=hot)
    return earlier.withColumn("cache_key", F.col("keys")[F.col("pillar")]).where("cache_key IS NOT NULL").drop("keys")


def outcome_store(spark: SparkSession, sf_dir: str, of: int) -> OutcomeStore:
    """Outcomes of an earlier run, stored in two batches with a compaction between them, the second one sent twice."""
    hot = local(spark, hot_keys(inputs.outcomes(spark, sf_dir), ["record_id"]))

    def batch(which: str, rounds: int) -> Iterator[DataFrame]:
        # A key digests the record id too, so no key is in two rounds.
        return (earlier_outcomes(spark, sf_dir, at, rounds, hot).where(which) for at in range(rounds))

    store = OutcomeStore(spark, shared_folder(spark), buckets=16)
    store.append(batch("outcome_index % 3 = 0", -(-of // 2)), "first")
    store.compact()
    # The second time, the batch lies there twice until it is replaced, so less is shuffled at a time.
    for rounds in (-(-of // 2), of):
        store.append(batch("outcome_index % 3 <> 0", rounds), "second")
    return store


def looked_up(spark: SparkSession, sf_dir: str, wanted: Callable[[Lookup], DataFrame]) -> DataFrame:
    """What is wanted of a lookup of all tasks, made in rounds."""
    of = rounds_for(inputs.table(spark, sf_dir, "orders"), inputs.table(spark, sf_dir, "lineitem"))
    store, rounds = outcome_store(spark, sf_dir, of), -(-of // 2)
    found = (wanted(store.lookup(keyed_tasks(spark, sf_dir, at, rounds), "now")) for at in range(rounds))
    rows = stored(spark, found, shared_folder(spark))
    store.remove()
    return rows


# The first batch keeps a key that both have.
q.define(
    "stored",
    ["outcomes"],
    "SELECT record_id, pillar, max(outcome_index) FILTER (WHERE outcome_index % 3 = 0) AS early,"
    " coalesce(early, max(outcome_index)) AS outcome_index"
    " FROM outcomes WHERE NOT failed AND pillar <> 'tone' GROUP BY record_id, pillar",
)


@query(
    "t4_cache_hits",
    q.with_ctes(
        "SELECT row_index, pillar, outcome_index, 'run-1' AS run_id FROM latest"
        f" CROSS JOIN {q.pillar_values()} JOIN stored USING (record_id, pillar)",
        "latest",
        "stored",
    ),
)
def cache_hits(spark, sf_dir):
    return looked_up(spark, sf_dir, lambda found: found.hits.select("row_index", "pillar", "outcome_index", "run_id"))


@query(
    "t4_cache_misses",
    q.with_ctes(
        f"SELECT row_index, pillar FROM latest CROSS JOIN {q.pillar_values()} ANTI JOIN stored USING (record_id, pillar)",
        "latest",
        "stored",
    ),
)
def cache_misses(spark, sf_dir):
    return looked_up(spark, sf_dir, lambda found: found.misses.select("row_index", "pillar"))


_NEEDS_CONTEXT = ", ".join(f"'{p}'" for p, i in RUBRIC_INPUTS.items() if "retrieved_context" in i)


@query(
    "t5_input_gate",
    q.with_ctes(
        f"SELECT row_index, record_id, pillar, 0::DOUBLE AS latency_ms, 0 AS attempts, 'JudgeExecutionError' AS error_type,"
        " 'Unhandled judge exception: Row ''' || record_id || ''' is missing rubric-required input(s)"
        " [''retrieved_context''] for pillar ''' || pillar || '''.' AS error"
        f" FROM chat_rows CROSS JOIN {q.pillar_values()} WHERE NOT has_context AND pillar IN ({_NEEDS_CONTEXT})",
        "chat_rows",
    ),
)
def input_gate(spark, sf_dir):
    plan = tasks.plan_tasks(chat_rows(spark, sf_dir), PILLARS)
    return tasks.gate_failures(tasks.gate_tasks(plan, rubric.default_rubrics(spark)))


# --- prompts ----------------------------------------------------------------------


def prompts_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = tasks.plan_tasks(chat_rows(spark, sf_dir), ["relevance", "hallucination"])
    return prompts.task_prompts(plan, rubric.default_rubrics(spark), "v1")


def _indent_sql(text: str) -> str:
    return f"'  ' || replace(regexp_replace({text}, E'\\n$', ''), E'\\n', E'\\n  ')"


_USER_SQL = f"""'Score the following row against the rubric you were given.' || E'\\n\\n' || 'record_id: ' || record_id
  || E'\\ncategory: ' || category || E'\\n\\nUser input:\\n' || CASE WHEN user_input = '' THEN '  (empty)'
  ELSE {_indent_sql('user_input')} END || E'\\n\\nAgent output (this is what you are scoring):\\n'
  || CASE WHEN agent_output = '' THEN '  (empty)' ELSE {_indent_sql('agent_output')} END
  || CASE WHEN pillar = 'hallucination' AND has_context THEN E'\\n\\nRetrieved context (2 chunks):\\n  [1] passage for '
  || conv_id || E'\\n  [2] {{\\n        "doc": ' || turn || E',\\n        "kind": "faq"\\n      }}' ELSE '' END
  || E'\\n\\nReturn ONLY the structured JSON object defined by the output contract. No preamble, no markdown,'
  || ' no trailing commentary.'"""


@query(
    "t6_user_prompts",
    q.with_ctes(
        f"SELECT row_index, pillar, {_USER_SQL} AS user_prompt FROM chat_rows"
        " CROSS JOIN (VALUES ('relevance'), ('hallucination')) AS p(pillar)",
        "chat_rows",
    ),
)
def user_prompts(spark, sf_dir):
    return prompts_of(spark, sf_dir).select("row_index", "pillar", "user_prompt")


def _rubric_sql(pillar: str) -> str:
    anchors = "\\n".join(f"  {s} (level {s}): score {s} of 5" for s in range(1, 6))
    tags = "\\n".join(f"  - {t}" for t in RUBRIC_TAGS[pillar])
    return (
        f"E'Pillar: {pillar}\\nRubric version: v1.0\\nScore scale: 1 (worst) to 5 (best)\\n\\nScore anchors:\\n{anchors}"
        f"\\n\\nAllowed failure_tags (use ONLY these strings; empty list is valid when score == 5):\\n{tags}'"
    )


@query(
    "t7_rubric_blocks",
    q.with_ctes(
        "SELECT row_index, pillar, CASE pillar "
        + " ".join(f"WHEN '{p}' THEN {_rubric_sql(p)}" for p in ("relevance", "hallucination"))
        + " END AS rubric_block FROM chat_rows CROSS JOIN (VALUES ('relevance'), ('hallucination')) AS p(pillar)",
        "chat_rows",
    ),
)
def rubric_blocks(spark, sf_dir):
    blocks = rubric.default_rubrics(spark).select("pillar", prompts.rubric_block().alias("rubric_block"))
    plan = tasks.plan_tasks(chat_rows(spark, sf_dir), ["relevance", "hallucination"])
    return plan.join(F.broadcast(blocks), "pillar").select("row_index", "pillar", "rubric_block")


@query(
    "t6_system_prompts",
    q.with_ctes(
        "SELECT row_index, pillar, system AS system_prompt FROM (SELECT row_index, pillar, replace(replace('"
        + prompts.SYSTEM_TEMPLATE.replace("'", "''")
        .replace("%3$s", "1")
        .replace("%4$s", "5")
        .replace("%5$s", "v1")
        + "', '%1$s', pillar), '%2$s', CASE pillar "
        + " ".join(f"WHEN '{p}' THEN {_rubric_sql(p)}" for p in ("relevance", "hallucination"))
        + " END) AS system FROM chat_rows CROSS JOIN (VALUES ('relevance'), ('hallucination')) AS p(pillar))",
        "chat_rows",
    ),
)
def system_prompts(spark, sf_dir):
    return prompts_of(spark, sf_dir).select("row_index", "pillar", "system_prompt")


# --- raw outputs: one JSON cell per line item, covering every check -----------------------------------

_RAW_CASES = [
    # (JSON body as SQL over line items, structure, invariants, rubric reasons)
    ('{"pillar":"@p","score":5,"confidence":0.9,"decision_summary":"fine","why_not_lower":"solid","rubric_anchor":5}', "", "", ""),
    (
        '{"pillar":"@p","score":3,"confidence":1,"decision_summary":"mixed","failure_tags":["@t"],"why_not_higher":"a",'
        '"why_not_lower":"b","rubric_anchor":4,"evidence_for_score":[{"claim":"c","status":"n/a","support":null}]}',
        "",
        "",
        "",
    ),
    ("not json", "not_an_object", "", ""),
    ("[1]", "not_an_object", "", ""),
    (
        '{"pillar":"@p","score":"4","confidence":1.5,"decision_summary":"","rubric_anchor":4.0,"mood":"x"}',
        "invalid:score,invalid:confidence,invalid:decision_summary,invalid:rubric_anchor,unknown_field:mood",
        "",
        "",
    ),
    ('{"score":4,"confidence":0.5}', "missing:pillar,missing:decision_summary,missing:rubric_anchor", "", ""),
    (
        '{"pillar":"@p","score":5,"confidence":0.5,"decision_summary":"s","failure_tags":["@t"],"rubric_anchor":3}',
        "",
        "tags_with_top_score,why_not_lower_missing,anchor_too_far",
        "",
    ),
    (
        '{"pillar":"@p","score":2,"confidence":0.5,"decision_summary":"s","why_not_lower":"b","why_not_higher":"",'
        '"rubric_anchor":2,"elements_present":["Step  One"],"elements_missing":[" step one "]}',
        "",
        "why_not_higher_missing,elements_overlap",
        "",
    ),
    (
        '{"pillar":"other","score":2,"confidence":0.5,"decision_summary":"s","failure_tags":["@t","@t","odd"],'
        '"why_not_higher":"a","why_not_lower":"b","rubric_anchor":2}',
        "",
        "",
        "pillar_mismatch,unknown_failure_tag,duplicate_failure_tag",
    ),
    (
        '{"pillar":"@p","score":1,"confidence":0.0,"decision_summary":"s","why_not_higher":"a","rubric_anchor":1,'
        '"evidence_for_score":[{"claim":"c","status":"maybe"}],"failure_tags":[1]}',
        "invalid:evidence_for_score,invalid:failure_tags",
        "",
        "",
    ),
    ('{"pillar":"@p","score":1,"confidence":0.25,"decision_summary":"s","why_not_higher":"a","rubric_anchor":2}', "", "", ""),
]


def _raw_case_sql(part: int) -> str:
    cases = " ".join(f"WHEN {i} THEN '{c[part]}'" for i, c in enumerate(_RAW_CASES))
    return f"CASE l_partkey % {len(_RAW_CASES)} {cases} END"


def raw_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scorer outputs as text; line number 7 is a pillar without a rubric."""
    pillar = inputs.pillar_case("l_linenumber")
    tags = " ".join(f"WHEN '{p}' THEN '{t[0]}'" for p, t in RUBRIC_TAGS.items())
    return (
        inputs.table(spark, sf_dir, "lineitem")
        .selectExpr(
            "l_orderkey * 8 + l_linenumber AS row_index",
            "CAST(l_orderkey AS STRING) AS record_id",
            f"{pillar} AS pillar",
            f"{_raw_case_sql(0)} AS body",
            "l_extendedprice / 100 AS latency_ms",
            "CAST(1 + l_suppkey % 3 AS INT) AS attempts",
            "CAST(l_partkey AS BIGINT) AS input_tokens",
            "CAST(l_suppkey AS BIGINT) AS output_tokens",
            "'model-x' AS model_name",
            "CASE WHEN l_suppkey % 17 = 0 THEN 'timed out' END AS error",
            "CASE WHEN l_suppkey % 17 = 0 THEN 'ProviderTimeoutError' END AS error_type",
        )
        .selectExpr(
            "*", f"replace(replace(body, '@p', pillar), '@t', coalesce(CASE pillar {tags} END, 'any')) AS raw"
        )
        .drop("body")
    )


q.define(
    "raw",
    [],
    f"""SELECT l_orderkey * 8 + l_linenumber AS row_index, CAST(l_orderkey AS VARCHAR) AS record_id,
  {q._pillar_case('l_linenumber')} AS pillar, {_raw_case_sql(1)} AS structure, {_raw_case_sql(2)} AS invariants,
  {_raw_case_sql(3)} AS rubric, l_partkey % {len(_RAW_CASES)} AS body, l_suppkey % 17 = 0 AS timed_out FROM lineitem""",
)
_RUBRIC_EXPECTED = (
    "CASE WHEN structure <> '' OR invariants <> '' THEN '' WHEN pillar = 'tone' THEN 'no_rubric' ELSE rubric END"
)


def checked_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes.checked_outputs(raw_outputs(spark, sf_dir), rubric.default_rubrics(spark))


def _reason_query(name: str, column: str, sql: str) -> None:
    @query(name, q.with_ctes(f"SELECT row_index, pillar, {sql} AS reasons FROM raw", "raw"))
    def run(spark, sf_dir):
        return checked_of(spark, sf_dir).select("row_index", "pillar", F.array_join(column, ",").alias("reasons"))


_reason_query("t8_structure_checks", "structure_reasons", "structure")
_reason_query("t9_invariants", "invariant_reasons", "invariants")
_reason_query("t10_rubric_checks", "rubric_reasons", _RUBRIC_EXPECTED)

_SCORES = ", ".join(
    f"({i}, {json.loads(c[0])['score']}, {float(json.loads(c[0])['confidence'])}::DOUBLE)"
    for i, c in enumerate(_RAW_CASES)
    if c[1:] == ("", "", "")
)


@query(
    "t11_assembled_outcomes",
    q.with_ctes(
        f"""SELECT row_index, record_id, pillar, ok, CASE WHEN ok THEN s.score END AS score,
  CASE WHEN ok THEN s.confidence END AS confidence,
  CASE WHEN timed_out THEN 'ProviderTimeoutError' WHEN NOT ok THEN 'JudgeOutputParseError' END AS error_type,
  CASE WHEN timed_out THEN 'timed out'
    WHEN structure || invariants <> '' THEN 'Judge output is invalid: ' || replace(structure || invariants, ',', ', ') || '.'
    WHEN NOT ok THEN 'Judge output for pillar ''' || pillar || ''' failed rubric validation: '
      || replace({_RUBRIC_EXPECTED}, ',', ', ') || '.' END AS error
FROM (SELECT *, NOT timed_out AND structure = '' AND invariants = '' AND {_RUBRIC_EXPECTED} = '' AS ok FROM raw)
LEFT JOIN (VALUES {_SCORES}) AS s(body, score, confidence) USING (body)""",
        "raw",
    ),
)
def assembled_outcomes(spark, sf_dir):
    done = outcomes.assemble_outcomes(raw_outputs(spark, sf_dir), rubric.default_rubrics(spark), "run-2", "v1")
    return done.select(
        "row_index",
        "record_id",
        "pillar",
        F.col("result").isNotNull().alias("ok"),
        F.col("result.score").alias("score"),
        F.col("result.confidence").alias("confidence"),
        "error_type",
        "error",
    )


@query(
    "t12_ordered_outcomes",
    q.with_ctes("SELECT row_index, pillar FROM raw ORDER BY row_index, pillar", "raw"),
)
def ordered_outcomes(spark, sf_dir):
    done = outcomes.assemble_outcomes(raw_outputs(spark, sf_dir), rubric.default_rubrics(spark), "run-2", "v1")
    return tasks.ordered_outcomes(done).select("row_index", "pillar")


_PERCENTILES = ", ".join(
    f"coalesce(quantile_cont(latency_ms, {f}), 0) AS {n}" for n, f in (("latency_ms_p50", 0.5), ("latency_ms_p95", 0.95))
)


@query(
    "t13_run_summary",
    q.with_ctes(
        "SELECT count(*) AS total_tasks, count(*) FILTER (WHERE NOT failed) AS succeeded, count(*) FILTER (WHERE failed)"
        " AS failed, CAST(12 AS BIGINT) AS cache_hits, 3.5::DOUBLE AS duration_s, round(latency_ms_p50, 9) AS latency_ms_p50,"
        " round(latency_ms_p95, 9) AS latency_ms_p95, CAST(sum(coalesce(input_tokens, 0)) AS BIGINT) AS total_input_tokens,"
        f" CAST(sum(output_tokens) AS BIGINT) AS total_output_tokens FROM outcomes, (SELECT {_PERCENTILES} FROM outcomes)"
        " GROUP BY latency_ms_p50, latency_ms_p95",
        "outcomes",
    ),
)
def run_summary(spark, sf_dir):
    summary = tasks.run_summary(inputs.outcomes(spark, sf_dir), cache_hits=12, duration_s=3.5)
    return summary.withColumns({c: F.round(c, 9) for c in ("latency_ms_p50", "latency_ms_p95")})


@query(
    "t14_latency_percentiles",
    q.with_ctes(
        f"SELECT round(latency_ms_p50, 9) AS latency_ms_p50, round(latency_ms_p95, 9) AS latency_ms_p95"
        f" FROM (SELECT {_PERCENTILES} FROM outcomes)",
        "outcomes",
    ),
)
def latency_percentiles(spark, sf_dir):
    found = tasks.latency_percentiles(inputs.outcomes(spark, sf_dir))
    return found.select(*[F.round(c, 9).alias(c) for c in found.columns])


@query(
    "t15_pillar_counts",
    q.with_ctes(
        "SELECT pillar, count(*) FILTER (WHERE NOT failed) AS succeeded, count(*) FILTER (WHERE failed) AS failed"
        " FROM outcomes GROUP BY pillar",
        "outcomes",
    ),
)
def pillar_counts(spark, sf_dir):
    return tasks.pillar_counts(inputs.outcomes(spark, sf_dir))


# --- pluggable scorers --------------------------------------------------------------


def length_scorer(task: dict) -> dict:
    """A user's scorer: shorter answers score higher; one conversation in 13 makes it fail."""
    if task["row_index"] // 100 % 13 == 0:
        raise RuntimeError("no answer")
    score = 1 + len(task["agent_output"]) % 5
    return {
        "raw": json.dumps(
            {
                "pillar": task["pillar"],
                "score": score,
                "confidence": 0.5,
                "decision_summary": f"length {len(task['agent_output'])}",
                "why_not_higher": None if score == 5 else "longer than needed",
                "why_not_lower": None if score == 1 else "short enough",
                "rubric_anchor": score,
            }
        ),
        "latency_ms": 1.0,
        "input_tokens": len(task["user_input"]),
        "model_name": "length",
    }


def scored_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plan, gate, score, validate: chat rows to outcomes."""
    registry = tasks.ScorerRegistry()
    for pillar in ("relevance", "toxicity", "hallucination"):
        registry.register(pillar, length_scorer)
    rubrics = rubric.default_rubrics(spark)
    plan = tasks.plan_tasks(chat_rows(spark, sf_dir), registry.pillars())
    ready = tasks.gate_tasks(plan, rubrics).where(F.size("missing_inputs") == 0)
    raw = tasks.run_scorers(ready, registry, registry.pillars(), ["user_input", "agent_output"], max_parallel=8)
    return outcomes.assemble_outcomes(raw, rubrics, "run-3", "v1")


q.define(
    "chat_tasks",
    ["chat_rows"],
    "SELECT *, conv_id % 13 = 0 AS broken FROM chat_rows CROSS JOIN (VALUES ('relevance'), ('toxicity'),"
    " ('hallucination')) AS p(pillar) WHERE has_context OR pillar <> 'hallucination'",
)


@query(
    "u1_scorer_outcomes",
    q.with_ctes(
        "SELECT row_index, record_id, pillar, CASE WHEN NOT broken THEN CAST(1 + length(agent_output) % 5 AS INTEGER) END"
        " AS score, CASE WHEN NOT broken THEN 'length ' || length(agent_output) END AS decision_summary,"
        " CASE WHEN NOT broken THEN CAST(length(user_input) AS BIGINT) END AS input_tokens FROM chat_tasks",
        "chat_tasks",
    ),
)
def scorer_outcomes(spark, sf_dir):
    return scored_chats(spark, sf_dir).select(
        "row_index",
        "record_id",
        "pillar",
        F.col("result.score").alias("score"),
        F.col("result.decision_summary").alias("decision_summary"),
        F.col("usage.input_tokens").alias("input_tokens"),
    )


@query(
    "u3_isolated_failures",
    q.with_ctes(
        "SELECT row_index, pillar, 'Unhandled judge exception: no answer' AS error, 'RuntimeError' AS error_type,"
        " 0::DOUBLE AS latency_ms, 0 AS attempts FROM chat_tasks WHERE broken",
        "chat_tasks",
    ),
)
def isolated_failures(spark, sf_dir):
    failed = scored_chats(spark, sf_dir).where(F.col("error").isNotNull())
    return failed.select("row_index", "pillar", "error", "error_type", "latency_ms", "attempts")


@query(
    "u4_scorer_cap",
    q.with_ctes("SELECT count(*) AS scored, TRUE AS within_cap FROM chat_tasks WHERE pillar = 'toxicity'", "chat_tasks"),
)
def scorer_cap(spark, sf_dir):
    """At most three scorer tasks run, whatever the input's partitioning."""
    registry = tasks.ScorerRegistry()
    registry.register("toxicity", length_scorer)
    plan = tasks.plan_tasks(chat_rows(spark, sf_dir), ["toxicity"])
    raw = tasks.run_scorers(plan, registry, ["toxicity"], ["user_input", "agent_output"], max_parallel=3)
    used = raw.select(F.spark_partition_id().alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    return used.agg(F.sum("n").alias("scored"), (F.count(F.lit(1)) <= 3).alias("within_cap"))


PROVIDER_OF = {"relevance": "north", "toxicity": "south", "hallucination": "south"}
PROVIDER_LANES = {"north": 2, "south": 3}


def flaky_scorer(task: dict) -> dict:
    """The scorer above behind a busy provider: some conversations need a second to fourth call."""
    if task["attempt"] <= task["row_index"] // 100 % 4:
        raise calls.Retryable("busy")
    return length_scorer(task)


def called_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat tasks in lanes, scored by the table function, with ``provider`` and ``lane`` to group by."""
    registry = tasks.ScorerRegistry()
    for pillar in PROVIDER_OF:
        registry.register(pillar, flaky_scorer)
    calls.register_scorers(spark, "score_chats", registry, calls.CallPolicy(initial_backoff_s=0.0, jitter_s=0.0))
    plan = tasks.plan_tasks(chat_rows(spark, sf_dir), registry.pillars())
    ready = tasks.gate_tasks(plan, rubric.default_rubrics(spark)).where(F.size("missing_inputs") == 0)
    laned = calls.lanes(ready, PROVIDER_OF, PROVIDER_LANES)
    return calls.call_scorers(laned, "score_chats", ["user_input", "agent_output"])


@query(
    "u2_retried_calls",
    q.with_ctes(
        "SELECT row_index, record_id, pillar, CAST(least(1 + conv_id % 4, 3) AS INTEGER) AS calls,"
        " CASE WHEN conv_id % 4 < 3 AND NOT broken THEN 1 + length(agent_output) % 5 END AS score,"
        " CASE WHEN conv_id % 4 = 3 THEN 'gave up after 3 calls: busy'"
        " WHEN broken THEN 'Unhandled judge exception: no answer' END AS error,"
        " CASE WHEN conv_id % 4 = 3 THEN 'Retryable' WHEN broken THEN 'RuntimeError' END AS error_type FROM chat_tasks",
        "chat_tasks",
    ),
)
def retried_calls(spark, sf_dir):
    score = F.get_json_object("raw", "$.score").cast("long").alias("score")
    return called_chats(spark, sf_dir).select("row_index", "record_id", "pillar", "calls", score, "error", "error_type")


@query(
    "u4_provider_lanes",
    q.with_ctes(
        "SELECT CASE WHEN pillar = 'relevance' THEN 'north' ELSE 'south' END AS provider, count(*) AS tasks,"
        " CAST(sum(least(1 + conv_id % 4, 3)) AS BIGINT) AS calls, TRUE AS within_cap FROM chat_tasks GROUP BY 1",
        "chat_tasks",
    ),
)
def provider_lanes(spark, sf_dir):
    """Tasks and calls per provider, and that no more lanes than its limit were used, over all pillars."""
    used = calls.lanes(called_chats(spark, sf_dir), PROVIDER_OF, PROVIDER_LANES)
    per_lane = used.groupBy("provider", "lane").agg(F.count(F.lit(1)).alias("tasks"), F.sum("calls").alias("calls"))
    limit = F.create_map(*[F.lit(v) for pair in PROVIDER_LANES.items() for v in pair])
    return per_lane.groupBy("provider").agg(
        F.sum("tasks").alias("tasks"),
        F.sum("calls").alias("calls"),
        (F.count(F.lit(1)) <= F.first(limit[F.col("provider")])).alias("within_cap"),
    )


# --- knowledge bank: benchmark passages are entries, documents are rows -----------------------


def kb_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with a topic list, an intent for every third, and some rule violations."""
    return inputs.table(spark, sf_dir, "benchmark").selectExpr(
        "item_id AS entry_index",
        "concat('kb_', item_id) AS kb_id",
        "text AS question_or_utterance_pattern",
        "array(concat('SRC', item_id % 20), concat(' topic  ', item_id % 6)) AS topic_list",
        "concat('Intent ', item_id % 30) AS intent",
        "'an example' AS example_agent_response",
        "concat('notes for ', item_id) AS completeness_notes",
        "array(concat('step ', item_id), 'timeline') AS required_elements",
        "CASE WHEN item_id % 2 = 0 THEN array('caveat') ELSE CAST(array() AS array<string>) END AS optional_elements",
        "CASE WHEN item_id % 7 = 0 THEN array(' Timeline ') ELSE CAST(array() AS array<string>) END AS forbidden_elements",
        "CASE WHEN item_id % 4 = 0 THEN array('policy') ELSE CAST(array() AS array<string>) END AS policy_refs",
        "CASE WHEN item_id % 5 = 0 THEN 'urgent' WHEN item_id % 5 = 1 THEN 'high' END AS priority_level",
        "CASE WHEN item_id % 3 = 0 THEN 'banking' END AS domain",
        "'1.0' AS version",
        "CAST(NULL AS STRING) AS author",
        "CAST(NULL AS STRING) AS last_updated",
    )


def kb_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.table(spark, sf_dir, "documents").selectExpr(
        "doc_id AS row_index",
        "text AS user_input",
        "CASE WHEN doc_id % 10 = 0 THEN concat(' INTENT   ', doc_id % 45) END AS intent",
        "CASE WHEN doc_id % 3 = 0 THEN concat('Topic ', doc_id % 9) END AS topic",
        "CASE WHEN doc_id % 4 <> 1 THEN source ELSE lang END AS category",
    )


_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)


def _keywords_sql(text: str) -> str:
    pattern = KEYWORD_PATTERN.replace("'", "''")
    return (
        f"list_distinct(list_filter(regexp_extract_all(lower({text}), '{pattern}'),"
        f" lambda w: length(w) > 2 AND w NOT IN ({_STOP})))"
    )


q.define(
    "entries",
    [],
    f"SELECT item_id AS entry_index, 'kb_' || item_id AS kb_id, {_keywords_sql('text')} AS words,"
    " ['src' || (item_id % 20), 'topic ' || (item_id % 6)] AS topics, 'intent ' || (item_id % 30) AS intent FROM benchmark",
)
q.define(
    "kb_rows",
    [],
    f"SELECT doc_id AS row_index, {_keywords_sql('text')} AS words,"
    " CASE WHEN doc_id % 10 = 0 THEN 'intent ' || (doc_id % 45) END AS intent,"
    " CASE WHEN doc_id % 3 = 0 THEN 'topic ' || (doc_id % 9) END AS topic,"
    " CASE WHEN doc_id % 4 <> 1 THEN lower(source) ELSE lower(lang) END AS category FROM documents",
)
_SHARE = "(CAST(length(list_intersect(r.words, e.words)) AS DOUBLE) / length(e.words) * 0.2::DOUBLE)"
q.define(
    "signals",
    ["entries", "kb_rows"],
    f"SELECT row_index, entry_index, intent, row_topic, row_category, CASE WHEN share > 0 THEN"
    f" {q.round_half_even('share', 4)} END AS keyword_overlap FROM (SELECT r.row_index, e.entry_index,"
    " CASE WHEN r.intent = e.intent THEN 0.7::DOUBLE END AS intent,"
    " CASE WHEN list_contains(e.topics, r.topic) THEN 0.4::DOUBLE END AS row_topic,"
    " CASE WHEN NOT coalesce(list_contains(e.topics, r.topic), FALSE) AND list_contains(e.topics, r.category)"
    f" THEN 0.3::DOUBLE END AS row_category, {_SHARE} AS share FROM kb_rows r CROSS JOIN entries e)",
)
_PART = "coalesce(CAST({} AS DECIMAL(6,4)), 0)"
q.define(
    "totals",
    ["signals"],
    "SELECT *, CAST(least("
    + " + ".join(_PART.format(s) for s in kb.SIGNALS)
    + ", 1) AS DOUBLE) AS score FROM signals WHERE "
    + " OR ".join(f"{s} IS NOT NULL" for s in kb.SIGNALS),
)
q.define(
    "best",
    ["totals"],
    "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY row_index ORDER BY score DESC, entry_index)"
    " AS rn FROM totals WHERE score > 0) WHERE rn = 1",
)
q.define(
    "matches",
    ["best", "kb_rows"],
    "SELECT r.row_index, CASE WHEN score >= 0.5 THEN entry_index END AS entry_index,"
    " CASE WHEN score >= 0.5 THEN 'kb_' || entry_index END AS kb_id,"
    f" CASE WHEN score >= 0.5 THEN {q.round_half_even('score', 4)} ELSE coalesce(score, 0) END AS match_confidence,"
    " CASE WHEN score IS NULL THEN 'no_candidate_scored' WHEN score < 0.5 THEN 'no_candidate_cleared_threshold'"
    " ELSE array_to_string(list_transform(list_sort(list_filter(["
    + ", ".join(f"{{'rank': -b.{s}, 'i': {i}, 't': '{s}=' || {q.fixed(f'b.{s}', 2)}}}" for i, s in enumerate(kb.SIGNALS))
    + "], lambda x: x.rank IS NOT NULL)), lambda x: x.t), '+') END AS match_reason,"
    " b.intent, b.row_topic, b.row_category, b.keyword_overlap FROM kb_rows r LEFT JOIN best b USING (row_index)",
)


@query(
    "k1_kb_issues",
    "SELECT 'kb_' || item_id AS kb_id, 'invalid_priority' AS issue FROM benchmark WHERE item_id % 5 = 0 UNION ALL"
    " SELECT 'kb_' || item_id, 'required_and_forbidden' FROM benchmark WHERE item_id % 7 = 0",
)
def kb_issues(spark, sf_dir):
    return kb.kb_issues(kb_of(spark, sf_dir))


@query(
    "k2_keywords",
    q.with_ctes("SELECT row_index, unnest(words) AS word FROM kb_rows", "kb_rows"),
)
def keyword_sets(spark, sf_dir):
    rows = kb_rows(spark, sf_dir)
    return rows.select("row_index", F.explode(keywords(F.col("user_input"))).alias("word"))


@query(
    "k3_normal_form",
    q.with_ctes("SELECT row_index, intent, topic, category FROM kb_rows", "kb_rows"),
)
def normal_forms(spark, sf_dir):
    rows = kb_rows(spark, sf_dir)
    return rows.select("row_index", *[normal_form(F.col(c)).alias(c) for c in ("intent", "topic", "category")])


@query(
    "k4_candidate_signals",
    q.with_ctes(
        "SELECT row_index, entry_index, intent, row_topic, row_category, keyword_overlap FROM totals", "totals"
    ),
)
def candidate_signals(spark, sf_dir):
    return kb.candidate_signals(kb_rows(spark, sf_dir), kb_of(spark, sf_dir))


@query(
    "k4_candidate_signals_large_kb",
    q.with_ctes(
        "SELECT row_index, entry_index, intent, row_topic, row_category, keyword_overlap FROM totals", "totals"
    ),
)
def candidate_signals_large(spark, sf_dir):
    """The plan for a bank too large to broadcast."""
    return kb.candidate_signals(kb_rows(spark, sf_dir), kb_of(spark, sf_dir), max_broadcast=10)


@query("k5_best_entry", q.with_ctes("SELECT row_index, entry_index, score FROM best", "best"))
def best_entry(spark, sf_dir):
    candidates = kb.leading_signals(kb_rows(spark, sf_dir), kb_of(spark, sf_dir))
    return kb.best_candidates(candidates).select("row_index", "entry_index", "score")


def matches_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kb.match_rows(kb_rows(spark, sf_dir), kb_of(spark, sf_dir))


@query(
    "k6_kb_match",
    q.with_ctes("SELECT row_index, entry_index, kb_id, match_confidence FROM matches", "matches"),
)
def kb_match(spark, sf_dir):
    return matches_of(spark, sf_dir).select("row_index", "entry_index", "kb_id", "match_confidence")


@query("k7_match_reason", q.with_ctes("SELECT row_index, match_reason FROM matches", "matches"))
def match_reason(spark, sf_dir):
    return matches_of(spark, sf_dir).select("row_index", "match_reason")


@query(
    "k8_task_profiles",
    q.with_ctes(
        "SELECT m.row_index, m.kb_id, m.match_confidence, 'step ' || m.entry_index || '|timeline' AS required_elements,"
        " 'notes for ' || m.entry_index AS completeness_notes,"
        " CASE WHEN m.entry_index % 5 = 0 THEN 'urgent' WHEN m.entry_index % 5 = 1 THEN 'high' END AS priority_level,"
        " CASE WHEN m.entry_index % 3 = 0 THEN 'banking' END AS domain FROM matches m WHERE kb_id IS NOT NULL",
        "matches",
    ),
)
def task_profiles(spark, sf_dir):
    profiles = kb.task_profiles(matches_of(spark, sf_dir), kb_of(spark, sf_dir))
    return profiles.select(
        "row_index",
        "kb_id",
        "match_confidence",
        F.array_join("required_elements", "|").alias("required_elements"),
        "completeness_notes",
        "priority_level",
        "domain",
    )


_BULLETS = "E'\\n  - '"


@query(
    "k9_profile_blocks",
    q.with_ctes(
        f"""SELECT row_index, 'Task-specific completeness profile (KB-informed):' || E'\\n  Source KB entry: ' || kb_id
  || E'\\n  Match confidence: ' || {q.fixed('match_confidence', 2)} || ' (' || match_reason || ')'
  || CASE WHEN e % 5 = 0 THEN E'\\n  Priority level: urgent' WHEN e % 5 = 1 THEN E'\\n  Priority level: high' ELSE '' END
  || CASE WHEN e % 3 = 0 THEN E'\\n  Domain: banking' ELSE '' END
  || E'\\n\\n' || '{prompts.NOTES_HEADING}' || E'\\n  notes for ' || e
  || E'\\n\\n' || '{prompts.REQUIRED_HEADING.replace("'", "''")}' || {_BULLETS} || 'step ' || e || {_BULLETS} || 'timeline'
  || CASE WHEN e % 2 = 0 THEN E'\\n\\n' || '{prompts.OPTIONAL_HEADING}' || {_BULLETS} || 'caveat' ELSE '' END
  || CASE WHEN e % 7 = 0 THEN E'\\n\\n' || '{prompts.FORBIDDEN_HEADING}' || {_BULLETS} || ' Timeline ' ELSE '' END
  || CASE WHEN e % 4 = 0 THEN E'\\n\\n' || '{prompts.POLICY_HEADING}' || {_BULLETS} || 'policy' ELSE '' END AS block
FROM (SELECT *, entry_index AS e FROM matches WHERE kb_id IS NOT NULL)""",
        "matches",
    ),
)
def profile_blocks(spark, sf_dir):
    profiles = kb.task_profiles(matches_of(spark, sf_dir), kb_of(spark, sf_dir))
    return prompts.profile_blocks(profiles, "block")


@query(
    "k10_match_extras",
    q.with_ctes(
        "SELECT row_index, CASE WHEN kb_id IS NULL THEN 'generic_fallback' ELSE 'kb_informed' END AS completeness_mode,"
        " CASE WHEN kb_id IS NULL THEN 'none' ELSE 'hit' END AS kb_match,"
        f" {q.fixed('match_confidence', 4)} AS kb_match_confidence, kb_id,"
        " CASE WHEN kb_id IS NOT NULL THEN match_reason END AS kb_match_reason FROM matches",
        "matches",
    ),
)
def match_extras(spark, sf_dir):
    extras = matches_of(spark, sf_dir).select("row_index", kb.match_extras().alias("x"))
    names = ["completeness_mode", "kb_match", "kb_match_confidence", "kb_id", "kb_match_reason"]
    return extras.select("row_index", *[F.try_element_at("x", F.lit(n)).alias(n) for n in names])


@query(
    "u2_completeness_prompts",
    q.with_ctes(
        "SELECT row_index, pillar, pillar = 'completeness' AND kb_id IS NOT NULL AS has_profile,"
        " CASE WHEN pillar <> 'completeness' THEN 'none' WHEN kb_id IS NULL THEN 'fallback' ELSE 'kb' END AS addendum"
        " FROM matches CROSS JOIN (VALUES ('completeness'), ('relevance')) AS p(pillar)",
        "matches",
    ),
)
def completeness_prompts(spark, sf_dir):
    """The scorer hooks together: match, profile, prompt and addendum per task."""
    rows = kb_rows(spark, sf_dir).selectExpr(
        "row_index", "CAST(row_index AS STRING) AS record_id", "user_input", "'ok' AS agent_output", "category"
    )
    plan = tasks.plan_tasks(rows, ["completeness", "relevance"])
    rendered = prompts.task_prompts(plan, rubric.default_rubrics(spark), "v1")
    profiles = kb.task_profiles(matches_of(spark, sf_dir), kb_of(spark, sf_dir))
    final = prompts.completeness_prompts(rendered, profiles)
    return final.select(
        "row_index",
        "pillar",
        F.col("user_prompt").startswith("Task-specific completeness profile").alias("has_profile"),
        F.when(F.col("system_prompt").endswith(prompts.KB_ADDENDUM), "kb")
        .when(F.col("system_prompt").endswith(prompts.FALLBACK_ADDENDUM), "fallback")
        .otherwise("none")
        .alias("addendum"),
    )


_ENTRY_JSON = (
    "'{\"author\":null,\"completeness_notes\":\"notes for ' || item_id || '\",\"domain\":' ||"
    " CASE WHEN item_id % 3 = 0 THEN '\"banking\"' ELSE 'null' END || ',\"example_agent_response\":\"an example\","
    "\"forbidden_elements\":[' || CASE WHEN item_id % 7 = 0 THEN '\" Timeline \"' ELSE '' END || '],\"intent\":\"Intent '"
    " || (item_id % 30) || '\",\"kb_id\":\"kb_' || item_id || '\",\"last_updated\":null,\"optional_elements\":[' ||"
    " CASE WHEN item_id % 2 = 0 THEN '\"caveat\"' ELSE '' END || '],\"policy_refs\":[' ||"
    " CASE WHEN item_id % 4 = 0 THEN '\"policy\"' ELSE '' END || '],\"priority_level\":' ||"
    " CASE WHEN item_id % 5 = 0 THEN '\"urgent\"' WHEN item_id % 5 = 1 THEN '\"high\"' ELSE 'null' END ||"
    " ',\"question_or_utterance_pattern\":' || CAST(to_json(text) AS VARCHAR) || ',\"required_elements\":[\"step '"
    " || item_id || '\",\"timeline\"],\"topic_list\":[\"SRC' || (item_id % 20) || '\",\" topic  ' || (item_id % 6)"
    " || '\"],\"version\":\"1.0\"}'"
)


_ENTRIES_SQL = (
    "SELECT kb_id, array_to_string(list_transform(string_split(j, ''), lambda c: CASE WHEN unicode(c) > 127"
    " THEN printf('\\u%04x', unicode(c)) ELSE c END), '') AS j"
    f" FROM (SELECT 'kb_' || item_id AS kb_id, {_ENTRY_JSON} AS j FROM benchmark)"
)


@query(
    "k11_kb_fingerprint",
    "SELECT 'kb.v1:sha256:' || substr(line, 1, 12) AS kb_fingerprint FROM"
    f" ({tree_sql(f'SELECT sha256(j) AS line FROM ({_ENTRIES_SQL})', 'line')})",
)
def kb_fingerprint(spark, sf_dir):
    return kb.kb_fingerprint(kb_of(spark, sf_dir), "kb.v1")


@query(
    "k11_small_kb_fingerprint",
    "SELECT 'kb.v1:sha256:' || substr(sha256('[' || string_agg(j, ',' ORDER BY kb_id) || ']'), 1, 12) AS kb_fingerprint"
    f" FROM ({_ENTRIES_SQL})",
)
def small_kb_fingerprint(spark, sf_dir):
    return kb.small_kb_fingerprint(kb_of(spark, sf_dir), "kb.v1")


@query(
    "k12_entry_by_id",
    "SELECT 'kb_' || item_id AS kb_id, text AS question_or_utterance_pattern FROM benchmark WHERE item_id = 7",
)
def entry_by_id(spark, sf_dir):
    return kb.kb_entry(kb_of(spark, sf_dir), "kb_7").select("kb_id", "question_or_utterance_pattern")


@query(
    "s10_kb_dir",
    "SELECT row_number() OVER (ORDER BY item_id) - 1 AS entry_index, 'kb_' || item_id AS kb_id,"
    " text AS question_or_utterance_pattern, 'dir.v7' AS version FROM benchmark",
)
def kb_dir(spark, sf_dir):
    """The bank as a directory of one file per entry, beside a ``_meta.json`` and a draft that do not count."""
    path = shared_folder(spark)
    fields = [f.name for f in KB_ENTRY.fields]
    # Names follow the tasks, and these the entries, in ranges.
    entries = kb_of(spark, sf_dir).repartitionByRange("entry_index").sortWithinPartitions("entry_index").select(fields)
    entries.write.option("maxRecordsPerFile", 1).json(path)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name, text in (("_meta.json", '{"version": "dir.v7"}'), ("_draft.json", '{"kb_id": "draft"}')):
        target = jvm.org.apache.hadoop.fs.Path(path, name)
        stream = target.getFileSystem(conf).create(target)
        stream.write(bytearray(text.encode()))
        stream.close()
    loaded, version = readers.load_kb_dir(spark, path)
    return loaded.select(
        "entry_index", "kb_id", "question_or_utterance_pattern", F.lit(version).alias("version")
    )


@query(
    "s10_kb_file",
    "SELECT item_id AS entry_index, 'kb_' || item_id AS kb_id, text AS question_or_utterance_pattern, 'seed.v1' AS version"
    " FROM benchmark",
)
def kb_file(spark, sf_dir):
    """The bank written as one document and loaded back; a bank is a small hand-written file."""
    path = shared_folder(spark)
    kb.require_small(kb_of(spark, sf_dir))
    entry = F.struct("entry_index", F.struct(*[f.name for f in KB_ENTRY.fields]).alias("entry"))
    listed = F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["entry"])
    document = F.to_json(F.struct(F.lit("seed.v1").alias("version"), listed.alias("entries")))
    kb_of(spark, sf_dir).agg(document.alias("value")).write.text(path)
    loaded, version = readers.load_kb(spark, path)
    return loaded.select(
        "entry_index", "kb_id", "question_or_utterance_pattern", F.lit(version).alias("version")
    )


# --- sinks --------------------------------------------------------------------------


def _long_sql(source: str, key: str, columns: dict[str, str], where: str = "TRUE") -> str:
    return " UNION ALL ".join(
        f"SELECT 'run-1' AS run_id, {key} || '/{name}' AS key, CAST({value} AS DOUBLE) AS value FROM {source}"
        f" WHERE {where} AND {value} IS NOT NULL"
        for name, value in columns.items()
    )


_METRIC_COLUMNS = {c: c for c in ("support", *q.METRICS) if not c.startswith("avg_")}


@query(
    "s11_agreement_metrics",
    q.with_ctes(
        _long_sql("report", f"CASE WHEN pillar = '{OVERALL}' THEN 'overall' ELSE pillar END", _METRIC_COLUMNS), "report"
    ),
)
def agreement_metrics(spark, sf_dir):
    path = shared_folder(spark) + "/metrics"
    sinks.write_metrics(sinks.agreement_metrics(report_of(spark, sf_dir), "run-1"), path)
    return sinks.read_metrics(spark, path).select("run_id", "key", "value")


@query(
    "s11_committed_metrics",
    q.with_ctes(
        "SELECT run_id, 'agreement' AS section, 2 AS attempt, key, value FROM ("
        + _long_sql("report", f"CASE WHEN pillar = '{OVERALL}' THEN 'overall' ELSE pillar END", _METRIC_COLUMNS)
        + ") UNION ALL SELECT run_id, 'slices', 1, key, value FROM ("
        + _long_sql(
            "sliced",
            "'slice/' || slice || '/' || pillar",
            {c: c for c in ("support", "severity_aware_alignment")},
            f"dimension = 'category' AND pillar <> '{OVERALL}'",
        )
        + ")",
        "report",
        "sliced",
    ),
)
def committed_metrics(spark, sf_dir):
    """Two sections of a run through the sink with a commit; the agreement section is written again."""
    path = shared_folder(spark) + "/metrics"
    agreement = sinks.agreement_metrics(report_of(spark, sf_dir), "run-1")
    metric_sink.write_metrics(agreement.where("key NOT LIKE 'overall%'"), path, "run-1", "agreement", attempt=1)
    metric_sink.write_metrics(agreement, path, "run-1", "agreement", attempt=2)
    slices = sinks.slice_metrics(sliced_of(spark, sf_dir, ["category"]), "run-1")
    metric_sink.write_metrics(slices, path, "run-1", "slices")
    return metric_sink.read_metrics(spark, path, run_id="run-1")


@query(
    "s12_slice_metrics",
    q.with_ctes(
        _long_sql(
            "sliced",
            "'slice/' || slice || '/' || pillar",
            {c: c for c in ("support", "severity_aware_alignment")},
            f"dimension = 'category' AND pillar <> '{OVERALL}'",
        ),
        "sliced",
    ),
)
def slice_metrics(spark, sf_dir):
    return sinks.slice_metrics(sliced_of(spark, sf_dir, ["category"]), "run-1")


@query(
    "s13_reviewer_metrics",
    q.with_ctes(
        "SELECT 'run-1' AS run_id, 'reviewer/' || reviewer || '/sample_count' AS key, CAST(samples AS DOUBLE) AS value"
        " FROM reviewer_counts UNION ALL "
        + _long_sql(
            "by_reviewer", "'reviewer/' || reviewer || '/' || pillar", _METRIC_COLUMNS, f"pillar <> '{OVERALL}'"
        )
        + " UNION ALL "
        + _long_sql(
            "reviewer_pillars",
            "'reviewer/' || reviewer || '/' || pillar",
            {
                "disagreement_rate": "disagreement_rate",
                "within_1_agreement": "within_1_agreement",
                "large_miss_rate": "large_miss_3_rate",
            },
        )
        + " UNION ALL "
        + _long_sql(
            "pair_stats",
            "'reviewer_pair/' || reviewer_a || '__' || reviewer_b",
            {
                "overlap": "overlap",
                "exact_match_rate": "exact_match_rate",
                "within_1_rate": "within_1_rate",
                "large_miss_rate": "large_miss_3_rate",
            },
        ),
        "reviewer_counts",
        "by_reviewer",
        "reviewer_pillars",
        "pair_stats",
    ),
)
def reviewer_metrics(spark, sf_dir):
    pairs = reviewers.reviewer_pairs(reviews_of(spark, sf_dir))
    return sinks.reviewer_metrics(reviewer_report_of(spark, sf_dir), pairs, "run-1")


def _code(status: str) -> str:
    return f"CASE {status} " + " ".join(f"WHEN '{s}' THEN {c}::DOUBLE" for s, c in gates.STATUS_CODES.items()) + " END"


@query(
    "s14_gate_metrics",
    q.with_ctes(
        f"SELECT 'run-1' AS run_id, 'threshold/' || pillar || '/overall' AS key, {_code('overall')} AS value FROM pillar_gate"
        f" UNION ALL SELECT 'run-1', 'threshold/' || pillar || '/' || metric, {_code('status')} FROM gate_status"
        " UNION ALL SELECT 'run-1', 'threshold/' || pillar || '/' || metric || '_value', value FROM gate_status"
        " WHERE value IS NOT NULL",
        "pillar_gate",
        "gate_status",
    ),
)
def gate_metrics(spark, sf_dir):
    return sinks.gate_metrics(*gates_of(spark, sf_dir), "run-1")


_DIAG = {
    "mean_residual_judge_minus_human": "mean_residual",
    "pct_positive_residual": "pct_positive_residual",
    "ols_slope": "ols_slope",
    "ols_intercept": "ols_intercept",
    "ols_r2": "ols_r2",
    "js_vs_baseline": "js_vs_baseline",
    "psi_vs_baseline": "psi_vs_baseline",
}


@query(
    "s15_diagnostics_metrics",
    q.with_ctes(
        "SELECT run_id, key, round(value, 12) AS value FROM ("
        + _long_sql("(SELECT * FROM ols JOIN drift USING (pillar))", "'diag/' || pillar", _DIAG)
        + " UNION ALL SELECT 'run-1', 'diag/baseline_compatible', 1::DOUBLE)",
        "ols",
        "drift",
    ),
)
def diagnostics_metrics(spark, sf_dir):
    metrics = sinks.diagnostics_metrics(diagnostics_of(spark, sf_dir), "run-1")
    return metrics.withColumn("value", F.round("value", 12))


@query(
    "s16_outcome_snapshot",
    q.with_ctes(
        "SELECT outcome_index, record_id, pillar, latency_ms, CASE WHEN failed THEN 'ProviderTimeoutError' END AS error_type,"
        " judge_score AS score, (SELECT count(*) > 500 FROM outcomes) AS outcomes_truncated FROM outcomes"
        " ORDER BY CAST(regexp_replace(record_id, '\\D', '', 'g') AS BIGINT), pillar, latency_ms, outcome_index LIMIT 500",
        "outcomes",
    ),
)
def outcome_snapshot(spark, sf_dir):
    """The first 500 outcomes by row and pillar; the row's number is in its record id."""
    numbered = inputs.outcomes(spark, sf_dir).withColumn(
        "row_index", F.regexp_replace("record_id", "\\D", "").cast("long")
    )
    return sinks.outcome_snapshot(numbered, order=("row_index", "pillar", "latency_ms", "outcome_index"))


_TAGS_SQL = (
    f"CASE WHEN {q.first_tag()} IS NULL OR judge_score = 5 THEN CAST([] AS VARCHAR[])"
    f" WHEN judge_score < 3 THEN [{q.first_tag()}, 'second'] ELSE [{q.first_tag()}] END"
)


@query(
    "s17_trace_rows",
    q.with_ctes(
        f"""SELECT o.pillar || '@' || o.record_id AS name, o.record_id, o.pillar, r.category, o.latency_ms, o.attempts,
  CASE WHEN NOT o.failed THEN 'v1' END AS prompt_version, CASE WHEN NOT o.failed THEN 'v1.0' END AS rubric_version,
  r.user_input, r.agent_output, CASE WHEN NOT o.failed THEN o.judge_score END AS score,
  CASE WHEN NOT o.failed THEN o.confidence END AS confidence,
  CASE WHEN NOT o.failed THEN 'score ' || o.judge_score || ' on ' || o.pillar END AS decision_summary,
  CASE WHEN NOT o.failed THEN array_to_string({_TAGS_SQL}, ',') END AS failure_tags, o.model_name AS model,
  coalesce(o.input_tokens, 0) AS input_tokens, o.output_tokens,
  coalesce(o.input_tokens, 0) + o.output_tokens AS total_tokens, CASE WHEN o.failed THEN 'ERROR' ELSE 'DEFAULT' END AS level,
  CASE WHEN o.failed THEN 'provider timed out' END AS status_message
FROM (SELECT * FROM outcomes) o JOIN (SELECT record_id, category, user_input, agent_output FROM latest) r
  ON r.record_id = o.record_id""",
        "outcomes",
        "latest",
    ),
)
def trace_rows(spark, sf_dir):
    return sinks.trace_rows(*base(spark, sf_dir)).selectExpr(
        "name",
        "metadata.record_id",
        "metadata.pillar",
        "metadata.category",
        "metadata.latency_ms",
        "metadata.attempts",
        "metadata.prompt_version",
        "metadata.rubric_version",
        "input.user_input",
        "input.agent_output",
        "output.score AS score",
        "output.confidence AS confidence",
        "output.decision_summary AS decision_summary",
        "array_join(output.failure_tags, ',') AS failure_tags",
        "model",
        "usage.input AS input_tokens",
        "usage.output AS output_tokens",
        "usage.total AS total_tokens",
        "level",
        "status_message",
    )


@query(
    "s18_redaction",
    "SELECT doc_id, '<redacted len=' || length(text) || '>' AS redacted, CASE WHEN length(text) <= 2048 THEN text ELSE"
    " substr(text, 1, 2048) || '... <truncated ' || (length(text) - 2048) || ' chars>' END AS shortened FROM documents",
)
def redaction(spark, sf_dir):
    from judgespark.functions.text import redact_or_truncate

    text = F.col("text")
    return inputs.table(spark, sf_dir, "documents").select(
        "doc_id",
        redact_or_truncate(text, redact=True).alias("redacted"),
        redact_or_truncate(text, redact=False).alias("shortened"),
    )


@query(
    "s19_export_rows",
    q.with_ctes(
        "SELECT pillar, record_id, NOT failed AS ok, latency_ms, attempts, model_name, 'run-1' AS run_id,"
        " CASE WHEN failed THEN 'provider timed out' END AS error,"
        " CASE WHEN failed THEN 'ProviderTimeoutError' END AS error_type, '{}' AS extras,"
        " CASE WHEN NOT failed THEN CAST(json_object('pillar', pillar, 'score', judge_score, 'confidence', confidence,"
        " 'decision_summary', 'score ' || judge_score || ' on ' || pillar, 'evidence_for_score', NULL,"
        f" 'failure_tags', {_TAGS_SQL},"
        " 'why_not_higher', CASE WHEN judge_score < 5 THEN 'some claims lack support' END,"
        " 'why_not_lower', CASE WHEN judge_score > 1 THEN 'the core answer is usable' END, 'rubric_anchor', judge_score,"
        " 'elements_present', CAST([] AS VARCHAR[]), 'elements_missing', CAST([] AS VARCHAR[]),"
        " 'raw_model_name', model_name, 'prompt_version', 'v1', 'rubric_version', 'v1.0') AS VARCHAR) END AS result,"
        " input_tokens, output_tokens, input_tokens + output_tokens AS total_tokens FROM outcomes",
        "outcomes",
    ),
)
def export_rows(spark, sf_dir):
    return sinks.export_rows(inputs.outcomes(spark, sf_dir))


def run_metadata_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.eval_rows(spark, sf_dir)
    run = {
        "run_id": "run-1",
        "provider": "batch",
        "pillars": PILLARS,
        "kb_version": "kb.v1",
        **{name: {p: str(CONFIGS[p][name]) for p in PILLARS} for name in ("model_alias", "model_name", "prompt_version", "rubric_version")},
    }
    return sinks.run_metadata(rows, ingest.dataset_fingerprint(rows), run)


_PARAMS = {
    "run_id": "'run-1'",
    "dataset_row_count": "(SELECT CAST(count(*) AS VARCHAR) FROM orders)",
    "pillars": "'" + ",".join(PILLARS) + "'",
    "provider": "'batch'",
    "kb_version": "'kb.v1'",
    **{
        f"{name}_{p}": f"'{CONFIGS[p][name]}'"
        for p in PILLARS
        for name in ("model_alias", "model_name", "prompt_version", "rubric_version")
    },
}


@query(
    "v21_run_metadata",
    q.with_ctes(
        " UNION ALL ".join(f"SELECT '{k}' AS key, {v} AS value" for k, v in _PARAMS.items())
        + f" UNION ALL SELECT 'dataset_fingerprint', dataset_fingerprint FROM ({fingerprint_sql()})",
        "eval_rows",
    ),
)
def run_metadata(spark, sf_dir):
    return sinks.metadata_params(run_metadata_of(spark, sf_dir))
