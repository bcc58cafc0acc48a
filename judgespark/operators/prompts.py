"""Prompt text per task, rendered with column expressions.

Only the inputs a pillar's rubric requires are shown to the grader.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from judgespark.functions.numeric import with_fixed
from judgespark.functions.text import bulleted, indent

# --- Fixed values: prompt wording. %n$s are the parameters named next to each template. ---

# pillar, rubric block, score_min, score_max, prompt version
SYSTEM_TEMPLATE = """You are a strict, impartial evaluation judge. You score a single chatbot response on one rubric pillar: %1$s.

Rubric (follow exactly):
%2$s

Output contract (your response is parsed as strict JSON; do not add fields, do not omit fields, do not add commentary outside the JSON):
  - pillar: string, MUST equal the rubric pillar above.
  - score: integer in [%3$s, %4$s].
  - confidence: float in [0.0, 1.0].
  - decision_summary: short natural-language summary (1-3 sentences).
  - evidence_for_score: list of {claim, status, support?}; may be empty.
  - failure_tags: list of strings (use ONLY from the allowed list above).
  - why_not_higher: string, REQUIRED when score < %4$s.
  - why_not_lower: string, REQUIRED when score > %3$s.
  - rubric_anchor: integer, the anchor closest to your score (within +/- 1 of score).

Hard invariants (violating any of these will cause your response to be rejected):
  - If score == %4$s, failure_tags MUST be empty.
  - If failure_tags is non-empty, score MUST be less than %4$s.
  - Every failure tag must come from the rubric's allowed list.
  - pillar must exactly equal: %1$s

Prompt version: %5$s
"""
# row block
USER_TEMPLATE = """Score the following row against the rubric you were given.

%1$s

Return ONLY the structured JSON object defined by the output contract. No preamble, no markdown, no trailing commentary."""
KB_ADDENDUM = """
Completeness KB mode: KB_INFORMED.
You will receive a task-specific completeness profile alongside the row. Score the agent's response ONLY against that profile's required_elements and forbidden_elements; do not invent new requirements. Populate `elements_present` with required items that ARE clearly addressed in the answer, and `elements_missing` with required items that are NOT addressed. Every required element must appear in exactly one of the two lists.
"""
FALLBACK_ADDENDUM = """
Completeness KB mode: GENERIC_FALLBACK.
No task-specific completeness profile is available for this row. Score against generic completeness criteria: does the answer directly address the user's question, cover the key sub-questions, and provide enough actionable detail. Leave `elements_present` and `elements_missing` as empty lists in this mode.
"""
NOTES_HEADING = (
    "SME completeness notes (treat as the authoritative definition of a complete answer for this row):"
)
REQUIRED_HEADING = (
    "Required elements (every item MUST appear in the agent's answer for a 5. Classify each into "
    "`elements_present` or `elements_missing`; together they must cover this list):"
)
OPTIONAL_HEADING = (
    "Optional elements (nice-to-have; do NOT penalise their absence, but cite them in `why_not_higher` if relevant):"
)
FORBIDDEN_HEADING = (
    "Forbidden elements (presence of any of these caps the score at 2 and must appear in `failure_tags`):"
)
POLICY_HEADING = "Policy references (context only; do not invent content):"

# --- rendering ------------------------------------------------------------------


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _lines(*parts: Column) -> Column:
    """Lines joined by line breaks; NULL parts are left out."""
    return F.concat_ws("\n", *parts)


def rubric_block() -> Column:
    """Scale, anchors in score order and allowed tags of a rubric row."""
    anchors = F.transform(
        F.array_sort("anchors"),
        lambda a: _text("  ", a["score"], " (", a["name"], "): ", a["description"]),
    )
    tags = F.when(
        F.size("failure_tags") > 0,
        _text(
            "\nAllowed failure_tags (use ONLY these strings; empty list is valid when score == ",
            F.col("score_max"),
            "):\n",
            bulleted(F.col("failure_tags")),
        ),
    )
    head = _text("Pillar: ", F.col("pillar"), "\nRubric version: ", F.col("version"))
    scale = _text("Score scale: ", F.col("score_min"), " (worst) to ", F.col("score_max"), " (best)\n")
    return _lines(head, scale, F.lit("Score anchors:"), F.array_join(anchors, "\n"), tags)


def system_prompts(rubrics: DataFrame, prompt_version: str) -> DataFrame:
    """``(pillar, rubric_version, system_prompt)`` per rubric row."""
    prompt = F.format_string(
        SYSTEM_TEMPLATE,
        F.col("pillar"),
        rubric_block(),
        F.col("score_min").cast("string"),
        F.col("score_max").cast("string"),
        F.lit(prompt_version),
    )
    return rubrics.select("pillar", F.col("version").alias("rubric_version"), prompt.alias("system_prompt"))


def _numbered(count: Column, noun: str) -> Column:
    return _text(" (", count, F.when(count == 1, f" {noun}").otherwise(f" {noun}s"), "):")


def _hanging(text: Column) -> Column:
    """A block whose first line starts behind a marker."""
    return F.ltrim(indent(text, "      "))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _pretty_json(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """JSON texts with sorted keys, two blanks per level; NULL entries stay NULL."""

    def pretty(texts):
        if texts is None:
            return None
        return [None if t is None else json.dumps(json.loads(t), indent=2, sort_keys=True) for t in texts]

    for batch in batches:
        yield batch.map(pretty, na_action="ignore")


def with_pretty_json(df: DataFrame) -> DataFrame:
    """Add ``_pretty``: readable JSON of the context's object chunks, then of the metadata.

    No built-in lays out nested arrays this way. Rows without any object skip Python.
    """
    none = F.lit(None).cast("string")
    parts = []
    if "retrieved_context" in df.columns:
        chunks = F.transform("retrieved_context", lambda x: F.when(x["kind"] == "json", x["text"]))
        parts.append(F.coalesce(chunks, F.array().cast("array<string>")))
    metadata = F.when(F.col("metadata") != "{}", F.col("metadata")) if "metadata" in df.columns else none
    texts = F.concat(*parts, F.array(metadata))
    return df.withColumn("_texts", texts).withColumn(
        "_pretty", _pretty_json(F.when(F.exists("_texts", lambda t: t.isNotNull()), F.col("_texts")))
    ).drop("_texts")


def context_section() -> Column:
    c = F.col("retrieved_context")
    chunks = F.transform(
        c,
        lambda x, i: _text(
            "  [", i + 1, "] ", _hanging(F.coalesce(F.try_element_at(F.col("_pretty"), i + 1), x["text"]))
        ),
    )
    return F.when(
        F.size(c) > 0,
        _text("Retrieved context", _numbered(F.size(c), "chunk"), "\n", F.array_join(chunks, "\n")),
    )


def history_section(c: Column) -> Column:
    turns = F.transform(c, lambda t: _text("  [", t["role"], "] ", _hanging(t["content"])))
    return F.when(
        F.size(c) > 0, _text("Chat history", _numbered(F.size(c), "turn"), "\n", F.array_join(turns, "\n"))
    )


def _labelled(label: str, name: str, block: bool = False) -> Column:
    body = indent(F.col(name)) if block else F.col(name)
    return F.when(F.col(name) != "", _text(label, "\n" if block else " ", body))


def row_block(columns: list[str]) -> Column:
    """The row as the grader sees it; needs ``required_inputs`` and ``_pretty``."""
    sections = {
        "retrieved_context": context_section,
        "chat_history": lambda: history_section(F.col("chat_history")),
        "metadata": lambda: F.when(
            F.col("metadata") != "{}", _text("Row metadata:\n", indent(F.element_at("_pretty", -1)))
        ),
        "intent": lambda: _labelled("Intent:", "intent"),
        "topic": lambda: _labelled("Topic:", "topic"),
        "ground_truth_answer": lambda: _labelled("Ground-truth answer (if available):", "ground_truth_answer", True),
        "policy_reference": lambda: _labelled("Policy reference:", "policy_reference"),
    }
    rendered = F.map_from_arrays(
        F.array(*[F.lit(name) for name in sections if name in columns]),
        F.array(*[section() for name, section in sections.items() if name in columns]),
    )
    # Sections follow the order in which the rubric lists its inputs.
    optional = F.array_join(
        F.filter(
            F.transform("required_inputs", lambda name: F.concat(F.lit("\n"), F.try_element_at(rendered, name))),
            lambda s: s.isNotNull(),
        ),
        "\n",
    )
    return _lines(
        _text("record_id: ", F.col("record_id")),
        _text("category: ", F.col("category"), "\n"),
        F.lit("User input:"),
        _text(indent(F.col("user_input")), "\n"),
        F.lit("Agent output (this is what you are scoring):"),
        indent(F.col("agent_output")),
        F.when(optional != "", optional),
    )


def profile_block() -> Column:
    """Task profile of a knowledge-bank hit; empty sections are left out.

    Needs ``_confidence_text`` (see ``profile_blocks``).
    """

    def section(heading: str, name: str) -> Column:
        return F.when(F.size(name) > 0, _text("\n", heading, "\n", bulleted(F.col(name))))

    required = F.when(F.size("required_elements") > 0, bulleted(F.col("required_elements"))).otherwise(
        "  (none declared)"
    )
    return _lines(
        F.lit("Task-specific completeness profile (KB-informed):"),
        _text("  Source KB entry: ", F.col("kb_id")),
        _text("  Match confidence: ", F.col("_confidence_text"), " (", F.col("match_reason"), ")"),
        F.when(F.col("priority_level") != "", _text("  Priority level: ", F.col("priority_level"))),
        F.when(F.col("domain") != "", _text("  Domain: ", F.col("domain"))),
        _text("\n", NOTES_HEADING, "\n", indent(F.col("completeness_notes"))),
        _text("\n", REQUIRED_HEADING, "\n", required),
        section(OPTIONAL_HEADING, "optional_elements"),
        section(FORBIDDEN_HEADING, "forbidden_elements"),
        section(POLICY_HEADING, "policy_refs"),
    )


def profile_blocks(profiles: DataFrame, name: str = "profile_block", row_key: str = "row_index") -> DataFrame:
    """``(row_key, name)`` with the rendered profile of each matched row."""
    shown = with_fixed(profiles, {"_confidence_text": ("match_confidence", 2)})
    return shown.select(row_key, profile_block().alias(name))


def task_prompts(tasks: DataFrame, rubrics: DataFrame, prompt_version: str) -> DataFrame:
    """Tasks (with their row columns) plus ``rubric_version``, ``system_prompt``, ``user_prompt``.

    The rubric table has one row per pillar, so it is broadcast.
    """
    per_pillar = system_prompts(rubrics, prompt_version).join(rubrics.select("pillar", "required_inputs"), "pillar")
    joined = with_pretty_json(tasks).join(F.broadcast(per_pillar), "pillar")
    user = F.format_string(USER_TEMPLATE, row_block(joined.columns))
    return joined.withColumn("user_prompt", user).drop("required_inputs", "_pretty")


def completeness_prompts(prompts: DataFrame, profiles: DataFrame) -> DataFrame:
    """Completeness prompts with the task profile of the row, or the fallback notice.

    ``profiles`` has one row per matched ``row_index``; other pillars are passed through.
    """
    joined = prompts.join(profile_blocks(profiles, "_profile"), "row_index", "left")
    mine, hit = F.col("pillar") == "completeness", F.col("_profile").isNotNull()
    return joined.withColumns(
        {
            "system_prompt": F.when(mine & hit, F.concat("system_prompt", F.lit(KB_ADDENDUM)))
            .when(mine, F.concat("system_prompt", F.lit(FALLBACK_ADDENDUM)))
            .otherwise(F.col("system_prompt")),
            "user_prompt": F.when(mine & hit, F.concat("_profile", F.lit("\n\n"), "user_prompt")).otherwise(
                F.col("user_prompt")
            ),
        }
    ).drop("_profile")
