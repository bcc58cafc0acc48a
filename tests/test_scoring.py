"""Tasks, prompts, output checks, scorers, knowledge bank and sinks on small fixtures."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from judgespark.operators import kb, outcomes, prompts, rubric, tasks
from judgespark.schema import CHUNK, KB_ENTRY, PILLARS, TURN
from judgespark.sources import sinks

ROW_SCHEMA = (
    "row_index long, record_id string, user_input string, agent_output string, category string, intent string,"
    f" topic string, retrieved_context array<{CHUNK.simpleString()}>, chat_history array<{TURN.simpleString()}>,"
    " metadata string"
)


def make_rows(spark, rows):
    base = dict(
        row_index=0, record_id="r", user_input="question", agent_output="answer", category="c", intent=None, topic=None,
        retrieved_context=None, chat_history=None, metadata=None,
    )
    full = [{**base, "row_index": i, "record_id": f"r{i}", **r} for i, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r.values()) for r in full], ROW_SCHEMA)


# --- tasks ----------------------------------------------------------------------


def test_task_plan_and_batches(spark):
    rows = make_rows(spark, [{}, {}, {}]).withColumn("row_index", F.col("row_index") * 2_000_000)
    with pytest.raises(ValueError):
        tasks.plan_tasks(rows, [])
    with pytest.raises(ValueError):
        tasks.plan_tasks(rows, ["relevance", "relevance"])
    with pytest.raises(ValueError):
        tasks.task_batches(rows, PILLARS, 0)
    batches = tasks.task_batches(rows, ["relevance", "toxicity"], 4).orderBy("row_index", "pillar_index").collect()
    assert [b.batch_id for b in batches] == [0, 0, 0, 0, 1, 1]
    assert batches[0].task_id == "r0::relevance"


def config(**changes):
    base = {"prompt_version": "v1", "rubric_version": "v1.0", "model_alias": "a", "model_name": "m", "temperature": 0.0, "max_output_tokens": 10}
    return {"relevance": {**base, **changes}}


def test_cache_key_changes_with_everything_that_matters(spark):
    rows = make_rows(spark, [{}])

    def key(cfg, kb_version=None, df=rows):
        keyed = tasks.with_cache_keys(
            tasks.plan_tasks(df, ["relevance"]), tasks.judge_configs(spark, cfg), ["record_id", "user_input"], kb_version
        )
        return keyed.first().cache_key

    base = key(config())
    assert base == key(config()) and len(base) == 64
    others = [
        key(config(prompt_version="v2")), key(config(temperature=0.5)), key(config(model_name="n")),
        key(config(), "kb.v2"), key(config(), df=rows.withColumn("user_input", F.lit("else"))),
    ]
    assert len({base, *others}) == 6


def test_second_run_needs_no_scorer_and_failures_are_not_stored(spark):
    rows = make_rows(spark, [{}, {}])
    plan = tasks.with_cache_keys(
        tasks.plan_tasks(rows, ["relevance"]), tasks.judge_configs(spark, config()), ["record_id"]
    )
    done = plan.select(
        "cache_key", F.col("row_index").alias("outcome_index"), "record_id", "pillar", F.lit("old-run").alias("run_id"),
        F.when(F.col("row_index") == 0, F.struct(F.lit(4).alias("score"))).alias("result"),
        F.when(F.col("row_index") == 1, F.lit("boom")).alias("error"),
    )
    store = tasks.storable_outcomes(done)
    assert store.count() == 1
    assert [r.record_id for r in tasks.uncached_tasks(plan, store).collect()] == ["r1"]
    (hit,) = tasks.cached_outcomes(plan, store).collect()
    assert (hit.record_id, hit.run_id, hit.result.score) == ("r0", "old-run", 4)


def test_input_gate(spark):
    rows = make_rows(spark, [{"retrieved_context": [("text", "x")]}, {"retrieved_context": []}, {}])
    gated = tasks.gate_tasks(tasks.plan_tasks(rows, ["hallucination", "toxicity"]), rubric.default_rubrics(spark))
    failed = tasks.gate_failures(gated).orderBy("row_index").collect()
    assert [(f.record_id, f.pillar) for f in failed] == [("r1", "hallucination"), ("r2", "hallucination")]
    assert failed[0].error == (
        "Unhandled judge exception: Row 'r1' is missing rubric-required input(s) ['retrieved_context'] for pillar"
        " 'hallucination'."
    )
    assert (failed[0].error_type, failed[0].latency_ms, failed[0].attempts) == ("JudgeExecutionError", 0.0, 0)


# --- prompts --------------------------------------------------------------------


def test_user_prompt_layout(spark):
    rows = make_rows(
        spark,
        [
            {
                "user_input": "line one\nline two", "agent_output": "", "intent": "ask",
                "retrieved_context": [("text", "a\nb"), ("json", '{"k":[1,2],"é":null}')],
                "chat_history": [("user", "hi\nthere")], "metadata": '{"b":1,"a":{"c":2}}',
            }
        ],
    )
    table = rubric.default_rubrics(spark, pillars=["relevance"]).withColumn(
        "required_inputs", F.array(*[F.lit(n) for n in ("metadata", "user_input", "retrieved_context", "topic", "chat_history", "intent")])
    )
    prompt = prompts.task_prompts(tasks.plan_tasks(rows, ["relevance"]), table, "v9").first()
    pretty = json.dumps({"b": 1, "a": {"c": 2}}, indent=2, sort_keys=True).replace("\n", "\n  ")
    chunk = json.dumps({"k": [1, 2], "é": None}, indent=2, sort_keys=True).replace("\n", "\n      ")
    expected = (
        "Score the following row against the rubric you were given.\n\nrecord_id: r0\ncategory: c\n\nUser input:\n"
        "  line one\n  line two\n\nAgent output (this is what you are scoring):\n  (empty)\n\nRow metadata:\n  "
        f"{pretty}\n\nRetrieved context (2 chunks):\n  [1] a\n      b\n  [2] {chunk}\n\nChat history (1 turn):\n"
        "  [user] hi\n      there\n\nIntent: ask\n\nReturn ONLY the structured JSON object defined by the output contract."
        " No preamble, no markdown, no trailing commentary."
    )
    assert prompt.user_prompt == expected
    assert prompt.system_prompt.endswith("\nPrompt version: v9\n")
    assert "  - score: integer in [1, 5].\n" in prompt.system_prompt


def test_rubric_rules(spark):
    good = rubric.default_rubrics(spark)
    assert rubric.rubric_issues(good).count() == 0
    bad = rubric.default_rubrics(spark, {"relevance": [(1, "a", "x"), (1, "b", "y"), (9, "c", "z")]}, ["relevance"])
    bad = bad.withColumns({"failure_tags": F.array(F.lit("t"), F.lit("t"), F.lit(" p")), "required_inputs": F.array(F.lit("mood"))})
    assert {r.issue for r in rubric.rubric_issues(bad).collect()} == {
        "anchor_out_of_scale", "duplicate_anchor", "missing_anchor", "unknown_input", "invalid_tag", "duplicate_tag",
    }


# --- raw outputs ----------------------------------------------------------------

GOOD = {"pillar": "relevance", "score": 4, "confidence": 0.5, "decision_summary": "s", "why_not_higher": "a", "why_not_lower": "b", "rubric_anchor": 4}


@pytest.fixture(scope="module")
def check(spark):
    def run(bodies):
        rows = [
            (i, f"r{i}", "relevance", b if isinstance(b, str) or b is None else json.dumps(b)) for i, b in enumerate(bodies)
        ]
        raw = spark.createDataFrame(rows, "row_index long, record_id string, pillar string, raw string")
        checked = outcomes.checked_outputs(raw, rubric.default_rubrics(spark)).orderBy("row_index")
        return [(r.structure_reasons + r.invariant_reasons + r.rubric_reasons, r.core) for r in checked.collect()]

    return run


def test_output_checks(check):
    cases = [
        (GOOD, []),
        ({**GOOD, "score": 4.0}, ["invalid:score"]),
        ({**GOOD, "score": "4"}, ["invalid:score"]),
        ({**GOOD, "score": 6}, ["invalid:score"]),
        ({**GOOD, "score": None}, ["invalid:score"]),
        ({k: v for k, v in GOOD.items() if k != "score"}, ["missing:score"]),
        ({**GOOD, "confidence": 1}, []),
        ({**GOOD, "confidence": -0.1}, ["invalid:confidence"]),
        ({**GOOD, "failure_tags": None}, ["invalid:failure_tags"]),
        ({**GOOD, "failure_tags": ["off_topic"]}, []),
        ({**GOOD, "failure_tags": ["off_topic", "off_topic", "odd"]}, ["unknown_failure_tag", "duplicate_failure_tag"]),
        ({**GOOD, "extra, field": 1}, ["unknown_field:extra, field"]),
        ({**GOOD, "why_not_higher": None}, ["why_not_higher_missing"]),
        ({**GOOD, "rubric_anchor": 2}, ["anchor_too_far"]),
        ({**GOOD, "score": 5, "rubric_anchor": 5, "failure_tags": ["off_topic"]}, ["tags_with_top_score"]),
        ({**GOOD, "evidence_for_score": [{"claim": "c", "status": "supported"}]}, []),
        ({**GOOD, "evidence_for_score": [{"claim": "c", "status": "supported", "x": 1}]}, ["invalid:evidence_for_score"]),
        ({**GOOD, "pillar": "toxicity"}, ["pillar_mismatch"]),
        ({**GOOD, "elements_present": ["A  b"], "elements_missing": [" a B "]}, ["elements_overlap"]),
        (None, ["not_an_object"]),
        ("[]", ["not_an_object"]),
        ("plain words", ["not_an_object"]),
    ]
    for (body, expected), (found, core) in zip(cases, check([b for b, _ in cases])):
        assert found == expected, body
        if not any(":" in r or r == "not_an_object" for r in found):
            assert core.score == body["score"] and core.elements_present == body.get("elements_present", [])


def test_rubric_without_taxonomy(spark):
    raw = spark.createDataFrame(
        [(0, "r", "relevance", json.dumps({**GOOD, "failure_tags": ["x"]}))],
        "row_index long, record_id string, pillar string, raw string",
    )
    bare = rubric.default_rubrics(spark).withColumn("failure_tags", F.array().cast("array<string>"))
    assert outcomes.checked_outputs(raw, bare).first().rubric_reasons == ["failure_tags_without_taxonomy"]


# --- scorers --------------------------------------------------------------------


def test_registry_rules():
    registry = tasks.ScorerRegistry()
    with pytest.raises(ValueError):
        registry.register("", len)
    registry.register("relevance", len)
    registry.register("relevance", len)
    with pytest.raises(ValueError):
        registry.register("relevance", str)
    registry.register("relevance", str, force=True)
    assert registry.resolve("relevance") is str
    with pytest.raises(KeyError, match="relevance"):
        registry.resolve("toxicity")


def test_one_failing_task_does_not_fail_the_run(spark):
    rows = make_rows(spark, [{}, {"agent_output": "boom"}, {}])
    registry = tasks.ScorerRegistry()

    def scorer(task):
        if task["agent_output"] == "boom":
            raise RuntimeError("bad answer")
        return {**GOOD}

    registry.register("relevance", scorer)
    raw = tasks.run_scorers(tasks.plan_tasks(rows, ["relevance"]), registry, ["relevance"], ["agent_output"], max_parallel=2)
    assert raw.rdd.getNumPartitions() <= 2
    done = outcomes.assemble_outcomes(raw, rubric.default_rubrics(spark), "run", "v1").orderBy("row_index").collect()
    assert [d.result.score if d.result else None for d in done] == [4, None, 4]
    assert (done[1].error, done[1].error_type) == ("Unhandled judge exception: bad answer", "RuntimeError")
    assert done[0].error is None and done[0].prompt_versions.rubric == "v1.0"


# --- knowledge bank -------------------------------------------------------------


def make_kb(spark, entries):
    base = {f.name: None for f in KB_ENTRY.fields}
    full = []
    for i, e in enumerate(entries):
        row = {**base, "kb_id": f"kb_{i}", "topic_list": ["t"], "intent": f"i{i}", "version": "1.0", **e}
        full.append((i, *row.values()))
    return spark.createDataFrame(full, f"entry_index long, {KB_ENTRY.simpleString()[7:-1].replace(':', ' ')}".replace("array<string>", "array<string>"))


def match(spark, row, entries, **kwargs):
    rows = make_rows(spark, [row])
    return kb.match_rows(rows, make_kb(spark, entries), **kwargs).first()


def test_match_signals(spark):
    entries = [
        {"question_or_utterance_pattern": "dispute card transaction", "topic_list": ["Disputes", "Card  Issues"], "intent": "dispute"},
        {"question_or_utterance_pattern": "card rates lookup", "topic_list": ["rates"], "intent": "rates"},
    ]
    hit = match(spark, {"intent": " DISPUTE ", "user_input": "my card"}, entries)
    assert (hit.kb_id, hit.match_reason) == ("kb_0", "intent=0.70+keyword_overlap=0.07")
    assert hit.match_confidence == 0.7667
    topic = match(spark, {"topic": "card issues", "category": "disputes", "user_input": "dispute transaction card"}, entries)
    assert (topic.row_topic, topic.row_category, topic.match_confidence) == (0.4, None, 0.6)
    # category 0.3 and full keyword overlap 0.2 sit exactly on the threshold and pass
    edge = match(spark, {"category": "rates", "user_input": "rates, card lookup"}, entries)
    assert (edge.kb_id, edge.match_confidence) == ("kb_1", 0.5)
    below = match(spark, {"category": "rates", "user_input": "nothing"}, entries)
    assert (below.kb_id, below.match_confidence, below.match_reason) == (None, 0.3, "no_candidate_cleared_threshold")
    none = match(spark, {"user_input": "hello"}, entries)
    assert (none.kb_id, none.match_confidence, none.match_reason) == (None, 0.0, "no_candidate_scored")


def test_first_entry_wins_ties_and_empty_bank(spark):
    entries = [{"question_or_utterance_pattern": "x", "intent": "same"}] * 3
    assert match(spark, {"intent": "same"}, entries).kb_id == "kb_0"
    rows = make_rows(spark, [{}])
    empty = kb.match_rows(rows, make_kb(spark, entries).where("false")).first()
    assert (empty.kb_id, empty.match_reason, empty.match_confidence) == (None, "kb_empty", 0.0)
    with pytest.raises(ValueError):
        kb.match_rows(rows, make_kb(spark, entries), threshold=1.5)


def test_both_plans_give_the_same_matches(spark):
    words = ["card", "dispute", "refund", "limit", "travel", "rates"]
    entries = [{"question_or_utterance_pattern": f"{words[i % 6]} {words[(i * 2) % 6]}", "topic_list": [words[i % 3]]} for i in range(12)]
    rows = make_rows(spark, [{"user_input": f"{words[i % 6]} and {words[(i + 1) % 6]}", "topic": words[i % 4], "category": words[i % 5]} for i in range(40)])
    bank = make_kb(spark, entries)
    small = kb.match_rows(rows, bank).orderBy("row_index").collect()
    assert small == kb.match_rows(rows, bank, max_broadcast=1).orderBy("row_index").collect()
    assert len(small) == 40


def test_kb_rules_and_fingerprint(spark):
    good = {
        "question_or_utterance_pattern": "pé", "example_agent_response": "e", "completeness_notes": "n", "required_elements": ["a"],
    }
    bank = make_kb(spark, [good, {**good, "kb_id": "Bad-Id", "priority_level": "urgent", "topic_list": ["x", " X"], "forbidden_elements": [" A "]},
                           {**good, "kb_id": "kb_0"}])
    found = {(r.kb_id, r.issue) for r in kb.kb_issues(bank).collect()}
    assert found == {
        ("Bad-Id", "invalid_id"), ("Bad-Id", "invalid_priority"), ("Bad-Id", "duplicate_topic"),
        ("Bad-Id", "required_and_forbidden"), ("kb_0", "duplicate_id"),
    }
    one = make_kb(spark, [good])
    lists = [f.name for f in KB_ENTRY.fields if f.dataType.typeName() == "array"]
    payload = {**{f.name: None for f in KB_ENTRY.fields}, **{n: [] for n in lists}, **good, "kb_id": "kb_0", "topic_list": ["t"], "intent": "i0", "version": "1.0"}
    blob = json.dumps([payload], sort_keys=True, separators=(",", ":"))
    assert kb.small_kb_fingerprint(one, "v").first()[0] == "v:sha256:" + hashlib.sha256(blob.encode()).hexdigest()[:12]


# --- sinks ----------------------------------------------------------------------


def test_run_metadata(spark):
    rows = make_rows(spark, [{}, {}])
    per_pillar = {n: {"relevance": n} for n in ("model_alias", "model_name", "prompt_version", "rubric_version")}
    mark = spark.range(1).select(F.lit("sha256:x").alias("f"))
    meta = sinks.run_metadata(rows, mark, {"run_id": "r", "pillars": ["relevance"], **per_pillar})
    params = {r.key: r.value for r in sinks.metadata_params(meta, ["relevance"]).collect()}
    assert params["dataset_row_count"] == "2" and params["provider"] == "unknown" and "kb_version" not in params
    assert params["model_name_relevance"] == "model_name"
    with pytest.raises(KeyError):
        sinks.run_metadata(rows, mark, {"run_id": "r", "pillars": ["toxicity"], **per_pillar})
