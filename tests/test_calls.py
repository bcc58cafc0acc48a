"""Scorer calls as a table function: retries, limits, lanes."""

import time

import pytest
from pyspark.sql import functions as F

from judgespark.operators import calls
from judgespark.operators.calls import CallPolicy, Retryable
from judgespark.operators.tasks import ScorerRegistry

FAST = CallPolicy(timeout_s=5.0, initial_backoff_s=0.0, jitter_s=0.0)


def flaky_scorer():
    """Answers at the call that ``needs`` states; below zero it breaks, at 100 it hangs."""

    def flaky(task):  # inside, as workers cannot import this file
        if task["needs"] == 100:
            time.sleep(30)
        if task["needs"] < 0:
            raise KeyError("broken")
        if task["attempt"] < task["needs"]:
            raise Retryable("busy")
        return {"raw": {"score": task["attempt"]}, "input_tokens": 7}

    return flaky


def tasks_of(spark, needs, pillars=("tone",)):
    rows = [(i, f"r{i}", p, n) for i, n in enumerate(needs) for p in pillars]
    return spark.createDataFrame(rows, "row_index long, record_id string, pillar string, needs int")


def run(spark, tasks, limits=None, providers=None, policy=FAST, **options):
    registry = ScorerRegistry()
    registry.register("tone", flaky_scorer())
    registry.register("truth", flaky_scorer())
    calls.register_scorers(spark, "score_tasks", registry, policy)
    laned = calls.lanes(tasks, providers or {"tone": "a", "truth": "b"}, limits or {"a": 2, "b": 1})
    return calls.call_scorers(laned, "score_tasks", ["needs"], **options)


def test_pauses_grow_up_to_a_bound():
    assert [CallPolicy().pause(n) for n in (1, 2, 3, 4, 5, 6)] == [0.5, 1.0, 2.0, 4.0, 8.0, 8.0]


@pytest.mark.parametrize("bad", [{"max_attempts": 0}, {"timeout_s": 0.0}, {"backoff_multiplier": 0.5}, {"jitter_s": -1.0}])
def test_policies_are_checked(bad):
    with pytest.raises(ValueError):
        CallPolicy(**bad).checked()


def test_retries_end_with_an_answer_or_an_error(spark):
    got = {r["row_index"]: r for r in run(spark, tasks_of(spark, [1, 2, 3, 4, -1])).collect()}
    assert [got[i]["calls"] for i in range(5)] == [1, 2, 3, 3, 1]
    assert [got[i]["attempts"] for i in range(5)] == [1, 2, 3, 0, 0]
    assert [got[i]["error_type"] for i in range(5)] == [None, None, None, "Retryable", "KeyError"]
    assert got[2]["raw"] == '{"score": 3}' and got[2]["input_tokens"] == 7
    assert got[3]["error"] == "gave up after 3 calls: busy" and got[3]["raw"] is None


def test_limits_can_be_stated_in_sql(spark):
    start = time.perf_counter()
    got = run(spark, tasks_of(spark, [1, 2, 100]), max_attempts=1, timeout_s=0.2).orderBy("row_index").collect()
    assert [(r["calls"], r["error_type"]) for r in got] == [(1, None), (1, "Retryable"), (1, "CallTimeout")]
    assert time.perf_counter() - start < 25


def test_unknown_pillars_become_errors(spark):
    got = run(spark, tasks_of(spark, [1], pillars=("tone", "mood"))).orderBy("pillar").collect()
    assert [(r["pillar"], r["calls"], r["error_type"]) for r in got] == [("mood", 0, "KeyError"), ("tone", 1, None)]


def test_missing_columns_are_refused(spark):
    registry = ScorerRegistry()
    registry.register("tone", flaky_scorer())
    calls.register_scorers(spark, "score_tasks", registry)
    tasks_of(spark, [1]).createOrReplaceTempView("bare_tasks")
    with pytest.raises(Exception, match="missing columns"):
        spark.sql("SELECT * FROM score_tasks(TABLE(bare_tasks))").collect()


def test_a_provider_has_no_more_lanes_than_its_limit(spark):
    tasks = tasks_of(spark, [1] * 300, pillars=("tone", "truth", "mood"))
    tasks = tasks.withColumn("record_id", F.lit("hot"))
    laned = calls.lanes(tasks, {"tone": "a", "truth": "b"}, {"a": 4, "b": 2})
    got = {r["provider"]: sorted(r["lanes"]) for r in laned.groupBy("provider").agg(F.collect_set("lane").alias("lanes")).collect()}
    assert got == {"a": [0, 1, 2, 3], "b": [4, 5], None: [-1]}
    with pytest.raises(KeyError):
        calls.lanes(tasks, {"tone": "c"}, {"a": 1})
    with pytest.raises(ValueError):
        calls.lanes(tasks, {"tone": "a"}, {"a": 0})


def test_calls_in_flight_stay_within_the_limit(spark, tmp_path):
    folder = str(tmp_path)

    def timed(task):
        start = time.time()
        time.sleep(0.01)
        with open(f"{folder}/{task['row_index']}", "w") as out:
            out.write(f"{start} {time.time()}")
        return {"raw": "{}"}

    registry = ScorerRegistry()
    registry.register("tone", timed)
    calls.register_scorers(spark, "timed_tasks", registry, FAST)
    laned = calls.lanes(tasks_of(spark, [1] * 60).repartition(8), {"tone": "a"}, {"a": 2})
    assert calls.call_scorers(laned, "timed_tasks", []).count() == 60
    spans = [tuple(map(float, p.read_text().split())) for p in tmp_path.iterdir()]
    assert max(sum(s <= at < e for s, e in spans) for at, _ in spans) <= 2


def test_no_tasks_give_no_rows(spark):
    assert run(spark, tasks_of(spark, [1]).limit(0)).collect() == []
