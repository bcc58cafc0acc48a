"""Scorer calls as a table function: retries, time limits, and lanes that cap the calls per provider.

``lanes`` gives each task a provider and one of that provider's lanes; the table function is partitioned by
lane, and a lane's tasks run one after another. A provider therefore has at most as many calls in flight as it
has lanes, over all pillars and whatever the cluster's size. Tasks are dealt by a hash of row, record and
pillar, so a record with very many tasks spreads over all lanes and a recomputed task lands where it was.

A call that fails with a :class:`Retryable`, a time limit or a lost connection is tried again with growing
pauses; any other exception ends the task at once. Tasks that give no answer become error outcomes; none is
dropped and none fails the job. A call over its time limit is left to itself and may go on in the background.
"""

from __future__ import annotations

import json
import queue
import random
import threading
import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, PartitioningColumn, udtf
from pyspark.sql.types import StructType

from judgespark.operators.crosstab import quoted
from judgespark.operators.tasks import RAW_SCHEMA, ScorerRegistry

LANE_COLUMNS = ("row_index", "record_id", "pillar", "lane")
CALL_SCHEMA = RAW_SCHEMA + ", calls int"
_FIELDS = [part.split()[0] for part in CALL_SCHEMA.split(",")]


class Retryable(RuntimeError):
    """A failure that another call may not have, such as a rate limit."""


class CallTimeout(TimeoutError):
    """A call that gave no answer within its time limit."""


class CallPolicy(NamedTuple):
    max_attempts: int = 3
    timeout_s: float = 60.0
    initial_backoff_s: float = 0.5
    max_backoff_s: float = 8.0
    backoff_multiplier: float = 2.0
    jitter_s: float = 0.25

    def checked(self) -> CallPolicy:
        if self.max_attempts < 1:
            raise ValueError("max_attempts must be at least 1")
        if not self.timeout_s > 0:
            raise ValueError("timeout_s must be above 0")
        if min(self.initial_backoff_s, self.max_backoff_s, self.jitter_s) < 0 or self.backoff_multiplier < 1:
            raise ValueError("pauses must not be negative and must not shrink")
        return self

    def pause(self, failed: int) -> float:
        """Seconds before the next call after ``failed`` calls, without jitter."""
        return min(self.max_backoff_s, self.initial_backoff_s * self.backoff_multiplier ** (failed - 1))


def within(seconds: float, call: Callable[[], object]) -> object:
    """What ``call`` gives, or :class:`CallTimeout` when it takes longer."""
    answer: queue.SimpleQueue = queue.SimpleQueue()

    def run() -> None:
        try:
            answer.put((call(), None))
        except BaseException as exc:  # handed to the waiting task
            answer.put((None, exc))

    threading.Thread(target=run, daemon=True).start()
    try:
        value, failure = answer.get(timeout=seconds)
    except queue.Empty:
        raise CallTimeout(f"no answer within {seconds:g} s") from None
    if failure is not None:
        raise failure
    return value


def score_task(scorer: Callable[[dict], object] | None, task: dict, policy: CallPolicy) -> dict:
    """One task's raw output, or its error. The scorer sees the number of its call as ``attempt``."""
    base = {"row_index": task["row_index"], "record_id": task["record_id"], "pillar": task["pillar"]}
    failed = {**base, "latency_ms": 0.0, "attempts": 0}
    if scorer is None:
        return {**failed, "calls": 0, "error": f"no scorer for pillar {task['pillar']!r}", "error_type": "KeyError"}
    start = time.perf_counter()
    for attempt in range(1, policy.max_attempts + 1):
        try:
            answer = within(policy.timeout_s, lambda: scorer({**task, "attempt": attempt}))
            fields = answer if isinstance(answer, dict) and "raw" in answer else {"raw": answer}
            raw = fields["raw"] if isinstance(fields["raw"], str) else json.dumps(fields["raw"])
            elapsed = (time.perf_counter() - start) * 1000.0
            return {"latency_ms": elapsed, "attempts": attempt, **base, **fields, "raw": raw, "calls": attempt}
        except (Retryable, TimeoutError, ConnectionError) as exc:
            last = exc
        except Exception as exc:  # one task must never fail the run
            error = f"Unhandled judge exception: {exc}"
            return {**failed, "calls": attempt, "error": error, "error_type": type(exc).__name__}
        if attempt < policy.max_attempts:
            time.sleep(policy.pause(attempt) + random.random() * policy.jitter_s)
    error = f"gave up after {policy.max_attempts} calls: {last}"
    return {**failed, "calls": policy.max_attempts, "error": error, "error_type": type(last).__name__}


def lanes(tasks: DataFrame, provider_of: Mapping[str, str], limits: Mapping[str, int]) -> DataFrame:
    """``tasks`` with ``provider`` and ``lane``: ``limits[provider]`` lanes each, numbered through all providers.

    Tasks of a pillar without provider share the one lane -1.
    """
    unlimited = sorted(set(provider_of.values()) - set(limits))
    if unlimited:
        raise KeyError(f"no limit for providers {unlimited}")
    if any(n < 1 for n in limits.values()):
        raise ValueError("a provider needs at least one lane")
    first, lane, provider = 0, F.lit(None).cast("long"), F.lit(None).cast("string")
    for name in sorted(limits):
        own = F.col("pillar").isin([p for p, of in provider_of.items() if of == name])
        place = F.pmod(F.xxhash64("row_index", "record_id", "pillar"), F.lit(limits[name])) + F.lit(first)
        provider, lane = F.when(own, name).otherwise(provider), F.when(own, place).otherwise(lane)
        first += limits[name]
    return tasks.withColumn("provider", provider).withColumn("lane", F.coalesce(lane, F.lit(-1).cast("long")))


@dataclass
class _Plan(AnalyzeResult):
    policy: tuple = ()


def _constant(argument: AnalyzeArgument | None, name: str, default: float) -> float:
    if argument is None:
        return default
    if argument.isTable or argument.value is None:
        raise ValueError(f"{name} must be a constant")
    return type(default)(argument.value)


def register_scorers(
    spark: SparkSession, name: str, registry: ScorerRegistry, policy: CallPolicy = CallPolicy()
) -> None:
    """Registers ``name(TABLE(tasks) [, max_attempts => n] [, timeout_s => s])``, giving ``CALL_SCHEMA``.

    ``tasks`` comes from :func:`lanes`; the scorers see all of its columns but the lane.
    """
    policy.checked()
    scorers = {p: registry.resolve(p) for p in registry.pillars()}
    schema = StructType.fromDDL(CALL_SCHEMA)  # needs the session, which workers lack

    class ScoreTasks:
        def __init__(self, plan: _Plan):
            self.policy = CallPolicy(*plan.policy)

        @staticmethod
        def analyze(tasks: AnalyzeArgument, max_attempts=None, timeout_s=None) -> _Plan:
            missing = [c for c in LANE_COLUMNS if not tasks.isTable or c not in tasks.dataType.names]
            if missing:
                raise ValueError(f"a table of tasks with lanes is needed; missing columns: {missing}")
            chosen = policy._replace(
                max_attempts=_constant(max_attempts, "max_attempts", policy.max_attempts),
                timeout_s=_constant(timeout_s, "timeout_s", policy.timeout_s),
            )
            return _Plan(
                schema=schema,
                partitionBy=[PartitioningColumn("lane")],
                policy=tuple(chosen.checked()),
            )

        def eval(self, tasks: Row, max_attempts=None, timeout_s=None):
            task = tasks.asDict()
            task.pop("lane")
            scored = score_task(scorers.get(task["pillar"]), task, self.policy)
            yield tuple(scored.get(field) for field in _FIELDS)

    spark.udtf.register(name, udtf(ScoreTasks))


def call_scorers(
    tasks: DataFrame,
    function: str,
    columns: Sequence[str],
    max_attempts: int | None = None,
    timeout_s: float | None = None,
) -> DataFrame:
    """The registered ``function`` over ``tasks`` (from :func:`lanes`), with the task columns a scorer sees."""
    needed = list(dict.fromkeys([*LANE_COLUMNS, *columns]))
    options = {"max_attempts": max_attempts, "timeout_s": timeout_s}
    stated = "".join(f", {k} => CAST({quoted(str(v))} AS DOUBLE)" for k, v in options.items() if v is not None)
    sql = f"SELECT * FROM {function}(TABLE(SELECT * FROM {{tasks}}){stated})"
    return tasks.sparkSession.sql(sql, tasks=tasks.select(*needed))
