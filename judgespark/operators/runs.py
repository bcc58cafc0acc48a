"""Two runs over the same records, side by side.

Both runs' outcomes fold in one aggregation to one row per record and pillar that holds the state before and after:
absent, failed, or a score. That is the full outer alignment without a join, and a record with a third of all
outcomes shrinks to one row per task before it. Labels meet these rows by unique keys. All that follows
reads one small table of counts ``(pillar, before, after, human, n)``: transitions, the metrics of
both runs on the items both scored, their differences, and an exact test of the change.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from judgespark.operators.crosstab import METRIC_COLUMNS, agreement_report, quoted
from judgespark.operators.scored import label_of, latest_rows
from judgespark.schema import OVERALL, PILLARS

ABSENT, FAILED = "absent", "failed"
CHANGES = ("same", "up", "down", "gained", "lost", "newly_failed", "recovered", "still_failed")


def _state(run: Column) -> Column:
    """The run's last outcome as ``(outcome_index, score)``; of several with one index, that with the highest score."""
    # The greatest of no rows is null, and of scores null is the least.
    return F.max(F.when(run, F.struct("outcome_index", F.col("result.score").alias("score"))))


def aligned(outcomes: DataFrame, before: Column, after: Column, pillars: Sequence[str] | None = None) -> DataFrame:
    """``(record_id, pillar, before, after)`` of the outcomes of two runs, which the two conditions tell.

    States are ``absent``, ``failed``, or the score as text; the last outcome of a run counts. Records
    that neither run has are left out, and so are other pillars.
    """
    active = outcomes.where(F.col("pillar").isin(list(PILLARS if pillars is None else pillars)) & (before | after))
    rows = active.groupBy("record_id", "pillar").agg(_state(before).alias("_before"), _state(after).alias("_after"))

    def text(side: str) -> Column:
        state = F.col(f"_{side}")
        score = F.coalesce(state["score"].cast("string"), F.lit(FAILED))
        return F.when(state.isNull(), F.lit(ABSENT)).otherwise(score).alias(side)

    return rows.select("record_id", "pillar", text("before"), text("after"))


def transition_counts(pairs: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """``(pillar, before, after, human, n)`` of :func:`aligned` rows; ``human`` is the label, if ``rows`` has one."""
    if rows is None:
        labelled = pairs.withColumn("human", F.lit(None).cast("int"))
    else:
        known = [c.removeprefix("label_") for c in rows.columns if c.startswith("label_")]
        labels = latest_rows(rows, ["row_index", *[f"label_{p}" for p in known]])
        labelled = pairs.join(labels, "record_id", "left").withColumn("human", F.expr(label_of(known)))
    return labelled.groupBy("pillar", "before", "after", "human").agg(F.count(F.lit(1)).alias("n"))


def change(before: str = "before", after: str = "after") -> str:
    """The kind of a transition, one of ``CHANGES``."""
    scored = f"NOT IN ('{ABSENT}', '{FAILED}')"
    return (
        f"CASE WHEN {before} = '{FAILED}' AND {after} = '{FAILED}' THEN 'still_failed'"
        f" WHEN {after} = '{FAILED}' THEN 'newly_failed'"
        f" WHEN {after} = '{ABSENT}' THEN 'lost'"
        f" WHEN {before} = '{ABSENT}' THEN 'gained'"
        f" WHEN {before} = '{FAILED}' THEN 'recovered'"
        f" WHEN {before} {scored} AND try_cast({before} AS INT) < try_cast({after} AS INT) THEN 'up'"
        f" WHEN {before} {scored} AND try_cast({before} AS INT) > try_cast({after} AS INT) THEN 'down'"
        " ELSE 'same' END"
    )


def transitions(counts: DataFrame) -> DataFrame:
    """``(pillar, before, after, change, n)``; a failure is ``newly_failed`` also where nothing was before."""
    folded = counts.groupBy("pillar", "before", "after").agg(F.sum("n").alias("n"))
    return folded.selectExpr("pillar", "before", "after", f"{change()} AS change", "n")


def two_sided_sign_test(fewer: int, more: int) -> float:
    """The exact probability that fair coins split ``fewer + more`` at least this unevenly.

    The binomial tail is summed from its largest term down, until terms no longer count, which takes some
    multiple of the root of the number of coins.
    """
    n, k = fewer + more, min(fewer, more)
    if fewer == more:
        return 1.0
    total, term, i = 1.0, 1.0, k
    while i > 0 and term > total * 1e-18:
        term *= i / (n - i + 1)
        total += term
        i -= 1
    first = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - n * math.log(2)
    return min(1.0, 2 * total * math.exp(first))


@F.pandas_udf(T.DoubleType())
def _sign_test(fewer: pd.Series, more: pd.Series) -> pd.Series:
    return pd.Series([two_sided_sign_test(int(a), int(b)) for a, b in zip(fewer, more)], dtype=float)


def comparison(
    counts: DataFrame, pillars: Sequence[str] | None = None, metrics: Sequence[str] = METRIC_COLUMNS
) -> DataFrame:
    """Per pillar, and over all, from :func:`transition_counts`:

    the number of each kind of change; ``support``, the labelled items that both runs scored, and over these each
    metric before, after and its difference; ``hits_lost`` and ``hits_gained``, the items whose exact match
    with the label was lost and gained, and ``p_value``, McNemar's exact two-sided test of the two.
    """
    names = list(PILLARS if pillars is None else pillars)
    both = "before NOT IN ('absent', 'failed') AND after NOT IN ('absent', 'failed') AND human IS NOT NULL"
    paired = counts.where(both).where(F.col("pillar").isin(names))
    sides = paired.selectExpr(
        "pillar", "human", "n", "inline(array(struct('before' AS side, try_cast(before AS INT) AS judge), struct('after' AS side, try_cast(after AS INT) AS judge)))"
    )
    table = sides.groupBy("side", "pillar", "judge", "human").agg(F.sum("n").alias("n"))
    report = agreement_report(table, ["side"], names)
    at = lambda side, m: F.max(F.when(F.col("side") == side, F.col(m)))
    wide = report.groupBy("pillar").agg(
        F.max("support").alias("support"),
        *[at(side, m).alias(f"{m}_{side}") for m in metrics for side in ("before", "after")],
    )
    labelled = counts.withColumn("kind", F.expr(change()))
    hit = lambda side: f"({both} AND try_cast({side} AS INT) = human)"
    total = lambda condition: F.expr(f"coalesce(sum(CASE WHEN {condition} THEN n END), 0L)")
    kinds = labelled.where(F.col("pillar").isin(names)).withColumn("pillar", F.explode(F.array(F.col("pillar"), F.lit(OVERALL))))
    grid = counts.sparkSession.range(1).selectExpr(f"explode(array({', '.join(map(quoted, [*names, OVERALL]))})) AS pillar")
    kinds = F.broadcast(grid).join(kinds, "pillar", "left").groupBy("pillar").agg(
        *[total(f"kind = '{c}'").alias(c) for c in CHANGES],
        total(f"{hit('before')} AND NOT {hit('after')}").alias("hits_lost"),
        total(f"{hit('after')} AND NOT {hit('before')}").alias("hits_gained"),
    )
    out = kinds.join(F.broadcast(wide), "pillar", "left").withColumn("support", F.coalesce("support", F.lit(0).cast("long")))
    out = out.withColumns({f"{m}_delta": F.col(f"{m}_after") - F.col(f"{m}_before") for m in metrics})
    return out.withColumn("p_value", _sign_test("hits_lost", "hits_gained"))
