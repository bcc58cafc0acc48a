"""Joining grader outcomes to human labels.

Two routes with the same rules. ``scored_items`` returns one row per surviving outcome.
``record_ledger`` first folds the outcomes of a record into one row of counts, so both join sides
have one row per record: a record with a third of all outcomes shrinks to one row per map task, and
the crosstab, the accounting and the missing-outcome count all come from that single join.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from judgespark.operators.crosstab import quoted
from judgespark.operators.skew import HOT_MIN_ROWS, skew_join
from judgespark.schema import ITEM_ATTRIBUTES, PILLARS, SCORES


def latest_rows(rows: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Last row per ``record_id`` by ``row_index``."""
    names = [c for c in (columns or rows.columns) if c != "record_id"]
    last = F.max_by(F.struct(*names), "row_index").alias("_row")
    return rows.groupBy("record_id").agg(last).select("record_id", "_row.*")


def labels_long(rows: DataFrame, pillars: Sequence[str] = PILLARS) -> DataFrame:
    """Wide label columns as ``(row_index, record_id, pillar, human_score)``."""
    entries = ", ".join(f"struct({quoted(p)} AS pillar, label_{p} AS human_score)" for p in pillars)
    return rows.selectExpr("row_index", "record_id", f"inline(array({entries}))")


def label_of(known: Sequence[str], pillar: str = "pillar") -> str:
    """The label column that belongs to ``pillar``; NULL when the row has none."""
    cases = " ".join(f"WHEN {quoted(p)} THEN label_{p}" for p in known)
    return f"CASE {pillar} {cases} END" if known else "CAST(NULL AS INT)"


def _label_pillars(rows: DataFrame) -> list[str]:
    return [c.removeprefix("label_") for c in rows.columns if c.startswith("label_")]


def outcomes_with_rows(
    rows: DataFrame,
    outcomes: DataFrame,
    row_columns: Sequence[str],
    hot_min_rows: int = HOT_MIN_ROWS,
) -> DataFrame:
    """Inner join of outcomes to the last row per record, safe against hot records."""
    return skew_join(
        outcomes,
        latest_rows(rows, ["row_index", *row_columns]).drop("row_index"),
        ["record_id"],
        spread_by=F.col("outcome_index"),
        min_rows=hot_min_rows,
    )


def scored_items(
    rows: DataFrame,
    outcomes: DataFrame,
    pillars: Sequence[str] | None = None,
    hot_min_rows: int = HOT_MIN_ROWS,
) -> DataFrame:
    """One item per successful outcome on an active pillar whose row has a label.

    Rows are last-wins per record. An empty ``pillars`` means all standard pillars. Duplicate
    outcomes give duplicate items.
    """
    active = list(pillars or PILLARS)
    labelled = [p for p in active if p in _label_pillars(rows)]
    attributes = [c for c in ITEM_ATTRIBUTES if c in rows.columns]
    ok = outcomes.where(F.col("pillar").isin(active) & F.col("result").isNotNull()).select(
        "outcome_index", "record_id", "pillar", F.col("result.score").alias("judge_score")
    )
    joined = outcomes_with_rows(
        rows, ok, [*attributes, *[f"label_{p}" for p in labelled]], hot_min_rows
    )
    return (
        joined.withColumn("human_score", F.expr(label_of(labelled)))
        .where(F.col("human_score").isNotNull())
        .select("outcome_index", "record_id", "pillar", "judge_score", "human_score", *attributes)
    )


def with_distance(items: DataFrame) -> DataFrame:
    return items.withColumn("distance", F.abs(F.col("judge_score") - F.col("human_score")))


def for_pillar(items: DataFrame, pillar: str) -> DataFrame:
    return items.where(F.col("pillar") == pillar)


def record_ledger(
    rows: DataFrame,
    outcomes: DataFrame,
    pillars: Sequence[str] | None = None,
    attributes: Sequence[str] = (),
    how: str = "inner",
    unique_rows: bool = False,
) -> DataFrame:
    """One row per record: attributes, labels and outcome counts per pillar and score.

    Columns ``ok_<k>_<score>`` and ``failed_<k>`` count the outcomes of pillar number ``k``;
    ``row_copies`` is the number of input rows with the record id (0 for orphans). With
    ``unique_rows`` the caller vouches that no record id repeats, which saves a shuffle of the rows
    when the outcomes are few enough to broadcast.
    """
    active = list(pillars or PILLARS)
    labelled = set(_label_pillars(rows))
    counts = []
    for k, p in enumerate(active):
        mine = f"pillar = {quoted(p)}"
        counts.append(f"count_if({mine} AND result IS NULL) AS failed_{k}")
        counts += [f"count_if({mine} AND result.score = {s}) AS ok_{k}_{s}" for s in SCORES]
    folded = (
        outcomes.where(F.col("pillar").isin(active))
        .groupBy("record_id")
        .agg(*[F.expr(c) for c in counts])
    )
    carried = [*attributes]
    carried += [
        f"{f'label_{p}' if p in labelled else 'CAST(NULL AS INT)'} AS label_{k}"
        for k, p in enumerate(active)
    ]
    if unique_rows:
        last = rows.selectExpr("record_id", "1L AS row_copies", *carried)
    else:
        last = (
            rows.groupBy("record_id")
            .agg(
                F.expr(f"max_by(struct({', '.join(carried)}), row_index) AS _row"),
                F.count(F.lit(1)).alias("row_copies"),
            )
            .select("record_id", "row_copies", "_row.*")
        )
    joined = last.join(folded, "record_id", how)
    if how == "inner":
        return joined
    absent = ["row_copies", *[c for c in folded.columns if c != "record_id"]]
    return joined.selectExpr(
        *[f"coalesce({c}, 0L) AS {c}" if c in absent else c for c in joined.columns]
    )


def ledger_crosstab(
    ledger: DataFrame, pillars: Sequence[str] | None = None, keys: Sequence[str] = ()
) -> DataFrame:
    """Crosstab ``(keys, pillar, judge, human, n)`` from a ledger.

    Each record contributes one row per labelled pillar with five counts, which the partial
    aggregation folds before the shuffle.
    """
    active = list(pillars or PILLARS)
    counts = [f"n{s}" for s in SCORES]
    entries = [
        f"struct({quoted(p)} AS pillar, label_{k} AS human, "
        + ", ".join(f"ok_{k}_{s} AS n{s}" for s in SCORES)
        + ")"
        for k, p in enumerate(active)
    ]
    spread = ledger.selectExpr(*keys, f"inline(array({', '.join(entries)}))").where("human IS NOT NULL")
    summed = spread.groupBy(*keys, "pillar", "human").agg(*[F.sum(c).alias(c) for c in counts])
    cells = ", ".join(f"struct({s} AS judge, n{s} AS n)" for s in SCORES)
    return (
        summed.selectExpr(*keys, "pillar", "human", f"inline(array({cells}))")
        .where("n > 0")
        .select(*keys, "pillar", "judge", "human", "n")
    )


def agreement_crosstab(
    rows: DataFrame, outcomes: DataFrame, pillars: Sequence[str] | None = None
) -> DataFrame:
    """Crosstab per pillar straight from rows and outcomes."""
    return ledger_crosstab(record_ledger(rows, outcomes, pillars), pillars)


def join_accounting(
    rows: DataFrame, outcomes: DataFrame, pillars: Sequence[str] | None = None
) -> DataFrame:
    """One row of join statistics.

    Outcomes count as failed first, then as orphans, then as unlabelled. ``considered`` counts
    duplicate rows; ``missing_outcomes`` counts distinct (record, pillar) pairs of the rows that
    have no outcome at all, a failed one included.
    """
    active = list(pillars or PILLARS)
    ledger = record_ledger(rows, outcomes, pillars, how="full")
    numbers = range(len(active))

    def ok(k: int) -> str:
        return "(" + " + ".join(f"ok_{k}_{s}" for s in SCORES) + ")"

    def count(name: str, term: Callable[[int], str]) -> str:
        return f"coalesce(sum({' + '.join(term(k) for k in numbers)}), 0L) AS {name}"

    def ok_if(k: int, condition: str) -> str:
        return f"IF({condition}, {ok(k)}, 0L)"

    seen = ", ".join(
        f"IF(sum({ok_if(k, f'row_copies > 0 AND label_{k} IS NOT NULL')}) > 0, {quoted(p)}, NULL)"
        for k, p in enumerate(active)
    )
    measures = [
        f"coalesce(sum(row_copies), 0L) * {len(active)} AS considered",
        count("failed_outcomes", lambda k: f"failed_{k}"),
        count("orphan_outcomes", lambda k: ok_if(k, "row_copies = 0")),
        count("missing_labels", lambda k: ok_if(k, f"row_copies > 0 AND label_{k} IS NULL")),
        count("paired", lambda k: ok_if(k, f"row_copies > 0 AND label_{k} IS NOT NULL")),
        count("missing_outcomes", lambda k: f"IF(row_copies > 0 AND {ok(k)} + failed_{k} = 0, 1L, 0L)"),
        f"array_sort(array_compact(array({seen}))) AS pillars_seen",
    ]
    return ledger.agg(*[F.expr(m) for m in measures])


def missing_outcomes(
    rows: DataFrame, outcomes: DataFrame, pillars: Sequence[str] | None = None
) -> DataFrame:
    """The distinct (record, pillar) pairs that no outcome covers."""
    active = list(pillars or PILLARS)
    ledger = record_ledger(rows, outcomes, pillars, how="left")
    absent = ", ".join(
        f"IF(failed_{k} + {' + '.join(f'ok_{k}_{s}' for s in SCORES)} = 0, {quoted(p)}, NULL)"
        for k, p in enumerate(active)
    )
    return ledger.selectExpr("record_id", f"explode(array_compact(array({absent}))) AS pillar")
