"""Agreement per slice of the data, one or many dimensions in one pass."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from judgespark.operators.crosstab import agreement_report, quoted
from judgespark.operators.scored import ledger_crosstab, record_ledger
from judgespark.schema import UNKNOWN_SLICE


# Reviewer name, else id.
REVIEWER = "coalesce(nullif(reviewer_name, ''), reviewer_id)"

# The standard slice keys over item attributes, and the row columns each needs.
DIMENSIONS = {
    "category": "category",
    "reviewer": REVIEWER,
    "intent": "intent",
    "topic": "topic",
    "model": "model_name",
}
DIMENSION_ATTRIBUTES = {
    "category": ("category",),
    "reviewer": ("reviewer_name", "reviewer_id"),
    "intent": ("intent",),
    "topic": ("topic",),
    "model": ("model_name",),
}


def reviewer() -> Column:
    return F.expr(REVIEWER)


def sliced_items(items: DataFrame, keys: Mapping[str, str]) -> DataFrame:
    """Items repeated once per dimension, with ``dimension`` and ``slice`` columns.

    Keys are SQL expressions over the item columns. NULL and the empty string fall into one
    unknown slice.
    """
    entries = ", ".join(
        f"struct({quoted(name)} AS dimension, coalesce(nullif({key}, ''), {quoted(UNKNOWN_SLICE)}) AS slice)"
        for name, key in keys.items()
    )
    return items.selectExpr("*", f"inline(array({entries}))")


def items_slice_crosstab(items: DataFrame, keys: Mapping[str, str]) -> DataFrame:
    """Crosstab per (dimension, slice, pillar) of scored items; any expression works as a key."""
    return (
        sliced_items(items, keys)
        .groupBy(
            "dimension",
            "slice",
            "pillar",
            F.col("judge_score").alias("judge"),
            F.col("human_score").alias("human"),
        )
        .agg(F.count(F.lit(1)).alias("n"))
    )


def slice_crosstab(
    rows: DataFrame,
    outcomes: DataFrame,
    names: Sequence[str] = tuple(DIMENSION_ATTRIBUTES),
    pillars: Sequence[str] | None = None,
) -> DataFrame:
    """Crosstab per standard dimension from rows and outcomes, all dimensions in one pass."""
    attributes = [a for name in names for a in DIMENSION_ATTRIBUTES[name]]
    ledger = record_ledger(rows, outcomes, pillars, attributes)
    spread = sliced_items(ledger, {name: DIMENSIONS[name] for name in names})
    return ledger_crosstab(spread, pillars, ["dimension", "slice"])


def sliced_report(
    ct: DataFrame,
    pillars: Sequence[str] | None = None,
    include_overall: bool = True,
) -> DataFrame:
    """Dense metrics per (dimension, slice, pillar) with the item count of each slice."""
    keys = ["dimension", "slice"]
    sizes = ct.groupBy(*keys).agg(F.sum("n").alias("slice_total_items"))
    report = agreement_report(ct, keys, pillars, include_overall)
    return report.join(sizes, keys)
