"""Counts of (judge, human) score pairs per group, and every ordinal metric derived from them.

All metrics depend on the items only through the crosstab ``(keys, judge, human, n)``, which has
at most 25 rows per group. One partial aggregation and one small shuffle build it; everything
after that works on the small table, with integer counts up to a last division, so results do not
depend on how the data was partitioned.

The wide expressions (25 cells, five marginals per side) are generated as SQL text: building them
node by node from Python costs seconds per query.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from judgespark.schema import DISTANCE_WEIGHTS, OVERALL, PILLARS, SCORES

RATE_COLUMNS = (
    "exact_match_rate",
    "within_1_rate",
    "off_by_2_rate",
    "off_by_3_plus_rate",
    "mean_absolute_error",
    "severity_aware_alignment",
)
METRIC_COLUMNS = (*RATE_COLUMNS, "weighted_kappa", "spearman_correlation")
_PAIRS = [(j, h) for j in SCORES for h in SCORES]


def quoted(name: str) -> str:
    """A string literal in SQL text."""
    escaped = name.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def crosstab(items: DataFrame, keys: Sequence[str] = ("pillar",)) -> DataFrame:
    """``(keys, judge, human, n)`` from scored items."""
    return items.groupBy(
        *keys, F.col("judge_score").alias("judge"), F.col("human_score").alias("human")
    ).agg(F.count(F.lit(1)).alias("n"))


def cell_counts(ct: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per group: distance buckets, marginals and the 25 cell counts.

    Cells clamp scores to the scale; distances and marginals use the scores as given.
    """
    low, high = SCORES[0], SCORES[-1]

    def weight(name: str, condition: str) -> str:
        return f"coalesce(sum(CASE WHEN {condition} THEN n END), 0L) AS {name}"

    def clamped(side: str) -> str:
        return f"greatest({low}, least({high}, {side}))"

    measures = ["coalesce(sum(n), 0L) AS support"]
    measures += [weight(f"d{d}", f"abs(judge - human) = {d}") for d in range(5)]
    measures += [
        weight("d3_plus", "abs(judge - human) >= 3"),
        "coalesce(sum(n * abs(judge - human)), 0L) AS abs_sum",
        "coalesce(sum(n * judge), 0L) AS judge_sum",
        "coalesce(sum(n * human), 0L) AS human_sum",
        weight("judge_above", "judge > human"),
    ]
    measures += [weight(f"{side[0]}{s}", f"{side} = {s}") for side in ("judge", "human") for s in SCORES]
    measures += [
        weight(f"c{j}{h}", f"{clamped('judge')} = {j} AND {clamped('human')} = {h}") for j, h in _PAIRS
    ]
    return ct.groupBy(*keys).agg(*[F.expr(m) for m in measures])


def weighted_alignment(weights: Mapping[int, float] = DISTANCE_WEIGHTS) -> str:
    """Mean weight by distance; distances without a weight count as zero."""
    terms = [f"double(d{d}) * {float(w)!r}D" for d, w in sorted(weights.items()) if 0 <= d < 5]
    return f"coalesce(try_divide({' + '.join(terms) or '0D'}, double(support)), 0D)"


def kappa(weights: str = "quadratic") -> str:
    """Cohen's weighted kappa over the cell columns.

    NULL below two pairs or without expected disagreement. Products of counts are formed as
    doubles because they leave the BIGINT range near a billion items.
    """
    if weights not in ("linear", "quadratic"):
        raise ValueError(f"weights must be 'linear' or 'quadratic', got {weights!r}")
    power = 2 if weights == "quadratic" else 1
    unequal = [(j, h, abs(j - h) ** power) for j, h in _PAIRS if j != h]
    observed = " + ".join(f"c{j}{h} * {w}" for j, h, w in unequal)
    expected = " + ".join(f"double(mj{j}) * double(mh{h}) * {w}D" for j, h, w in unequal)
    ratio = f"try_divide(double({observed}) * double(support), {expected})"
    return f"CASE WHEN support >= 2 THEN 1D - {ratio} END"


def spearman() -> str:
    """Rank correlation with average ranks for ties; NULL when a side is constant.

    ``r`` columns hold twice the average rank minus its mean, an integer.
    """
    product = " + ".join(f"double(c{j}{h}) * rj{j} * rh{h}" for j, h in _PAIRS)
    judge = " + ".join(f"double(mj{s}) * rj{s} * rj{s}" for s in SCORES)
    human = " + ".join(f"double(mh{s}) * rh{s} * rh{s}" for s in SCORES)
    return f"CASE WHEN support >= 2 THEN try_divide({product}, sqrt(({judge}) * ({human}))) END"


def _centered_rank(side: str, s: int) -> str:
    """Items below score ``s`` minus items above it."""
    below = " + ".join(["0L", *[f"m{side}{v}" for v in SCORES if v < s]])
    above = " + ".join(["0L", *[f"m{side}{v}" for v in SCORES if v > s]])
    return f"double(({below}) - ({above})) AS r{side}{s}"


def with_metrics(
    cells: DataFrame,
    weights: Mapping[int, float] = DISTANCE_WEIGHTS,
    kappa_weights: str = "quadratic",
) -> DataFrame:
    """Add the metric columns to ``cell_counts`` output."""

    def rate(numerator: str, name: str) -> str:
        return f"coalesce(try_divide(double({numerator}), double(support)), 0D) AS {name}"

    marginals = [" + ".join(f"c{j}{h}" for h in SCORES) + f" AS mj{j}" for j in SCORES]
    marginals += [" + ".join(f"c{j}{h}" for j in SCORES) + f" AS mh{h}" for h in SCORES]
    ranks = [_centered_rank(side, s) for side in "jh" for s in SCORES]
    return (
        cells.selectExpr("*", *marginals)
        .selectExpr("*", *ranks)
        .selectExpr(
            "*",
            rate("d0", "exact_match_rate"),
            rate("d0 + d1", "within_1_rate"),
            rate("d2", "off_by_2_rate"),
            rate("d3_plus", "off_by_3_plus_rate"),
            rate("abs_sum", "mean_absolute_error"),
            f"{weighted_alignment(weights)} AS severity_aware_alignment",
            f"{kappa(kappa_weights)} AS weighted_kappa",
            f"{spearman()} AS spearman_correlation",
            rate("judge_sum", "avg_judge_score"),
            rate("human_sum", "avg_human_score"),
        )
    )


def score_distribution(side: str) -> str:
    """Dense counts for scores 1..5, out-of-range scores counted at the nearest edge."""
    return "array(" + ", ".join(f"m{side[0]}{s}" for s in SCORES) + ")"


def confusion_matrix() -> str:
    """Nested 5x5 array: row = human score, column = judge score."""
    lines = ["array(" + ", ".join(f"c{j}{h}" for j in SCORES) + ")" for h in SCORES]
    return "array(" + ", ".join(lines) + ")"


def dense_labels(
    ct: DataFrame,
    keys: Sequence[str],
    pillars: Sequence[str] | None,
    include_overall: bool,
) -> DataFrame:
    """Relabel crosstab rows so each group carries every requested pillar and the overall label.

    Each row contributes its count to its own pillar and to the overall label, and zero to the
    other requested pillars. One aggregation then yields a dense report without a grid join.
    """
    names = list(PILLARS if pillars is None else pillars)
    entries = [
        f"struct({quoted(p)} AS label, CASE WHEN pillar = {quoted(p)} THEN n ELSE 0L END AS m)" for p in names
    ]
    if include_overall:
        names.append(OVERALL)
        entries.append(f"struct({quoted(OVERALL)} AS label, n AS m)")
    if not entries:
        return ct.where("false").withColumn("label", F.col("pillar")).drop("pillar")
    spread = ct.selectExpr(*keys, "judge", "human", f"inline(array({', '.join(entries)}))").selectExpr(
        *keys, "label", "judge", "human", "m AS n"
    )
    if keys:
        return spread
    labels = f"explode(array({', '.join(quoted(n) for n in names)})) AS label"
    zeros = ct.sparkSession.range(1).selectExpr(labels, "1 AS judge", "1 AS human", "0L AS n")
    return spread.where("n > 0").unionByName(zeros)


def agreement_report(
    ct: DataFrame,
    keys: Sequence[str] = (),
    pillars: Sequence[str] | None = None,
    include_overall: bool = True,
    weights: Mapping[int, float] = DISTANCE_WEIGHTS,
    kappa_weights: str = "quadratic",
) -> DataFrame:
    """Metrics per group and pillar, dense over ``pillars``, plus an overall row.

    ``None`` means the six standard pillars and an empty list means none. The overall row covers
    all items of the group, also those on pillars that were not requested.
    """
    labelled = dense_labels(ct, keys, pillars, include_overall)
    cells = cell_counts(labelled, [*keys, "label"])
    return with_metrics(cells, weights, kappa_weights).withColumnRenamed("label", "pillar")


def single_report(ct: DataFrame, weights: Mapping[int, float] = DISTANCE_WEIGHTS) -> DataFrame:
    """Metrics of all items as one group; one row also for empty input."""
    return with_metrics(cell_counts(ct, []), weights)


def confusion_cells(report: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Long 25-row grid per group: ``(keys, human, judge, count)``."""
    cells = [f"struct({h} AS human, {j} AS judge, c{j}{h} AS count)" for j, h in _PAIRS]
    return report.selectExpr(*keys, f"inline(array({', '.join(cells)}))")


def distribution_rows(report: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Long score counts: ``(keys, score, source, count)``."""
    rows = [
        f"struct({s} AS score, '{source}' AS source, m{source[0]}{s} AS count)"
        for s in SCORES
        for source in ("judge", "human")
    ]
    return report.selectExpr(*keys, f"inline(array({', '.join(rows)}))")
