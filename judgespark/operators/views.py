"""Result filters, report tables and the relation behind each chart."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from judgespark.functions.numeric import with_rounded
from judgespark.operators.scored import label_of, outcomes_with_rows
from judgespark.operators.skew import HOT_MIN_ROWS, skew_join
from judgespark.operators.slices import reviewer
from judgespark.schema import OVERALL, PILLARS, SCORES

SEVERITIES = ("all", "exact", "within_1", "off_by_2", "off_by_3_plus")

# Chart metric name -> report column.
CHART_METRICS = {
    "exact_match": "exact_match_rate",
    "within_1": "within_1_rate",
    "severity_alignment": "severity_aware_alignment",
    "mae": "mean_absolute_error",
    "large_miss": "off_by_3_plus_rate",
}


def distance() -> Column:
    return F.abs(F.col("judge_score") - F.col("human_score"))


def severity_bucket(d: Column) -> Column:
    return F.when(d == 0, "exact").when(d == 1, "within_1").when(d == 2, "off_by_2").otherwise("off_by_3_plus")


def matches_severity(d: Column, severity: str) -> Column:
    """Filter condition of a severity; ``within_1`` as a filter also takes exact matches."""
    if severity not in SEVERITIES:
        raise ValueError(f"severity must be one of {SEVERITIES}, got {severity!r}")
    conditions = {"all": F.lit(True), "exact": d == 0, "within_1": d <= 1, "off_by_2": d == 2}
    return conditions.get(severity, d >= 3)


def filter_condition(
    pillars: Collection[str] = (),
    categories: Collection[str] = (),
    reviewers: Collection[str] = (),
    severity: str = "all",
    min_distance: int = 0,
) -> Column:
    """Conjunctive item filter; an empty collection does not restrict its dimension."""
    condition = matches_severity(distance(), severity)
    if min_distance > 0:
        condition = condition & (distance() >= min_distance)
    for key, wanted in (
        (F.col("pillar"), pillars),
        (F.col("category"), categories),
        (reviewer(), reviewers),
    ):
        if wanted:
            condition = condition & F.coalesce(key.isin(*sorted(wanted)), F.lit(False))
    return condition


def apply_filter(items: DataFrame, **restrictions) -> DataFrame:
    return items.where(filter_condition(**restrictions))


def filter_counts(items: DataFrame, **restrictions) -> DataFrame:
    """Total and matching items with the share shown."""
    counts = items.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(filter_condition(**restrictions)).alias("matching"),
    )
    return counts.withColumn(
        "share_shown", F.coalesce(F.try_divide(F.col("matching").cast("double"), F.col("total")), F.lit(0.0))
    )


def distinct_values(items: DataFrame, what: str) -> DataFrame:
    """Sorted distinct pillars, categories or reviewers (blank reviewers left out)."""
    keys = {"pillar": F.col("pillar"), "category": F.col("category"), "reviewer": reviewer()}
    if what not in keys:
        raise ValueError(f"what must be one of {sorted(keys)}, got {what!r}")
    values = items.select(keys[what].alias(what)).distinct()
    if what == "reviewer":
        values = values.where(F.coalesce(F.col(what), F.lit("")) != "")
    return values.orderBy(what)


# --- report tables ------------------------------------------------------------


def _scaled(df: DataFrame, columns: dict[str, tuple[str, float, int]]) -> DataFrame:
    """Add ``name: (source, factor, digits)`` columns, rounded like a report table."""
    return with_rounded(
        df,
        {
            name: (src if factor == 1.0 else f"{src} * {factor}D", digits)
            for name, (src, factor, digits) in columns.items()
        },
    )


_SUMMARY = {
    "exact_match_pct": ("exact_match_rate", 100.0, 2),
    "within_1_pct": ("within_1_rate", 100.0, 2),
    "off_by_2_pct": ("off_by_2_rate", 100.0, 2),
    "off_by_3_plus_pct": ("off_by_3_plus_rate", 100.0, 2),
    "mae": ("mean_absolute_error", 1.0, 3),
    "severity_alignment": ("severity_aware_alignment", 1.0, 3),
    "kappa": ("weighted_kappa", 1.0, 3),
    "spearman": ("spearman_correlation", 1.0, 3),
}
SUMMARY_COLUMNS = ("pillar", "support", *_SUMMARY)


def agreement_summary(report: DataFrame, include_overall: bool = True) -> DataFrame:
    """Display table of a report: pillars in alphabetical order, overall last."""
    shown = report if include_overall else report.where(F.col("pillar") != OVERALL)
    is_overall = (F.col("pillar") == OVERALL).cast("int")
    return _scaled(shown, _SUMMARY).orderBy(is_overall, "pillar").select(*SUMMARY_COLUMNS)


def slice_breakdown(sliced: DataFrame, pillar: str | None = None) -> DataFrame:
    """Display table per (dimension, slice, pillar), without the overall rows."""
    wanted = F.col("pillar") != OVERALL if pillar is None else F.col("pillar") == pillar
    return (
        _scaled(sliced.where(wanted), _SUMMARY)
        .orderBy("dimension", "slice", "pillar")
        .select("dimension", "slice", *SUMMARY_COLUMNS, "slice_total_items")
    )


def reviewer_summary(report: DataFrame) -> DataFrame:
    """One row per reviewer with the cross-pillar agreement."""
    columns = {
        "exact_match_pct": ("exact_match_rate", 100.0, 2),
        "within_1_pct": ("within_1_rate", 100.0, 2),
        "large_miss_pct": ("off_by_3_plus_rate", 100.0, 2),
        "severity_alignment": ("severity_aware_alignment", 1.0, 3),
    }
    overall = _scaled(report.where(F.col("pillar") == OVERALL), columns)
    return overall.select("reviewer", F.col("sample_count").alias("samples"), *columns).orderBy("reviewer")


def reviewer_pillar_table(report: DataFrame) -> DataFrame:
    columns = {
        "avg_human": ("avg_human_score", 1.0, 2),
        "avg_judge": ("avg_judge_score", 1.0, 2),
        "disagreement_pct": ("disagreement_rate", 100.0, 2),
        "within_1_pct": ("within_1_agreement", 100.0, 2),
        "large_miss_pct": ("large_miss_3_rate", 100.0, 2),
    }
    table = _scaled(report.where(F.col("pillar") != OVERALL), columns)
    return table.select("reviewer", "pillar", "support", *columns).orderBy("reviewer", "pillar")


def reviewer_pair_table(pairs: DataFrame) -> DataFrame:
    columns = {
        "exact_match_pct": ("exact_match_rate", 100.0, 2),
        "within_1_pct": ("within_1_rate", 100.0, 2),
        "large_miss_pct": ("large_miss_3_rate", 100.0, 2),
    }
    return (
        _scaled(pairs, columns)
        .select("reviewer_a", "reviewer_b", "overlap", *columns)
        .orderBy("reviewer_a", "reviewer_b")
    )


def disagreement_rows(
    rows: DataFrame,
    outcomes: DataFrame,
    items: DataFrame | None = None,
    hot_min_rows: int = HOT_MIN_ROWS,
) -> DataFrame:
    """Wide display row per successful outcome with a row; the label may be missing.

    ``items`` restricts the result to the (record, pillar) keys present in it.
    """
    known = [c.removeprefix("label_") for c in rows.columns if c.startswith("label_")]
    ok = outcomes.where("result IS NOT NULL").selectExpr(
        "outcome_index",
        "record_id",
        "pillar",
        "latency_ms",
        "coalesce(model_name, '') AS model",
        "result.score AS judge_score",
        "result.confidence AS confidence",
        "result.decision_summary AS decision_summary",
        "array_join(result.failure_tags, ',') AS failure_tags",
        "coalesce(result.why_not_higher, '') AS why_not_higher",
        "coalesce(result.why_not_lower, '') AS why_not_lower",
    )
    # Rounded on this side of the join, where rows are narrow and generated code stays small.
    ok = with_rounded(ok, {"confidence": ("confidence", 3), "latency_ms": ("latency_ms", 2)})
    if items is not None:
        keys = items.select("record_id", "pillar").distinct()
        # The keys are distinct, so the join keeps each outcome at most once.
        ok = skew_join(ok, keys, ["record_id", "pillar"], F.col("outcome_index"), min_rows=hot_min_rows)
    carried = ["category", "reviewer_name", "reviewer_id", "intent", "topic", "user_input", "agent_output"]
    joined = outcomes_with_rows(rows, ok, [*carried, *[f"label_{p}" for p in known]], hot_min_rows)
    shown = joined.withColumns({"reviewer": reviewer(), "human_score": F.expr(label_of(known))})
    return shown.select(
        "record_id",
        "pillar",
        "category",
        "reviewer",
        "intent",
        "topic",
        "judge_score",
        "human_score",
        distance().alias("distance"),
        "confidence",
        "decision_summary",
        "failure_tags",
        "why_not_higher",
        "why_not_lower",
        "user_input",
        "agent_output",
        "latency_ms",
        "model",
    )


# --- chart relations ----------------------------------------------------------


def chart_metric(name: str) -> Column:
    if name not in CHART_METRICS:
        raise ValueError(f"unknown metric {name!r}, expected one of {sorted(CHART_METRICS)}")
    return F.col(CHART_METRICS[name])


def pillar_metric_rows(report: DataFrame) -> DataFrame:
    """Supported pillars with every chart metric."""
    supported = report.where((F.col("pillar") != OVERALL) & (F.col("support") > 0))
    return supported.select("pillar", "support", *[F.col(c).alias(n) for n, c in CHART_METRICS.items()])


def slice_heatmap(sliced: DataFrame, metric: str = "severity_alignment") -> DataFrame:
    return sliced.where(F.col("pillar") != OVERALL).select(
        "dimension", "slice", "pillar", chart_metric(metric).alias("value"), "support"
    )


def large_miss_by_slice(sliced: DataFrame, pillar: str | None = None) -> DataFrame:
    """Off-by-3+ rate per slice: of one pillar, or the plain mean over supported pillars."""
    supported = sliced.where((F.col("pillar") != OVERALL) & (F.col("support") > 0))
    if pillar is not None:
        return supported.where(F.col("pillar") == pillar).select(
            "dimension", "slice", F.col("off_by_3_plus_rate").alias("large_miss_rate"), "support"
        )
    # Summed in pillar order, so the double result does not depend on row arrival.
    rates = [
        F.coalesce(F.max(F.when(F.col("pillar") == p, F.col("off_by_3_plus_rate"))), F.lit(0.0))
        for p in PILLARS
    ]
    total = rates[0]
    for r in rates[1:]:
        total = total + r
    others = F.coalesce(
        F.sum(F.when(~F.col("pillar").isin(*PILLARS), F.col("off_by_3_plus_rate"))), F.lit(0.0)
    )
    return supported.groupBy("dimension", "slice").agg(
        ((total + others) / F.count(F.lit(1))).alias("large_miss_rate"), F.sum("support").alias("support")
    )


def reviewer_exact_match(report: DataFrame, pillar: str | None = None) -> DataFrame:
    """Exact-match rate per reviewer, overall or for one pillar."""
    shown = report.where((F.col("pillar") == (pillar or OVERALL)) & (F.col("support") > 0))
    rate = F.col("exact_match_rate") if pillar is None else 1.0 - F.col("disagreement_rate")
    return shown.select("reviewer", rate.alias("exact_match_rate"), "support")


def residual_histogram(ct: DataFrame) -> DataFrame:
    return ct.groupBy("pillar", (F.col("judge") - F.col("human")).alias("residual")).agg(
        F.sum("n").alias("count")
    )


def score_points(ct: DataFrame) -> DataFrame:
    """Points of the human-versus-judge plot with their item count."""
    return ct.groupBy("pillar", "judge", "human").agg(F.sum("n").alias("count"))


def fit_line(diagnostics: DataFrame) -> DataFrame:
    """End points of the regression line per pillar that has one."""
    ends = [
        F.struct(
            F.lit(float(x)).alias("x"),
            (F.col("ols_intercept") + F.col("ols_slope") * float(x)).alias("y"),
        )
        for x in (SCORES[0], SCORES[-1])
    ]
    return diagnostics.where(F.col("ols_slope").isNotNull()).select("pillar", F.inline(F.array(*ends)))


def pillar_overview(diagnostics: DataFrame) -> DataFrame:
    return diagnostics.select(
        "pillar", "mean_residual", F.coalesce("ols_r2", F.lit(0.0)).alias("r_squared")
    ).orderBy("pillar")
