"""Reviewer analytics: grader against each reviewer, and reviewers against each other."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from judgespark.functions.numeric import ratio
from judgespark.operators.crosstab import agreement_report, cell_counts, quoted, with_metrics
from judgespark.operators.scored import ledger_crosstab, record_ledger
from judgespark.operators.skew import HOT_MIN_ROWS, skew_join
from judgespark.operators.slices import REVIEWER, reviewer
from judgespark.schema import OVERALL, PILLARS


def has_reviewer_signal(items: DataFrame) -> DataFrame:
    """One row: does any item name a reviewer?"""
    return items.agg(
        F.coalesce(F.bool_or(reviewer().isNotNull()), F.lit(False)).alias("has_reviewer_signal")
    )


def reviewer_crosstab(
    rows: DataFrame, outcomes: DataFrame, pillars: Sequence[str] | None = None
) -> DataFrame:
    """Crosstab per (reviewer, pillar); records without a reviewer are left out."""
    ledger = record_ledger(rows, outcomes, pillars, ["reviewer_name", "reviewer_id"])
    named = ledger.withColumn("reviewer", reviewer()).where(F.col("reviewer").isNotNull())
    return ledger_crosstab(named, pillars, ["reviewer"])


def reviewer_report(
    ct: DataFrame, pillars: Sequence[str] | None = None
) -> DataFrame:
    """Dense agreement per reviewer with ``sample_count`` and the reviewer-only rates."""
    sizes = ct.groupBy("reviewer").agg(F.sum("n").alias("sample_count"))
    report = agreement_report(ct, ["reviewer"], pillars, include_overall=True)
    empty = F.col("support") == 0
    return report.join(sizes, "reviewer").withColumns(
        {
            "disagreement_rate": F.when(empty, 0.0).otherwise(1.0 - F.col("exact_match_rate")),
            "within_1_agreement": F.col("within_1_rate"),
            "large_miss_3_rate": F.col("off_by_3_plus_rate"),
        }
    )


def reviewer_pillars(report: DataFrame) -> DataFrame:
    """The per-pillar part of ``reviewer_report``."""
    return report.where(F.col("pillar") != OVERALL)


def reviews_from_items(items: DataFrame) -> DataFrame:
    """Long reviews ``(review_index, record_id, pillar, reviewer, human_score)`` of scored items."""
    return items.select(
        F.col("outcome_index").alias("review_index"),
        "record_id",
        "pillar",
        reviewer().alias("reviewer"),
        "human_score",
    )


def reviews_from_rows(rows: DataFrame, pillars: Sequence[str] = PILLARS) -> DataFrame:
    """Long reviews of all rows, keeping several rows per record (multi-review data)."""
    entries = ", ".join(f"struct({quoted(p)} AS pillar, label_{p} AS human_score)" for p in pillars)
    return rows.selectExpr(
        "row_index AS review_index", "record_id", f"{REVIEWER} AS reviewer", f"inline(array({entries}))"
    ).where("human_score IS NOT NULL")


def reviewer_overlaps(reviews: DataFrame, hot_min_rows: int = HOT_MIN_ROWS) -> DataFrame:
    """``(reviewer_a, reviewer_b, distance, n)`` over items both reviewers scored, a < b.

    A reviewer's last score per item wins. Items with very many reviewers are spread over salted
    pieces of the self-join, and the pair rows are counted map-side right behind the join.
    """
    latest = (
        reviews.where(F.col("reviewer").isNotNull())
        .groupBy("record_id", "pillar", "reviewer")
        .agg(F.max_by("human_score", "review_index").alias("score"))
    )
    keys = ["record_id", "pillar"]
    first = latest.select(*keys, F.col("reviewer").alias("reviewer_a"), F.col("score").alias("score_a"))
    second = latest.select(*keys, F.col("reviewer").alias("reviewer_b"), F.col("score").alias("score_b"))
    pairs = skew_join(first, second, keys, F.col("reviewer_a"), min_rows=hot_min_rows)
    return (
        pairs.where(F.col("reviewer_a") < F.col("reviewer_b"))
        .groupBy("reviewer_a", "reviewer_b", F.abs(F.col("score_a") - F.col("score_b")).alias("distance"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def reviewer_pairs(reviews: DataFrame, hot_min_rows: int = HOT_MIN_ROWS) -> DataFrame:
    """Agreement of each reviewer pair on the items both scored."""
    n, d = F.col("n"), F.col("distance")
    sums = reviewer_overlaps(reviews, hot_min_rows).groupBy("reviewer_a", "reviewer_b").agg(
        F.sum(n).alias("overlap"),
        F.sum(F.when(d == 0, n).otherwise(0)).alias("exact"),
        F.sum(F.when(d <= 1, n).otherwise(0)).alias("close"),
        F.sum(F.when(d >= 3, n).otherwise(0)).alias("far"),
    )
    return sums.select(
        "reviewer_a",
        "reviewer_b",
        "overlap",
        ratio(F.col("exact"), F.col("overlap")).alias("exact_match_rate"),
        ratio(F.col("close"), F.col("overlap")).alias("within_1_rate"),
        ratio(F.col("far"), F.col("overlap")).alias("large_miss_3_rate"),
    )


PAIR_BLOCK = 256  # reviewers of one item that meet in one piece
MIN_OVERLAP = 20


def reviewer_pair_crosstab(
    reviews: DataFrame, min_overlap: int = MIN_OVERLAP, block: int = PAIR_BLOCK, hot_min_rows: int = HOT_MIN_ROWS
) -> DataFrame:
    """``(reviewer_a, reviewer_b, pillar, judge, human, n)`` over items both reviewers scored, a < b.

    ``judge`` is the score of ``a`` and ``human`` that of ``b``, so that all metrics of a crosstab apply. A
    reviewer's last score per item wins. Reviewers with fewer than ``min_overlap`` items of a pillar can
    be in no pair with that overlap and are left out before any pairing. The reviewers of an item with more
    than ``block`` are dealt to blocks, and each two blocks meet in a piece of their own, so a piece
    holds some two blocks of rows however many reviewers an item has.
    """
    latest = (
        reviews.where(F.col("reviewer").isNotNull() & F.col("human_score").isNotNull())
        .groupBy("record_id", "pillar", "reviewer")
        .agg(F.max_by("human_score", "review_index").alias("score"))
    )
    if min_overlap > 1:
        busy = latest.groupBy("reviewer", "pillar").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_overlap)
        latest = skew_join(latest, busy.drop("_n"), ["reviewer", "pillar"], F.col("record_id"), min_rows=hot_min_rows)
    item = ["record_id", "pillar"]
    sizes = latest.groupBy(*item).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    blocks = sizes.select(*item, F.ceil(F.col("_n") / block).cast("int").alias("_blocks"))
    dealt = skew_join(latest, blocks, item, F.col("reviewer"), min_rows=hot_min_rows)
    dealt = dealt.withColumn("_own", F.pmod(F.xxhash64("reviewer"), F.col("_blocks").cast("long")).cast("int"))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    low, high = F.least("_own", "_other").alias("_low"), F.greatest("_own", "_other").alias("_high")
    piece = [*item, "_low", "_high"]
    dealt = dealt.select(*item, low, high, "_own", "reviewer", "score")
    first = dealt.select(*piece, F.col("_own").alias("_a"), F.col("reviewer").alias("reviewer_a"), F.col("score").alias("judge"))
    second = dealt.select(*piece, F.col("_own").alias("_b"), F.col("reviewer").alias("reviewer_b"), F.col("score").alias("human"))
    met = first.join(second, piece).where("reviewer_a < reviewer_b AND (_low = _high OR _a <> _b)")
    return met.groupBy("reviewer_a", "reviewer_b", "pillar", "judge", "human").agg(F.count(F.lit(1)).alias("n"))


def reviewer_pair_report(ct: DataFrame, min_overlap: int = MIN_OVERLAP) -> DataFrame:
    """Agreement of each pair of reviewers on each pillar with at least ``min_overlap`` items of both."""
    keys = ["reviewer_a", "reviewer_b", "pillar"]
    cells = cell_counts(ct, keys).where(F.col("support") >= min_overlap)
    return with_metrics(cells).select(
        *keys,
        F.col("support").alias("overlap"),
        "exact_match_rate",
        "within_1_rate",
        "mean_absolute_error",
        "weighted_kappa",
        "severity_aware_alignment",
        F.col("avg_judge_score").alias("avg_score_a"),
        F.col("avg_human_score").alias("avg_score_b"),
    )


def reviewer_matrix(report: DataFrame, metric: str = "exact_match_rate") -> DataFrame:
    """``(pillar, reviewer, other, overlap, value, disagreement_rate)``: every pair of the report in both directions."""
    cells = ", ".join(
        f"struct({a} AS reviewer, {b} AS other)" for a, b in (("reviewer_a", "reviewer_b"), ("reviewer_b", "reviewer_a"))
    )
    return report.selectExpr(
        "pillar", f"inline(array({cells}))", "overlap", f"{metric} AS value", "1D - exact_match_rate AS disagreement_rate"
    )
