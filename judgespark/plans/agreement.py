"""Queries: joins, ordinal metrics, slices, reviewers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from judgespark.operators import crosstab, reviewers, scored, slices
from judgespark.plans import inputs
from judgespark.plans import sqltext as q
from judgespark.plans.registry import query
from judgespark.plans.scratch import shared_folder
from judgespark.schema import OVERALL, PILLARS, SCORES
from judgespark.sources.slice_store import SliceStore

ITEM_COLUMNS = (
    "outcome_index, record_id, pillar, judge_score, human_score, category, reviewer_name, reviewer_id, intent, topic,"
    " conversation_id, model_name"
)


def base(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return inputs.eval_rows(spark, sf_dir), inputs.outcomes(spark, sf_dir)


def items_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored.scored_items(*base(spark, sf_dir))


def crosstab_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored.agreement_crosstab(*base(spark, sf_dir))


def report_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosstab.agreement_report(crosstab_of(spark, sf_dir))


def sliced_of(spark: SparkSession, sf_dir: str, names=tuple(slices.DIMENSION_ATTRIBUTES)) -> DataFrame:
    return slices.sliced_report(slices.slice_crosstab(*base(spark, sf_dir), names))


def reviewer_report_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviewers.reviewer_report(reviewers.reviewer_crosstab(*base(spark, sf_dir)))


# --- joins --------------------------------------------------------------------


@query(
    "j1_labels_long",
    q.with_ctes(
        " UNION ALL ".join(
            f"SELECT row_index, record_id, '{p}' AS pillar, label_{p} AS human_score FROM eval_rows" for p in PILLARS
        ),
        "eval_rows",
    ),
)
def labels_long(spark, sf_dir):
    return scored.labels_long(inputs.eval_rows(spark, sf_dir))


@query("j2_scored_items", q.with_ctes(f"SELECT {ITEM_COLUMNS} FROM items", "items"))
def scored_items(spark, sf_dir):
    return items_of(spark, sf_dir)


@query(
    "j2_scored_items_hot_records",
    q.with_ctes(f"SELECT {ITEM_COLUMNS} FROM items", "items"),
)
def scored_items_hot(spark, sf_dir):
    """Same join with the hot-record limit low enough that records get salted."""
    return scored.scored_items(*base(spark, sf_dir), hot_min_rows=2)


@query(
    "j3_join_accounting",
    q.with_ctes(
        f"""SELECT (SELECT count(*) FROM eval_rows) * {len(PILLARS)} AS considered,
  count(*) FILTER (WHERE o.failed) AS failed_outcomes,
  count(*) FILTER (WHERE NOT o.failed AND r.record_id IS NULL) AS orphan_outcomes,
  count(*) FILTER (WHERE NOT o.failed AND r.record_id IS NOT NULL AND l.human_score IS NULL) AS missing_labels,
  count(*) FILTER (WHERE NOT o.failed AND l.human_score IS NOT NULL) AS paired,
  (SELECT count(*) FROM (SELECT record_id, pillar FROM labels_long EXCEPT SELECT record_id, pillar FROM outcomes))
    AS missing_outcomes,
  string_agg(DISTINCT CASE WHEN NOT o.failed AND l.human_score IS NOT NULL THEN o.pillar END, ',' ORDER BY
    CASE WHEN NOT o.failed AND l.human_score IS NOT NULL THEN o.pillar END) AS pillars_seen
FROM outcomes o LEFT JOIN latest r ON r.record_id = o.record_id
LEFT JOIN labels_long l ON l.record_id = o.record_id AND l.pillar = o.pillar
WHERE o.pillar <> 'tone'""",
        "eval_rows",
        "outcomes",
        "latest",
        "labels_long",
    ),
)
def join_accounting(spark, sf_dir):
    stats = scored.join_accounting(*base(spark, sf_dir))
    return stats.withColumn("pillars_seen", F.array_join("pillars_seen", ","))


@query(
    "j4_missing_outcomes",
    q.with_ctes(
        "SELECT record_id, pillar FROM labels_long EXCEPT SELECT record_id, pillar FROM outcomes",
        "labels_long",
        "outcomes",
    ),
)
def missing_outcomes(spark, sf_dir):
    return scored.missing_outcomes(*base(spark, sf_dir))


# --- ordinal metrics ----------------------------------------------------------


@query(
    "m0_crosstab",
    q.with_ctes(
        "SELECT pillar, judge_score AS judge, human_score AS human, count(*) AS n FROM items GROUP BY ALL", "items"
    ),
)
def crosstab_query(spark, sf_dir):
    return crosstab_of(spark, sf_dir)


def _metric_query(name: str, metric: str) -> None:
    @query(name, q.with_ctes(f"SELECT pillar, support, {metric} FROM report", "report"))
    def run(spark, sf_dir):
        return report_of(spark, sf_dir).select("pillar", "support", metric)


for _name, _metric in {
    "m1_exact_match_rate": "exact_match_rate",
    "m2_within_1_rate": "within_1_rate",
    "m3_off_by_2_rate": "off_by_2_rate",
    "m4_off_by_3_plus_rate": "off_by_3_plus_rate",
    "m5_mean_absolute_error": "mean_absolute_error",
    "m6_severity_alignment": "severity_aware_alignment",
    "m9_weighted_kappa": "weighted_kappa",
    "m10_spearman": "spearman_correlation",
}.items():
    _metric_query(_name, _metric)

# A user's own weight map, with a distance left out on purpose.
CUSTOM_WEIGHTS = {0: 1.0, 1: 0.5, 3: 0.25}


@query(
    "u6_custom_weights",
    q.with_ctes(f"SELECT pillar, support, {q.alignment(CUSTOM_WEIGHTS)} AS alignment FROM report", "report"),
)
def custom_weights(spark, sf_dir):
    report = crosstab.agreement_report(crosstab_of(spark, sf_dir), weights=CUSTOM_WEIGHTS)
    return report.select("pillar", "support", F.col("severity_aware_alignment").alias("alignment"))


@query(
    "m7_score_distribution",
    q.with_ctes(
        " UNION ALL ".join(
            f"SELECT pillar, {s} AS score, '{side}' AS source, {side[0]}{s} AS count FROM report"
            for s in SCORES
            for side in ("judge", "human")
        ),
        "report",
    ),
)
def score_distribution(spark, sf_dir):
    return crosstab.distribution_rows(report_of(spark, sf_dir), ["pillar"])


_CELLS = " UNION ALL ".join(
    f"SELECT pillar, {h} AS human, {j} AS judge, c{j}{h} AS count FROM report" for h in SCORES for j in SCORES
)


@query("m8_confusion_matrix", q.with_ctes(_CELLS, "report"))
def confusion_matrix(spark, sf_dir):
    return crosstab.confusion_cells(report_of(spark, sf_dir), ["pillar"])


@query(
    "m9_linear_kappa",
    q.with_ctes(f"SELECT pillar, support, {q.kappa(1)} AS weighted_kappa FROM report", "report"),
)
def linear_kappa(spark, sf_dir):
    report = crosstab.agreement_report(crosstab_of(spark, sf_dir), kappa_weights="linear")
    return report.select("pillar", "support", "weighted_kappa")


@query(
    "m11_average_scores",
    q.with_ctes("SELECT pillar, support, avg_judge_score, avg_human_score FROM report", "report"),
)
def average_scores(spark, sf_dir):
    return report_of(spark, sf_dir).select("pillar", "support", "avg_judge_score", "avg_human_score")


_REPORT_COLUMNS = ("pillar", "support", *crosstab.METRIC_COLUMNS)


@query(
    "a1_agreement_report",
    q.with_ctes(f"SELECT {', '.join(_REPORT_COLUMNS)} FROM report WHERE pillar <> '{OVERALL}'", "report"),
)
def agreement_report(spark, sf_dir):
    report = crosstab.agreement_report(crosstab_of(spark, sf_dir), include_overall=False)
    return report.select(*_REPORT_COLUMNS)


# Two requested pillars, one of them without a single item: both must appear, and the overall row
# must still cover every pillar.
SUBSET = ("relevance", "politeness")


@query(
    "a2_agreement_overall",
    q.with_ctes(
        f"SELECT {', '.join(_REPORT_COLUMNS)} FROM ({q.report('items', (), SUBSET)})", "items"
    ),
)
def agreement_overall(spark, sf_dir):
    report = crosstab.agreement_report(crosstab_of(spark, sf_dir), pillars=SUBSET)
    return report.select(*_REPORT_COLUMNS)


@query(
    "a3_for_pillar",
    q.with_ctes(f"SELECT {ITEM_COLUMNS} FROM items WHERE pillar = 'toxicity'", "items"),
)
def for_pillar(spark, sf_dir):
    return scored.for_pillar(items_of(spark, sf_dir), "toxicity")


# --- slices -------------------------------------------------------------------

_SLICED_COLUMNS = ("dimension", "slice", *_REPORT_COLUMNS, "slice_total_items")


def _sliced_sql(where: str = "TRUE") -> str:
    return q.with_ctes(
        f"SELECT {', '.join(_SLICED_COLUMNS)} FROM sliced JOIN slice_sizes USING (dimension, slice) WHERE {where}",
        "sliced",
        "slice_sizes",
    )


@query(
    "l1_slice_counts",
    q.with_ctes("SELECT dimension, slice, slice_total_items FROM slice_sizes", "slice_sizes"),
)
def slice_counts(spark, sf_dir):
    ct = slices.slice_crosstab(*base(spark, sf_dir))
    return ct.groupBy("dimension", "slice").agg(F.sum("n").alias("slice_total_items"))


def _slice_query(name: str, dimension: str) -> None:
    @query(name, _sliced_sql(f"dimension = '{dimension}'"))
    def run(spark, sf_dir):
        return sliced_of(spark, sf_dir, [dimension]).select(*_SLICED_COLUMNS)


for _name, _dimension in {
    "l2_by_category": "category",
    "l3_by_reviewer": "reviewer",
    "l4_by_intent": "intent",
    "l4_by_topic": "topic",
    "l4_by_model": "model",
}.items():
    _slice_query(_name, _dimension)


@query("l5_sliced_report", _sliced_sql(f"dimension = 'category' AND pillar <> '{OVERALL}'"))
def sliced_report(spark, sf_dir):
    ct = slices.slice_crosstab(*base(spark, sf_dir), ["category"])
    return slices.sliced_report(ct, include_overall=False).select(*_SLICED_COLUMNS)


@query("l6_all_dimensions", _sliced_sql())
def all_dimensions(spark, sf_dir):
    return sliced_of(spark, sf_dir).select(*_SLICED_COLUMNS)


@query("l6_all_dimensions_kept", _sliced_sql())
def all_dimensions_kept(spark, sf_dir):
    """The same from changes: a base and three more, the rows and outcomes of a record in different ones."""
    rows, outcomes = base(spark, sf_dir)
    store = SliceStore(spark, shared_folder(spark), buckets=16)
    for change in range(1, 5):
        mine = rows.where(F.pmod(F.xxhash64("row_index"), F.lit(4)) == change - 1)
        store.apply(change, mine, outcomes.where(F.pmod(F.xxhash64("outcome_index"), F.lit(4)) == change - 1))
        if change == 2:
            store.compact()
    return store.report(4).select(*_SLICED_COLUMNS)


q.define(
    "by_outcome",
    ["items"],
    "SELECT 'customer_group' AS dimension,"
    " CASE WHEN topic IS NULL THEN '__unknown__' ELSE topic || '/' || category END AS slice, pillar, judge_score,"
    " human_score FROM items",
)


@query(
    "u5_custom_selector",
    q.with_ctes(
        f"SELECT dimension, slice, {', '.join(_REPORT_COLUMNS)} FROM ({q.report('by_outcome', ('dimension', 'slice'))})",
        "by_outcome",
    ),
)
def custom_selector(spark, sf_dir):
    """Any expression over the item columns works as a slice key."""
    keys = {"customer_group": "concat(topic, '/', category)"}
    ct = slices.items_slice_crosstab(items_of(spark, sf_dir), keys)
    return slices.sliced_report(ct).select("dimension", "slice", *_REPORT_COLUMNS)


# --- reviewers ----------------------------------------------------------------


@query(
    "r1_reviewer_signal",
    q.with_ctes("SELECT count(reviewer) > 0 AS has_reviewer_signal FROM items", "items"),
)
def reviewer_signal(spark, sf_dir):
    return reviewers.has_reviewer_signal(items_of(spark, sf_dir))


q.define("reviewer_sizes", ["reviewed"], "SELECT reviewer, count(*) AS sample_count FROM reviewed GROUP BY reviewer")


@query(
    "r2_reviewer_report",
    q.with_ctes(
        f"SELECT reviewer, {', '.join(_REPORT_COLUMNS)}, sample_count FROM by_reviewer JOIN reviewer_sizes"
        " USING (reviewer)",
        "by_reviewer",
        "reviewer_sizes",
    ),
)
def reviewer_report(spark, sf_dir):
    return reviewer_report_of(spark, sf_dir).select("reviewer", *_REPORT_COLUMNS, "sample_count")


_R3 = (
    "reviewer, pillar, support, avg_human_score, avg_judge_score,"
    " CASE WHEN support = 0 THEN 0::DOUBLE ELSE 1::DOUBLE - exact_match_rate END AS disagreement_rate,"
    " within_1_rate AS within_1_agreement, off_by_3_plus_rate AS large_miss_3_rate"
)
q.define("reviewer_pillars", ["by_reviewer"], f"SELECT {_R3} FROM by_reviewer WHERE pillar <> '{OVERALL}'")


@query("r3_reviewer_pillars", q.with_ctes("SELECT * FROM reviewer_pillars", "reviewer_pillars"))
def reviewer_pillars(spark, sf_dir):
    return reviewers.reviewer_pillars(reviewer_report_of(spark, sf_dir)).select(
        "reviewer",
        "pillar",
        "support",
        "avg_human_score",
        "avg_judge_score",
        "disagreement_rate",
        "within_1_agreement",
        "large_miss_3_rate",
    )


def reviews_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multi-review table: several orders of one customer group count as reviews of one record.

    Orders whose keys share the integer part of key / 4 review the same record.
    """
    rows = inputs.eval_rows(spark, sf_dir).withColumn(
        "record_id", F.floor(F.col("row_index") / 4).cast("string")
    )
    return reviewers.reviews_from_rows(rows)


q.define(
    "reviews",
    ["eval_rows"],
    " UNION ALL ".join(
        "SELECT row_index AS review_index, CAST(row_index // 4 AS VARCHAR) AS record_id,"
        f" coalesce(nullif(reviewer_name, ''), reviewer_id) AS reviewer, '{p}' AS pillar, label_{p} AS human_score"
        f" FROM eval_rows WHERE label_{p} IS NOT NULL"
        for p in PILLARS
    ),
)
q.define(
    "last_reviews",
    ["reviews"],
    "SELECT record_id, pillar, reviewer, arg_max(human_score, review_index) AS score FROM reviews"
    " WHERE reviewer IS NOT NULL GROUP BY ALL",
)
q.define(
    "review_pairs",
    ["last_reviews"],
    "SELECT a.reviewer AS reviewer_a, b.reviewer AS reviewer_b, abs(a.score - b.score) AS distance"
    " FROM last_reviews a JOIN last_reviews b ON a.record_id = b.record_id AND a.pillar = b.pillar"
    " AND a.reviewer < b.reviewer",
)
q.define(
    "pair_stats",
    ["review_pairs"],
    "SELECT reviewer_a, reviewer_b, count(*) AS overlap,"
    " (count(*) FILTER (WHERE distance = 0))::DOUBLE / count(*) AS exact_match_rate,"
    " (count(*) FILTER (WHERE distance <= 1))::DOUBLE / count(*) AS within_1_rate,"
    " (count(*) FILTER (WHERE distance >= 3))::DOUBLE / count(*) AS large_miss_3_rate"
    " FROM review_pairs GROUP BY ALL",
)


@query(
    "j6_reviewer_overlaps",
    q.with_ctes(
        "SELECT reviewer_a, reviewer_b, distance, count(*) AS n FROM review_pairs GROUP BY ALL", "review_pairs"
    ),
)
def reviewer_overlaps(spark, sf_dir):
    return reviewers.reviewer_overlaps(reviews_of(spark, sf_dir))


@query("r4_reviewer_pairs", q.with_ctes("SELECT * FROM pair_stats", "pair_stats"))
def reviewer_pairs(spark, sf_dir):
    return reviewers.reviewer_pairs(reviews_of(spark, sf_dir))


@query(
    "r4_reviewer_pairs_single_review",
    q.with_ctes(
        "SELECT a.reviewer AS reviewer_a, b.reviewer AS reviewer_b, count(*) AS overlap FROM items a JOIN items b"
        " ON a.record_id = b.record_id AND a.pillar = b.pillar AND a.reviewer < b.reviewer GROUP BY ALL",
        "items",
    ),
)
def reviewer_pairs_single(spark, sf_dir):
    """Pairs over scored items: empty, because rows are last-wins per record."""
    reviews = reviewers.reviews_from_items(items_of(spark, sf_dir))
    return reviewers.reviewer_pairs(reviews).select("reviewer_a", "reviewer_b", "overlap")
