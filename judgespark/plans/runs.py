"""Queries: several runs over the same records, reviewer pairs in full, usage and failure tags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from judgespark.operators import reviewers, runs, stability, usage
from judgespark.operators.crosstab import METRIC_COLUMNS
from judgespark.plans import inputs
from judgespark.plans import sqltext as q
from judgespark.plans.agreement import reviews_of
from judgespark.plans.registry import query
from judgespark.schema import OVERALL, PILLARS, SCORES

# --- several runs -----------------------------------------------------------------


def dealt_runs(spark: SparkSession, sf_dir: str, count: int) -> DataFrame:
    """All outcomes dealt to ``count`` runs: neighbouring ones of an order are runs over one pillar."""
    place = "(outcome_index % 8 - 1)"
    return inputs.outcomes(spark, sf_dir).selectExpr(
        "outcome_index",
        "record_id",
        f"{inputs.pillar_case(f'1 + {place} div {count}')} AS pillar",
        f"concat('run-', {place} % {count}) AS run_id",
        "result",
    )


def _dealt_sql(count: int) -> str:
    place = "(outcome_index % 8 - 1)"
    return (
        f"SELECT outcome_index, record_id, {q._pillar_case(f'1 + {place} // {count}')} AS pillar,"
        f" 'run-' || ({place} % {count}) AS run_id, judge_score AS score FROM outcomes"
    )


for _count in (2, 3):
    q.define(f"dealt{_count}", ["outcomes"], _dealt_sql(_count))
    q.define(
        f"runs{_count}",
        [f"dealt{_count}"],
        f"SELECT * FROM dealt{_count}"
        " QUALIFY row_number() OVER (PARTITION BY record_id, pillar, run_id ORDER BY outcome_index DESC, score DESC NULLS LAST) = 1",
    )

q.define(
    "units",
    ["runs3"],
    "SELECT record_id, pillar, count(score) AS m, count(*) FILTER (WHERE score IS NULL) AS failed, min(score) AS low,"
    " max(score) AS high, sum(score)::BIGINT AS total, sum(score * score)::BIGINT AS squares FROM runs3 GROUP BY ALL",
)
q.define(
    "modes",
    ["runs3"],
    "SELECT record_id, pillar, score AS mode, count(*) AS times FROM runs3 WHERE score IS NOT NULL GROUP BY record_id, pillar, score"
    " QUALIFY row_number() OVER (PARTITION BY record_id, pillar ORDER BY times DESC, mode) = 1",
)
q.define(
    "rated_pairs",
    ["runs3", "units"],
    "SELECT a.pillar, a.score AS c, b.score AS k, u.m FROM runs3 a JOIN runs3 b USING (record_id, pillar)"
    " JOIN units u USING (record_id, pillar)"
    " WHERE a.run_id <> b.run_id AND a.score IS NOT NULL AND b.score IS NOT NULL AND a.score <= b.score",
)


@query(
    "x5_record_stability",
    q.with_ctes(
        "SELECT record_id, pillar, m AS ratings, failed AS failed_runs, low AS lowest_score, high AS highest_score,"
        " mode AS modal_score, total::DOUBLE / m AS mean_score,"
        " CASE WHEN m > 1 THEN (m * squares - total * total)::DOUBLE / (m * (m - 1))::DOUBLE END AS score_variance,"
        " CASE WHEN m > 1 THEN low = high END AS unanimous FROM units LEFT JOIN modes USING (record_id, pillar)",
        "units",
        "modes",
    ),
)
def record_stability(spark, sf_dir):
    vectors = stability.score_vectors(stability.run_scores(dealt_runs(spark, sf_dir, 3)))
    return stability.record_stability(vectors)


def _alpha_sql() -> str:
    """The measure over columns ``o<c><k>`` of ordered pairs, c <= k, and ratings."""
    total = {c: "(" + " + ".join(f"o{min(c, k)}{max(c, k)}" for k in SCORES) + ")" for c in SCORES}
    gap = lambda c, k: f"(({' + '.join(total[g] for g in range(c, k + 1))}) - ({total[c]} + {total[k]}) / 2)"
    unequal = [(c, k) for c in SCORES for k in SCORES if c < k]
    seen = " + ".join(f"o{c}{k} * {gap(c, k)} * {gap(c, k)}" for c, k in unequal)
    expected = " + ".join(f"{total[c]} * {total[k]} * {gap(c, k)} * {gap(c, k)}" for c, k in unequal)
    return f"1 - ((ratings::DOUBLE - 1) * ({seen})) / nullif({expected}, 0)"


def _both(relation: str) -> str:
    return (
        f"(SELECT * FROM {relation} UNION ALL SELECT * REPLACE ('{OVERALL}' AS pillar) FROM {relation}"
        f" WHERE pillar IN ({q._ACTIVE}))"
    )


# Pairs of equal scores count in both orders already, unequal ones were kept in one.
_CELLS_SQL = ", ".join(
    f"coalesce(sum(1::DOUBLE / (m - 1)) FILTER (WHERE c = {c} AND k = {k}), 0) AS o{c}{k}"
    for c in SCORES
    for k in SCORES
    if c <= k
)


@query(
    "x5_rerun_stability",
    q.with_ctes(
        f"""SELECT pillar, coalesce(records, 0) AS records, coalesce(ratings, 0) AS ratings,
  coalesce(single_records, 0) AS single_records, coalesce(failed_runs, 0) AS failed_runs,
  unanimous::DOUBLE / records AS unanimous_share, modal / records AS modal_share, variance / records AS mean_variance,
  {_alpha_sql()} AS alpha
FROM {q.pillar_values([*PILLARS, OVERALL])}
LEFT JOIN (
  SELECT pillar, sum(n) FILTER (WHERE m > 1)::BIGINT AS records, sum(n * m) FILTER (WHERE m > 1)::BIGINT AS ratings,
    sum(n) FILTER (WHERE m <= 1)::BIGINT AS single_records, sum(failed)::BIGINT AS failed_runs,
    sum(same) FILTER (WHERE m > 1) AS unanimous, sum(times::DOUBLE / m) FILTER (WHERE m > 1) AS modal,
    sum(spread::DOUBLE / (m * (m - 1))) FILTER (WHERE m > 1) AS variance
  FROM (
    SELECT pillar, m, count(*) AS n, sum(failed) AS failed, count(*) FILTER (WHERE low = high) AS same,
      sum(times) AS times, sum(m * squares - total * total) AS spread
    FROM {_both('(SELECT * FROM units LEFT JOIN modes USING (record_id, pillar))')} GROUP BY ALL
  ) GROUP BY pillar
) USING (pillar)
LEFT JOIN (SELECT pillar, {_CELLS_SQL} FROM {_both('rated_pairs')} GROUP BY pillar) USING (pillar)""",
        "units",
        "modes",
        "rated_pairs",
    ),
)
def rerun_stability(spark, sf_dir):
    vectors = stability.score_vectors(stability.run_scores(dealt_runs(spark, sf_dir, 3)))
    return stability.stability_report(vectors)


# --- two runs ---------------------------------------------------------------------


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = runs.aligned(dealt_runs(spark, sf_dir, 2), F.col("run_id") == "run-0", F.col("run_id") == "run-1")
    return runs.transition_counts(pairs, inputs.eval_rows(spark, sf_dir))


q.define(
    "aligned",
    ["runs2", "labels_long"],
    """SELECT record_id, pillar, a.run_id IS NOT NULL AS had, b.run_id IS NOT NULL AS has, a.score AS old, b.score AS new,
  l.human_score AS human
  FROM (SELECT * FROM runs2 WHERE run_id = 'run-0') a FULL JOIN (SELECT * FROM runs2 WHERE run_id = 'run-1') b
  USING (record_id, pillar) LEFT JOIN labels_long l USING (record_id, pillar)""",
)
q.define(
    "changed",
    ["aligned"],
    """SELECT *, CASE WHEN old < new THEN 'up' WHEN old > new THEN 'down' WHEN old = new THEN 'same'
    WHEN NOT has THEN 'lost' WHEN new IS NULL THEN CASE WHEN had AND old IS NULL THEN 'still_failed' ELSE 'newly_failed' END
    WHEN NOT had THEN 'gained' ELSE 'recovered' END AS change FROM aligned""",
)


def _state_sql(seen: str, score: str) -> str:
    return f"CASE WHEN NOT {seen} THEN 'absent' WHEN {score} IS NULL THEN 'failed' ELSE {score}::VARCHAR END"


@query(
    "x4_run_transitions",
    q.with_ctes(
        f"SELECT pillar, {_state_sql('had', 'old')} AS before, {_state_sql('has', 'new')} AS after, change,"
        " count(*) AS n FROM changed GROUP BY ALL",
        "changed",
    ),
)
def run_transitions(spark, sf_dir):
    return runs.transitions(_counts(spark, sf_dir))


_PAIRED = "old IS NOT NULL AND new IS NOT NULL AND human IS NOT NULL"
_SIDES = ", ".join(f"s.{m}_{side}" for m in METRIC_COLUMNS for side in ("before", "after"))
_DELTAS = ", ".join(f"s.{m}_after - s.{m}_before AS {m}_delta" for m in METRIC_COLUMNS)
_WIDE = ", ".join(
    f"max({m}) FILTER (WHERE side = '{side}') AS {m}_{side}" for m in METRIC_COLUMNS for side in ("before", "after")
)
_P_VALUE = """CASE WHEN hits_lost = hits_gained THEN 1 ELSE least(1, 2 * list_sum([
  exp(lgamma(hits_lost + hits_gained + 1) - lgamma(i + 1) - lgamma(hits_lost + hits_gained - i + 1)
      - (hits_lost + hits_gained) * ln(2)) FOR i IN range(0, least(hits_lost, hits_gained) + 1)])) END"""
q.define(
    "sided",
    ["aligned"],
    f"SELECT 'before' AS side, pillar, old AS judge_score, human AS human_score FROM aligned WHERE {_PAIRED}"
    f" UNION ALL SELECT 'after', pillar, new, human FROM aligned WHERE {_PAIRED}",
)


@query(
    "x4_run_comparison",
    q.with_ctes(
        f"""SELECT k.*, coalesce(s.support, 0) AS support, {_SIDES}, {_DELTAS}, round({_P_VALUE}, 6) AS p_value
FROM (
  SELECT p.pillar, {', '.join(f"count(*) FILTER (WHERE change = '{c}') AS {c}" for c in runs.CHANGES)},
    count(*) FILTER (WHERE {_PAIRED} AND old = human AND new <> human) AS hits_lost,
    count(*) FILTER (WHERE {_PAIRED} AND old <> human AND new = human) AS hits_gained
  FROM {q.pillar_values([*PILLARS, OVERALL])} LEFT JOIN {_both('changed')} c USING (pillar) GROUP BY p.pillar
) k LEFT JOIN (SELECT pillar, max(support) AS support, {_WIDE} FROM ({q.report('sided', ['side'])}) GROUP BY pillar) s
USING (pillar)""",
        "changed",
        "sided",
    ),
)
def run_comparison(spark, sf_dir):
    return runs.comparison(_counts(spark, sf_dir)).withColumn("p_value", F.round("p_value", 6))


# --- reviewer pairs -----------------------------------------------------------------

q.define(
    "pair_items",
    ["last_reviews"],
    "SELECT a.reviewer AS reviewer_a, b.reviewer AS reviewer_b, pillar, a.score AS judge_score, b.score AS human_score"
    " FROM last_reviews a JOIN last_reviews b USING (record_id, pillar) WHERE a.reviewer < b.reviewer",
)
_PAIR_METRICS = ("exact_match_rate", "within_1_rate", "mean_absolute_error", "weighted_kappa", "severity_aware_alignment")
q.define(
    "pair_report",
    ["pair_items"],
    f"SELECT reviewer_a, reviewer_b, pillar, support AS overlap, {', '.join(f'{q.METRICS[m]} AS {m}' for m in _PAIR_METRICS)},"
    f" {q.METRICS['avg_judge_score']} AS avg_score_a, {q.METRICS['avg_human_score']} AS avg_score_b"
    f" FROM (SELECT reviewer_a, reviewer_b, pillar, {q._counts()} FROM pair_items GROUP BY ALL)"
    f" WHERE support >= {reviewers.MIN_OVERLAP}",
)


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviewers.reviewer_pair_report(reviewers.reviewer_pair_crosstab(reviews_of(spark, sf_dir)))


@query("x3_reviewer_pair_agreement", q.with_ctes("SELECT * FROM pair_report", "pair_report"))
def reviewer_pair_agreement(spark, sf_dir):
    return _pairs(spark, sf_dir)


@query(
    "x3_reviewer_matrix",
    q.with_ctes(
        " UNION ALL ".join(
            f"SELECT pillar, {a} AS reviewer, {b} AS other, overlap, weighted_kappa AS value,"
            " 1 - exact_match_rate AS disagreement_rate FROM pair_report"
            for a, b in (("reviewer_a", "reviewer_b"), ("reviewer_b", "reviewer_a"))
        ),
        "pair_report",
    ),
)
def reviewer_matrix(spark, sf_dir):
    return reviewers.reviewer_matrix(_pairs(spark, sf_dir), "weighted_kappa")


# --- usage and failure tags -----------------------------------------------------------

RATES = {"model-0": (0.5, 1.5), "model-1": (2.5, 10.0)}


@query(
    "x1_judge_usage",
    q.with_ctes(
        f"""SELECT *, CASE model_name {' '.join(
            f"WHEN '{m}' THEN (tokens_in::DOUBLE * {i}::DOUBLE + tokens_out::DOUBLE * {o}::DOUBLE) / 1000000::DOUBLE"
            for m, (i, o) in RATES.items()
        )} END AS cost_estimate
FROM (
  SELECT pillar, model_name, count(*) AS calls, count(*) FILTER (WHERE NOT failed) AS succeeded,
    count(*) FILTER (WHERE failed) AS failed, sum(attempts)::BIGINT AS attempts,
    (sum(round(latency_ms * 1000)::HUGEINT)::DOUBLE / count(latency_ms)) / 1000 AS avg_latency_ms,
    coalesce(sum(input_tokens), 0)::BIGINT AS tokens_in, coalesce(sum(output_tokens), 0)::BIGINT AS tokens_out,
    count(*) FILTER (WHERE input_tokens IS NULL OR output_tokens IS NULL) AS calls_without_usage
  FROM outcomes WHERE pillar IN ({q._ACTIVE}) GROUP BY ALL
)""",
        "outcomes",
    ),
)
def judge_usage(spark, sf_dir):
    return usage.judge_usage(inputs.outcomes(spark, sf_dir), usage.rates_table(spark, RATES))


q.define(
    "tags",
    ["outcomes"],
    f"""SELECT pillar, unnest(CASE WHEN judge_score = 5 THEN [] WHEN judge_score < 3 THEN [tag, 'second'] ELSE [tag] END) AS tag
  FROM (SELECT *, {q.first_tag()} AS tag FROM outcomes) WHERE NOT failed AND pillar IN ({q._ACTIVE})""",
)


@query(
    "x2_failure_tags",
    q.with_ctes(
        f"""SELECT pillar, tag, n, n::DOUBLE / scored AS share, row_number() OVER (PARTITION BY pillar ORDER BY n DESC, tag)::INTEGER AS rank
FROM (SELECT pillar, tag, count(*) AS n FROM tags GROUP BY ALL)
JOIN (SELECT pillar, count(*) AS scored FROM outcomes WHERE NOT failed GROUP BY ALL) USING (pillar)""",
        "tags",
    ),
)
def failure_tags(spark, sf_dir):
    return usage.failure_tags(inputs.outcomes(spark, sf_dir))
