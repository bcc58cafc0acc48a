"""Queries: gates, diagnostics and drift, filters, tables and chart relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from judgespark.operators import crosstab, drift, gates, reviewers, scored, views
from judgespark.plans import sqltext as q
from judgespark.plans.agreement import (
    base,
    crosstab_of,
    items_of,
    report_of,
    reviewer_report_of,
    reviews_of,
    sliced_of,
)
from judgespark.plans.registry import query
from judgespark.schema import OVERALL, PILLARS, SCORES

# --- gates --------------------------------------------------------------------

_RANK = "CASE status WHEN 'fail' THEN 3 WHEN 'warn' THEN 2 WHEN 'pass' THEN 1 ELSE 0 END"
_LABEL = "CASE {0} WHEN 3 THEN 'fail' WHEN 2 THEN 'warn' WHEN 1 THEN 'pass' ELSE 'skip' END"

q.define("pillar_report", ["report"], f"SELECT * FROM report WHERE pillar <> '{OVERALL}'")
q.define(
    "gate_values",
    ["pillar_report"],
    " UNION ALL ".join(
        f"SELECT pillar, {i} AS gate_order, '{m}' AS metric, {str(up).upper()} AS higher, {value} AS value"
        " FROM pillar_report"
        for i, (m, up) in enumerate(gates.GATES.items())
        for value in [m if m != "large_miss_rate" else "off_by_2_rate + off_by_3_plus_rate"]
    ),
)
q.define(
    "gate_status",
    ["gate_values", "bounds"],
    "SELECT *, CASE WHEN value IS NULL THEN 'skip'"
    " WHEN (higher AND value >= target) OR (NOT higher AND value <= target) THEN 'pass'"
    " WHEN (higher AND value >= warn) OR (NOT higher AND value <= warn) THEN 'warn' ELSE 'fail' END AS status"
    " FROM gate_values JOIN bounds USING (pillar, metric)",
)
_V, _T, _W = (q.fixed(c, 4) for c in ("value", "target", "warn"))
q.define(
    "gates",
    ["gate_status"],
    f"""SELECT pillar, metric, status, value, target, warn, gate_order,
  CASE WHEN status = 'skip' THEN metric || ' undefined for this sample'
    WHEN higher AND status = 'pass' THEN 'value ' || {_V} || ' >= target ' || {_T}
    WHEN higher AND status = 'warn' THEN 'value ' || {_V} || ' in [warn, target) = [' || {_W} || ', ' || {_T} || ')'
    WHEN higher THEN 'value ' || {_V} || ' < warn ' || {_W}
    WHEN status = 'pass' THEN 'value ' || {_V} || ' <= target ' || {_T}
    WHEN status = 'warn' THEN 'value ' || {_V} || ' in (target, warn] = (' || {_T} || ', ' || {_W} || ']'
    ELSE 'value ' || {_V} || ' > warn ' || {_W} END AS detail FROM gate_status""",
)
q.define(
    "pillar_gate",
    ["gate_status"],
    f"SELECT pillar, {_LABEL.format(f'max({_RANK})')} AS overall FROM gate_status GROUP BY pillar",
)


def gates_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    report = crosstab.agreement_report(crosstab_of(spark, sf_dir), include_overall=False)
    return report, gates.gate_results(report, gates.bounds_table(spark))


@query(
    "j7_pillar_bounds",
    q.with_ctes(
        "SELECT pillar, metric, target, warn, support FROM bounds JOIN (SELECT pillar, support FROM report)"
        " USING (pillar)",
        "bounds",
        "report",
    ),
)
def pillar_bounds(spark, sf_dir):
    report = crosstab.agreement_report(crosstab_of(spark, sf_dir), include_overall=False)
    bounds = gates.pillar_bounds(report, gates.bounds_table(spark))
    return bounds.join(report.select("pillar", "support"), "pillar")


@query(
    "g1_gate_status",
    q.with_ctes("SELECT pillar, metric, status, value, detail FROM gates", "gates"),
)
def gate_status(spark, sf_dir):
    return gates_of(spark, sf_dir)[1].select("pillar", "metric", "status", "value", "detail")


@query(
    "g2_large_miss_gate",
    q.with_ctes(
        "SELECT pillar, status, value, target, warn, gate_order FROM gates WHERE metric = 'large_miss_rate'", "gates"
    ),
)
def large_miss_gate(spark, sf_dir):
    results = gates_of(spark, sf_dir)[1].where(F.col("metric") == "large_miss_rate")
    return results.select("pillar", "status", "value", "target", "warn", "gate_order")


# A pillar without items has an undefined kappa: its gate is skipped, the zero rates still count.
@query(
    "g2_gates_of_empty_pillar",
    q.with_ctes(
        f"""SELECT pillar, metric, CASE WHEN metric = 'weighted_kappa' THEN 'skip'
  WHEN metric IN ('mean_absolute_error', 'large_miss_rate') THEN 'pass' ELSE 'fail' END AS status FROM
  (SELECT 'relevance' AS pillar UNION ALL SELECT 'toxicity') CROSS JOIN
  (VALUES {', '.join(f"('{m}')" for m in gates.GATES)}) AS m(metric)
  WHERE NOT EXISTS (SELECT 1 FROM items WHERE pillar = 'nothing')""",
        "items",
    ),
)
def empty_pillar_gates(spark, sf_dir):
    nothing = crosstab_of(spark, sf_dir).where("pillar = 'nothing'")
    report = crosstab.agreement_report(nothing, pillars=["relevance", "toxicity"], include_overall=False)
    return gates.gate_results(report, gates.bounds_table(spark)).select("pillar", "metric", "status")


@query("g3_pillar_rollup", q.with_ctes("SELECT pillar, overall FROM pillar_gate", "pillar_gate"))
def pillar_rollup(spark, sf_dir):
    return gates.pillar_status(*gates_of(spark, sf_dir))


@query(
    "g4_worst_status",
    q.with_ctes(f"SELECT {_LABEL.format(f'max({_RANK})')} AS worst_status FROM gate_status", "gate_status"),
)
def worst_status(spark, sf_dir):
    return gates.worst_status(gates.pillar_status(*gates_of(spark, sf_dir)))


_GATE_JSON = (
    "version string, worst_status string,"
    " pillars map<string, struct<overall: string, gates: array<struct<metric: string, status: string,"
    " value: double, detail: string>>>>"
)


@query(
    "g5_gate_json",
    q.with_ctes(
        f"SELECT '1' AS version, (SELECT {_LABEL.format(f'max({_RANK})')} FROM gate_status) AS worst_status, pillar,"
        " overall, metric, status, value, detail FROM gates JOIN pillar_gate USING (pillar)",
        "gates",
        "gate_status",
        "pillar_gate",
    ),
)
def gate_json(spark, sf_dir):
    """The JSON report, read back into rows."""
    report = gates.gate_json(*gates_of(spark, sf_dir))
    parsed = report.select(F.from_json("gate_report", _GATE_JSON).alias("r"))
    return parsed.selectExpr(
        "r.version AS version", "r.worst_status AS worst_status", "explode(r.pillars) AS (pillar, p)"
    ).selectExpr("version", "worst_status", "pillar", "p.overall AS overall", "inline(p.gates)")


_HINT = "CASE metric " + " ".join(f"WHEN '{m}' THEN '{t}'" for m, t in gates.ACTIONS.items()) + " END"


@query(
    "g6_suggested_actions",
    q.with_ctes(
        f"SELECT pillar, coalesce(string_agg({_HINT}, '; ' ORDER BY gate_order) FILTER (WHERE status IN"
        f" ('warn', 'fail')), '{gates.NO_ACTION}') AS suggested_actions FROM gate_status GROUP BY pillar",
        "gate_status",
    ),
)
def suggested_actions(spark, sf_dir):
    return gates.suggested_actions(*gates_of(spark, sf_dir))


# --- diagnostics and drift: outcomes of even orders are the baseline, odd orders the current run ---

q.define("current_items", ["items"], "SELECT * FROM items WHERE (outcome_index // 8) % 2 = 1")
q.define("baseline_items", ["items"], "SELECT * FROM items WHERE (outcome_index // 8) % 2 = 0")
q.define("current", ["current_items"], q.report("current_items", include_overall=False))
q.define("baseline", ["baseline_items"], q.report("baseline_items", include_overall=False))


def _pmf(side: str, s: int, source: str = "") -> str:
    return f"CASE WHEN {source}support = 0 THEN 0.2::DOUBLE ELSE {source}{side[0]}{s}::DOUBLE / {source}support::DOUBLE END"


def _pmf_rows(relation: str) -> str:
    return " UNION ALL ".join(
        f"SELECT pillar, {s} AS score, '{side}' AS source, {_pmf(side, s)} AS p FROM {relation}"
        for s in SCORES
        for side in ("judge", "human")
    )


_MJ, _MH = "(judge_sum::DOUBLE / support::DOUBLE)", "(human_sum::DOUBLE / support::DOUBLE)"


def _spread(a: str, b: str) -> str:
    deviation = {"j": lambda j, h: f"({j}::DOUBLE - {_MJ})", "h": lambda j, h: f"({h}::DOUBLE - {_MH})"}
    return " + ".join(
        f"c{j}{h}::DOUBLE * {deviation[a](j, h)} * {deviation[b](j, h)}" for j in SCORES for h in SCORES
    )


def _constant(side: str) -> str:
    return "(" + " OR ".join(f"{side}{s} = support" for s in SCORES) + ")"


q.define(
    "moments",
    ["current"],
    f"SELECT *, {_MJ} AS mj, {_MH} AS mh, {_spread('j', 'j')} AS sjj, {_spread('j', 'h')} AS sjh,"
    f" {_spread('h', 'h')} AS shh FROM current",
)
q.define(
    "ols",
    ["moments"],
    f"SELECT *, mh - ols_slope * mj AS ols_intercept FROM (SELECT *,"
    f" CASE WHEN support < 2 OR {_constant('j')} THEN NULL WHEN {_constant('h')} THEN 0::DOUBLE ELSE sjh / sjj END"
    f" AS ols_slope, CASE WHEN support < 2 OR {_constant('j')} THEN NULL WHEN {_constant('h')} THEN 1::DOUBLE"
    f" ELSE greatest(0::DOUBLE, least(1::DOUBLE, (sjh * sjh) / (sjj * shh))) END AS ols_r2,"
    f" (judge_sum - human_sum)::DOUBLE / support::DOUBLE AS mean_residual,"
    f" judge_above::DOUBLE / support::DOUBLE AS pct_positive_residual FROM moments)",
)


def _floor(p: str, eps: str) -> str:
    return f"greatest({p}, {eps}::DOUBLE)"


def _js() -> str:
    ps = [_floor(_pmf("judge", s, "c."), "1e-12") for s in SCORES]
    qs = [_floor(_pmf("judge", s, "b."), "1e-12") for s in SCORES]
    mid = [f"(({p} + {r}) * 0.5::DOUBLE)" for p, r in zip(ps, qs)]
    mass = "(" + " + ".join(mid) + ")"

    def divergence(xs):
        return "(" + " + ".join(f"{x} * ln({x} / {_floor(f'({m} / {mass})', '1e-12')})" for x, m in zip(xs, mid)) + ")"

    return f"{divergence(ps)} * 0.5::DOUBLE + {divergence(qs)} * 0.5::DOUBLE"


def _psi() -> str:
    terms = []
    for s in SCORES:
        e = _floor(_pmf("judge", s, "b."), "1e-6")
        a = _floor(_pmf("judge", s, "c."), "1e-6")
        terms.append(f"({a} - {e}) * ln({a} / {e})")
    return " + ".join(terms)


# Logarithms may differ in the last bit between engines, so drift is compared at 12 decimals.
q.define(
    "drift",
    ["current", "baseline"],
    f"SELECT pillar, round({_js()}, 12) AS js_vs_baseline, round({_psi()}, 12) AS psi_vs_baseline"
    " FROM current c JOIN baseline b USING (pillar)",
)

FINGERPRINT = "sha256:feedc0de00000000"


def halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Crosstabs of the current and the baseline run."""
    rows, outcomes = base(spark, sf_dir)
    parity = F.expr("floor(outcome_index / 8) % 2")
    return (
        scored.agreement_crosstab(rows, outcomes.where(parity == 1)),
        scored.agreement_crosstab(rows, outcomes.where(parity == 0)),
    )


def diagnostics_of(spark: SparkSession, sf_dir: str, **kwargs) -> DataFrame:
    current, earlier = halves(spark, sf_dir)
    snapshot = drift.baseline_snapshot(earlier, FINGERPRINT, run_id="run-0", **kwargs)
    return drift.run_diagnostics(current, FINGERPRINT, snapshot)


@query("d1_pmf", q.with_ctes(_pmf_rows("current"), "current"))
def pmf(spark, sf_dir):
    return drift.pmf_rows(drift.pillar_diagnostics(halves(spark, sf_dir)[0]))


@query("d2_js_divergence", q.with_ctes("SELECT pillar, js_vs_baseline FROM drift", "drift"))
def js_divergence(spark, sf_dir):
    return diagnostics_of(spark, sf_dir).select("pillar", F.round("js_vs_baseline", 12).alias("js_vs_baseline"))


@query("d3_psi", q.with_ctes("SELECT pillar, psi_vs_baseline FROM drift", "drift"))
def psi(spark, sf_dir):
    return diagnostics_of(spark, sf_dir).select("pillar", F.round("psi_vs_baseline", 12).alias("psi_vs_baseline"))


@query("d4_residuals", q.with_ctes("SELECT pillar, support, mean_residual, pct_positive_residual FROM ols", "ols"))
def residuals(spark, sf_dir):
    return drift.pillar_diagnostics(halves(spark, sf_dir)[0]).select(
        "pillar", "support", "mean_residual", "pct_positive_residual"
    )


@query("d5_regression", q.with_ctes("SELECT pillar, ols_slope, ols_intercept, ols_r2 FROM ols", "ols"))
def regression(spark, sf_dir):
    return drift.pillar_diagnostics(halves(spark, sf_dir)[0]).select(
        "pillar", "ols_slope", "ols_intercept", "ols_r2"
    )


_D6 = "pillar, support, mean_residual, pct_positive_residual, ols_slope, ols_intercept, ols_r2"


@query(
    "d6_pillar_diagnostics",
    q.with_ctes(f"SELECT {_D6}, js_vs_baseline, psi_vs_baseline FROM ols JOIN drift USING (pillar)", "ols", "drift"),
)
def pillar_diagnostics(spark, sf_dir):
    return diagnostics_of(spark, sf_dir).select(
        *_D6.split(", "),
        F.round("js_vs_baseline", 12).alias("js_vs_baseline"),
        F.round("psi_vs_baseline", 12).alias("psi_vs_baseline"),
    )


@query(
    "d7_baseline_snapshot",
    q.with_ctes(
        f"SELECT 'run-0' AS run_id, '{FINGERPRINT}' AS dataset_fingerprint, pillar, score, p"
        f" FROM ({_pmf_rows('baseline')}) WHERE source = 'judge'",
        "baseline",
    ),
)
def baseline_snapshot(spark, sf_dir):
    return drift.baseline_snapshot(halves(spark, sf_dir)[1], FINGERPRINT, run_id="run-0")


@query(
    "d8_compatible_baseline",
    q.with_ctes(
        "SELECT pillar, TRUE AS baseline_compatible, 'run-0' AS baseline_run_id, js_vs_baseline FROM drift", "drift"
    ),
)
def compatible_baseline(spark, sf_dir):
    return diagnostics_of(spark, sf_dir).select(
        "pillar", "baseline_compatible", "baseline_run_id", F.round("js_vs_baseline", 12).alias("js_vs_baseline")
    )


@query(
    "d8_partial_baseline",
    q.with_ctes(
        "SELECT pillar, support, FALSE AS baseline_compatible, CAST(NULL AS DOUBLE) AS js_vs_baseline FROM current",
        "current",
    ),
)
def partial_baseline(spark, sf_dir):
    """A baseline that misses one pillar gives no drift for any pillar."""
    return diagnostics_of(spark, sf_dir, pillars=PILLARS[:5]).select(
        "pillar", "support", "baseline_compatible", "js_vs_baseline"
    )


_DIAGNOSTICS_JSON = (
    "dataset_fingerprint string, baseline_run_id string, baseline_compatible boolean, pillars map<string, struct<"
    "support: bigint, judge_pmf: map<string, double>, human_pmf: map<string, double>,"
    " mean_residual_judge_minus_human: double, pct_positive_residual: double,"
    " ols_human_on_judge: struct<slope: double, intercept: double, r_squared: double>,"
    " js_vs_baseline: double, psi_vs_baseline: double>>"
)


@query(
    "d9_diagnostics_json",
    q.with_ctes(
        f"SELECT '{FINGERPRINT}' AS dataset_fingerprint, 'run-0' AS baseline_run_id, TRUE AS baseline_compatible, pillar,"
        f" support, {', '.join(f'{_pmf(side, s)} AS {side}_p{s}' for side in ('judge', 'human') for s in SCORES)},"
        " mean_residual, pct_positive_residual, ols_slope, ols_intercept, ols_r2, js_vs_baseline, psi_vs_baseline"
        " FROM ols JOIN drift USING (pillar)",
        "ols",
        "drift",
    ),
)
def diagnostics_json(spark, sf_dir):
    """The JSON document, read back into rows."""
    document = drift.diagnostics_json(diagnostics_of(spark, sf_dir), FINGERPRINT)
    parsed = document.select(F.from_json("diagnostics", _DIAGNOSTICS_JSON).alias("d"))
    rows = parsed.selectExpr(
        "d.dataset_fingerprint AS dataset_fingerprint",
        "d.baseline_run_id AS baseline_run_id",
        "d.baseline_compatible AS baseline_compatible",
        "explode(d.pillars) AS (pillar, p)",
    )
    return rows.selectExpr(
        "dataset_fingerprint",
        "baseline_run_id",
        "baseline_compatible",
        "pillar",
        "p.support AS support",
        *[f"p.{side}_pmf['{s}'] AS {side}_p{s}" for side in ("judge", "human") for s in SCORES],
        "p.mean_residual_judge_minus_human AS mean_residual",
        "p.pct_positive_residual AS pct_positive_residual",
        "p.ols_human_on_judge.slope AS ols_slope",
        "p.ols_human_on_judge.intercept AS ols_intercept",
        "p.ols_human_on_judge.r_squared AS ols_r2",
        "round(p.js_vs_baseline, 12) AS js_vs_baseline",
        "round(p.psi_vs_baseline, 12) AS psi_vs_baseline",
    )


@query(
    "j8_baseline_join",
    q.with_ctes(
        " UNION ALL ".join(
            f"SELECT pillar, {s} AS score, {_pmf('judge', s, 'c.')} AS current_p, {_pmf('judge', s, 'b.')} AS baseline_p"
            " FROM current c JOIN baseline b USING (pillar)"
            for s in SCORES
        ),
        "current",
        "baseline",
    ),
)
def baseline_join(spark, sf_dir):
    return drift.drift_rows(diagnostics_of(spark, sf_dir))


# --- filters ------------------------------------------------------------------

_BUCKET = "CASE distance WHEN 0 THEN 'exact' WHEN 1 THEN 'within_1' WHEN 2 THEN 'off_by_2' ELSE 'off_by_3_plus' END"


@query(
    "v1_severity_buckets",
    q.with_ctes(f"SELECT pillar, {_BUCKET} AS severity, count(*) AS n FROM items GROUP BY ALL", "items"),
)
def severity_buckets(spark, sf_dir):
    ct = crosstab_of(spark, sf_dir)
    bucket = views.severity_bucket(F.abs(F.col("judge") - F.col("human"))).alias("severity")
    return ct.groupBy("pillar", bucket).agg(F.sum("n").alias("n"))


FILTER = {
    "pillars": ["relevance", "toxicity"],
    "categories": ["1-URGENT", "5-LOW"],
    "reviewers": ["rev-1", "rev-5", "id-4"],
    "severity": "within_1",
}
_FILTER_SQL = (
    "pillar IN ('relevance', 'toxicity') AND category IN ('1-URGENT', '5-LOW')"
    " AND coalesce(reviewer IN ('rev-1', 'rev-5', 'id-4'), FALSE) AND distance <= 1"
)


@query(
    "v2_filtered_items",
    q.with_ctes(
        f"SELECT outcome_index, record_id, pillar, judge_score, human_score, category FROM items WHERE {_FILTER_SQL}",
        "items",
    ),
)
def filtered_items(spark, sf_dir):
    return views.apply_filter(items_of(spark, sf_dir), **FILTER).select(
        "outcome_index", "record_id", "pillar", "judge_score", "human_score", "category"
    )


@query(
    "v2_large_misses",
    q.with_ctes(
        "SELECT outcome_index, record_id, pillar, judge_score, human_score FROM items WHERE distance >= 4", "items"
    ),
)
def large_misses(spark, sf_dir):
    kept = views.apply_filter(items_of(spark, sf_dir), severity="off_by_3_plus", min_distance=4)
    return kept.select("outcome_index", "record_id", "pillar", "judge_score", "human_score")


def _distinct_query(what: str) -> None:
    column = "reviewer" if what == "reviewer" else what
    where = " WHERE coalesce(reviewer, '') <> ''" if what == "reviewer" else ""

    @query(f"v3_distinct_{what}", q.with_ctes(f"SELECT DISTINCT {column} FROM items{where}", "items"))
    def run(spark, sf_dir):
        return views.distinct_values(items_of(spark, sf_dir), what)


for _what in ("pillar", "category", "reviewer"):
    _distinct_query(_what)


@query(
    "v4_filter_counts",
    q.with_ctes(
        f"SELECT count(*) AS total, count(*) FILTER (WHERE {_FILTER_SQL}) AS matching,"
        f" (count(*) FILTER (WHERE {_FILTER_SQL}))::DOUBLE / count(*) AS share_shown FROM items",
        "items",
    ),
)
def filter_counts(spark, sf_dir):
    return views.filter_counts(items_of(spark, sf_dir), **FILTER)


# --- tables -------------------------------------------------------------------


def _shown(source: str, factor: int, digits: int) -> str:
    return q.round_half_even(f"({source} * {factor}::DOUBLE)" if factor != 1 else source, digits)


_SUMMARY_SQL = ", ".join(
    f"{_shown(src, int(factor), digits)} AS {name}" for name, (src, factor, digits) in views._SUMMARY.items()
)


@query("v5_agreement_summary", q.with_ctes(f"SELECT pillar, support, {_SUMMARY_SQL} FROM report", "report"))
def agreement_summary(spark, sf_dir):
    return views.agreement_summary(report_of(spark, sf_dir))


@query(
    "v6_slice_breakdown",
    q.with_ctes(
        f"SELECT dimension, slice, pillar, support, {_SUMMARY_SQL}, slice_total_items FROM sliced"
        f" JOIN slice_sizes USING (dimension, slice) WHERE pillar <> '{OVERALL}' AND dimension = 'category'",
        "sliced",
        "slice_sizes",
    ),
)
def slice_breakdown(spark, sf_dir):
    return views.slice_breakdown(sliced_of(spark, sf_dir, ["category"]))


q.define("reviewer_counts", ["reviewed"], "SELECT reviewer, count(*) AS samples FROM reviewed GROUP BY reviewer")


@query(
    "v7_reviewer_summary",
    q.with_ctes(
        f"SELECT reviewer, samples, {_shown('exact_match_rate', 100, 2)} AS exact_match_pct,"
        f" {_shown('within_1_rate', 100, 2)} AS within_1_pct, {_shown('off_by_3_plus_rate', 100, 2)} AS large_miss_pct,"
        f" {_shown('severity_aware_alignment', 1, 3)} AS severity_alignment"
        f" FROM by_reviewer JOIN reviewer_counts USING (reviewer) WHERE pillar = '{OVERALL}'",
        "by_reviewer",
        "reviewer_counts",
    ),
)
def reviewer_summary(spark, sf_dir):
    return views.reviewer_summary(reviewer_report_of(spark, sf_dir))


@query(
    "v8_reviewer_pillars",
    q.with_ctes(
        f"SELECT reviewer, pillar, support, {_shown('avg_human_score', 1, 2)} AS avg_human,"
        f" {_shown('avg_judge_score', 1, 2)} AS avg_judge, {_shown('disagreement_rate', 100, 2)} AS disagreement_pct,"
        f" {_shown('within_1_agreement', 100, 2)} AS within_1_pct,"
        f" {_shown('large_miss_3_rate', 100, 2)} AS large_miss_pct FROM reviewer_pillars",
        "reviewer_pillars",
    ),
)
def reviewer_pillar_table(spark, sf_dir):
    return views.reviewer_pillar_table(reviewer_report_of(spark, sf_dir))


@query(
    "v9_reviewer_pairs",
    q.with_ctes(
        f"SELECT reviewer_a, reviewer_b, overlap, {_shown('exact_match_rate', 100, 2)} AS exact_match_pct,"
        f" {_shown('within_1_rate', 100, 2)} AS within_1_pct, {_shown('large_miss_3_rate', 100, 2)} AS large_miss_pct"
        " FROM pair_stats",
        "pair_stats",
    ),
)
def reviewer_pair_table(spark, sf_dir):
    return views.reviewer_pair_table(reviewers.reviewer_pairs(reviews_of(spark, sf_dir)))


q.define(
    "shown",
    ["outcomes", "latest", "labels_long"],
    f"""SELECT o.record_id, o.pillar, r.category, coalesce(nullif(r.reviewer_name, ''), r.reviewer_id) AS reviewer,
  r.intent, r.topic, o.judge_score, l.human_score, abs(o.judge_score - l.human_score) AS distance,
  {q.round_half_even('o.confidence', 3)} AS confidence, 'score ' || o.judge_score || ' on ' || o.pillar
    AS decision_summary,
  CASE WHEN o.tag IS NULL OR o.judge_score = 5 THEN '' WHEN o.judge_score < 3 THEN o.tag || ',second' ELSE o.tag END
    AS failure_tags,
  CASE WHEN o.judge_score < 5 THEN 'some claims lack support' ELSE '' END AS why_not_higher,
  CASE WHEN o.judge_score > 1 THEN 'the core answer is usable' ELSE '' END AS why_not_lower,
  r.user_input, r.agent_output, {q.round_half_even('o.latency_ms', 2)} AS latency_ms, o.model_name AS model
FROM (SELECT *, {q.first_tag()} AS tag FROM outcomes) o
JOIN latest r ON r.record_id = o.record_id
LEFT JOIN labels_long l ON l.record_id = o.record_id AND l.pillar = o.pillar WHERE NOT o.failed""",
)


@query("v10_disagreement_table", q.with_ctes("SELECT * FROM shown", "shown"))
def disagreement_table(spark, sf_dir):
    return views.disagreement_rows(*base(spark, sf_dir))


@query(
    "j5_filtered_display_rows",
    q.with_ctes(
        f"SELECT shown.* FROM shown SEMI JOIN (SELECT record_id, pillar FROM items WHERE {_FILTER_SQL}) USING (record_id, pillar)",
        "shown",
        "items",
    ),
)
def filtered_display_rows(spark, sf_dir):
    rows, outcomes = base(spark, sf_dir)
    kept = views.apply_filter(scored.scored_items(rows, outcomes), **FILTER)
    return views.disagreement_rows(rows, outcomes, kept)


# --- chart relations ----------------------------------------------------------

_CHART = ", ".join(f"{c} AS {n}" for n, c in views.CHART_METRICS.items())


@query(
    "v11_pillar_metric_rows",
    q.with_ctes(f"SELECT pillar, support, {_CHART} FROM pillar_report WHERE support > 0", "pillar_report"),
)
def pillar_metric_rows(spark, sf_dir):
    return views.pillar_metric_rows(report_of(spark, sf_dir))


@query(
    "v12_distribution_rows",
    q.with_ctes(
        " UNION ALL ".join(
            f"SELECT {s} AS score, '{side}' AS source, {side[0]}{s} AS count FROM report WHERE pillar = 'relevance'"
            for s in SCORES
            for side in ("judge", "human")
        ),
        "report",
    ),
)
def distribution_rows(spark, sf_dir):
    report = report_of(spark, sf_dir).where(F.col("pillar") == "relevance")
    return crosstab.distribution_rows(report, [])


@query(
    "v13_slice_heatmap",
    q.with_ctes(
        f"SELECT dimension, slice, pillar, mean_absolute_error AS value, support FROM sliced"
        f" WHERE pillar <> '{OVERALL}' AND dimension = 'topic'",
        "sliced",
    ),
)
def slice_heatmap(spark, sf_dir):
    return views.slice_heatmap(sliced_of(spark, sf_dir, ["topic"]), "mae")


_MEAN_MISS = " + ".join(
    f"coalesce(max(CASE WHEN pillar = '{p}' THEN off_by_3_plus_rate END), 0::DOUBLE)" for p in PILLARS
)


@query(
    "v14_large_miss_by_slice",
    q.with_ctes(
        f"SELECT dimension, slice, ({_MEAN_MISS}) / count(*) AS large_miss_rate, CAST(sum(support) AS BIGINT) AS support"
        f" FROM sliced WHERE pillar <> '{OVERALL}' AND support > 0 GROUP BY dimension, slice",
        "sliced",
    ),
)
def large_miss_by_slice(spark, sf_dir):
    return views.large_miss_by_slice(sliced_of(spark, sf_dir))


@query(
    "v14_large_miss_one_pillar",
    q.with_ctes(
        "SELECT dimension, slice, off_by_3_plus_rate AS large_miss_rate, support FROM sliced"
        " WHERE pillar = 'toxicity' AND support > 0",
        "sliced",
    ),
)
def large_miss_one_pillar(spark, sf_dir):
    return views.large_miss_by_slice(sliced_of(spark, sf_dir), "toxicity")


@query(
    "v15_confusion_cells",
    q.with_ctes(
        " UNION ALL ".join(
            f"SELECT {h} AS human, {j} AS judge, c{j}{h} AS count FROM report WHERE pillar = '{OVERALL}'"
            for h in SCORES
            for j in SCORES
        ),
        "report",
    ),
)
def confusion_cells(spark, sf_dir):
    report = report_of(spark, sf_dir).where(F.col("pillar") == OVERALL)
    return crosstab.confusion_cells(report, [])


@query(
    "v16_reviewer_exact_match",
    q.with_ctes(
        f"SELECT reviewer, exact_match_rate, support FROM by_reviewer WHERE pillar = '{OVERALL}' AND support > 0",
        "by_reviewer",
    ),
)
def reviewer_exact_match(spark, sf_dir):
    return views.reviewer_exact_match(reviewer_report_of(spark, sf_dir))


@query(
    "v16_reviewer_exact_match_pillar",
    q.with_ctes(
        "SELECT reviewer, 1::DOUBLE - (1::DOUBLE - exact_match_rate) AS exact_match_rate, support FROM by_reviewer"
        " WHERE pillar = 'relevance' AND support > 0",
        "by_reviewer",
    ),
)
def reviewer_exact_match_pillar(spark, sf_dir):
    return views.reviewer_exact_match(reviewer_report_of(spark, sf_dir), "relevance")


@query(
    "v17_residual_histogram",
    q.with_ctes(
        "SELECT pillar, judge_score - human_score AS residual, count(*) AS count FROM items GROUP BY ALL", "items"
    ),
)
def residual_histogram(spark, sf_dir):
    return views.residual_histogram(crosstab_of(spark, sf_dir))


@query("v18_pmf_rows", q.with_ctes(_pmf_rows("report"), "report"))
def pmf_rows(spark, sf_dir):
    return drift.pmf_rows(drift.pillar_diagnostics(crosstab_of(spark, sf_dir), include_overall=True))


@query(
    "v19_score_points",
    q.with_ctes(
        "SELECT pillar, judge_score AS judge, human_score AS human, count(*) AS count FROM items GROUP BY ALL", "items"
    ),
)
def score_points(spark, sf_dir):
    return views.score_points(crosstab_of(spark, sf_dir))


@query(
    "v19_fit_line",
    q.with_ctes(
        "SELECT pillar, 1::DOUBLE AS x, ols_intercept + ols_slope * 1::DOUBLE AS y FROM ols UNION ALL"
        " SELECT pillar, 5::DOUBLE AS x, ols_intercept + ols_slope * 5::DOUBLE AS y FROM ols",
        "ols",
    ),
)
def fit_line(spark, sf_dir):
    return views.fit_line(drift.pillar_diagnostics(halves(spark, sf_dir)[0]))


@query("v20_pillar_overview", q.with_ctes("SELECT pillar, mean_residual, ols_r2 AS r_squared FROM ols", "ols"))
def pillar_overview(spark, sf_dir):
    return views.pillar_overview(drift.pillar_diagnostics(halves(spark, sf_dir)[0]))
