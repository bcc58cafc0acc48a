"""Metrics from the crosstab against values worked out by hand and row-level textbook formulas."""

import math
import random

import numpy as np
import pytest

from judgespark.operators import crosstab, drift, gates, views
from judgespark.schema import DISTANCE_WEIGHTS, PILLARS


def single(pair_items, pairs, **kwargs):
    return crosstab.single_report(crosstab.crosstab(pair_items(pairs)), **kwargs).first()


_W = DISTANCE_WEIGHTS

# Worked out by hand. MIXED has the distances 0, 0, 1, 1, 3, 4, 0.
MIXED = [(2, 2), (2, 2), (2, 3), (4, 3), (1, 4), (5, 1), (3, 3)]
# Two scores only, so quadratic weights are Cohen's: 9 of 12 agree, and 8 * 7 + 4 * 5 = 76 of 144 would by chance.
TWO_SCORES = [(1, 1)] * 6 + [(1, 2)] * 2 + [(2, 1)] + [(2, 2)] * 3
# Squared distances 9 + 1 + 1 + 9 = 20; all sixteen combinations have 40, a quarter of that is expected.
UPSIDE_DOWN = [(1, 4), (2, 3), (3, 2), (4, 1)]
# Squared rank differences 1 + 1 + 1 + 1 = 4: 1 - 6 * 4 / (4 * 15).
SWAPPED = [(1, 2), (2, 1), (3, 4), (4, 3)]


@pytest.mark.parametrize(
    ("pairs", "expected"),
    [
        (
            MIXED,
            {
                "support": 7,
                "exact_match_rate": 3 / 7,
                "within_1_rate": 5 / 7,
                "off_by_2_rate": 0.0,
                "off_by_3_plus_rate": 2 / 7,
                "mean_absolute_error": 9 / 7,
                "severity_aware_alignment": (3 * _W[0] + 2 * _W[1] + _W[3] + _W[4]) / 7,
            },
        ),
        (TWO_SCORES, {"weighted_kappa": 32 / 68, "exact_match_rate": 0.75}),
        (UPSIDE_DOWN, {"weighted_kappa": -1.0, "spearman_correlation": -1.0}),
        (SWAPPED, {"spearman_correlation": 0.6, "weighted_kappa": 0.6}),  # 4 of 10 expected
        ([(2, 1), (2, 4)], {"weighted_kappa": 0.0, "spearman_correlation": None}),  # a constant side
        ([(4, 4), (4, 4)], {"weighted_kappa": None, "spearman_correlation": None, "exact_match_rate": 1.0}),
        ([(2, 5)], {"support": 1, "weighted_kappa": None, "off_by_3_plus_rate": 1.0}),
        ([], {"support": 0, "within_1_rate": 0.0, "severity_aware_alignment": 0.0, "spearman_correlation": None}),
    ],
)
def test_worked_out_by_hand(pair_items, pairs, expected):
    row = single(pair_items, pairs)
    for name, value in expected.items():
        assert row[name] == (value if value is None else pytest.approx(value, abs=1e-12)), name


def _ranks(values):
    order = sorted(values)
    return [np.mean([i + 1 for i, v in enumerate(order) if v == x]) for x in values]


def _kappa(pairs, power):
    n = len(pairs)
    o = np.zeros((5, 5))
    for j, h in pairs:
        o[h - 1, j - 1] += 1
    w = np.array([[abs(a - b) ** power / 4**power for b in range(5)] for a in range(5)])
    e = np.outer(o.sum(1), o.sum(0)) / n
    return None if (w * e).sum() == 0 else 1 - (w * o).sum() / (w * e).sum()


def test_against_row_level_formulas(spark, pair_items):
    rng = random.Random(7)
    for size in (2, 3, 5, 40, 300):
        pairs = [(rng.randint(1, 5), rng.randint(1, 5)) for _ in range(size)]
        row = single(pair_items, pairs)
        linear = single(pair_items, pairs)  # same counts, other weights below
        for power, name in ((2, "quadratic"), (1, "linear")):
            report = crosstab.with_metrics(
                crosstab.cell_counts(crosstab.crosstab(pair_items(pairs)), []), kappa_weights=name
            ).first()
            expected = _kappa(pairs, power)
            assert report.weighted_kappa == (expected if expected is None else pytest.approx(expected, abs=1e-12))
        judge, human = zip(*pairs)
        if len(set(judge)) > 1 and len(set(human)) > 1:
            expected = np.corrcoef(_ranks(judge), _ranks(human))[0, 1]
            assert row.spearman_correlation == pytest.approx(expected, abs=1e-12)
        assert -1 <= (row.weighted_kappa or 0) <= 1
        parts = row.exact_match_rate + (row.within_1_rate - row.exact_match_rate)
        assert parts + row.off_by_2_rate + row.off_by_3_plus_rate == pytest.approx(1.0)
        assert linear.support == size


def test_independent_of_partitioning(spark, pair_items):
    rng = random.Random(3)
    items = pair_items([(rng.randint(1, 5), rng.randint(1, 5)) for _ in range(200)])
    columns = ["pillar", "support", *crosstab.METRIC_COLUMNS]
    results = {
        tuple(sorted(map(str, crosstab.agreement_report(crosstab.crosstab(items.repartition(n))).select(*columns).collect())))
        for n in (1, 7, 50)
    }
    assert len(results) == 1


def test_dense_report_and_pillar_arguments(pair_items):
    ct = crosstab.crosstab(pair_items([(5, 5), (1, 5)]))
    rows = {r.pillar: r for r in crosstab.agreement_report(ct).collect()}
    assert set(rows) == {*PILLARS, "__overall__"}
    assert rows["toxicity"].support == 0 and rows["toxicity"].weighted_kappa is None
    assert rows["__overall__"].support == rows["relevance"].support == 2
    only = crosstab.agreement_report(ct, pillars=[], include_overall=True).collect()
    assert [r.pillar for r in only] == ["__overall__"] and only[0].support == 2
    assert crosstab.agreement_report(ct, pillars=[], include_overall=False).count() == 0


def test_out_of_range_scores_are_clamped_in_cells_only(pair_items):
    row = single(pair_items, [(7, 5), (0, 1), (3, 3)])
    assert (row.c55, row.c11, row.c33) == (1, 1, 1)
    assert row.exact_match_rate == pytest.approx(1 / 3)
    assert (row.j5, row.h5) == (0, 1)


def test_unknown_kappa_weights_raise():
    with pytest.raises(ValueError):
        crosstab.kappa("cubic")


# --- diagnostics --------------------------------------------------------------


def diagnostics(pair_items, pairs, baseline=None, fingerprint="fp"):
    ct = crosstab.crosstab(pair_items(pairs))
    if baseline is None:
        return drift.pillar_diagnostics(ct, ["relevance"]).first()
    snapshot = drift.baseline_snapshot(crosstab.crosstab(pair_items(baseline)), "fp", ["relevance"], "run-0")
    return drift.run_diagnostics(ct, fingerprint, snapshot, ["relevance"]).first()


def test_empty_diagnostics(pair_items):
    row = diagnostics(pair_items, [])
    assert row.judge_pmf == [0.2] * 5 and row.mean_residual == 0.0 and row.ols_slope is None


def test_regression_matches_numpy(pair_items):
    rng = random.Random(11)
    pairs = [(rng.randint(1, 5), rng.randint(1, 5)) for _ in range(60)]
    row = diagnostics(pair_items, pairs)
    judge, human = np.array(pairs).T
    slope, intercept = np.polyfit(judge, human, 1)
    assert row.ols_slope == pytest.approx(slope)
    assert row.ols_intercept == pytest.approx(intercept)
    assert row.ols_r2 == pytest.approx(np.corrcoef(judge, human)[0, 1] ** 2)


@pytest.mark.parametrize("pairs, slope, r2", [([(3, 1), (3, 5)], None, None), ([(1, 4), (2, 4), (5, 4)], 0.0, 1.0), ([(2, 2)], None, None)])
def test_degenerate_regression(pair_items, pairs, slope, r2):
    row = diagnostics(pair_items, pairs)
    assert (row.ols_slope, row.ols_r2) == (slope, r2)


def test_drift(pair_items):
    current, baseline = [(1, 1), (1, 2), (5, 5), (4, 4)], [(1, 1), (5, 5), (5, 4), (5, 5)]
    row = diagnostics(pair_items, current, baseline)
    p = [max(x, 1e-12) for x in (0.5, 0, 0, 0.25, 0.25)]
    q = [max(x, 1e-12) for x in (0.25, 0, 0, 0, 0.75)]
    m = [(a + b) / 2 for a, b in zip(p, q)]
    m = [x / sum(m) for x in m]
    js = sum(a * math.log(a / c) for a, c in zip(p, m)) / 2 + sum(b * math.log(b / c) for b, c in zip(q, m)) / 2
    assert row.js_vs_baseline == pytest.approx(js)
    e = [max(x, 1e-6) for x in (0.25, 0, 0, 0, 0.75)]
    a = [max(x, 1e-6) for x in (0.5, 0, 0, 0.25, 0.25)]
    assert row.psi_vs_baseline == pytest.approx(sum((x - y) * math.log(x / y) for x, y in zip(a, e)))
    same = diagnostics(pair_items, current, current)
    assert same.js_vs_baseline == pytest.approx(0.0, abs=1e-9) and same.baseline_compatible


def test_drift_needs_equal_fingerprint(pair_items):
    row = diagnostics(pair_items, [(1, 1)], [(1, 1)], fingerprint="other")
    assert row.js_vs_baseline is None and not row.baseline_compatible


# --- gates --------------------------------------------------------------------


def test_gate_boundaries(spark, pair_items):
    # within-1 rate exactly 0.75, which is between warn 0.70 and target 0.85
    report = crosstab.agreement_report(
        crosstab.crosstab(pair_items([(5, 5), (4, 5), (3, 3), (1, 5)])), pillars=["relevance"], include_overall=False
    )
    bounds = gates.bounds_table(spark, {"within_1_rate": (0.75, 0.5), "mean_absolute_error": (0.35, 1.25)}, {})
    rows = {r.metric: r for r in gates.gate_results(report, bounds).collect()}
    assert set(rows) == {"within_1_rate", "mean_absolute_error"}
    assert rows["within_1_rate"].status == "pass"
    assert rows["within_1_rate"].detail == "value 0.7500 >= target 0.7500"
    assert rows["mean_absolute_error"].status == "warn"
    assert rows["mean_absolute_error"].detail == "value 1.2500 in (target, warn] = (0.3500, 1.2500]"
    strict = gates.bounds_table(spark, {"within_1_rate": (0.75, 0.5)}, {("relevance", "within_1_rate"): (0.9, 0.8)})
    status = gates.pillar_status(report, gates.gate_results(report, strict)).first()
    assert status.overall == "fail"


def test_no_gates_is_skip(spark, pair_items):
    report = crosstab.agreement_report(crosstab.crosstab(pair_items([(3, 3)])), pillars=["relevance"], include_overall=False)
    bounds = gates.bounds_table(spark, {"weighted_kappa": (0.5, 0.3)}, {})
    results = gates.gate_results(report, bounds)
    assert results.first().status == "skip"
    assert gates.worst_status(gates.pillar_status(report, results)).first().worst_status == "skip"
    assert gates.suggested_actions(report, results).first().suggested_actions == gates.NO_ACTION


# --- filters ------------------------------------------------------------------


def test_unknown_names_raise(pair_items):
    with pytest.raises(ValueError):
        views.filter_condition(severity="huge")
    with pytest.raises(ValueError):
        views.chart_metric("accuracy")
    with pytest.raises(ValueError):
        views.distinct_values(pair_items([]), "intent")
