"""Several runs over the same records, reviewer pairs, usage and tags, against brute force."""

import itertools
import math
import random
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from judgespark.operators import reviewers, runs, stability, usage
from judgespark.schema import DISTANCE_WEIGHTS, OVERALL

OUTCOMES = "outcome_index long, record_id string, pillar string, run_id string, result struct<score:int>"


def outcomes_of(spark, rows):
    """``(record, pillar, run, score or None)`` in order of time."""
    return spark.createDataFrame([(i, r, p, run, None if s is None else (s,)) for i, (r, p, run, s) in enumerate(rows)], OUTCOMES)


def last_scores(rows):
    return {(r, p, run): s for r, p, run, s in rows}


def ordinal_alpha(units):
    """Krippendorff's alpha from pairs of ratings, as fractions."""
    seen = defaultdict(Fraction)
    for ratings in units:
        for a, b in itertools.permutations(ratings, 2):
            seen[a, b] += Fraction(1, len(ratings) - 1)
    total = {c: sum(v for (a, _), v in seen.items() if a == c) for c in range(1, 6)}
    n = sum(total.values())
    gap = lambda a, b: (sum(total[g] for g in range(min(a, b), max(a, b) + 1)) - (total[a] + total[b]) / 2) ** 2
    expected = sum(total[a] * total[b] * gap(a, b) for a in total for b in total if a != b)
    if not expected:
        return None
    return 1 - (n - 1) * sum(v * gap(a, b) for (a, b), v in seen.items() if a != b) / expected


def sample(seed, records=40, pillars=("relevance", "toxicity"), runs_=4):
    rng = random.Random(seed)
    rows = []
    for r in range(records):
        for p in pillars:
            base = rng.randint(1, 5)
            for run in range(rng.randint(0, runs_)):
                for _ in range(rng.choice([1, 1, 1, 2])):  # sent again
                    score = None if rng.random() < 0.1 else min(5, max(1, base + rng.choice([-1, 0, 0, 0, 1])))
                    rows.append((f"r{r}", p, f"run{run}", score))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_stability_equals_pairing_all_runs(spark, seed):
    rows = sample(seed)
    vectors = stability.score_vectors(stability.run_scores(outcomes_of(spark, rows).repartition(5)))
    got = {r.pillar: r for r in stability.stability_report(vectors).collect()}
    units = defaultdict(list)
    for (r, p, _), s in last_scores(rows).items():
        units[r, p].append(s)
    assert set(got) == {"factual_accuracy", "hallucination", "relevance", "completeness", "toxicity", "bias_discrimination", OVERALL}
    for pillar in ("relevance", "toxicity", OVERALL):
        mine = [[s for s in v if s is not None] for (r, p), v in units.items() if pillar in (p, OVERALL)]
        rated = [v for v in mine if len(v) > 1]
        row = got[pillar]
        assert (row.records, row.ratings, row.single_records) == (len(rated), sum(map(len, rated)), len(mine) - len(rated))
        assert row.failed_runs == sum(s is None for (r, p), v in units.items() if pillar in (p, OVERALL) for s in v)
        assert row.unanimous_share == pytest.approx(sum(len(set(v)) == 1 for v in rated) / len(rated))
        assert row.modal_share == pytest.approx(sum(max(Counter(v).values()) / len(v) for v in rated) / len(rated))
        spread = lambda v: sum((x - sum(v) / len(v)) ** 2 for x in v) / (len(v) - 1)
        assert row.mean_variance == pytest.approx(sum(map(spread, rated)) / len(rated))
        assert row.alpha == pytest.approx(float(ordinal_alpha(rated)))
    assert got["completeness"].records == 0 and got["completeness"].alpha is None
    each = {(r.record_id, r.pillar): r for r in stability.record_stability(vectors).collect()}
    for key, v in units.items():
        scores = [s for s in v if s is not None]
        row = each[key]
        assert (row.ratings, row.failed_runs) == (len(scores), len(v) - len(scores))
        if scores:
            most = max(Counter(scores).values())
            assert row.modal_score == min(s for s, n in Counter(scores).items() if n == most)
            assert (row.lowest_score, row.highest_score) == (min(scores), max(scores))
        assert row.unanimous == (len(set(scores)) == 1 if len(scores) > 1 else None)


def test_stability_of_equal_ratings_and_of_nothing(spark):
    same = outcomes_of(spark, [("a", "relevance", f"run{i}", 3) for i in range(5)])
    row = stability.stability_report(stability.score_vectors(stability.run_scores(same)), ["relevance"]).where("pillar = 'relevance'").first()
    assert (row.records, row.ratings, row.unanimous_share, row.mean_variance, row.alpha) == (1, 5, 1.0, 0.0, None)
    none = stability.stability_report(stability.score_vectors(stability.run_scores(outcomes_of(spark, []))))
    assert [(r.records, r.alpha) for r in none.collect()] == [(0, None)] * 7


def test_a_hot_record_folds_before_the_shuffle(spark):
    vectors = stability.score_vectors(stability.run_scores(outcomes_of(spark, sample(1))))
    plan = vectors._jdf.queryExecution().executedPlan().toString()
    assert plan.count("partial_max") == 1 and plan.count("partial_count_if") + plan.count("partial_count") >= 1


def brute_change(a, b):
    if a == "failed" and b == "failed":
        return "still_failed"
    if b == "failed":
        return "newly_failed"
    if b == "absent":
        return "lost"
    if a == "absent":
        return "gained"
    if a == "failed":
        return "recovered"
    return "up" if a < b else "down" if a > b else "same"


@pytest.mark.parametrize("seed", range(2))
def test_comparison_equals_brute_force(spark, seed):
    rows = sample(seed, runs_=2)
    rng = random.Random(seed)
    labels = {f"r{r}": {p: rng.choice([None, 1, 2, 3, 4, 5]) for p in ("relevance", "toxicity")} for r in range(35)}
    table = spark.createDataFrame(
        [(i, r, v["relevance"], v["toxicity"]) for i, (r, v) in enumerate(labels.items())],
        "row_index long, record_id string, label_relevance int, label_toxicity int",
    )
    pairs = runs.aligned(outcomes_of(spark, rows), F.col("run_id") == "run0", F.col("run_id") == "run1")
    counts = runs.transition_counts(pairs, table)
    last = last_scores(rows)
    want, paired = Counter(), defaultdict(list)
    for r, p in {(r, p) for r, p, _ in last}:
        state = lambda run: "absent" if (r, p, run) not in last else "failed" if last[r, p, run] is None else str(last[r, p, run])  # noqa: B023, E731
        a, b = state("run0"), state("run1")
        want[p, a, b, brute_change(a, b)] += 1
        human = labels.get(r, {}).get(p)
        if a.isdigit() and b.isdigit() and human is not None:
            paired[p].append((int(a), int(b), human))
            paired[OVERALL].append((int(a), int(b), human))
    assert {(r.pillar, r.before, r.after, r.change): r.n for r in runs.transitions(counts).collect()} == dict(want)
    got = {r.pillar: r for r in runs.comparison(counts).collect()}
    assert len(got) == 7
    for p in ("relevance", "toxicity", OVERALL):
        row, items = got[p], paired[p]
        for c in runs.CHANGES:
            assert row[c] == sum(n for (q, _, _, k), n in want.items() if q == p or p == OVERALL if k == c)
        assert row.support == len(items)
        lost = sum(a == h != b for a, b, h in items)
        gained = sum(b == h != a for a, b, h in items)
        assert (row.hits_lost, row.hits_gained) == (lost, gained)
        assert row.exact_match_rate_delta == pytest.approx((gained - lost) / len(items))
        error = lambda i: sum(abs(x[i] - x[2]) for x in items) / len(items)  # noqa: B023, E731
        assert row.mean_absolute_error_delta == pytest.approx(error(1) - error(0))
        tail = sum(math.comb(lost + gained, i) for i in range(min(lost, gained) + 1))
        assert row.p_value == pytest.approx(min(1.0, 2 * tail / 2 ** (lost + gained)))
    assert got["completeness"].support == 0 and got["completeness"].p_value == 1.0


def test_comparison_with_one_side_only_and_without_labels(spark):
    rows = [("a", "relevance", "run0", 3), ("b", "relevance", "run0", None)]
    pairs = runs.aligned(outcomes_of(spark, rows), F.col("run_id") == "run0", F.col("run_id") == "run1")
    row = {r.pillar: r for r in runs.comparison(runs.transition_counts(pairs)).collect()}["relevance"]
    assert (row.lost, row.support, row.exact_match_rate_before, row.p_value) == (2, 0, None, 1.0)
    none = runs.aligned(outcomes_of(spark, []), F.lit(True), F.lit(True))
    assert all(r.same == 0 for r in runs.comparison(runs.transition_counts(none)).collect())


@given(st.integers(0, 60), st.integers(0, 60))
def test_sign_test_is_exact(a, b):
    tail = sum(math.comb(a + b, i) for i in range(min(a, b) + 1))
    assert runs.two_sided_sign_test(a, b) == pytest.approx(min(1.0, 2 * tail / 2 ** (a + b)), rel=1e-9)


def test_sign_test_of_many():
    # Far in the normal range: z = 5 gives 5.7e-7.
    assert runs.two_sided_sign_test(5 * 10**9 - 250_000, 5 * 10**9 + 250_000) == pytest.approx(5.733e-7, rel=1e-3)


REVIEWS = "review_index long, record_id string, pillar string, reviewer string, human_score int"


def brute_pairs(rows, least):
    last = {}
    for _, r, p, who, s in rows:
        if who is not None and s is not None:
            last[r, p, who] = s
    out = defaultdict(list)
    by_item = defaultdict(dict)
    for (r, p, who), s in last.items():
        by_item[r, p][who] = s
    for (_, p), scores in by_item.items():
        for a, b in itertools.combinations(sorted(scores), 2):
            out[a, b, p].append((scores[a], scores[b]))
    return {k: v for k, v in out.items() if len(v) >= least}


def quadratic_kappa(pairs):
    if len(pairs) < 2:
        return None
    first, second = Counter(a for a, _ in pairs), Counter(b for _, b in pairs)
    expected = sum(n * m * (a - b) ** 2 for a, n in first.items() for b, m in second.items())
    return None if not expected else 1 - sum((a - b) ** 2 for a, b in pairs) * len(pairs) / expected


@pytest.mark.parametrize(("least", "block"), [(1, 256), (4, 3), (20, 2)])
def test_pairs_of_reviewers_in_blocks(spark, least, block):
    rng = random.Random(block)
    rows = []
    for r in range(60):
        crowd = 30 if r < 2 else rng.randint(0, 6)
        for who in rng.sample(range(30), crowd):
            for p in ("relevance", "toxicity"):
                rows.append((len(rows), f"r{r}", p, rng.choice([f"w{who:02}"] * 9 + [None]), rng.choice([1, 2, 3, 4, 5, None])))
    rows += [(len(rows) + i, f"r{i}", "relevance", w, 1 + i % 5) for i in range(25) for w in ("w00", "w01")]
    ct = reviewers.reviewer_pair_crosstab(spark.createDataFrame(rows, REVIEWS), least, block, hot_min_rows=20)
    report = reviewers.reviewer_pair_report(ct, least)
    got = {(r.reviewer_a, r.reviewer_b, r.pillar): r for r in report.collect()}
    want = brute_pairs(rows, least)
    assert set(got) == set(want) and want
    for key, pairs in want.items():
        row = got[key]
        assert row.overlap == len(pairs)
        assert row.exact_match_rate == pytest.approx(sum(a == b for a, b in pairs) / len(pairs))
        assert row.weighted_kappa == (None if (k := quadratic_kappa(pairs)) is None else pytest.approx(k))
        assert row.avg_score_a == pytest.approx(sum(a for a, _ in pairs) / len(pairs))


        assert row.severity_aware_alignment == pytest.approx(sum(DISTANCE_WEIGHTS[abs(a - b)] for a, b in pairs) / len(pairs))
    matrix = {(r.pillar, r.reviewer, r.other): r.value for r in reviewers.reviewer_matrix(report).collect()}
    assert len(matrix) == 2 * len(want)
    assert all(matrix[p, a, b] == matrix[p, b, a] == got[a, b, p].exact_match_rate for a, b, p in want)


def test_usage_and_tags(spark):
    schema = (
        "pillar string, model_name string, latency_ms double, attempts int, usage struct<input_tokens:long,output_tokens:long>,"
        " result struct<failure_tags:array<string>>"
    )
    rows = [
        ("relevance", "m", 10.5, 1, (100, 20), (["x", "y", "x"],)),
        ("relevance", "m", 20.0, 2, (None, 5), (["y"],)),
        ("relevance", "m", None, 3, None, None),
        ("relevance", None, 1.0, 1, (1, 1), (None,)),
        ("tone", "m", 1.0, 1, (1, 1), (["z"],)),
    ]
    df = spark.createDataFrame(rows, schema)
    got = {r.model_name: r for r in usage.judge_usage(df, usage.rates_table(spark, {"m": (2.0, 4.0)})).collect()}
    assert (got["m"].calls, got["m"].succeeded, got["m"].failed, got["m"].attempts) == (3, 2, 1, 6)
    assert (got["m"].avg_latency_ms, got["m"].tokens_in, got["m"].tokens_out, got["m"].calls_without_usage) == (15.25, 100, 25, 2)
    assert got["m"].cost_estimate == pytest.approx((200 + 100) / 1e6) and got[None].cost_estimate is None
    tags = [(r.tag, r.n, round(r.share, 6), r.rank) for r in usage.failure_tags(df).orderBy("rank").collect()]
    assert tags == [("y", 2, 0.666667, 1), ("x", 1, 0.333333, 2)]
    assert usage.failure_tags(df.where("false")).count() == 0
    assert usage.judge_usage(df.where("false"), usage.rates_table(spark, {})).count() == 0
