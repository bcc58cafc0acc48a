"""Joins, skew handling, slices and reviewers."""

import pytest
from pyspark.sql import functions as F

from judgespark.operators import crosstab, reviewers, scored, skew, slices
from judgespark.schema import LABEL_FIELDS, OUTCOME

ROW_SCHEMA = (
    "row_index long, record_id string, category string, reviewer_name string, reviewer_id string, intent string,"
    " topic string, conversation_id string, model_name string, " + ", ".join(f"{c} int" for c in LABEL_FIELDS)
)


def make_rows(spark, rows):
    """``(row_index, record_id, reviewer, label)``: the same label on every pillar."""
    return spark.createDataFrame(
        [(i, r, "c", rev, None, None, None, None, None, *[label] * 6) for i, r, rev, label in rows], ROW_SCHEMA
    )


def make_outcomes(spark, outcomes):
    """``(outcome_index, record_id, pillar, score or None)``."""
    flat = spark.createDataFrame(outcomes, "outcome_index long, record_id string, pillar string, score int")
    result = OUTCOME["result"].dataType
    fields = [
        (F.col("score") if f.name == "score" else F.lit(None).cast(f.dataType)).alias(f.name) for f in result.fields
    ]
    return flat.withColumn("result", F.when(F.col("score").isNotNull(), F.struct(*fields))).drop("score")


@pytest.fixture(scope="module")
def small(spark):
    rows = make_rows(spark, [(0, "a", "alex", 5), (1, "b", None, 2), (2, "a", "blake", 4), (3, "c", "alex", None)])
    outcomes = make_outcomes(
        spark,
        [
            (0, "a", "relevance", 4),
            (1, "a", "relevance", 1),  # duplicate outcome
            (2, "a", "toxicity", None),  # failed
            (3, "b", "relevance", 2),
            (4, "c", "relevance", 3),  # no label
            (5, "ghost", "relevance", 3),  # orphan
            (6, "ghost", "toxicity", None),  # failed orphan counts as failed
            (7, "a", "tone", 3),  # inactive pillar
        ],
    )
    return rows, outcomes


def test_items_use_last_row_and_keep_duplicates(small):
    items = {(r.outcome_index, r.human_score, r.reviewer_name) for r in scored.scored_items(*small).collect()}
    assert items == {(0, 4, "blake"), (1, 4, "blake"), (3, 2, None)}


def test_accounting(small):
    row = scored.join_accounting(*small).first()
    assert row.considered == 24 and row.failed_outcomes == 2 and row.orphan_outcomes == 1
    assert row.missing_labels == 1 and row.paired == 3 and list(row.pillars_seen) == ["relevance"]
    # a, b, c have 18 expected pairs; (a, relevance), (a, toxicity), (b, relevance), (c, relevance) exist
    assert row.missing_outcomes == 14 == scored.missing_outcomes(*small).count()


def test_empty_pillar_list_means_all(small):
    assert scored.scored_items(*small, pillars=[]).count() == 3
    assert scored.scored_items(*small, pillars=["toxicity"]).count() == 0


def test_empty_inputs(spark, small):
    rows, outcomes = small
    none = outcomes.where("false")
    row = scored.join_accounting(rows, none).first()
    assert (row.paired, row.missing_outcomes, row.considered) == (0, 18, 24)
    assert scored.agreement_crosstab(rows, none).count() == 0


def test_ledger_equals_items(spark):
    rows = make_rows(spark, [(i, f"r{i % 30}", None, 1 + i % 5 if i % 7 else None) for i in range(50)])
    outcomes = make_outcomes(
        spark, [(i, f"r{i % 35}", ["relevance", "toxicity"][i % 2], 1 + (i * 3) % 5 if i % 11 else None) for i in range(400)]
    )
    by_items = crosstab.crosstab(scored.scored_items(rows, outcomes))
    by_ledger = scored.agreement_crosstab(rows, outcomes).select("pillar", "judge", "human", "n")
    assert sorted(by_items.collect()) == sorted(by_ledger.collect())


def test_hot_record_is_salted_and_whole(spark):
    rows = make_rows(spark, [(i, f"r{i}", None, 3) for i in range(20)])
    skewed = [(i, "r0" if i % 3 else f"r{i % 20}", "relevance", 1 + i % 5) for i in range(3000)]
    outcomes = make_outcomes(spark, skewed)
    hot = {r.record_id: r.n_salts for r in skew.hot_keys(outcomes, ["record_id"], 0.001, 200).collect()}
    assert set(hot) == {"r0"} and hot["r0"] > 5
    plain = scored.scored_items(rows, outcomes)
    salted = scored.scored_items(rows, outcomes, hot_min_rows=200)
    assert plain.count() == 3000
    assert sorted(r.outcome_index for r in salted.collect()) == list(range(3000))


def test_left_skew_join_keeps_unmatched(spark):
    big = spark.createDataFrame([(i, "k" if i < 50 else f"x{i}") for i in range(60)], "i long, key string")
    small_side = spark.createDataFrame([("k", 1), ("k", 2)], "key string, v int")
    joined = skew.skew_join(big, small_side, ["key"], F.col("i"), how="left", min_rows=5)
    assert joined.count() == 110
    with pytest.raises(ValueError):
        skew.skew_join(big, small_side, ["key"], F.col("i"), how="full")


def test_slices_put_blank_keys_into_unknown(spark):
    rows = make_rows(spark, [(0, "a", "alex", 5), (1, "b", "", 5), (2, "c", None, 5)])
    outcomes = make_outcomes(spark, [(i, r, "relevance", 5) for i, r in enumerate("abc")])
    ct = slices.slice_crosstab(rows, outcomes, ["reviewer", "category"])
    report = slices.sliced_report(ct, pillars=["relevance", "toxicity"])
    found = {(r.dimension, r["slice"], r.pillar): (r.support, r.slice_total_items) for r in report.collect()}
    assert found[("reviewer", "__unknown__", "relevance")] == (2, 2)
    assert found[("reviewer", "alex", "toxicity")] == (0, 1)
    assert found[("category", "c", "__overall__")] == (3, 3)


def test_reviewer_stats(spark):
    rows = make_rows(spark, [(i, r, "alex", 5) for i, r in enumerate("abc")])
    outcomes = make_outcomes(spark, [(0, "a", "relevance", 5), (1, "b", "relevance", 4), (2, "c", "relevance", 2)])
    report = reviewers.reviewer_report(reviewers.reviewer_crosstab(rows, outcomes))
    row = report.where("pillar = 'relevance'").first()
    assert row.disagreement_rate == pytest.approx(2 / 3) and row.within_1_agreement == pytest.approx(2 / 3)
    assert row.large_miss_3_rate == pytest.approx(1 / 3) and row.sample_count == 3
    empty = report.where("pillar = 'toxicity'").first()
    assert (empty.support, empty.disagreement_rate, empty.avg_human_score) == (0, 0.0, 0.0)


def test_reviewer_pairs(spark):
    reviews = spark.createDataFrame(
        [
            (0, "a", "relevance", "blake", 1),
            (1, "a", "relevance", "alex", 5),
            (2, "a", "relevance", "blake", 4),  # replaces the first score
            (3, "b", "relevance", "alex", 5),
            (4, "b", "relevance", "blake", 5),
            (5, "b", "toxicity", "alex", 5),
            (6, "b", "relevance", None, 1),
        ],
        "review_index long, record_id string, pillar string, reviewer string, human_score int",
    )
    for limit in (1, 1000):
        (pair,) = reviewers.reviewer_pairs(reviews, hot_min_rows=limit).collect()
        assert (pair.reviewer_a, pair.reviewer_b, pair.overlap) == ("alex", "blake", 2)
        assert (pair.exact_match_rate, pair.within_1_rate, pair.large_miss_3_rate) == (0.5, 1.0, 0.0)


def test_empty_reviewer_counts_as_signal(spark, small):
    items = scored.scored_items(*small)
    assert reviewers.has_reviewer_signal(items).first()[0] is True
    assert reviewers.has_reviewer_signal(items.where("false")).first()[0] is False


def test_hot_keys_by_hash_first(spark):
    df = spark.range(4000).selectExpr("IF(id % 4 = 0, 'hot', IF(id % 10 = 1, NULL, 'k' || id)) AS a", "id % 2 = 0 AS b", "id")
    want = df.groupBy("a", "b").count().where("count > 100")
    got = skew.hot_keys(df, ["a", "b"], share=0.05, min_rows=100)
    piece = 200.0
    counts = [(r.a, r.b, -(-r["count"] // piece)) for r in want.collect() if r["count"] > piece]
    assert sorted(map(str, ((r.a, r.b, float(r.n_salts)) for r in got.collect()))) == sorted(map(str, counts))
    assert skew.hot_keys(df.limit(0), ["a"]).count() == 0


def test_counting_hot_keys_does_not_shuffle_the_keys(spark):
    df = spark.range(0, 200_000, 1, 4).select(F.sha2(F.col("id").cast("string"), 256).alias("k"))
    hot = skew.hot_keys(df, ["k"], min_rows=1000)
    assert hot.count() == 0
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = hot.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    # Keys are shuffled only behind the join with the large hashes.
    lines = plan.splitlines()
    at = next(i for i, x in enumerate(lines) if "hashpartitioning(k" in x)
    assert any("BroadcastHashJoin [_hash" in x for x in lines[at:])


@pytest.mark.parametrize("how", ["inner", "left"])
def test_unique_small_side(spark, how):
    big = spark.range(3000).selectExpr("id", "IF(id % 3 = 0, 'hot', IF(id % 7 = 1, NULL, 'k' || id % 50)) AS k")
    small = spark.range(40).selectExpr("IF(id = 0, 'hot', 'k' || id) AS k", "id AS v")
    plain = sorted(map(str, big.join(small, "k", how).collect()))
    assert sorted(map(str, skew.skew_join(big, small, ["k"], F.col("id"), how, min_rows=100, unique=True).collect())) == plain
    gone = small.where("k <> 'hot'")
    plain = sorted(map(str, big.join(gone, "k", how).collect()))
    assert sorted(map(str, skew.skew_join(big, gone, ["k"], F.col("id"), how, min_rows=100, unique=True).collect())) == plain
