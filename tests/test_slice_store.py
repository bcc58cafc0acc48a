"""Slice reports kept up to date from changes equal those of everything at once."""

import random

import pytest

from judgespark.operators import slices
from judgespark.schema import PILLARS
from judgespark.sources.slice_store import SliceStore

ROWS = (
    "row_index long, record_id string, category string, reviewer_name string, reviewer_id string, intent string, topic string,"
    " model_name string, " + ", ".join(f"label_{p} int" for p in PILLARS)
)
OUTCOMES = "outcome_index long, record_id string, pillar string, result struct<score:int>"


def some_rows(rng, start, n, records):
    pick = lambda *x: rng.choice([*x, None])
    return [
        (start + i, f"r{rng.randrange(records)}", rng.choice("ab"), pick("ann", "bob", ""), pick("1"), pick("x"), pick("t"), pick("m"), *[pick(1, 2, 3, 4, 5) for _ in PILLARS])
        for i in range(n)
    ]


def some_outcomes(rng, start, n, records):
    return [(start + i, f"r{rng.randrange(records + 5)}", rng.choice([*PILLARS, "tone"]), rng.choice([None, *[(s,) for s in range(1, 6)]])) for i in range(n)]


def cells(df):
    return sorted(tuple(r[c] for c in ("dimension", "slice", "pillar", "judge", "human", "n")) for r in df.collect())


def test_changes_add_up(spark, tmp_path):
    rng = random.Random(1)
    store = SliceStore(spark, str(tmp_path / "store"), buckets=4)
    parts = [(some_rows(rng, 100 * c, 30, 40), some_outcomes(rng, 1000 * c, 120, 40)) for c in range(4)]
    parts[1], parts[2] = (parts[2][0], parts[1][1]), (parts[1][0], parts[2][1])  # an earlier row arrives later
    seen_rows, seen_outcomes = [], []
    for change, (rows, outcomes) in enumerate(parts, 1):
        seen_rows += rows
        seen_outcomes += outcomes
        for _ in range(2 if change == 3 else 1):  # made again
            store.apply(change, spark.createDataFrame(rows, ROWS), spark.createDataFrame(outcomes, OUTCOMES))
        whole = slices.slice_crosstab(spark.createDataFrame(seen_rows, ROWS), spark.createDataFrame(seen_outcomes, OUTCOMES))
        assert cells(store.crosstab(change)) == cells(whole)
        if change == 2:
            store.compact()
            assert store._ledger.files() <= 4
    assert sorted(map(str, store.report(4).collect())) == sorted(map(str, slices.sliced_report(whole).collect()))
    store.close()
    again = SliceStore(spark, str(tmp_path / "store"), buckets=4)
    again.apply(5, spark.createDataFrame([], ROWS), spark.createDataFrame([], OUTCOMES))  # nothing new
    assert cells(again.crosstab(5)) == cells(whole)
    again.close()


def test_outcomes_before_rows_and_an_empty_base(spark, tmp_path):
    store = SliceStore(spark, str(tmp_path / "store"), ["category"], ["relevance"], buckets=2)
    none_r, none_o = spark.createDataFrame([], ROWS), spark.createDataFrame([], OUTCOMES)
    store.apply(1, none_r, none_o)
    assert cells(store.crosstab(1)) == []
    store.apply(2, none_r, spark.createDataFrame([(1, "r1", "relevance", (4,))], OUTCOMES))
    assert cells(store.crosstab(2)) == []
    labels = [3] * 6
    store.apply(3, spark.createDataFrame([(7, "r1", "a", None, None, None, None, None, *labels)], ROWS), none_o)
    assert cells(store.crosstab(3)) == [("category", "a", "relevance", 4, 3, 1)]
    store.apply(4, spark.createDataFrame([(8, "r1", "b", None, None, None, None, None, *[5] * 6), (2, "r1", "c", *[None] * 5, *labels)], ROWS), none_o)
    assert cells(store.crosstab(4)) == [("category", "b", "relevance", 4, 5, 1)]  # the old cell is gone
    with pytest.raises(ValueError):
        store.apply(0, none_r, none_o)
    store.close()
