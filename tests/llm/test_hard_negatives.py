import math
import random
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from judgespark.llm import hard_negatives as hn
from judgespark.llm.queries import op12

SCHEMA = "vec_id long, embedding array<double>, label int"
COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def brute(rows, anchor=lambda i: i % 100 == 0):
    good = []
    for place, (i, vector, label) in enumerate(rows):
        if i is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        good.append((i, place, label, [math.floor(Fraction(x) * 256) for x in vector]))
    out = []
    for a in good:
        if not anchor(a[0]):
            continue
        scored = [(-sum(x * y for x, y in zip(a[3], b[3])), b[0], b[1], b[2]) for b in good if b[1] != a[1] and len(b[3]) == len(a[3])]
        scored.sort()
        for p in [s for s in scored if s[3] == a[2]][:5]:
            near = [s for s in scored if s[3] != a[2] and 80 * -p[0] <= 100 * -s[0] <= 100 * -p[0]]
            out += [(a[0], p[1], r + 1, n[1], -p[0], -n[0]) for r, n in enumerate(near[:5])]
    long = lambda s: s if -(2**63) <= s < 2**63 else None
    return sorted(((*r[:4], long(r[4]), long(r[5])) for r in out), key=str)


def found(spark, rows, anchor="id % 100 = 0"):
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1).withColumns({"score": F.lit("x"), "_group": F.lit(1), "anchor": F.lit("y")})
    held = hn.eligible(df, "vec_id", "embedding", F.col("label"))
    return sorted((tuple(r[c] for c in COLUMNS) for r in hn.mine(held, F.expr(anchor)).collect()), key=str)


@pytest.mark.parametrize("sf", ["0.001", "0.1"])
def test_query_equals_brute_force(spark, sf):
    sf_dir = f"/root/testdata/sf{sf}"
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = sorted((tuple(r[c] for c in COLUMNS) for r in op12(spark, sf_dir).collect()), key=str)
    assert got and got == brute(rows)


def test_many_groups_ties_and_a_hot_label(spark, monkeypatch):
    monkeypatch.setattr(hn, "GROUP_ROWS", 37)
    rng = random.Random(3)
    rows = [(i, [rng.randint(-2, 2) / 4 for _ in range(3)], 0 if rng.random() < 0.5 else rng.randint(0, 3)) for i in range(700)]
    assert found(spark, rows) == brute(rows)


@pytest.mark.parametrize("size", [1e-30, 3e4, 1e6, 1e20, 1e300])
def test_any_magnitude(spark, size):
    rng = random.Random(4)
    rows = [(i, [rng.choice([-1, 1, 2, 0.5]) * size * rng.random() for _ in range(4)], i % 3) for i in range(60)]
    assert found(spark, rows, "id % 5 = 0") == brute(rows, lambda i: i % 5 == 0)


def test_unusable_rows_lengths_and_repeated_ids(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 1), (1, [1.0, 0.5], 1), (2, [1.0, 0.5], 2), (3, [1.0, 0.4], 2), (100, None, 1), (200, [1.0, None], 1), (300, [nan, 1.0], 1),
            (400, [inf, 1.0], 1), (500, [1.0, 0.5], None), (None, [1.0, 0.5], 1), (600, [1.0], 1), (601, [1.0], 2), (602, [1.0], 1), (0, [1.0, 0.5], 1),
            (0, [0.9, 0.5], 2), (700, [], 1), (701, [], 1), (702, [], 2), (800, [-1.0, 2.0], 5), (900, [0.0, 0.0], 6), (901, [0.0, 0.0], 6)]
    got = found(spark, rows)
    assert got == brute(rows)
    assert (700, 701, 1, 702, 0, 0) in got


def test_empty_tables(spark):
    assert found(spark, []) == []
    assert found(spark, [(0, [1.0], 1)]) == []
    assert found(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []  # no anchors


@settings(max_examples=200, deadline=None)
@given(st.data())
def test_fields_hold_exact_products(data):
    dim, bits = data.draw(st.integers(1, 9)), data.draw(st.integers(1, 70))
    value = st.integers(-(1 << bits), 1 << bits)
    a = data.draw(st.lists(st.lists(value, min_size=dim, max_size=dim), min_size=1, max_size=4))
    c = data.draw(st.lists(st.lists(value, min_size=dim, max_size=dim), min_size=1, max_size=40))
    wide = hn.fields_needed(dim, 1 << bits)
    kind = object if wide else np.float64
    packed = hn.Packed(np.array(c, kind), 1 << bits)
    assert packed.wide == wide and packed.fields * packed.bits <= 53 or wide
    want = [[sum(x * y for x, y in zip(p, q)) for q in c] for p in a]
    assert packed.scores(np.array(a, kind)).tolist() == want


def test_several_rows_share_one_wide_integer():
    values = np.arange(-320, 320, dtype=np.float64).reshape(10, 64) / 2 // 1
    packed = hn.Packed(values, 160)
    assert packed.fields == 2 and packed.packed.shape == (5, 64)


def test_keys_sort_like_scores():
    scores = [-(2**70), -1, 0, 1, 5, 2**70]
    held = hn.keys(scores, 10)
    assert held == sorted(held) and hn.of_keys(held, 10) == scores
