import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from judgespark.llm import mixing
from llm.helpers import DOCS, SF_DIR


def brute_targets(words):
    """Share by weight, cut at three times the size, share out what is over, and so on."""
    names = sorted((s for s in words if s is not None), key=lambda s: s.encode()) + [s for s in words if s is None]
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, open_ = {}, set(names)
    left = sum(words.values())
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * words[s]}
        if not over:
            target.update(share)
            break
        for s in over:
            target[s] = 3 * words[s]
            left -= target[s]
        open_ -= over
    return target


def check(spark, rows, **options):
    df = spark.createDataFrame([(i, t, None, s, None) for i, t, s in rows], DOCS)
    got = mixing.mixture(df, **options).collect()
    assert len(got) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    words, source = Counter(), {}
    for i, t, s in rows:
        words[s] += size(t)
        source[i] = s
    target, taken = brute_targets(words), Counter()
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == words[s] and r.target == pytest.approx(target[s], abs=1e-6)
        assert 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    for s in words:
        assert abs(taken[s] - target[s]) <= 0.5 + 1e-6, s
    return got


def test_sources(spark):
    rows = [(i, "w " * (i % 37), f"s{i % 7}") for i in range(400)] + [(1000 + i, "x y z", None) for i in range(20)]
    rows += [(2000, None, "é"), (2001, "a " * 9000, "Z"), (2002, "", "s1"), (2003, "a", "tiny"), (2004, "b\x0bc\x1fd", "z")]
    one = check(spark, rows, block_words=300, shard_draws=4)
    two = check(spark, rows[::-1], block_words=300, shard_draws=4)
    key = lambda rs: {r.doc_id: (r.taken, [tuple(c) for c in r.copies]) for r in rs}
    assert key(one) == key(two)


def test_shards_are_disjoint_draws_of_equal_number(spark):
    rows = [(i, "w " * 50, f"s{i % 4}") for i in range(600)]
    got = check(spark, rows, block_words=500, shard_draws=8)
    load = defaultdict(int)
    for r in got:
        for c in r.copies:
            load[c.shard] += c.words
    assert len(load) > 4 and max(load.values()) < 3 * min(load.values())


def test_tree_splits_exactly():
    quota = np.array([7, 0, 100, 13, 1])
    leaves = list(mixing.split_quotas(quota, 9, 0, 9, 5))
    assert sorted(s for s, _, _ in leaves) == list(range(9))
    assert (sum(own for _, _, own in leaves) == quota).all()
    for shard, before, own in leaves:
        assert own.sum() in (121 // 9, 121 // 9 + 1)
        assert (before == sum((o for s, _, o in leaves if s < shard), np.zeros(5, int))).all()
    assert {s: o.tolist() for s, _, o in leaves if 3 <= s < 6} == {s: o.tolist() for s, _, o in mixing.split_quotas(quota, 9, 3, 6, 5)}


def test_tree_is_hypergeometric():
    quota, counts = np.array([30, 10]), []
    for seed in range(400):
        counts.append(next(iter(mixing.split_quotas(quota, 4, 0, 1, seed)))[2][0])
    assert abs(np.mean(counts) - 7.5) < 0.3 and abs(np.var(counts) - 10 * 0.75 * 0.25 * 30 / 39) < 0.5


def test_mixed_rows_take_effect(spark):
    rows = [(i, f"d{i} " * 10, None, "a" if i < 90 else "b", None) for i in range(100)]
    df = spark.createDataFrame(rows, DOCS).withColumn("size", F.lit("x")).withColumn("words", F.lit("y"))
    out = mixing.mixed(df, block_words=100, shard_draws=4).collect()
    words = Counter()
    for r in out:
        words[r.source] += len(r.text.split())
    assert words == {"a": 700, "b": 300} and {r.size for r in out} == {"x"}
    places = [(r._shard, r._place) for r in out]
    assert len(set(places)) == len(out)


def test_repeats_nulls_and_empty_table(spark):
    check(spark, [(1, "a b", "s"), (1, "a b", "s"), (None, "a", "s")])
    assert mixing.mixture(spark.createDataFrame([], DOCS)).count() == 0
    got = mixing.mixture(spark.createDataFrame([(1, None, None, None, None)], DOCS)).collect()
    assert (got[0].size, got[0].target, got[0].taken) == (0, 0.0, 0)


def test_sample(spark):
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    assert not any(math.isnan(r.target) for r in check(spark, rows))
