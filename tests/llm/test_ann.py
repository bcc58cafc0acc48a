import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from judgespark.llm import ann, hnsw
from judgespark.llm.queries import op1

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, queries, k):
    vectors = {i: np.array(v, float) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    out = {}
    for q in queries:
        if q in vectors:
            near = [(math.sqrt(((v - vectors[q]) ** 2).sum()), i) for i, v in vectors.items() if i != q and len(v) == len(vectors[q])]
            out[q] = sorted(near)[:k]
    return out


def found(spark, rows, queries, k=10, **options):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).withColumn("shard", F.lit("x"))
    vectors = ann.usable(df, "vec_id", "embedding")
    got = ann.nearest(ann.build_index(vectors, **options), vectors.where(F.col("id").isin(queries)), k).collect()
    out = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r.rank == len(out[r.query_id])
    return out


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_recall_and_scores(spark, sf):
    sf_dir = f"/root/testdata/sf{sf}"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    want = brute(rows, [i for i, _ in rows if i % 100 == 0], 10)
    hits = 0
    vectors = dict(rows)
    for r in op1(spark, sf_dir).collect():
        hits += r.vec_id in {i for _, i in want[r.query_id]}
        gap = np.array(vectors[r.vec_id], float) - np.array(vectors[r.query_id], float)
        assert r.score == pytest.approx(math.sqrt((gap**2).sum()), rel=1e-14)
    assert hits >= 0.97 * 10 * len(want)


def test_small_tables_are_exact_with_ties_copies_and_many_shards(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(300)] + [(1000 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(200)]
    queries = [0, 7, 299, 1000, 1199]
    assert found(spark, rows, queries, shard_rows=100) == brute(rows, queries, 10)


@pytest.mark.parametrize("exponent", [66, -80, -100, 660, -700])
def test_vectors_of_any_size(spark, exponent):
    rng = np.random.default_rng(6)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(300)]
    scaled = [(i, np.ldexp(v, exponent).tolist()) for i, v in rows]
    queries = list(range(0, 300, 15))
    want = {q: [(math.ldexp(s, exponent), i) for s, i in near] for q, near in brute(rows, queries, 10).items()}
    got = found(spark, scaled, queries)
    assert {q: [i for _, i in near] for q, near in got.items()} == {q: [i for _, i in near] for q, near in want.items()}
    for q in queries:
        assert [s for s, _ in got[q]] == pytest.approx([s for s, _ in want[q]], rel=1e-14, abs=0)


def test_large_and_small_vectors_in_one_table(spark):
    rng = np.random.default_rng(7)
    rows = [(i, (rng.standard_normal(6) * [1e20, 1e-30, 1.0][i % 3]).tolist()) for i in range(300)]
    queries = [0, 1, 2, 150, 151, 152]
    got = found(spark, rows, queries, shard_rows=100)
    assert got == brute(rows, queries, 10)


def test_a_target_far_outside_its_shard(spark):
    rows = [(i, [math.ldexp(1.0 + i, -300), 0.0]) for i in range(20)] + [(100, [math.ldexp(1.0, 500), 1.0])]
    got = found(spark, rows, [100])
    assert len(got[100]) == 10 and all(s == math.ldexp(1.0, 500) for s, _ in got[100])


def test_unusable_vectors_lengths_and_fewer_candidates(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0, None]), (6, [nan, 1.0]), (7, [inf, 1.0]),
            (8, []), (9, [1.0, 1.0, 1.0]), (None, [1.0, 1.0]), (10, [-0.0, 1.0])]
    got = found(spark, rows, list(range(11)))
    assert got == {q: w for q, w in brute(rows, range(11), 10).items() if w}
    assert [i for _, i in got[10]] == [2, 1]


def test_empty_table(spark):
    assert found(spark, [], [1]) == {}
    assert found(spark, [(1, [1.0])], [1]) == {}


def test_repeated_ids(spark):
    assert found(spark, [(1, [1.0, 1.0]), (1, [1.0, 1.0]), (2, [1.0, 2.0]), (2, [1.0, 9.0])], [1]) == {1: [(1.0, 2)]}


def test_all_nodes_can_be_reached():
    rng = np.random.default_rng(4)
    points = np.concatenate([rng.standard_normal((700, 8)) * 0.01 + c for c in rng.standard_normal((4, 8)) * 10])
    level = np.minimum(-np.log(rng.random(len(points))) / np.log(16), 5).astype(int)
    order, graph = hnsw.build(points, level)
    got = hnsw.search(graph, points[order], 32)
    assert (got[:, 0] == np.arange(len(points))).mean() > 0.99


def test_a_wide_beam_finds_every_node_of_far_groups():
    rng = np.random.default_rng(5)
    sizes = np.repeat([1e20, 1e-30, 1.0], 60)[:, None]
    points = np.ldexp(rng.standard_normal((180, 6)) * sizes, -70)
    level = np.minimum(-np.log(rng.random(180)) / np.log(16), 5).astype(int)
    _, graph = hnsw.build(points, level)
    got = hnsw.search(graph, graph.points, 180)
    assert (np.sort(got, axis=1) == np.arange(180)).all()
