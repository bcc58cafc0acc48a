import numpy as np
import pytest
from pyspark.sql import functions as F

from judgespark.llm import quality
from judgespark.llm.queries import hash_of_id, op3
from llm.helpers import DOCS, docs

SF = "/root/testdata/sf0.01"


def brute_votes(space, vectors, k):
    out = []
    for v in vectors.astype(np.float64):
        near = space.vectors.astype(np.float64) @ v
        top = np.argsort(-near)[:k]
        w = np.maximum(near[top], 0) ** quality.SHARPNESS
        out.append((w * space.labels[top]).sum() / w.sum() if w.sum() > 1e-9 else space.labels.mean())
    return np.array(out)


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in op3(spark, SF).collect()}
    labels = [(r.quality, got[r.doc_id]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    held = [(q, r) for q, r in labels if r.held_out]
    right = sum(q == r.predicted for q, r in held)
    assert right >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values()) and len(got) == 1000
    assert not any(r.predicted == 0 for q, r in held if q == 1)


def test_labels_of_held_out_rows_are_not_used(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet").withColumnRenamed("quality", "label")
    one = quality.learn(df, labels.where(hash_of_id(5) != 0))
    turned = labels.withColumn("label", F.when(hash_of_id(5) == 0, 1 - F.col("label")).otherwise(F.col("label")))
    two = quality.learn(df, turned.where(hash_of_id(5) != 0))
    assert len(one.labels) == len(two.labels) and one.labels.sum() == two.labels.sum()


def test_votes_equal_brute_force():
    rng = np.random.default_rng(0)
    unit = lambda n: (lambda x: x / np.linalg.norm(x, axis=1, keepdims=True))(rng.standard_normal((n, 6))).astype(np.float32)
    space = quality.Space(np.ones(1), np.ones((1, 6)), unit(90), rng.integers(0, 2, 90).astype(float))
    vectors = np.concatenate([unit(700), np.zeros((1, 6), np.float32)])
    assert space.vote(vectors, 7) == pytest.approx(brute_votes(space, vectors, 7), abs=1e-5)
    assert space.vote(vectors[:3], 500) == pytest.approx(brute_votes(space, vectors[:3], 500), abs=1e-5)


def test_sample_is_bounded(spark):
    df = docs(spark, [f"w{i} text" for i in range(50)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, label int")
    assert len(quality.learn(df, labels, fit_docs=20).labels) == 20


def test_nulls_empty_and_long_texts_repeats_clashes_and_empty_tables(spark):
    texts = [None, "", "a " * 60_000, "A|b !!", "plain words here"]
    df = docs(spark, texts).withColumn("label", F.lit("x")).withColumn("weights", F.lit(1))
    df = df.unionByName(df)
    labels = spark.createDataFrame([(4, 1), (3, 0), (3, None), (None, 1), (99, 1), (0, 1)], "doc_id long, label int")
    space = quality.learn(df.distinct(), labels)
    assert sorted(space.labels) == [0.0, 1.0]
    got = quality.scores(df, space).collect()
    assert len(got) == 10 and {r._score for r in got if not r.text} == {0.5} and {r.label for r in got} == {"x"}
    none = quality.learn(df, labels.where("false"))
    assert {r._score for r in quality.scores(df, none).collect()} == {0.5}
    assert quality.scores(spark.createDataFrame([], DOCS), space).count() == 0


def test_sample_is_bounded_where_an_id_repeats(spark):
    df = docs(spark, {1: "some words here"}).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(3000)))).drop("k").repartition(4)
    df = df.unionByName(docs(spark, {2: "other words there"}))
    labels = spark.createDataFrame([(1, 0), (2, 1)] + [(1, 0)] * 30, "doc_id long, label int")
    assert sorted(quality.learn(df, labels, fit_docs=20).labels) == [0.0, 1.0]
