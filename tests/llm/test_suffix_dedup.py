import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from judgespark.llm import suffix_array, suffix_dedup
from llm.helpers import DOCS, docs, sample_texts


def brute(texts, width):
    seen, out = set(), {}
    for i in sorted(texts):
        raw = (texts[i] or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for p in range(len(raw) - width + 1):
            key = raw[p : p + width]
            if key in seen:
                gone[p : p + width] = True
            seen.add(key)
        gone = gone[:-1]
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out[i] = (len(raw), int(gone.sum()), spans, bytes(np.frombuffer(raw, np.uint8)[~gone]))
    return out


def check(spark, texts, width=100, parts=2):
    texts = dict(enumerate(texts)) if isinstance(texts, list) else texts
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    rows = docs(spark, texts).repartition(parts).checkpoint()
    got = suffix_dedup.remove_repeats(rows, width).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got} == brute(texts, width)


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=300).map(lambda b: bytes(x % 3 for x in b)), st.integers(8, 40))
def test_suffix_array_and_copies(raw, width):
    data = np.frombuffer(raw, np.uint8)
    order, near = suffix_array.suffix_array(data, width)
    assert [raw[i : i + width] for i in order] == sorted(raw[i : i + width] for i in range(len(raw)))
    got = suffix_array.common_prefixes(data, order[near], order[near - 1], width)
    for n, a, b in zip(got, order[near], order[near - 1]):
        same = next((i for i in range(len(raw)) if raw[a + i : a + i + 1] != raw[b + i : b + i + 1] or not raw[a + i : a + i + 1]), len(raw))
        assert min(n, width) == min(same, width)
    late = suffix_array.later_copies(data, np.arange(len(raw)) + width <= len(raw), width)
    seen = set()
    for p in range(len(raw) - width + 1):
        assert late[p] == (raw[p : p + width] in seen)
        seen.add(raw[p : p + width])


def test_sample(spark):
    check(spark, sample_texts(), parts=5)


@pytest.mark.parametrize("width,letters", [(100, 26), (30, 2)])
def test_passages(spark, width, letters):
    rng = random.Random(width)
    texts = []
    for _ in range(80):
        t = "".join(chr(97 + rng.randrange(letters)) for _ in range(rng.randrange(0, 400)))
        for _ in range(rng.randrange(3)):
            if texts:
                other = rng.choice(texts)
                a = rng.randrange(len(other) + 1)
                t = t[: len(t) // 2] + other[a : a + rng.randrange(0, 250)] + t[len(t) // 2 :]
        texts.append(t + "xy" * rng.randrange(0, 100) * (rng.random() < 0.2))
    check(spark, texts, width, parts=6)


def test_edges(spark):
    rng = random.Random(1)
    text = "".join(rng.choice("abcdéß€ ") for _ in range(400))
    check(spark, [None, "", text[:40], text, "q" + text[:150], text + text, "é" * 3000, "ab" * 5000, text[100:260] + "z" + text[:99]])


def test_null_ids_come_last_repeats_and_empty_table(spark):
    text = "".join(f"{i}," for i in range(60))
    rows = [(None, text, None, None, None), (7, text, None, None, None), (7, text, None, None, None)]
    df = spark.createDataFrame(rows, DOCS).coalesce(1).withColumn("k", F.lit(1)).withColumn("kept", F.lit("x"))
    got = sorted((r.doc_id or 0, r.n_removed) for r in suffix_dedup.remove_repeats(df).collect())
    assert got == [(0, len(text)), (7, 0), (7, len(text))]
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0
