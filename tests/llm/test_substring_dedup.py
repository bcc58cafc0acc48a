import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from judgespark.llm import substring_dedup as sd
from llm.helpers import DOCS, alike_modulo_powers_of_two, docs, sample_texts


def brute(texts, window):
    seen, out = set(), {}
    for i in sorted(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", texts[i] or "")
        gone = set()
        for p in range(len(words) - window + 1):
            key = tuple(words[p : p + window])
            if key in seen:
                gone.update(range(p, p + window))
            seen.add(key)
        out[i] = (len(words), len(gone), " ".join(w for p, w in enumerate(words) if p not in gone))
    return out


def check(spark, texts, window=20, parts=2):
    texts = dict(enumerate(texts)) if isinstance(texts, list) else texts
    rows = docs(spark, texts).repartition(parts).checkpoint() if parts > 1 else docs(spark, texts)
    got = {r.doc_id: (r.n_words, r.n_removed, bytes(r.kept).decode()) for r in sd.remove_repeats(rows, window).collect()}
    assert got == brute(texts, window)


@pytest.fixture(autouse=True)
def folder(spark):
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))


def test_sample(spark):
    check(spark, sample_texts())


@pytest.mark.parametrize("window,letters", [(20, 2), (20, 50), (45, 3), (3, 4)])
def test_small_alphabets(spark, window, letters):
    """Runs, periods and repeats at every place, also inside one text."""
    rng = random.Random(window * letters)
    texts = []
    for _ in range(60):
        t = [f"w{rng.randrange(letters)}" for _ in range(rng.randrange(0, 120))]
        if texts and rng.random() < 0.6:
            other = rng.choice(texts).split()
            a = rng.randrange(len(other) + 1)
            t[len(t) // 2 : len(t) // 2] = other[a : a + rng.randrange(0, 60)]
        if rng.random() < 0.3:
            t += ["run"] * rng.randrange(0, 70)
        texts.append(" ".join(t))
    check(spark, texts, window)


def test_edges(spark):
    w = [f"w{i}" for i in range(60)]
    check(spark, [None, "", " ".join(w[:19]), " ".join(w[:20]), " ".join(w), "\n".join(w[5:45]), "W0 " + " ".join(w[1:]),
                  " ".join(w * 300), "a" * 50_000, "é x " * 30])


def test_null_ids_come_last_repeats_and_empty_table(spark):
    text = " ".join(f"w{i}" for i in range(25))
    rows = [(None, text, None, None, None), (7, text, None, None, None), (7, text, None, None, None)]
    df = spark.createDataFrame(rows, DOCS).coalesce(1).withColumn("k", F.lit(1)).withColumn("start", F.lit("x"))
    got = sorted((r.doc_id or 0, r.n_removed) for r in sd.remove_repeats(df).collect())
    assert got == [(0, 25), (7, 0), (7, 25)]
    assert sd.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0


def test_hot_passage(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    check(spark, [f"a{i} b{i} {passage} c{i}" for i in range(1500)] + [f"q{i}" for i in range(200)])


@pytest.mark.parametrize("window", [20, 60, 200])
def test_every_plain_window_has_an_anchor(window):
    """The guarantee behind the number of rounds."""
    rng = np.random.default_rng(1)
    for letters in (3, 10_000):
        hashes = sd.mix(rng.integers(0, letters, 5000).astype(np.uint64))
        hashes = hashes[np.concatenate([[True], hashes[1:] != hashes[:-1]])]
        first = np.array([0, len(hashes)])
        parse = sd.Parse(hashes, first, sd.rounds_for(window))
        low, high, key, place = parse.anchors()
        _, _, anchor = sd.pick_anchors(low, high, key, place, window, sd._valid(first, len(parse.words), window))
        if letters > 3:
            assert (anchor >= 0).all()
    assert sd.rounds_for(20) == 1 and sd.rounds_for(200) > 2


def test_words_of_one_pattern_are_told_apart(spark):
    a, b = alike_modulo_powers_of_two()
    rest = [f"w{i}" for i in range(19)]
    check(spark, [" ".join([a, *rest]), " ".join([b, *rest])])
