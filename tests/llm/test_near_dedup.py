import random
import re

import pytest
from pyspark.sql import functions as F

from judgespark.llm.components import components
from judgespark.llm import near_dedup
from judgespark.llm.near_dedup import near_groups
from llm.helpers import DOCS, alike_modulo_powers_of_two, by_id, docs, sample_texts


def shingles(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def brute(texts, percent=85):
    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = [i for i in sorted(sets) if sets[i]]
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in texts}


def check(spark, texts):
    texts = dict(enumerate(texts)) if isinstance(texts, list) else texts
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_groups(docs(spark, texts)).collect()}
    assert got == brute(texts)
    return got


def test_edges(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(9999)}" for _ in range(300)]
    near = base.copy()
    near[5] = "x"
    texts = [None, "", " \n\t", "a b", "A B", "a b c d e", "a\x0bb\x0cc\rd\ne", " ".join(base), " ".join(base).upper(),
             " ".join(near), "x " * 9, "x " * 400, " ".join(base * 40), "É b", "é b"]
    got = check(spark, texts)
    assert got[9][1] == 7 and got[4][1] == 3 and got[11][1] == 10


def test_sample(spark):
    check(spark, sample_texts())


def test_chain_and_spread_group(spark):
    """Copies at many distances: hubs alone do not find all links."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(9999)}" for _ in range(200)]
    texts = []
    for edits in list(range(0, 12)) * 12:
        t = base.copy()
        for _ in range(edits):
            t[rng.randrange(200)] = f"e{rng.randrange(9**6)}"
        texts.append(" ".join(t))
    chain = base.copy()
    for i in range(40):
        chain[(i * 5) % 200] = f"c{i}"
        texts.append(" ".join(chain))
    rng.shuffle(texts)
    got = check(spark, texts)
    assert len({c for _, c in got.values()}) > 3


def test_many_copies_and_rows(spark):
    texts = ["one two three four five six"] * 2500 + [f"t{i} a b c d e" for i in range(300)]
    out = near_groups(docs(spark, texts)).where("component_id = 0")
    assert out.count() == 2500 and out.where("kept").count() == 1


def test_repeats_nulls_clashing_columns_and_empty_table(spark):
    rows = [(1, "a b c", None, None, None)] * 2 + [(None, "a b c", None, None, None)]
    df = spark.createDataFrame(rows, DOCS).withColumn("digest", F.lit(1)).withColumn("rows", F.lit(1))
    assert sorted((r.doc_id or 0, r.component_id) for r in near_groups(df).collect()) == [(0, None), (1, 1), (1, 1)]
    assert near_groups(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 60])
def test_components(spark, n):
    rng = random.Random(n)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(n)] + [(100 + i, 101 + i) for i in range(n)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def test_words_of_one_pattern_are_told_apart(spark):
    a, b = alike_modulo_powers_of_two()
    got = by_id(near_dedup.near_groups(docs(spark, [a, b, a])))
    assert [got[i]["component_id"] for i in range(3)] == [0, 1, 0]


def test_bands_miss_a_pair_at_the_threshold_once_in_a_million():
    for percent in (60, 80, 85, 95):
        assert (1 - (percent / 100) ** near_dedup.BAND_ROWS) ** near_dedup.bands_for(percent) <= near_dedup.MISS
