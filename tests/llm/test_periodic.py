import hashlib
import random
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from judgespark.llm import periodic
from judgespark.llm.queries import op11
from llm.helpers import DOCS, SF_DIR, by_id, docs, sample_texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words, least=6, times=4):
    """Every lag's maximal stretches; a stretch counts where no shorter lag is a period of it."""
    n, runs = len(words), []
    for q in range(1, n):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            e = i
            while e < n and words[e] == words[e - q]:
                e += 1
            start, length = i - q, e - i + q
            if length >= max(least, times * q):
                part = words[start:e]
                if not any(all(part[k] == part[k - p] for k in range(p, length)) for p in range(1, q)):
                    runs.append((start, length, q))
            i = e
    return sorted(runs, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def periodic_part(words, doc_id):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(doc_id, text):
    words = periodic_part(WORD.findall(text or ""), doc_id)
    runs = brute(words)
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    first = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(runs), *first, sha("".join("%d,%d,%d\n" % r for r in runs)), sha(collapsed(words, runs)))


def test_query_equals_brute_force(spark):
    texts = {i: t for i, t in sample_texts().items() if len(t) < 6000}
    got = by_id(op11(spark, SF_DIR))
    assert len(got) == len(sample_texts())
    columns = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    for i, text in texts.items():
        assert tuple(got[i][c] for c in columns) == expected(i, text), i
    assert sum(r.n_runs > 0 for r in got.values()) > 10


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60), st.integers(2, 9), st.integers(4, 6))
def test_runs_of_few_symbols(symbols, least, times):
    assert periodic.find_runs(np.array(symbols, np.int32), least, times) == brute(symbols, least, times)


def test_runs_within_runs():
    rng = random.Random(5)
    for _ in range(150):
        out = []
        for _ in range(rng.randint(1, 6)):
            unit = [rng.randint(0, 3) for _ in range(rng.randint(1, 20))]
            out += (unit * rng.randint(1, 9))[: rng.randint(1, 150)] + [rng.randint(0, 9)] * rng.randint(0, 2)
        inner = out[: rng.randint(0, 40)]
        out += inner * rng.randint(1, 5)
        assert periodic.find_runs(np.array(out)) == brute(out)


def test_every_lag_has_one_class():
    for least in (2, 6, 40):
        classes = list(periodic.lag_classes(5000, least))
        assert [q for a, b, _ in classes for q in range(a, b + 1)] == list(range(1, 5001))
        for a, b, gram in classes:
            assert gram <= min(max(least - q, 3 * q) for q in range(a, b + 1)) and b <= gram // 2 + 1


def test_one_word_many_times_stays_sparse():
    symbols = np.zeros(300_000, np.int32)
    assert len(periodic.occurrences(symbols)[0]) <= len(symbols)
    assert periodic.find_runs(symbols) == [(0, 300_000, 1)]
    symbols[::7] = 1
    assert periodic.find_runs(symbols)[0] == (0, 300_000, 7)


def test_thue_morse_words_and_equal_prefixes(spark):
    word = "a"
    while len(word) < 1024:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    row = by_id(periodic.collapse(docs(spark, [" ".join([word, other] * 4), " ".join([word] * 5 + [other])])))
    assert [tuple(r) for r in row[0].runs] == [(0, 8, 2)] and row[0].collapsed == f"{word} {other}"
    assert row[1].runs == []  # five of one word are too few


def test_edges(spark):
    texts = [None, "", " \n\t ", "a", "a " * 6, "x " * 5, "a b " * 4, "é é " * 6 + "z", "\x0b".join("ab" * 4), "a a a a a a b b b b b b"]
    got = by_id(periodic.collapse(docs(spark, texts)))
    assert [got[i].n_words for i in range(len(texts))] == [0, 0, 0, 1, 6, 5, 8, 7, 8, 12]
    assert [got[i].collapsed for i in range(len(texts))] == ["", "", "", "a", "a", "x x x x x", "a b", "é é z", "a b", "a b"]
    assert [tuple(r) for r in got[9].runs] == [(0, 6, 1), (6, 6, 1)]


def test_repeats_nulls_clashing_columns_and_empty_table(spark):
    rows = [(1, "a " * 9, None, None, None)] * 2 + [(None, "b " * 9, None, None, None)]
    df = spark.createDataFrame(rows, DOCS).withColumns({"runs": F.lit(1), "collapsed": F.lit("x"), "n_words": F.lit(0)})
    assert sorted((str(r.doc_id), r.collapsed, len(r.runs)) for r in periodic.collapse(df).collect()) == [("1", "a", 1), ("1", "a", 1), ("None", "b", 1)]
    assert periodic.collapse(spark.createDataFrame([], DOCS)).count() == 0


def test_long_text(spark):
    text = "the cat sat " * 200_000 + "end"
    row = by_id(periodic.collapse(docs(spark, [text])))[0]
    assert [tuple(r) for r in row.runs] == [(0, 600_000, 3)] and row.collapsed == "the cat sat end"
