import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from judgespark.llm import common, hmm
from judgespark.llm.queries import hash_of_id
from llm.helpers import DOCS, alike_modulo_powers_of_two, docs, sample_texts


def model(symbols, states, seed=0):
    rng = np.random.default_rng(seed)
    one = lambda *s: (lambda x: x / x.sum(-1, keepdims=True))(rng.random(s) + 0.05)
    return hmm.Model(one(states), one(states), one(states, states), one(states, symbols).T.copy())


def paths(m, symbol, begins=True):
    """Every path of states with its probability together with the symbols."""
    prior = m.start if begins else m.any
    for path in itertools.product(range(len(prior)), repeat=len(symbol)):
        p = prior[path[0]] * m.emit[symbol[0], path[0]]
        for (a, b), s in zip(zip(path, path[1:]), symbol[1:]):
            p *= m.follow[a, b] * m.emit[s, b]
        yield path, p


def test_forward_is_exact():
    m = model(4, 3)
    seqs = [[0], [3, 1, 2], [1, 1, 1, 1, 2], [2, 0], [0, 1, 2, 3, 0, 1]]
    first = np.concatenate([[0], np.cumsum([len(s) for s in seqs])])
    got = hmm.log_likelihoods(m, np.concatenate(seqs), first)
    want = [math.log(sum(p for _, p in paths(m, s))) for s in seqs]
    assert got == pytest.approx(want, rel=1e-12)


def test_likelihoods_of_a_length_sum_to_one():
    m = model(3, 2)
    seqs = np.array(list(itertools.product(range(3), repeat=4)))
    got = hmm.log_likelihoods(m, seqs.ravel(), np.arange(len(seqs) + 1) * 4)
    assert np.exp(got).sum() == pytest.approx(1)


def test_long_sequence_does_not_underflow():
    m = model(5, 3)
    got = hmm.log_likelihoods(m, np.zeros(20_000, int), np.array([0, 20_000]))
    assert np.isfinite(got).all() and got[0] < -1000


def test_expected_counts_are_exact():
    m = model(4, 3, 2)
    seqs, begins = [[0], [3, 1, 2], [1, 1, 2, 0], [2, 0]], [True, False, True, False]
    first = np.concatenate([[0], np.cumsum([len(s) for s in seqs])])
    got, log = hmm.expected_counts(m, np.concatenate(seqs), first, np.array(begins))
    want = [np.zeros_like(x) for x in m]
    total = 0.0
    for s, b in zip(seqs, begins):
        all_ = list(paths(m, s, b))
        z = sum(p for _, p in all_)
        total += math.log(z)
        for path, p in all_:
            want[0][path[0]] += b * p / z
            for x, y in zip(path, path[1:]):
                want[2][x, y] += p / z
            for x, sym in zip(path, s):
                want[1][x] += p / z
                want[3][sym, x] += p / z
    assert log == pytest.approx(total)
    for g, w in zip(got, want):
        assert g == pytest.approx(w)


def test_training_raises_likelihood():
    rng = np.random.default_rng(3)
    seqs = [np.tile([0, 1, 2] if rng.random() < 0.5 else [3, 4, 5], 10) for _ in range(40)]
    symbol, first = np.concatenate(seqs), np.arange(41) * 30
    m, base, logs = model(6, 3), np.full(6, 1 / 6), []
    for _ in range(12):
        counts, log = hmm.expected_counts(m, symbol, first, np.ones(40, bool))
        logs.append(log)
        m = hmm.from_counts(counts, base)
    assert all(b > a - 1e-6 for a, b in zip(logs, logs[1:])) and logs[-1] > logs[0] + 200


def brute_base(texts):
    tokens = {i: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) + [None] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    c = Counter(x for i, w in tokens.items() if not held[i] for x in w)
    n, v = sum(c.values()), len(c)
    return {
        i: (held[i], len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w))
        for i, w in tokens.items()
    }


def check(spark, texts):
    got = {r.doc_id: r for r in hmm.scores(docs(spark, texts), hash_of_id(7) != 2).collect()}
    for i, (held, n, known, total, base) in brute_base(texts).items():
        r = got[i]
        assert (r.trained, r.n_tokens, r.n_known, r.train_tokens) == (not held, n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9) and math.isfinite(r.score) and r.score < 0
    return got


def test_scores_equal_a_plain_forward_recursion(spark, monkeypatch):
    """The whole score, shares inside classes included, token by token from the model that was trained."""
    texts, seen, train = {i: f"the w{i % 9} w{i % 50} x{i} the É{i % 7}" for i in range(150)} | {150: None, 151: "the " * 3000}, [], hmm.train
    monkeypatch.setattr(hmm, "train", lambda rows, vocab, *a: seen.append((vocab, train(rows, vocab, *a))) or seen[0][1])
    got = {r.doc_id: r.score for r in hmm.scores(docs(spark, texts), hash_of_id(7) != 2).collect()}
    (vocab, m), data = seen[0], {i: (t or "").encode() for i, t in texts.items()}
    parts = {i: hmm.tokens(np.frombuffer(d, np.uint8), np.array([0, len(d)])) for i, d in data.items()}
    n = Counter(h for i, t in parts.items() if zlib.crc32(str(i).encode()) % 7 != 2 for h in t.hash.tolist())
    kind = {h: k for t in parts.values() for h, k in zip(t.hash.tolist(), t.kind.tolist())}
    own = {h for h in n if n[h] > max(sum(n.values()) * hmm.SYMBOL_SHARE, hmm.SYMBOL_LEAST - 1)}
    mass = dict.fromkeys(range(hmm.CLASSES), 1)
    for h in n.keys() - own:
        mass[kind[h]] += n[h] + 1
    for i, t in parts.items():
        state, log = m.start, 0.0
        for at, (h, s) in enumerate(zip(t.hash.tolist(), vocab.look_up(t)[0].tolist())):
            assert (s < vocab.symbols) == (h in own)
            state = (state if not at else state @ m.follow) * m.emit[s] * (1 if h in own else (n[h] + 1) / mass[kind[h]])
            log, state = log + math.log10(state.sum()), state / state.sum()
        assert got[i] == pytest.approx(log, rel=1e-9)


def test_sample_beats_the_base_on_held_out_texts(spark):
    got = check(spark, sample_texts())
    held = [r for r in got.values() if not r.trained]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_edges(spark):
    check(spark, dict(enumerate([None, "", "a", "A\x0bB c", "É é", "x " * 5000, "\x1fq", "a b " * 3, "new words only"] * 2)))


def test_rare_words_meet_their_counts_in_the_shuffle(spark, monkeypatch):
    monkeypatch.setattr(hmm, "KNOWN_SHARE", 0.01)
    monkeypatch.setattr(hmm, "SYMBOL_SHARE", 0.05)
    check(spark, {i: f"the w{i % 9} w{i % 50} x{i} the" for i in range(300)})


def test_no_training_rows_repeats_nulls_and_empty_table(spark):
    rows = [(5, "a b", None, None, None), (5, "a b", None, None, None), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, DOCS).withColumn("word", F.lit(1)).withColumn("score", F.lit("x"))
    assert hmm.scores(df, F.lit(True)).count() == 3
    none = hmm.scores(df, F.lit(False)).collect()
    assert {r.n_known for r in none} == {0} and {r.train_tokens for r in none} == {0} and {r.base_score for r in none} == {0.0}
    assert hmm.scores(spark.createDataFrame([], DOCS), F.lit(True)).count() == 0


def test_training_settles_on_all_texts(spark):
    """A rare kind of texts, too few to be in any sample, is learned too: another round gains next to nothing."""
    rng = np.random.default_rng(4)
    usual = [" ".join(rng.choice(["a", "b", "c", "d"], 12)) for _ in range(2000)]
    rare = ["u v w x y z " * 60] * 12
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(usual + rare)], "_order long, text string")
    counted = texts.select("text").mapInArrow(hmm._counts, "word long, n long, kind int")
    vocab = hmm.vocabulary(counted.groupBy("word").agg(F.sum("n").alias("n"), F.min("kind").alias("kind")))
    m, logs = hmm.train(texts, vocab), []
    data = [t.encode() for t in usual + rare]
    t = hmm.tokens(np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in data])]))
    for _ in range(2):
        counts, log = hmm.expected_counts(m, vocab.look_up(t)[0], *hmm._stretches(t, hmm.STRETCH))
        m = hmm.from_counts(counts, vocab.base())
        logs.append(log)
    assert logs[1] - logs[0] <= 2 * 1e-3 * abs(logs[0])


def test_words_of_one_pattern_are_told_apart(spark):
    a, b = alike_modulo_powers_of_two()
    got = {r.doc_id: r for r in hmm.scores(docs(spark, {1: f"{a} x", 2: f"{b} x"}), F.col("doc_id") == 1).collect()}
    assert (got[1].n_known, got[2].n_known) == (3, 2)


def test_names_of_words():
    words_ = [bytes([97 + i % 3]) * n for i in range(3) for n in (1, 7, 8, 9, 16, 63, 64, 65, 500)] + [b"ab\0", b"ab", b"ab\0\0"]
    data = np.frombuffer(b" ".join(words_), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words_]) - 1
    starts = ends - [len(w) for w in words_]
    one, two = (common.word_hashes(data, starts, ends, k) for k in (0, 1))
    assert len(set(one.tolist())) == len(set(words_)) and not set(one.tolist()) & set(two.tolist())
    assert (common.word_hashes(data[5:], starts[9:] - 5, ends[9:] - 5) == one[9:]).all()
    assert len(common.word_hashes(data[:0], starts[:0], ends[:0])) == 0


def test_rescaling_every_few_times_keeps_long_and_improbable_texts():
    rng = np.random.default_rng(3)
    emit = rng.random((40, 3)) * 10.0 ** -rng.integers(0, 30, (40, 1))  # eight in a row are far below a float's least
    follow = rng.random((3, 3))
    model = hmm.Model(np.full(3, 1 / 3), np.full(3, 1 / 3), follow / follow.sum(1, keepdims=True), emit)
    sizes = np.array([1, 700, 3, 8, 9, 16, 700, 1])
    first = np.append(0, np.cumsum(sizes))
    symbol = rng.integers(0, 40, first[-1])
    got = hmm.log_likelihoods(model, symbol, first)
    for k, (a, b) in enumerate(zip(first[:-1], first[1:])):
        state, log = model.start * emit[symbol[a]], 0.0
        for s in symbol[a + 1 : b]:
            log, state = log + np.log(state.sum()), (state / state.sum()) @ model.follow * emit[s]
        assert abs(got[k] - log - np.log(state.sum())) < 1e-9 * abs(got[k])
    assert len(hmm.log_likelihoods(model, symbol[:0], np.array([0]))) == 0
