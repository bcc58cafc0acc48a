import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from judgespark.llm import byte_tokens, genetic_packing
from judgespark.llm.genetic_packing import Problem
from judgespark.llm.queries import byte_bpe, op13
from llm.helpers import DOCS, SF_DIR, docs, sample_texts


def check(rows, texts, window=2048, repeats=1):
    """Each id in one piece, only long documents cut, checksums right, windows gapless and not too long. Gives (windows, tokens)."""
    tokenizer = Tokenizer.from_file(byte_bpe())
    own, windows, tokens = defaultdict(list), defaultdict(list), 0
    for r in rows:
        own[r.doc_id].append(r)
        windows[r.sequence_id].append(r)
    assert set(own) == set(texts)
    for i, text in texts.items():
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        n = -(-len(ids) // window)
        lengths = [len(ids) - (n - 1) * window] + [window] * (n - 1)
        starts = np.cumsum([0] + lengths[:-1]).tolist()
        want = [(p, s, m, zlib.crc32(ids[s : s + m].tobytes())) for p, (s, m) in enumerate(zip(starts, lengths))] * repeats
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in own[i]) == sorted(want), i
        tokens += len(ids) * repeats
    for held in windows.values():
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
    return len(windows), tokens


def test_sample_needs_no_window_more_than_its_tokens(spark):
    n, tokens = check(op13(spark, SF_DIR).collect(), sample_texts())
    assert n <= -(-tokens // 2048) + 1


def test_several_shards_islands_and_epochs(spark):
    texts = sample_texts()
    out = genetic_packing.pack(docs(spark, texts).repartition(3), byte_bpe(), window=700, shard_pieces=60)
    n, tokens = check(out.collect(), texts, window=700)
    assert n <= 1.1 * tokens / 700
    assert sorted(map(str, out.collect())) == sorted(map(str, out.collect()))


def test_edges(spark):
    texts = dict(enumerate([None, "", " \n", "a b c", "<|endoftext|> x<|endoftext|>  y", "é ́x \x1cq\x1f  z", "word " * 30_000, "x" * 9000, "  two", "end ", "　 a", "a　 b", "don't  I'LL\n\n we've"]))
    check(genetic_packing.pack(docs(spark, texts), byte_bpe()).collect(), texts)


def test_repeats_nulls_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b c", None, None, None)] * 2, DOCS).withColumns({"item": F.lit("x"), "shard": F.lit(3), "length": F.lit(0)})
    check(genetic_packing.pack(df, byte_bpe()).collect(), {1: "a b c"}, repeats=2)
    assert genetic_packing.pack(spark.createDataFrame([(None, None, None, None, None)], DOCS), byte_bpe()).count() == 1
    assert genetic_packing.pack(spark.createDataFrame([], DOCS), byte_bpe()).count() == 0


def test_exactly_full_documents(spark):
    tokenizer = Tokenizer.from_file(byte_bpe())
    texts = {n: " word" * (n - 1) for n in (1, 2047, 2048, 2049, 4096, 4097)}
    assert all(len(tokenizer.encode(t).ids) == n - 1 for n, t in texts.items())
    rows = genetic_packing.pack(docs(spark, texts), byte_bpe()).collect()
    check(rows, texts)
    assert [r.length for r in sorted((r for r in rows if r.doc_id == 4097), key=lambda r: r.piece)] == [1, 2048, 2048]


@settings(max_examples=500, deadline=None)
@given(st.text(st.sampled_from([*" \n\tabcXYZ'stdllre09,.!<|>éßÀ× 　 \x1c\x85ωя²ªn_"]), max_size=60))
def test_encoder_equals_the_tokenizer(text):
    got = byte_tokens.Encoder.of(byte_bpe(), 0)(text).tolist()
    assert got == _tokenizer().encode(text, add_special_tokens=False).ids + [0]


def _tokenizer(held=[]):  # noqa: B006
    if not held:
        held.append(Tokenizer.from_file(byte_bpe()))
    return held[0]


def valid(problem, bins):
    assert sorted(i for b in bins for i in b) == list(range(len(problem.sizes)))
    assert all(0 < problem.load(b) <= problem.window for b in bins)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 99), min_size=1, max_size=60), st.integers(0, 99))
def test_crossover_and_mutation_keep_every_document_once(sizes, seed):
    problem, rng = Problem(sizes, 100), random.Random(seed)
    population = problem.first(4, rng)
    population += [problem.best_fit([], rng.sample(range(len(sizes)), len(sizes))) for _ in range(2)]
    for bins in population:
        valid(problem, bins)
        valid(problem, problem.mutate(bins, rng))
    child = problem.crossover(population[0], population[-1], rng)
    valid(problem, child)
    assert genetic_packing.decoded(genetic_packing.coded(child, len(sizes))) == [tuple(sorted(b)) for b in child]
    assert problem.quality(problem.evolve(population, 4, 3, rng)[0]) <= min(map(problem.quality, population))


def test_crossover_injects_whole_full_bins():
    problem, rng = Problem([60, 40, 50, 50, 70, 20], 100), random.Random(1)
    giver = [(0, 1), (2, 3), (4, 5)]
    child = problem.crossover([(0,), (1, 2), (3, 5), (4,)], giver, rng)
    assert any(b in child for b in giver[:2])


@pytest.mark.parametrize("seed", range(3))
def test_evolution_is_no_worse_than_best_fit_decreasing(seed):
    rng = random.Random(seed)
    cuts = [sorted(rng.sample(range(1, 1000), 2)) for _ in range(60)]  # sixty full bins, cut in three
    problem = Problem([n for a, b in cuts for n in (a, b - a, 1000 - b)], 1000)
    population = problem.first(8, rng)
    assert len(problem.evolve(population, 8, 40, rng)[0]) <= len(population[0])
    assert problem.least == 60
