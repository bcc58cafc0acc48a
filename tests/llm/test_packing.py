import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from judgespark.llm import packing
from judgespark.llm.queries import word_bpe
from llm.helpers import DOCS, docs, sample_texts


def check(rows, texts, repeats=1):
    """Every id in one piece, checksums right, windows gapless, full or at a power of two."""
    tokenizer = Tokenizer.from_file(word_bpe())
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        windows[r.sequence_id].append(r)
    for i, text in texts.items():
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        own = sorted(pieces[i], key=lambda r: r.start)
        assert sum(r.length for r in own) == len(ids) * repeats
        covered = defaultdict(int)
        for r in own:
            assert r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
            for p in range(r.start, r.start + r.length):
                covered[p] += 1
        assert set(covered.values()) == {repeats}
    for own in windows.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 2048 and at & (at - 1) == 0 and own[0].tier == at


def test_sample(spark):
    texts = sample_texts()
    check(packing.pack(docs(spark, texts).repartition(3), word_bpe()).collect(), texts)


def test_edges(spark):
    texts = dict(enumerate([None, "", " \n", "a b c", "<|endoftext|> x<|endoftext|>y", "é ́x \x1cq\x1f", "Ω ΑΣ Σ 's't", "word " * 30_000, "x" * 5000]))
    check(packing.pack(docs(spark, texts), word_bpe()).collect(), texts)


def test_repeated_rows_nulls_and_empty_table(spark):
    rows = [(1, "a b c", None, None, None)] * 2
    df = spark.createDataFrame(rows, DOCS).withColumn("sequence_id", F.lit("x"))
    check(packing.pack(df, word_bpe()).collect(), {1: "a b c"}, repeats=2)
    assert packing.pack(spark.createDataFrame([(None, None, None, None, None)], DOCS), word_bpe()).count() == 1
    assert packing.pack(spark.createDataFrame([], DOCS), word_bpe()).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 2047), max_size=40))
def test_blocks_lose_nothing(lengths):
    tails = [(n, i, 0) for i, n in enumerate(lengths)]
    windows, rest = packing.pack_block(tails, packing.TIERS, False)
    assert all(sum(p[2] for p in pieces) == size for size, pieces in windows)
    more, none = packing.pack_block(rest, packing.TIERS, True)
    assert not none and sum(s for s, _ in windows + more) == sum(lengths)


def test_groups_are_even():
    sizes = [2048] * 20 + [512] * 13 + [256] * 7
    groups = packing.step_groups(sizes, 8)
    loads = [sum(s for s, g in zip(sizes, groups) if g == k) for k in range(8)]
    assert max(loads) - min(loads) <= 512
