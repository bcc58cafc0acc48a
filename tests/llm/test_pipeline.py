from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from judgespark.llm.common import stored
from llm.helpers import DOCS, SF_DIR, docs
from llm.test_mixing import brute_targets
from llm.test_near_dedup import brute as brute_near
from llm.test_packing import check as check_pieces


@pytest.fixture(scope="module")
def stages(spark):
    """The rows each stage gets and gives."""
    docs, out = spark.read.parquet(f"{SF_DIR}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        given = stored(stage(spark, docs, SF_DIR))
        out.append((name, docs, given))
        docs = given
    return out


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_all_but_the_last_return_documents(stages):
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns and after.dtypes == before.dtypes


def test_quality_rejects_junk_and_keeps_clean(stages):
    _, before, after = stages[0]
    kept = {r["doc_id"] for r in rows(after)}
    assert kept <= {r["doc_id"] for r in rows(before)}
    table = pq.read_table(f"{SF_DIR}/labels.parquet").to_pydict()
    by_label = defaultdict(list)
    for i, q in zip(table["doc_id"], table["quality"]):
        by_label[q].append(i in kept)
    assert sum(by_label[1]) >= 0.99 * len(by_label[1]) and sum(by_label[0]) <= 0.3 * len(by_label[0])


def test_exact_keeps_the_last_of_equal_texts(stages):
    _, before, after = stages[1]
    last = {}
    for r in rows(before):
        last[r["text"]] = max(last.get(r["text"], -1), r["doc_id"])
    assert {r["doc_id"]: r["text"] for r in rows(after)} == {i: t for t, i in last.items()}


def test_near_keeps_the_first_of_each_group(stages):
    _, before, after = stages[2]
    groups = brute_near({r["doc_id"]: r["text"] for r in rows(before)}, percent=corpus_pipeline.NEAR_PERCENT)
    assert sorted(r["doc_id"] for r in rows(after)) == sorted(i for i, (_, c) in groups.items() if i == c)


def test_near_links_from_a_similarity_of_080(spark):
    """Pairs of about 0.80 to 0.85, which the stage must link, and of 0.77, which it must not."""
    texts = {}
    for n, words in enumerate((50, 52, 54, 56, 46, 44)):  # an end of five new words: words - 9 shared of words + 1
        base = [f"p{n}w{i}" for i in range(words)]
        texts[2 * n], texts[2 * n + 1] = " ".join(base), " ".join(base[:-5] + [f"p{n}n{i}" for i in range(5)])
    texts |= {100 + i: " ".join(f"q{i}w{j}" for j in range(40)) for i in range(3)}
    groups = brute_near(texts, percent=80)
    kept = corpus_pipeline._unlike(spark, stored(docs(spark, texts)), SF_DIR)
    want = sorted(i for i, (_, c) in groups.items() if i == c)
    assert sorted(r.doc_id for r in kept.collect()) == want
    assert len(want) < len(texts) and want != sorted(i for i, (_, c) in brute_near(texts).items() if i == c)


def test_mixing_meets_the_targets(stages):
    _, before, after = stages[3]
    size = lambda t: len((t or "").encode().split())
    words, taken = Counter(), Counter()
    for r in rows(before):
        words[r["source"]] += size(r["text"])
    for r in rows(after):
        taken[r["source"]] += size(r["text"])
    for s, target in brute_targets(words).items():
        assert abs(taken[s] - target) <= 0.51


def test_packing_keeps_every_token(stages):
    _, before, after = stages[4]
    # Copies of a document are told apart by their texts' lengths only; whole documents once are checked in full.
    count = Counter(r["doc_id"] for r in rows(before))
    assert sum(r.length for r in after.collect()) > 0
    got = Counter()
    for r in after.collect():
        got[r.doc_id] += r.length
    once = {r["doc_id"]: r["text"] for r in rows(before) if count[r["doc_id"]] == 1}
    pieces = [r for r in after.collect() if r.doc_id in once]
    tokens = {r.doc_id: r.doc_tokens for r in pieces}
    assert all(got[i] == tokens[i] for i in once)


def test_pieces_of_stage_without_copies(spark, stages):
    _, before, _ = stages[3]
    texts = {r["doc_id"]: r["text"] for r in rows(before)}
    check_pieces(corpus_pipeline._packed(spark, before, SF_DIR).collect(), texts)


def test_run_equals_the_stages(spark, stages):
    last = stages[-1][2]
    again = corpus_pipeline.run(spark, SF_DIR)
    key = lambda df: sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert len(key(again)) == pytest.approx(len(key(last)), rel=0.05)
    assert sum(r.length for r in again.collect()) == sum(r.length for r in last.collect())


def test_empty_table(spark):
    docs = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF_DIR))
        assert docs.count() == 0
