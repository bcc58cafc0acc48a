import pytest
from pyspark.sql import functions as F

from judgespark.llm.common import scratch
from judgespark.llm.exact_dedup import DigestIndex, ingest
from llm.helpers import DOCS, docs


@pytest.fixture
def index(spark):
    return DigestIndex(spark, scratch(spark), 4).open()


def test_largest_id_stays_null_is_empty_and_case_counts(spark, index):
    got = {r.doc_id: r for r in ingest(index, docs(spark, ["a", "A", "a", None, "", "a "])).collect()}
    assert {i: r.keep_id for i, r in got.items()} == {0: 2, 1: 1, 2: 2, 3: 4, 4: 4, 5: 5}
    assert [i for i, r in sorted(got.items()) if r.kept] == [1, 2, 4, 5]
    assert got[0].group_size == 2


def test_second_batch_meets_the_first(spark, index):
    ingest(index, docs(spark, {5: "x", 6: "y"})).count()
    again = DigestIndex(spark, index.path, 4).open()
    got = {r.doc_id: r for r in ingest(again, docs(spark, {1: "x", 9: "z", 10: "z"})).collect()}
    assert (got[1].keep_id, got[1].kept, got[1].known) == (5, False, True)
    assert (got[9].kept, got[10].kept) == (False, True)
    assert again.rows().count() == 3


def test_index_is_not_shuffled_in_the_anti_join(spark, index):
    new = spark.createDataFrame([(bytearray(b"x"), 1)], "digest binary, keep_id long")
    plan = new.join(index.rows().hint("merge"), "digest", "left_anti")._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and plan.split("== Physical Plan ==")[1].count("Exchange") == 1


def test_repeated_rows_null_ids_and_empty_table(spark, index):
    rows = [(1, "a", None, None, None), (1, "a", None, None, None), (None, "b", None, None, None), (3, "b", None, None, None)]
    df = spark.createDataFrame(rows, DOCS).withColumn("digest", F.lit(1)).withColumn("kept", F.lit("x"))
    got = ingest(index, df).collect()
    assert sum(r.kept for r in got if r.doc_id == 1) == 1 and {r.keep_id for r in got} == {1, 3}
    assert ingest(index, spark.createDataFrame([], DOCS)).count() == 0


def test_hot_digest(spark, index):
    got = ingest(index, docs(spark, ["same"] * 3000 + [str(i) for i in range(500)]))
    assert got.where("kept").count() == 501
    assert got.where("group_size = 3000").select("keep_id").distinct().collect()[0][0] == 2999
