import pytest
from pyspark.sql import functions as F

from judgespark.operators.ingest import dataset_fingerprint
from judgespark.plans.scratch import shared_folder
from judgespark.schema import REQUIRED_FIELDS
from judgespark.sources.fingerprint_store import FingerprintStore


def rows_of(spark, start, end):
    """Rows with gaps between positions, repeated positions and null cells."""
    position = (F.col("id") * 3 - F.col("id") % 2 * 3).alias("row_index")
    cells = [F.when(F.col("id") % 5 != i % 5, F.concat(F.lit(f"{c} "), "id")).alias(c) for i, c in enumerate(REQUIRED_FIELDS)]
    return spark.range(start, end).select(position, *cells)


def shown(df):
    return [r.dataset_fingerprint for r in df.collect()]


@pytest.mark.parametrize("cuts", [[0, 0], [0, 2], [0, 4, 8, 16], [0, 10, 10, 64], [0, 64, 66], [0, 62, 130]])
def test_batches_equal_a_fingerprint_from_scratch(spark, cuts):
    store = FingerprintStore(spark, shared_folder(spark), fanout=4)
    for batch, (start, end) in enumerate(zip(cuts, cuts[1:]), 1):
        store.append(rows_of(spark, start, end), batch)
        assert shown(store.fingerprint()) == shown(dataset_fingerprint(rows_of(spark, 0, end), fanout=4))
        assert store.rows() == end


def test_the_latest_batch_may_be_sent_again(spark):
    store = FingerprintStore(spark, shared_folder(spark), fanout=4)
    store.append(rows_of(spark, 0, 10), 1)
    store.append(rows_of(spark, 10, 18), 2)
    once = shown(store.fingerprint())
    store.append(rows_of(spark, 10, 18), 2)
    assert shown(store.fingerprint()) == once and store.rows() == 18
    store.append(rows_of(spark, 10, 30), 2)
    assert shown(store.fingerprint()) == shown(dataset_fingerprint(rows_of(spark, 0, 30), fanout=4))
    for batch in (0, 1, 4):
        with pytest.raises(ValueError):
            store.append(rows_of(spark, 0, 1), batch)


def test_a_batch_without_its_mark_does_not_count(spark):
    path = shared_folder(spark)
    store = FingerprintStore(spark, path, fanout=4)
    store.append(rows_of(spark, 0, 10), 1)
    spark.range(3).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{path}/batch-2")
    assert store.latest() == 1 and store.rows() == 10
    store.append(rows_of(spark, 10, 12), 2)
    assert shown(store.fingerprint()) == shown(dataset_fingerprint(rows_of(spark, 0, 12), fanout=4))


def test_what_is_kept_does_not_grow_with_the_rows(spark):
    store = FingerprintStore(spark, shared_folder(spark), fanout=4)
    store.append(rows_of(spark, 0, 998), 1)
    held = {r.level: r["count"] for r in store._state(1).groupBy("level").count().collect()}
    assert held.pop(-1) == 1 and max(held.values()) < 4 and max(held) < 5
