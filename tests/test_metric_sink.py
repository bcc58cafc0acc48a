"""Metric sink: a commit makes a write visible as a whole, attempts replace each other."""

import os

import pytest
from pyspark.sql import functions as F

from judgespark.sources import metric_sink as sink


def metrics(spark, pairs, parts=3):
    return spark.createDataFrame(pairs, "key string, value double").repartition(parts)


def values(df):
    return sorted((r["run_id"], r["section"], r["attempt"], r["key"], r["value"]) for r in df.collect())


def files_below(path):
    return [f for _, _, names in os.walk(path) for f in names if f.endswith(".parquet")]


def test_runs_and_sections_are_kept_apart(spark, tmp_path):
    path = str(tmp_path / "m")
    sink.write_metrics(metrics(spark, [("a", 1.0), ("b", 2.0)]), path, "run 1/x")
    sink.write_metrics(metrics(spark, [("a", 3.0)]), path, "run 1/x", section="slices")
    sink.write_metrics(metrics(spark, [("a", 4.0)]), path, "run2")
    assert values(sink.read_metrics(spark, path)) == [
        ("run 1/x", "metrics", 1, "a", 1.0),
        ("run 1/x", "metrics", 1, "b", 2.0),
        ("run 1/x", "slices", 1, "a", 3.0),
        ("run2", "metrics", 1, "a", 4.0),
    ]
    assert values(sink.read_metrics(spark, path, run_id="run2")) == [("run2", "metrics", 1, "a", 4.0)]
    assert values(sink.read_metrics(spark, path, section="slices")) == [("run 1/x", "slices", 1, "a", 3.0)]


def test_highest_attempt_counts_and_a_repeat_replaces_itself(spark, tmp_path):
    path = str(tmp_path / "m")
    sink.write_metrics(metrics(spark, [("a", 1.0), ("gone", 1.0)]), path, "r", attempt=1)
    sink.write_metrics(metrics(spark, [("a", 2.0)]), path, "r", attempt=10)
    sink.write_metrics(metrics(spark, [("a", 9.0)]), path, "r", attempt=9)  # arrives late
    assert values(sink.read_metrics(spark, path)) == [("r", "metrics", 10, "a", 2.0)]
    sink.write_metrics(metrics(spark, [("a", 2.5)]), path, "r", attempt=10)
    assert values(sink.read_metrics(spark, path)) == [("r", "metrics", 10, "a", 2.5)]


def test_a_failing_partition_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "m")
    sink.write_metrics(metrics(spark, [("a", 1.0)]), path, "r", attempt=1)
    before = files_below(path)
    broken = spark.range(0, 400, 1, 4).select(
        F.concat(F.lit("k"), "id").alias("key"),
        F.when(F.col("id") == 399, F.raise_error(F.lit("lost"))).otherwise(F.col("id").cast("double")).alias("value"),
    )
    with pytest.raises(Exception, match="lost"):
        sink.write_metrics(broken, path, "r", attempt=2)
    assert values(sink.read_metrics(spark, path)) == [("r", "metrics", 1, "a", 1.0)]
    assert files_below(path) == before


def test_rows_without_value_are_refused(spark, tmp_path):
    path = str(tmp_path / "m")
    with pytest.raises(Exception, match="need a key and a value"):
        sink.write_metrics(metrics(spark, [("a", None)]), path, "r")
    with pytest.raises(Exception, match="numbered from 1"):
        sink.write_metrics(metrics(spark, [("a", 1.0)]), path, "r", attempt=0)
    assert values(sink.read_metrics(spark, path)) == []


def test_an_empty_write_is_a_commit_without_rows(spark, tmp_path):
    path = str(tmp_path / "m")
    sink.write_metrics(metrics(spark, [("a", 1.0)]), path, "r", attempt=1)
    sink.write_metrics(metrics(spark, []), path, "r", attempt=2)
    assert values(sink.read_metrics(spark, path)) == []
    assert [m["rows"] for m in sink.manifests(path)] == [0]


def test_more_columns_and_another_order_are_fine(spark, tmp_path):
    path = str(tmp_path / "m")
    extra = spark.createDataFrame([(1.5, "x", "k")], "value double, section string, key string")
    sink.write_metrics(extra, path, "r", section="gates")
    assert values(sink.read_metrics(spark, path)) == [("r", "gates", 1, "k", 1.5)]
