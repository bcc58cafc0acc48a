import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
for p in (str(ROOT), str(ROOT / "tests")):
    if p not in sys.path:
        sys.path.insert(0, p)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def pair_items(spark):
    """Scored items of one pillar from ``(judge, human)`` pairs."""

    def make(pairs, pillar="relevance"):
        rows = [(i, f"r{i}", pillar, j, h) for i, (j, h) in enumerate(pairs)]
        schema = "outcome_index long, record_id string, pillar string, judge_score int, human_score int"
        return spark.createDataFrame(rows, schema)

    return make
