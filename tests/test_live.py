"""Live agreement with bounded state: outcomes sent again, late ones, restarts from the checkpoint."""

import json
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from judgespark.plans import live as plans_live
from judgespark.schema import OUTCOME
from judgespark.streaming import live

START = datetime(2024, 1, 1)


@pytest.fixture
def feed(spark, tmp_path):
    """Sends ``(outcome_index, record, score, minute)`` as one file and runs the stream over what is new."""
    labels = [(i, f"r{i}", 1 + i % 5) for i in range(20)]
    rows = live.prepare_rows(spark.createDataFrame(labels, "row_index long, record_id string, label_relevance int"), str(tmp_path / "rows"))
    schema = "outcome_index long, record_id string, score int, sent_at timestamp"
    (tmp_path / "sent").mkdir()

    def send(*batch, run=True):
        data = [(i, r, s, START + timedelta(minutes=m)) for i, r, s, m in batch]
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "sent"))
        if not run:
            return None
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "sent"))
        result = F.from_json(F.to_json(F.struct("score")), OUTCOME["result"].dataType)
        stream = stream.withColumns({"result": result, "pillar": F.lit("relevance")})
        query = live.start_agreement(
            stream, rows, str(tmp_path / "parts"), str(tmp_path / "checkpoint"), ["relevance"], available_now=True,
            unique_by=("outcome_index",), event_time="sent_at", delay="10 minutes",
        )
        query.awaitTermination()
        ct = live.live_crosstab(spark, str(tmp_path / "parts"))
        state = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
        return {(r.judge, r.human): r.n for r in ct.collect()}, state

    return send


def test_sent_again_late_and_restarted(feed):
    assert feed((1, "r1", 2, 0), (1, "r1", 2, 0), (2, "r2", 3, 1))[0] == {(2, 2): 1, (3, 3): 1}
    # Another session: again, late but within the delay, and for the first time.
    assert feed((1, "r1", 2, 0), (3, "r3", 1, -5), (4, "r4", 5, 5))[0] == {(2, 2): 1, (3, 3): 1, (1, 4): 1, (5, 5): 1}
    # Time moves on; the first ones are forgotten, and what is older than the watermark does not count.
    feed((5, "r5", 1, 60))
    counts, state = feed((6, "r6", 2, 61), (1, "r1", 2, 0), (7, "r7", 3, 3))
    assert counts == {(2, 2): 2, (3, 3): 1, (1, 4): 1, (5, 5): 1, (1, 1): 1}
    counts, state = feed((8, "r8", 4, 120))
    counts, state = feed((9, "r9", 5, 121))
    assert state[-1] <= 3  # not the nine that were sent


def test_same_counts_as_one_batch(feed, spark):
    sent = [(i, f"r{i % 25}", 1 + i * 7 % 5, i) for i in range(60)]
    for at in range(0, 60, 12):
        counts, state = feed(*sent[at : at + 12], *sent[max(0, at - 6) : at])
        assert state[-1] <= 40
    want = {}
    for _, r, s, _ in sent:
        i = int(r[1:])
        if i < 20:
            want[s, 1 + i % 5] = want.get((s, 1 + i % 5), 0) + 1
    assert counts == want


def test_a_batch_that_runs_again_counts_once(feed, tmp_path):
    feed((1, "r1", 2, 0))
    once, _ = feed((2, "r2", 3, 1))
    commits = sorted((tmp_path / "checkpoint" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for old in commits[-1:]:  # as if the driver had died before the commit
        Path(old).unlink()
        (old.parent / f".{old.name}.crc").unlink(missing_ok=True)
    assert feed((2, "r2", 3, 1))[0] == once
    assert json.dumps(sorted(map(list, once))) == "[[2, 2], [3, 3]]"


def test_without_times_state_is_kept(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "outcome_index long, record_id string")
    assert live.unique_outcomes(df, ("outcome_index",)).count() == 2
    assert live.unique_outcomes(df, ()).count() == 3


@pytest.mark.parametrize("name", ["live_agreement_resent", "live_agreement_bounded"])
def test_no_task_writes_more_as_the_table_grows(spark, tmp_path, monkeypatch, name):
    source = "/root/testdata/sf0.001"
    if not Path(source).exists():
        pytest.skip("sample tables not available")
    spark.read.parquet(f"{source}/lineitem.parquet").repartition(6).write.parquet(str(tmp_path / "lineitem.parquet"))
    (tmp_path / "orders.parquet").symlink_to(f"{source}/orders.parquet")
    want = plans_live.live_agreement(spark, source).collect()
    monkeypatch.setattr(plans_live, "shared_folder", lambda _: str(tmp_path / "shared"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")  # a task for each file
    try:
        got = getattr(plans_live, name)(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(list((tmp_path / "shared/sent").glob("part-*"))) >= 4 * 6
    assert len(list((tmp_path / "shared/checkpoint/commits").glob("[0-9]*"))) >= 4
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got)
