"""Registered queries against DuckDB on the smallest sample.

A selection runs by default; set JUDGESPARK_ALL_QUERIES=1 for all of them.
"""

import os
from pathlib import Path

import pytest

import __spark_entry__ as entry
from oracle import compare, connect

SF_DIR = os.environ.get("JUDGESPARK_SF_DIR", "/root/testdata/sf0.001")
SELECTED = [
    "j3_join_accounting",
    "a2_agreement_overall",
    "l6_all_dimensions",
    "r4_reviewer_pairs",
    "g1_gate_status",
    "d6_pillar_diagnostics",
    "v10_disagreement_table",
    "i1_normalized_rows",
    "i10_failures",
    "s1_csv",
    "s3_json_array",
    "t2_task_batches",
    "t6_user_prompts",
    "t11_assembled_outcomes",
    "t13_run_summary",
    "u1_scorer_outcomes",
    "k6_kb_match",
    "w1_live_progress",
    "w2_live_agreement",
]
NAMES = sorted(entry.queries()) if os.environ.get("JUDGESPARK_ALL_QUERIES") else SELECTED

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="sample tables not available")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    fn, sql = entry.queries()[name], entry.oracle_sql().get(name)
    if sql is None:
        assert fn(spark, SF_DIR).count() >= 0
    else:
        assert compare(spark, con, fn, sql, SF_DIR) is None


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
