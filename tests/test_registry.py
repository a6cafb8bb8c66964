"""The registered queries: contract and a sample against SQL at the smallest scale."""

import os

import pytest

import __spark_entry__ as contract
from checks.compare import differences, oracle

FOLDER = "/root/testdata/sf0.001"
SAMPLE = (
    "rules_only_findings",
    "blocking_capped",
    "explanation_tests",
    "replayed_verdicts",
    "decisions_intake",
    "new_candidates",
)
needs_data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


def test_every_sql_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert len(contract.queries()) > 50


@needs_data
@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, name):
    assert differences(spark, oracle(FOLDER), name, FOLDER) == ""


@needs_data
def test_entry(spark):
    assert contract.entry(spark).columns[0] == "candidate_id"


@needs_data
@pytest.mark.parametrize("name", ["blocking_work_whole", "blocking_hot_third"])
def test_complete_comparison_matches_sql(spark, name):
    assert differences(spark, oracle(FOLDER), name, FOLDER) == ""
