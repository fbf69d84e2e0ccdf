"""Every catalogue key with oracle SQL matches DuckDB on the driver tables
(row count, column names, order-insensitive values)."""

import os

import pytest

import __spark_entry__ as E
from tests.oracle_check import compare, duck

SF = os.environ.get("UPSHELF_TEST_SF", "/root/testdata/sf0.001")
KEYS = sorted(E.oracle_sql())


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("key", KEYS)
def test_matches_oracle(spark, con, key):
    res = compare(spark, key, SF, con, verbose=False)
    assert res["status"] == "ok", res
    assert not res.get("types"), res


def test_every_query_runs_and_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "sales" in df.columns
    for k in ["counterfactual_ridge", "within_campaign_coefs", "campaign_coefs", "top_drivers", "scenario_scores"]:
        assert k in E.queries()
