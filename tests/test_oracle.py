"""Registered queries against their DuckDB twins at sf0.001."""

import pytest

from oracle_harness import compare, duck
from sievekit.plans.catalog import ORACLE

SF = "/root/testdata/sf0.001"
#: 200 boosting rounds each: run with tests/oracle_harness.py instead.
SLOW = {"train_eval_gradient_boosting", "train_eval_xgboost_gbt"}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(n for n in ORACLE if n not in SLOW))
def test_query_matches_duckdb(spark, con, name):
    r = compare(spark, SF, name, con)
    assert r["status"] == "match", r
