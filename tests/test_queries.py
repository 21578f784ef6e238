"""Every registered query runs; where SQL exists, both engines agree value for value."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as contract
from tools.check_queries import compare, connect

SLOW = {"m5_fit_forest", "m6_fit_boosting", "m9_baselines", "m9_full_grid", "m9_log_and_kernel_grid"}


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", [n for n in contract.queries() if n in contract.oracle_sql()])
def test_same_as_sql(spark, sf, duck, name):
    got = contract.queries()[name](spark, sf).toPandas()
    want = duck.execute(contract.oracle_sql()[name]).df()
    assert compare(got, want) == ""
    assert len(got) > 0


@pytest.mark.parametrize("name", [n for n in contract.queries() if n not in contract.oracle_sql() and n not in SLOW])
def test_runs(spark, sf, name):
    assert contract.queries()[name](spark, sf).count() > 0


def test_entry(spark):
    assert contract.entry(spark).count() > 0
