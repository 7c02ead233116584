"""Every bound query against its SQL twin on the smallest tables."""

import pytest
from harness import compare, connect

from coppice.plans import catalog

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_agrees_with_sql(spark, con, name):
    rows, problems = compare(spark, con, catalog.queries()[name], catalog.oracle_sql()[name], SF_DIR)
    assert not problems


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs_without_sql(spark, name):
    assert catalog.queries()[name](spark, SF_DIR).count() > 0


def test_entry(spark):
    import __spark_entry__ as driver
    assert driver.entry(spark).limit(1).count() == 1
    assert set(driver.oracle_sql()) <= set(driver.queries())
