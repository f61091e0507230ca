"""Each query beside its SQL on the smallest tables."""

import os

import pytest

from helixloom.plans import reference_queries as R
from helixloom.plans import export_queries, gate_queries, record_queries, rule_queries  # noqa: F401
from verify_queries import canonical, connect

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(R.QUERIES))
def test_same_as_sql(spark, con, name):
    got, want = R.QUERIES[name](spark, SF).toPandas(), con.execute(R.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) and canonical(got) == canonical(want)


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).schema.names
