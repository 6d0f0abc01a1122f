"""Every registered query against its SQL, on the smallest tables; DuckDB is the independent reading."""

import pytest

from quire.plans.compare import mismatch
from quire.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
#: Queries that find nothing in the smallest tables are compared on the next size.
LARGER = {"kept_dependents"}


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", QUERIES)
def test_equals_sql(spark, name):
    sf = SF.replace("0.001", "0.01") if name in LARGER else SF
    assert mismatch(QUERIES[name](spark, sf), SQL[name], sf) is None


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
