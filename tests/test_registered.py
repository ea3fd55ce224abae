"""Every registered query against its SQL, on the smallest tables that exercise it."""

import pytest

import __spark_entry__ as entry
from tests.compare import differences, duck

SF = "/root/testdata/sf0.001"
QUERIES = entry.queries()
SQL = entry.oracle_sql()
# The smallest tables have fewer items than the large k, and never reach the prefix length.
LARGER = dict.fromkeys(("phi_k_large", "prefix_until_t", "stream_prefix_report"), "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def connections():
    return {sf: duck(sf) for sf in (SF, *LARGER.values())}


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, connections, name):
    sf = LARGER.get(name, SF)
    found = QUERIES[name](spark, sf).toPandas()
    assert differences(found, connections[sf].sql(SQL[name]).df()) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows_only(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_fewer_items_than_k_has_no_phi(spark):
    assert QUERIES["phi_k_large"](spark, SF).collect()[0]["phi"] is None


def test_entry(spark):
    assert entry.entry(spark).count() == 1
