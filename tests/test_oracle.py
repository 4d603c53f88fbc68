"""Every registered query against its SQL on the smallest tables."""

import pytest
from oracle import difference, duck

import __spark_entry__ as entry

ORACLES = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def connection(sf_dir):
    return duck(sf_dir)


def test_every_query_has_sql():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLES) <= {n for n in QUERIES if n.startswith("op") or n == "pipeline"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(name, spark, sf_dir, connection):
    assert difference(QUERIES[name](spark, sf_dir), connection, ORACLES[name]) is None


def test_entry_has_rows_and_stable_columns(spark):
    df = entry.entry(spark)
    assert df.columns == ["window_start", "window_end", "rank", "auction_id", "n"]
    assert df.count() > 0
