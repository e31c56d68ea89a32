import pytest

import __spark_entry__ as entry
from stratafill.analogues.queries import QUERIES
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
ORACLES = {k: v for k, v in entry.oracle_sql().items() if k in QUERIES}
# sf0.001 has none of these
EMPTY = set()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_agrees_with_sql(spark, con, name):
    found = compare(spark, con, name, entry.queries()[name], ORACLES[name], FOLDER)
    assert found == ("no rows" if name in EMPTY else None)


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
