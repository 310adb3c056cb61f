"""Every registered query against its SQL."""

import pytest

import __spark_entry__ as entry
from catalog import all_queries
from compare import connect, differences

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def database():
    return connect(SMALL)


# Queries of the subpackage for training data that SQL cannot express are tested beside it.
@pytest.mark.parametrize("name", sorted({*all_queries(), *entry.oracle_sql()}))
def test_query(spark, database, name):
    frame = entry.queries()[name](spark, SMALL)
    assert frame.count() > 0
    if name in entry.oracle_sql():
        assert differences(frame, database, entry.oracle_sql()[name]) == ""


def test_entry(spark):
    assert entry.entry(spark).count() > 0
