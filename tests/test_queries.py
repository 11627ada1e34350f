"""Every query of the engine's own operators against its SQL, and the entry."""

import pytest

import __spark_entry__ as entry
from shelfmark.plans import queries as own
from tests.compare import rows, sql_rows

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(own.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    assert rows(own.queries()[name](spark, DIR)) == sql_rows(own.oracle_sql()[name], DIR)


def test_entry_and_registry(spark):
    assert entry.entry(spark).columns == ["name", "n"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
