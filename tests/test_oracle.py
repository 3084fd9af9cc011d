"""Every query with SQL gives what DuckDB gives on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from compare import compare, duck

SF = "/root/testdata/sf0.001"
#: Queries that find nothing in the smallest tables.
EMPTY = {"cross_fields_and", "phrase_slop", "author_query_cascade", "accented_name_terms", "p2_search"}
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, entry.queries()[name], entry.oracle_sql()[name], SF) == ("empty" if name in EMPTY else "")


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
