"""Every registered query against its check query."""

import pytest

import __spark_entry__ as entry
from fixhound.catalog.checks import CHECKS
from fixhound.catalog.queries import QUERIES
from tests.compare import SF_DIR, check_rows, open_tables, spark_rows


@pytest.fixture(scope="module")
def tables():
    return open_tables()


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_check(spark, tables, name):
    names, rows = spark_rows(entry.queries()[name](spark, SF_DIR))
    expected_names, expected = check_rows(tables, entry.oracle_sql()[name])
    assert names == expected_names
    assert rows == expected, (len(rows), len(expected))


def test_every_query_has_a_check():
    # MinHash bands hang on Spark's hash; they are compared with the exact classes in test_classes
    assert set(QUERIES) - set(CHECKS) == {"similar_classes_lsh"} and set(CHECKS) <= set(QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
