"""Every registered query with SQL gives the rows that DuckDB gives."""

import pytest

import __spark_entry__ as entry
from heatloom.plans.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(matches_sql, name):
    matches_sql(QUERIES[name], ORACLE_SQL[name])


def test_names_and_entry(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
