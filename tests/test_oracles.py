"""Every query that has SQL gives the same rows as DuckDB; the others give rows."""

import pytest

from scribewell.plans import rules, table_queries
from tests.oracle import SF_DIR, difference

QUERIES = rules.queries() | table_queries.queries()
SQL = rules.oracle_sql() | table_queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_duckdb(spark, name):
    assert difference(spark, QUERIES[name], SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_has_rows(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)
