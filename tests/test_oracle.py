import pytest
from compare import duck, rows_of, sql_rows

from vahini.queries import analytics, landing, lifecycle, listing, operators, problems, streams, texts

MODULES = (analytics, operators, listing, texts, landing, lifecycle, problems, streams)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in MODULES for k, v in m.ORACLE_SQL.items()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, small, name):
    assert rows_of(QUERIES[name](spark, small)) == sql_rows(duck(small), SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() >= 0
